"""Secret scans: fixed patterns and character Markov models, in DataFrame operations only.

Patterns find assignments, access keys and long hexadecimal strings. Beyond
them, strings of ``CANDIDATE`` form are judged by two first-order Markov models
of characters, one of random strings and one of ordinary identifiers, trained
from labelled samples: a string is a secret if its log-likelihood ratio per
transition, in thousandths, is ``THRESHOLD`` or more and it holds a digit.

Positions are code points. The pieces that ``split`` leaves between the matches
of a pattern give the matches' places, so the JVM's regular expressions do all
scanning; texts without a possible match are passed over by a cheaper test.

On Spark: one narrow stage over the texts; the models are a matrix of
``len(ALPHABET) + 1`` squared integers, built by one small aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

# The patterns of the base kinds, in the order in which kinds at the same place stand.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The two in the form that only finds matches of 20 and 24 characters or more. Runs are taken whole, and an access key
# that fails leaves too little of its run for another, so the spans are the same.
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
LONG_HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 400
#: Matches whose places are summed together.
BLOCK = 256
#: Labelled strings of either kind that the models are trained on at most.
MOST_SAMPLES = 20_000


def _blocks(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` elements."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i * size + 1, size))


def _matches(text: Column, pattern: str, group: int, probe: Column, keep) -> Column:
    """(at, size, value): place, length and group of the matches from left to
    right that ``keep`` accepts; none where the probe fails.

    Places are running sums, taken in blocks of ``BLOCK`` matches and then over
    the blocks, so that no long array is copied match by match.
    """
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    if group:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pairs = F.zip_with(whole, part, lambda w, v: F.struct(F.length(w).alias("size"), v.alias("value")))
    else:
        pairs = F.transform(whole, lambda w: F.struct(F.length(w).alias("size"), w.alias("value")))
    rows = F.zip_with(pairs, gaps, lambda m, g: F.struct(m["size"].alias("size"), F.length(g).alias("gap"), m["value"].alias("value")))
    none = F.array().cast("array<struct<at:int,size:int,value:string>>")

    def step(a: Column, m: Column) -> Column:
        found = F.struct((a["end"] + m["gap"]).alias("at"), m["size"].alias("size"), m["value"].alias("value"))
        return F.struct((a["end"] + m["gap"] + m["size"]).alias("end"), F.when(keep(found), F.concat(a["found"], F.array(found))).otherwise(a["found"]).alias("found"))

    inner = F.transform(_blocks(F.filter(rows, lambda m: m["size"].isNotNull()), BLOCK), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("end"), none.alias("found")), step))
    shifted = lambda a, b: F.transform(b["found"], lambda m: F.struct((m["at"] + a["end"]).alias("at"), m["size"].alias("size"), m["value"].alias("value")))
    outer = F.aggregate(inner, F.struct(F.lit(0).alias("end"), F.array().cast("array<array<struct<at:int,size:int,value:string>>>").alias("found")), lambda a, b: F.struct((a["end"] + b["end"]).alias("end"), F.concat(a["found"], F.array(shifted(a, b))).alias("found")), lambda a: F.flatten(a["found"]))
    return F.when(probe, outer).otherwise(none)


def _codes(value: Column) -> Column:
    """Place of each character in ALPHABET; others share the place behind it."""
    n = len(ALPHABET)
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)) - 1, F.lit(n)))


def train(samples: DataFrame) -> list[int]:
    """Log ratio of the two models for each pair of characters, in thousandths.

    ``samples``: value string, is_random boolean. Rows with a null take no
    part; counts start at one half, so an empty sample gives an even model.
    """
    n = len(ALPHABET) + 1
    coded = samples.filter(F.col("value").isNotNull() & F.col("is_random").isNotNull() & (F.length("value") > 1)).select("is_random", _codes(F.col("value")).alias("c"))
    pairs = coded.select("is_random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: a * n + b)).alias("pair")).filter(F.col("pair").isNotNull())
    counts = {(r["is_random"], r["pair"]): r["n"] for r in pairs.groupBy("is_random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 n^2 rows at most
    out = []
    for a in range(n):
        total = [sum(counts.get((k, a * n + b), 0) for b in range(n)) + n / 2 for k in (False, True)]
        out += [round(1000 * (math.log((counts.get((True, a * n + b), 0) + 0.5) / total[1]) - math.log((counts.get((False, a * n + b), 0) + 0.5) / total[0]))) for b in range(n)]
    return out


def labelled_samples(docs: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """Random strings and ordinary identifiers, ``most`` of either kind.

    Random: digests of numbers in hexadecimal and base-64 form. Ordinary: all
    words of ``most / 100`` documents, those with the lowest hashes of id and
    text, joined in twos by the signs that names use; of these the strings with
    the lowest hashes. Both choices depend on the rows alone, so reruns agree.
    """
    ids = docs.sparkSession.range(0, most, 1, 4)
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = ids.select(F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).otherwise(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), 1, 40)).alias("value"), F.lit(True).alias("is_random"))
    some = docs.filter(F.col("text").isNotNull()).select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("place"), "text").orderBy("place").limit(max(1, most // 100))
    word = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))
    some = some.select(word.alias("word"))
    joined = F.transform("word", lambda w, i: F.concat(w, F.element_at(F.array(*map(F.lit, ("_", "-", "/", ""))), i % 4 + 1), F.coalesce(F.get("word", i + 1), w)))
    named = some.select(F.explode(joined).alias("value"), F.lit(False).alias("is_random")).distinct().orderBy(F.xxhash64("value"), "value").limit(most)
    return made.unionByName(named)


def find_secrets(docs: DataFrame, model: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_spans, spans: one row
    for each row of ``docs``, spans as arrays of (kind, begin, end).

    A null text counts as empty. Assignments that fail their length still cover
    what they matched. A Markov span that meets a base span is not repeated.
    Ids may be null or repeat, rows are scanned one by one; an empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(rows, model, threshold)


def _with_spans(rows: DataFrame, model: list[int], threshold: int) -> DataFrame:
    n, kept = len(ALPHABET) + 1, [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))

    def span(k: int):
        return lambda m: F.struct(m["at"].alias("begin"), F.lit(k).alias("k"), (m["at"] + m["size"]).alias("end"))

    t = F.col("text")
    rows = rows.select(
        *kept,
        _matches(t, ASSIGN, 2, t.rlike(ASSIGN), lambda m: F.length(m["value"]) >= 6).alias("assign"),
        _matches(t, LONG_ACCESS, 0, F.contains(t, F.lit("AKIA")), lambda m: F.lit(True)).alias("access"),
        _matches(t, LONG_HEX, 0, t.rlike(r"[0-9a-f]{24}"), lambda m: F.lit(True)).alias("hex"),
        _matches(t, CANDIDATE, 0, t.rlike(CANDIDATE), lambda m: m["value"].rlike("[0-9]")).alias("other"),
    )
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")

    def ratio(value: Column) -> Column:
        c = _codes(value)
        total = F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: F.get(table, a * n + b)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
        return total / F.greatest(F.size(c) - 1, F.lit(1))

    base = F.concat(*[F.transform(kind, span(k)) for k, kind in enumerate(KINDS[:3])])
    rows = rows.select(*kept, *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]], F.array_sort(base).alias("base_spans"), "other")
    apart = lambda m: ~F.exists("base_spans", lambda s: (s["begin"] < m["at"] + m["size"]) & (m["at"] < s["end"]))
    more = F.when(F.size("other") > 0, F.transform(F.filter("other", lambda m: apart(m) & (ratio(m["value"]) >= threshold)), span(3))).otherwise(F.slice("base_spans", 1, 0))
    return rows.withColumn("more", more).select(*kept, "n_assign", "n_access", "n_hex", F.size("more").cast("long").alias("n_markov"), "base_spans", F.array_sort(F.concat("base_spans", "more")).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:begin:end by begin, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def trained_on(docs: DataFrame, most: int = MOST_SAMPLES) -> list[int]:
    return train(written(labelled_samples(docs, most), "secrets-samples"))


def without_secrets(docs: DataFrame, model: list[int], threshold: int = THRESHOLD, sign: str = "<SECRET>") -> DataFrame:
    """``docs`` with ``sign`` for every stretch of secrets in ``text`` and, where
    there is one, ``n_chars`` set anew; null texts and clean rows stay."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _with_spans(rows, model, threshold)
    t = F.coalesce(F.col("row.text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["begin"] >= a["at"], F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, s["begin"] - a["at"]), F.lit(sign)))).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))),
    )
    rows = rows.select("row", F.when(F.col("row.text").isNotNull() & (F.size("spans") > 0), clean).otherwise(F.col("row.text")).alias("text"))
    kept = {"text": F.col("text"), "n_chars": F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in columns else None}
    return rows.select(*[(kept[c] if c in kept else F.col(f"row.{c}")).alias(c) for c in columns])

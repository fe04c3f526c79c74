"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask picks four of five or six consecutive words and ignores the others, so a
seed survives substituted words at ignored places. Documents and benchmark items
are hashed at every word, and the masks together miss nothing: whichever words
of a ``WINDOW`` differ, if ``NEEDED`` are equal (in whole items of ten to twelve
words: three quarters) some mask at some place has only equal ones.
Seeds are joined by hash, and a seed may be a stock phrase. So the join looks
around: each side packs a byte of every word near the seed, seven to a number,
and a pair holds only if as many bytes are equal as a window must have equal words:
all windows that hold the seed lie within what is packed.
What is left names a diagonal (place in the document minus place in the item),
and along it the words themselves are compared: an overlap counts if some
``WINDOW`` words of the item have at least ``NEEDED`` equal to the document's,
wherever the others lie.

On Spark: seeds of documents are produced and probed in one stage against the
benchmark's, which are broadcast only if they are few; else Spark joins them by
a shuffle of hashes and packed bytes without texts. A phrase that many documents
and items share costs comparisons of a few numbers within the join, but no
rows. Only hit documents are read again for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, written

MASKS = ("11101", "100111")
#: Words that an item has at least.
LEAST_WORDS = 10
STRIDE = 1
WINDOW = 13
NEEDED = 10
#: Words are runs of letters and digits, in lower case.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words of a text; null: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _seeds(masks: tuple[str, ...], stride: int) -> Column:
    """Hashes for each mask at every stride-th place of the array h; mask by mask."""
    h = F.col("h")

    def one(m: int, mask: str) -> Column:
        starts = F.when(F.size(h) >= len(mask), F.sequence(F.lit(0), F.size(h) - len(mask), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(m), *[F.get(h, i + j) for j, c in enumerate(mask) if c == "1"]))

    return F.concat(*[one(m, mask) for m, mask in enumerate(masks)])


def _place(masks: tuple[str, ...], stride: int) -> Column:
    """First word of the seed at ``pos`` in the array of all masks over ``n`` words."""
    sizes = [f"(CASE WHEN n >= {len(mask)} THEN (n - {len(mask)}) div {stride} + 1 ELSE 0 END)" for mask in masks]
    before = [" + ".join(["0", *sizes[:m]]) for m in range(len(masks) + 1)]
    cases = " ".join(f"WHEN pos < {before[m + 1]} THEN pos - ({before[m]})" for m in range(len(masks)))
    return F.expr(f"CAST((CASE {cases} END) * {stride} AS INT)")


#: Bytes of one packed number: the eighth stays free, so that no sum of bytes leaves its number.
PACKED = 7
_LOW, _HIGH = int("7f" * PACKED, 16), int("80" * PACKED, 16)


def _packed(place: Column, before: int, size: int, outside: int) -> list[Column]:
    """A byte, 1 to 254, for each of ``size`` words of the array h from ``before``
    words before the place on, ``outside`` beyond its ends; ``PACKED`` to a number.
    No lambda: this is compiled code, and runs only where a seed is met."""
    out = []
    for first in range(0, size, PACKED):
        whole = F.lit(0).cast("long")
        for j in range(min(PACKED, size - first)):
            byte = F.coalesce(F.pmod(F.get("h", place - before + first + j), F.lit(254)) + 1, F.lit(outside).cast("long"))
            whole = whole.bitwiseOR(F.shiftleft(byte, 8 * j))
        out.append(whole)
    return out


def _equal_around(ours: list[Column], theirs: list[Column]) -> Column:
    """How many packed bytes are equal; outside bytes of two sides must differ."""
    counts = []
    for a, b in zip(ours, theirs, strict=True):
        x = a.bitwiseXOR(b)
        # a byte's high bit stays unset only where all its bits are
        counts.append(F.bit_count(F.bitwise_not((x.bitwiseAND(_LOW) + F.lit(_LOW)).bitwiseOR(x)).bitwiseAND(_HIGH)))
    return sum(counts[1:], counts[0])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, stride: int = STRIDE, window: int = WINDOW, needed: int = NEEDED) -> DataFrame:
    """doc_id, item_id, n_matched and n_words: one row for each document and
    benchmark item that overlap, with the most equal words on one diagonal and
    the item's length.

    Null or empty texts overlap with nothing, and so do items of fewer than
    ``LEAST_WORDS`` words; in items shorter than ``window`` the whole item is the
    window and three quarters of it are needed. Rows without a doc_id or
    item_id take no part. Rows that repeat an id are compared one by one and
    reported once. Empty tables give no rows.
    """
    hashed = lambda text: F.transform(words(text), lambda w: F.xxhash64(w))
    items = written(benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), hashed(F.col("text")).alias("h")).filter(F.size("h") >= LEAST_WORDS), "decontaminate-items")
    before = window - min(map(len, masks))
    size = before + window
    names = [f"around_{k}" for k in range(-(-size // PACKED))]
    around = lambda place, outside: [c.alias(n) for c, n in zip(_packed(place, before, size, outside), names, strict=True)]
    need = lambda n: F.when(n >= window, F.lit(needed)).otherwise(F.ceil(n * 3 / 4)).cast("int")

    of_items = items.select("item_id", "h", F.size("h").alias("n"), F.posexplode(_seeds(masks, 1)).alias("pos", "seed")).withColumn("item_at", _place(masks, 1))
    of_items = of_items.select("item_id", "seed", "item_at", need(F.col("n")).alias("need"), *[c.alias(f"item_{c_name}") for c, c_name in zip(_packed(F.col("item_at"), before, size, 255), names, strict=True)])
    of_items = small(written(of_items.distinct(), "decontaminate-seeds"))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # seeds are a column of their own before they become rows, so that rows, packed bytes and join are one compiled loop;
    # outer, since else a filter on their number is inferred, which hashes all words again for each of them
    of_docs = rows.select("doc_id", hashed(F.col("text")).alias("h")).select("doc_id", "h", F.size("h").alias("n"), _seeds(masks, stride).alias("seeds"))
    of_docs = of_docs.select("doc_id", "h", "n", F.posexplode_outer("seeds").alias("pos", "seed")).withColumn("at", _place(masks, stride))
    of_docs = of_docs.select("doc_id", "seed", "at", *around(F.col("at"), 0))
    met = (of_docs["seed"] == of_items["seed"]) & (_equal_around([of_docs[c] for c in names], [of_items[f"item_{c}"] for c in names]) >= of_items["need"])
    hits = of_docs.join(of_items, met).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = written(hits, "decontaminate-hits").groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals"))
    hits = small(written(hits, "decontaminate-pairs"), values=F.size("diagonals"))
    near = rows.join(hits, "doc_id").select("doc_id", "item_id", "diagonals", hashed(F.col("text")).alias("d"))
    near = near.join(small(items, values=F.size("h")), "item_id").withColumn("diagonal", F.explode("diagonals"))
    same = F.transform("h", lambda w, j: F.when(F.get("d", F.col("diagonal") + j) == w, 1).otherwise(0))
    near = near.select("doc_id", "item_id", F.size("h").alias("n_words"), same.alias("same"))
    wide = F.least(F.lit(window), F.col("n_words"))
    # equal words of the window that ends at each word of the item: one comes in, one goes out
    ends = F.sequence(F.lit(0), F.col("n_words") - 1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, j: Column) -> Column:
        now = a["now"] + F.get("same", j) - F.coalesce(F.get("same", j - wide), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    most = F.aggregate(ends, start, step, lambda a: a["most"])
    total = F.aggregate("same", F.lit(0), lambda x, y: x + y)
    return near.filter(most >= need(F.col("n_words"))).groupBy("doc_id", "item_id").agg(F.max(total).cast("long").alias("n_matched"), F.max("n_words").cast("long").alias("n_words"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that overlap with no item; rows without a doc_id stay."""
    leaks = small(written(find_overlaps(docs, benchmark, **how).select(F.col("doc_id").alias("leak_id")).distinct(), "decontaminate-leaks"))
    return docs.join(leaks, docs["doc_id"] == leaks["leak_id"], "left_anti")


# Independent of the masks: a window of the rule always holds three equal words in a row, as at most three of 13
# (two of 10 and 11, three of 12) differ, so every overlap lies on a diagonal of a common run of three words.
ORACLE_SQL = r"""
WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
      FROM documents WHERE doc_id IS NOT NULL),
ip AS (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS p FROM i WHERE len(w) >= 10),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
iruns AS (SELECT item_id, p, w[p:p + 2] AS run FROM ip),
druns AS (SELECT doc_id, p, w[p:p + 2] AS run FROM dp),
hits AS (SELECT DISTINCT doc_id, item_id, druns.p - iruns.p AS diagonal FROM druns JOIN iruns USING (run)),
same AS (SELECT doc_id, item_id, diagonal, len(i.w) AS n_words,
                list_transform(range(1, len(i.w) + 1), lambda j: CASE WHEN diagonal + j >= 1 AND d.w[diagonal + j] = i.w[j] THEN 1 ELSE 0 END) AS same
         FROM hits JOIN d USING (doc_id) JOIN i USING (item_id)),
ok AS (SELECT *, len(list_filter(range(1, n_words - least(13, n_words) + 2),
              lambda p: list_sum(same[p:p + least(13, n_words) - 1]) >= CASE WHEN n_words >= 13 THEN 10 ELSE ceil(n_words * 3 / 4) END)) > 0 AS found FROM same)
SELECT doc_id, item_id, CAST(max(list_sum(same)) AS BIGINT) AS n_matched, CAST(max(n_words) AS BIGINT) AS n_words
FROM ok WHERE found GROUP BY doc_id, item_id"""

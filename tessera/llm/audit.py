"""How filters of documents interact, from counts of failure masks.

Every document gets a mask with one bit for each filter that it fails. Counts
of documents by part and mask, at most two to the number of filters for a part,
hold all that matters; a subset-zeta transform turns them into the documents
that survive any subset of filters:

    survivors(S) = sum of counts(m) over the masks m that share no bit with S.

The steps of any order of the filters are differences between neighbouring
subsets, survivors(before) - survivors(before and this one), the same for good
and toxic labels, and a filter's Shapley sum weighs these differences by the
orders in which they occur.

On Spark: texts are read once, and what leaves that stage is an id, a part, a
digest and a mask, already counted where rows agree. The first id of every text
is an aggregate by digest, the rows that have it are found by a join on digest
and id together, so copies of one text never meet in one task. Labels join on
the id. The transform works on arrays of one row per part.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: What parts words; everything else belongs to words.
BETWEEN_WORDS = "[\\x20\\x09-\\x0D]+"
#: The filter of copies has no condition on the text alone.
COPY = None


def text_filters(least_words: int = 200, distinct_percent: int = 50, capitals_percent: int = 2, signs: str = "[#$%&*|]") -> dict[str, Column | None]:
    """Conditions on the column ``text`` (null: empty) under which a document fails:
    A few words, B few distinct words, C many capitals, D any of the signs, E a copy.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words, distinct = F.col("n_words"), F.col("n_distinct")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": words < least_words,
        "B": distinct * 100 < words * distinct_percent,
        "C": capitals * 100 > F.length(text) * capitals_percent,
        "D": text.rlike(signs),
        "E": COPY,
    }


def failure_masks(docs: DataFrame, filters: dict[str, Column | None], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask and n, the number of rows that agree in all three and in their text.

    Bit i of the mask is set if the i-th filter fails the document. Conditions
    may name ``text``, ``n_words`` and ``n_distinct``; ``COPY`` fails documents
    whose text is that of a smaller id, in any part. Null texts are empty, and
    so copies of each other. Rows without an id are no copies and make none;
    rows that share id and text are no copies of each other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", BETWEEN_WORDS), lambda w: w != ""))
    rows = rows.withColumns({"n_words": F.size("words").cast("long"), "n_distinct": F.size(F.array_distinct("words")).cast("long")})
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(filters.values()) if fails is not COPY]
    mask = sum(bits, F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    rows = written(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-masks")
    copies = [1 << i for i, fails in enumerate(filters.values()) if fails is COPY]
    if not copies:
        return rows.drop("digest")
    firsts = rows.filter("doc_id IS NOT NULL").groupBy(F.col("digest").alias("first_digest")).agg(F.min("doc_id").alias("first_id"))
    joined = rows.join(firsts, (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id")), "left")
    later = F.col("first_id").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "part", (F.col("mask") + F.when(later, sum(copies)).otherwise(0)).alias("mask"), "n")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents there are, with quality 1, with toxic 1.

    An id is good or toxic if any of its labels says so. Labels without a
    document or an id count nowhere.
    """
    ones = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(ones("quality").alias("good"), ones("toxic").alias("toxic"))
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(known, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("docs"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def survivors(counts: DataFrame, n: int, measures: tuple[str, ...] = ("docs", "good", "toxic")) -> DataFrame:
    """One row per part: for each measure an array whose element S counts what no
    filter of the subset S fails; ``only`` has the counts of the masks themselves.

    The zeta transform takes a bit a round: what stands at a mask with the bit
    gets what stands at the mask without it.
    """

    def dense(m: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0)))

    def with_subsets(m: str, bit: int) -> Column:
        return F.transform(m, lambda v, k: v + F.when(k.bitwiseAND(bit) != 0, F.get(F.col(m), k - bit)).otherwise(0))

    rows = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", m))).alias(m) for m in measures])
    rows = rows.select("part", *[dense(m).alias(m) for m in measures]).withColumn("only", F.col(measures[0]))
    for i in range(n):
        rows = rows.withColumns({m: with_subsets(m, 1 << i) for m in measures})
    return rows.select("part", "only", *[F.reverse(m).alias(m) for m in measures])


def order_steps(survived: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step; see ``audit_filters``."""
    n, full = len(letters), 1 << len(letters)

    def lost(measure: str, before: Column, bit: Column) -> Column:
        return F.get(F.col(measure), before) - F.get(F.col(measure), before.bitwiseOR(bit))

    def shapley(bit: int) -> Column:
        ways = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)])
        added = lambda a, s: a + F.when(s.bitwiseAND(bit) == 0, F.get(ways, F.bit_count(s)) * lost("docs", s, F.lit(bit))).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(full - 1)), F.lit(0).cast("long"), added)

    orders = F.split(F.lit(" ".join(map("".join, itertools.permutations(letters)))), " ")
    rows = survived.withColumn("shapleys", F.array(*[shapley(1 << i) for i in range(n)]))
    rows = rows.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    earlier = [F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)]
    rows = rows.withColumns({"place": place, "before": sum(earlier, F.lit(0))}).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("place")))
    removed = lost("docs", F.col("before"), F.col("bit"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("docs", F.col("before").bitwiseOR(F.col("bit"))).alias("kept"),
        removed.alias("removed"),
        (lost("docs", F.lit(0), F.col("bit")) - removed).alias("redundant"),
        F.get("only", F.col("bit")).alias("unique_fails"),
        lost("good", F.col("before"), F.col("bit")).alias("good_lost"),
        lost("toxic", F.col("before"), F.col("bit")).alias("toxic_lost"),
        F.get("shapleys", F.col("place")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, for every value of ``part_col`` (null: empty string),
    every order of the filters (names of one character) and every step of it.

    kept documents are left after the step, removed ones went in it, redundant
    ones fail its filter but went before, unique_fails fail no other filter;
    good_lost and toxic_lost are the removed ones with such a label; shapley is
    what the filter removes, summed over all orders. Empty tables give no rows;
    what nulls, copies and repeated ids mean stand at ``failure_masks`` and
    ``mask_counts``; other columns are ignored.
    """
    filters = filters or text_filters()
    counts = mask_counts(failure_masks(docs, filters, id_col, text_col, part_col), labels)
    return order_steps(survivors(counts, len(filters)), "".join(filters))


#: Counts each order step by step from documents, without masks or subsets.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
f AS (
  SELECT n, doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
g AS (
  SELECT f.n, f.part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS fails,
         coalesce(bool_or(l.quality = 1), false) AS good, coalesce(bool_or(l.toxic = 1), false) AS toxic
  FROM f LEFT JOIN labels l USING (doc_id) GROUP BY ALL),
k AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
t AS (SELECT filter_order, step, filter_order[step] AS x, string_split(filter_order[:step - 1], '') AS before FROM s),
r AS (
  SELECT k.part, t.filter_order, t.step, t.x,
         sum(docs) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, x)) AS kept,
         sum(docs) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, x)) AS removed,
         sum(docs) FILTER (list_has_any(fails, before) AND list_contains(fails, x)) AS redundant,
         sum(docs) FILTER (fails = [x]) AS unique_fails,
         sum(good) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, x)) AS good_lost,
         sum(toxic) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, x)) AS toxic_lost
  FROM k CROSS JOIN t GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM r"""

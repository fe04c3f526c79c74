"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies,
``target / source_size``. Its whole part is taken as it is; the fractions are
rounded together. Two documents with fractions ``x`` and ``y`` exchange words:
one of them gains what the other loses until one fraction is 0 or 1, the
direction drawn so that each fraction keeps its mean. The words of the pair
stay the same, so a source's words stay at its target up to the last document
left with a fraction.

On Spark: documents of a source are dealt to leaves of bounded size by a hash
of their id, size and, where rows agree in both, their number among these, so
null or repeated ids make no large leaf; a leaf leaves one fractional document
at most. These go up a reduction tree, ``fan_in`` to one, until one document
per source is left, which is rounded at random: a source misses its target by
that document at most. Long documents meet first in every node, so the words
of short ones are left to close them. Hot sources only have more leaves. All
draws come from generators seeded by (seed, source, level, node) over rows in
a fixed order, so reruns agree however the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, small, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
LEAF_ROWS = 512
FAN_IN = 64
SEED = 20240607


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of each text (null: 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.array([len(t.split()) if t else 0 for t in as_bytes(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), sizes], ["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(count, "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: its place ``src`` by code point (null last), its
    size, weight and target.

    Targets share the total size by weight, stop at ``most`` times the
    source's size, and what is cut is reshared by weight. With sources in the
    order of ``cap / weight``, those before the first that keeps its share are
    capped. The windows are over the sources, not over the documents.
    """
    by_name, by_ratio, before = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "src"), (Window.unboundedPreceding, -1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("src", F.row_number().over(by_name) - 1).withColumn("weight", F.get(w, F.col("src") % len(weights)))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    s = s.withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(*before)), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(*before)), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_words") / F.col("left_weight"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every)["level"])
    return s.select("src", "source", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def pivot(fraction: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in place of a copy; returns them and the position of
    the one still fractional (-1: none). Words, sum(fraction * size), stay."""
    f, at = fraction.astype(float).copy(), -1
    for i in np.flatnonzero((f > 0) & (f < 1)):
        if at < 0:
            at = i
            continue
        x, s, y, t = f[at], float(size[at]), f[i], float(size[i])
        up, down = min((1 - x) * s, y * t), min(x * s, (1 - y) * t)
        if draws[i] * (up + down) < down:
            x, y = (1.0, y - up / t) if (1 - x) * s <= y * t else (x + up / s, 0.0)
        else:
            x, y = (0.0, y + down / t) if x * s <= (1 - y) * t else (x - down / s, 1.0)
        f[at], f[i] = x, y
        if not 0 < x < 1:
            at = i if 0 < y < 1 else -1
    return f, at


def _round_nodes(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """Rounds the fractions of each (src, node); ``open`` marks the one left."""

    def node(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(g["src"].iloc[0]), level, int(g["node"].iloc[0])])
        f, at = pivot(g["fraction"].to_numpy(), g["size"].to_numpy(), rng.random(len(g)))
        return g.assign(fraction=f, open=np.arange(len(g)) == at)

    return rows.groupBy("src", "node").applyInPandas(node, "src int, node long, doc_id long, size long, fraction double, open boolean")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_copies: int = MOST_COPIES, seed: int = SEED, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row.

    Null texts and texts without words have size 0 and are taken 0 times;
    documents without a source form a source of their own, named last. A
    repeated doc_id is rounded as often as it stands in the table; other
    columns than doc_id, text and source are ignored. An empty table gives
    no rows.
    """
    sizes = written(document_sizes(docs), "mix-sizes")
    sources = written(source_targets(sizes, weights, most_copies), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most_copies)))).otherwise(0.0)
    s = small(sources.select("src", F.col("source").alias("name"), "n_docs", rate.alias("rate")))
    alike = sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000))))
    alike = alike.withColumn("number", F.explode(F.sequence(F.col("thousand") * 1000, F.least(F.col("thousand") * 1000 + 999, F.col("n") - 1))))
    rows = alike.join(s, alike["source"].eqNullSafe(s["name"])).select("src", F.pmod(F.xxhash64("doc_id", "size", "number"), F.ceil(F.col("n_docs") / leaf_rows)).alias("node"), "doc_id", "size", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("fraction"))
    done, level = [], 0
    nodes = -(-(sources.agg(F.max("n_docs")).first()[0] or 0) // leaf_rows)
    while True:
        rounded = written(_round_nodes(rows, level, seed), "mix-level")
        done.append(rounded.filter(~F.col("open")))
        rows = rounded.filter("open").select("src", F.floor(F.col("node") / fan_in).alias("node"), "doc_id", "size", "fraction")
        if nodes <= 1:
            break
        level, nodes = level + 1, -(-nodes // fan_in)
    last = F.pmod(F.xxhash64(F.lit(seed), "src", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    done.append(rows.withColumn("fraction", F.when(last < F.col("fraction"), 1.0).otherwise(0.0)).withColumn("open", F.lit(False)))
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.unionByName(d)
    whole = F.floor(rate).cast("long")
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.round("fraction").cast("long"), F.lit(most_copies).cast("long"))).otherwise(F.lit(0).cast("long"))
    s = small(sources.select("src", "source", "source_size", "target", whole.alias("whole")))
    return rounded.join(s, "src").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

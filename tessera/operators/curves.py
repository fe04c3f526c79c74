"""Curves that are alike, found without comparing all pairs.

The distance of two curves is the mean over their values of |x - y| / ((x + y) / 2),
which is 2 tanh(d / 2) for d = |ln x - ln y|. Below a threshold the sum of all
terms stays below S = threshold * values, so no d exceeds W = 2 artanh(S / 2),
and as tanh is concave the d of all values together stay below W as well. So
any sum of logarithms, whatever its signs, differs by less than W between near
curves: two such sums place a curve in a grid of cells W wide, and near curves
lie in neighbouring cells.

Leaders are elected in rounds. A round looks at the ``HEADS`` lowest open ids of
each cell only; one that has no near open curve before it leads, and settles all
near curves. A curve is compared with few heads and with the leaders around,
which lie a threshold apart, so work grows with curves times leaders of a
neighbourhood, not with pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

#: Open curves of a cell that a round looks at.
HEADS = 64
#: Leaders that may be broadcast: each is a few numbers.
BROADCAST_LEADERS = 20_000
LEAST = 1e-12


def width_of(threshold: float, values: int) -> float:
    """W for curves of so many values."""
    total = threshold * values
    if total >= 2:
        raise ValueError("thresholds of 2 / values and more bound no single value")
    return 2 * math.atanh(total / 2) * (1 + 1e-9)


def distance(a: Column, b: Column) -> Column:
    """Mean relative difference of two arrays of one length; of two zeros it is 0."""
    term = lambda x, y: F.when(x == y, 0.0).otherwise(F.abs(x - y) / ((x + y) / 2))
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, t: s + t) / F.size(a)


def curves_of(points: DataFrame, *values: str, order: str = "q") -> DataFrame:
    """image_id and v, the ``values`` of its points: the first of all in their order, then the second."""
    one = F.array_sort(F.collect_list(F.struct(order, *values)))
    rows = points.groupBy("image_id").agg(one.alias("points"))
    return rows.select("image_id", F.concat(*[F.col("points").getField(c) for c in values]).cast("array<double>").alias("v"))


def in_cells(curves: DataFrame, threshold: float, values: int) -> DataFrame:
    """Curves (image_id, v) with their cell (cx, cy): sums of logarithms of the first and of the second half."""
    w, half = width_of(threshold, values), values // 2
    logs = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + F.log(F.greatest(x, F.lit(LEAST))))
    place = lambda part: F.floor(logs(part) / w)
    return curves.withColumns({"cx": place(F.slice("v", 1, half)), "cy": place(F.slice("v", half + 1, values - half))})


def _around(cells: DataFrame, prefix: str) -> DataFrame:
    """Each row once for each of the nine cells around its own; its columns get a prefix."""
    near = F.array(*[F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return cells.withColumn("near", F.explode(near)).select(F.col("near.x").alias("cx"), F.col("near.y").alias("cy"), F.col("image_id").alias(f"{prefix}_id"), F.col("v").alias(f"{prefix}_v"))


def near_pairs(cells: DataFrame, threshold: float) -> DataFrame:
    """image_a < image_b and distance of all pairs of curves below the threshold."""
    met = cells.join(_around(cells, "other"), ["cx", "cy"]).filter("image_id < other_id")
    pairs = met.select(F.col("image_id").alias("image_a"), F.col("other_id").alias("image_b"), distance(F.col("v"), F.col("other_v")).alias("distance"))
    return pairs.filter(F.col("distance") < threshold)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_LEADERS + 1).count() <= BROADCAST_LEADERS else df


def leaders(cells: DataFrame, threshold: float, heads: int = HEADS) -> DataFrame:
    """The curves that lead if they come in the order of their ids and each joins
    a leader before it that is near, else leads: rows of ``cells`` (image_id, v,
    cx, cy; ids differ)."""
    still = open_ = kept(cells, "curves-open")
    found = []
    while not open_.isEmpty():
        rank = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("image_id"))
        first = kept(open_.withColumn("rank", rank).filter(F.col("rank") <= heads).drop("rank"), "curves-heads")
        # beyond the last head of a full cell there may be open curves that no one has looked at
        seen = first.groupBy("cx", "cy").agg(F.when(F.count(F.lit(1)) == heads, F.max("image_id")).alias("seen_to"))
        around = _around(first, "head")
        unseen = around.join(seen, ["cx", "cy"]).filter("head_id > seen_to").select("head_id")
        before = around.join(first, ["cx", "cy"]).filter("image_id < head_id").filter(distance(F.col("v"), F.col("head_v")) < threshold).select("head_id")
        waiting = unseen.union(before).distinct()
        new = kept(first.join(waiting, first["image_id"] == waiting["head_id"], "left_anti"), "curves-leaders")
        found.append(new)
        settled = open_.join(_few(_around(new, "leader")), ["cx", "cy"]).filter(distance(F.col("v"), F.col("leader_v")) < threshold).select("image_id").distinct()
        open_ = kept(open_.join(settled, "image_id", "left_anti"), "curves-open")
    if not found:
        return still
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return kept(whole, "curves-leaders")


def clusters(cells: DataFrame, led: DataFrame, threshold: float) -> DataFrame:
    """image_id and cluster, the first leader that is near; every curve has one."""
    met = cells.join(_few(_around(led, "leader")), ["cx", "cy"]).filter(distance(F.col("v"), F.col("leader_v")) < threshold)
    return met.groupBy("image_id").agg(F.min("leader_id").alias("cluster"))

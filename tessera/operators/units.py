"""Planes of two resolutions under one grid of units.

A unit is 16 by 16 samples: four blocks of either full plane and one block of
the third, at half the size a side. Samples are shuffled once, by unit; all
that follows, the halves' means and the samples repeated beyond the border,
lies within a unit, as the last unit of a row holds the last sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.transform import _W, map_blocks, quantise

#: Samples are held to this part of a level; means of four to a quarter of it.
PART = 4096
SHIFT_BITS = 14
#: Bits by which transformed samples of a unit are scaled.
BITS = 26 + SHIFT_BITS


def unit_blocks(planes: DataFrame) -> DataFrame:
    """image_id, uy, ux, place, comp and s of the nine blocks of each unit.

    ``planes`` has image_id, y, x, w, h and the planes p0, p1, p2 as whole numbers
    of 1 / ``PART`` levels. Places 0 to 3 are the blocks of the first plane, row
    by row, 4 to 7 those of the second, 8 that of the third. Values of s count
    in parts of 2^-``SHIFT_BITS`` around the middle level. Blocks that lie
    wholly beyond the border hold its last samples.
    """
    in_unit = F.struct((F.col("y") % 16 * 16 + F.col("x") % 16).cast("int").alias("p"), "p0", "p1", "p2")
    units = planes.groupBy("image_id", F.floor(F.col("y") / 16).alias("uy"), F.floor(F.col("x") / 16).alias("ux")).agg(F.array_sort(F.collect_list(in_unit)).alias("u"), F.first("w").alias("w"), F.first("h").alias("h"))
    side = lambda size, at: F.least(F.lit(16), F.col(size) - F.col(at) * 16).cast("int")
    units = units.withColumns({"lw": side("w", "ux"), "lh": side("h", "uy")})
    middle = F.lit(128 << SHIFT_BITS).cast("long")

    def sample(plane: str, y: Column, x: Column) -> Column:
        place = F.least(y, F.col("lh") - 1) * F.col("lw") + F.least(x, F.col("lw") - 1)
        return F.get("u", place.cast("int"))[plane].cast("long")

    def full(plane: str, top: int, left: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: sample(plane, F.floor(k / 8) + top, k % 8 + left) * 4 - middle)

    def half(plane: str) -> Column:
        def mean(k: Column) -> Column:
            # beyond its own border the small plane repeats its last mean
            y, x = (F.least(i, F.floor((F.col(size) + 1) / 2) - 1) * 2 for i, size in ((F.floor(k / 8), "lh"), (k % 8, "lw")))
            return sample(plane, y, x) + sample(plane, y, x + 1) + sample(plane, y + 1, x) + sample(plane, y + 1, x + 1) - middle

        return F.transform(F.sequence(F.lit(0), F.lit(63)), mean)

    blocks = [full(plane, top, left) for plane in ("p0", "p1") for top in (0, 8) for left in (0, 8)] + [half("p2")]
    return units.select("image_id", "uy", "ux", F.posexplode(F.array(*blocks)).alias("place", "s")).withColumn("comp", F.floor(F.col("place") / 4).cast("int"))


def quantised_units(blocks: DataFrame, table_of: list[list[int]]) -> DataFrame:
    """z in place of s, by plain rounding with the table of each block's plane."""
    c = map_blocks(blocks, "s", "c", "long", lambda s: (_W @ s.reshape(-1, 8, 8) @ _W.T).reshape(-1, 64))
    parts = [quantise(c.filter(F.col("comp") == i), table, BITS) for i, table in enumerate(table_of)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def coding_order(blocks: DataFrame, across: Column) -> DataFrame:
    """``n``, the place of a block in a scan of whole units that lie ``across`` to a row."""
    return blocks.withColumn("n", (F.col("uy") * across + F.col("ux")) * 9 + F.col("place"))

"""Block transforms on arrays of 64 numbers, one row per block, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.tables import BASIS, ZIGZAG, longs


def map_blocks(df: DataFrame, source: str, target: str, kind: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``target = f(source)`` for arrays of 64 numbers, a batch of blocks at a time."""
    schema = T.StructType([x for x in df.schema.fields if x.name != source]).add(target, T.ArrayType({"long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType()}[kind]))
    names = [x.name for x in schema.fields]
    arrow = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(source).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            out = np.ascontiguousarray(f(flat)).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, 64, dtype=np.int32)), pa.array(out, arrow))
            yield pa.RecordBatch.from_arrays([lists if n == target else b.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


_W = np.array(BASIS, np.int64)


def integer_dct(s: np.ndarray) -> np.ndarray:
    """Level shift and separable cosine transform in whole numbers, scaled by 2^26."""
    x = s.astype(np.int64).reshape(-1, 8, 8) - 128
    return (_W @ x @ _W.T).reshape(-1, 64)


def dct_blocks(blocks: DataFrame) -> DataFrame:
    return map_blocks(blocks, "s", "c", "long", integer_dct)


def idct(c: np.ndarray) -> np.ndarray:
    """Samples from coefficients, both as real numbers, level shift undone."""
    w = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    return (w.T @ c.astype(float).reshape(-1, 8, 8) @ w).reshape(-1, 64) + 128


def loeffler_dct(s: np.ndarray) -> np.ndarray:
    """The eleven-multiplication integer transform: constants of 13 bits, two
    more bits between the passes, result scaled by 8."""
    fix = lambda v: int(v * 8192 + 0.5)
    x = s.astype(np.int64).reshape(-1, 8, 8) - 128

    def one(v: np.ndarray, first: bool) -> np.ndarray:
        d = [v[..., i] for i in range(8)]
        even, odd = [d[i] + d[7 - i] for i in range(4)], [d[i] - d[7 - i] for i in range(4)]
        a, b, c, e = even[0] + even[3], even[1] + even[2], even[1] - even[2], even[0] - even[3]
        n = 11 if first else 15
        down = lambda y: (y + (1 << (n - 1))) >> n
        out = [None] * 8
        out[0], out[4] = ((a + b) << 2, (a - b) << 2) if first else ((a + b + 2) >> 2, (a - b + 2) >> 2)
        z = (c + e) * fix(0.541196100)
        out[2], out[6] = down(z + e * fix(0.765366865)), down(z - c * fix(1.847759065))
        t7, t6, t5, t4 = odd
        z1, z2, z3, z4 = t4 + t7, t5 + t6, t4 + t6, t5 + t7
        z5 = (z3 + z4) * fix(1.175875602)
        z1, z2 = z1 * -fix(0.899976223), z2 * -fix(2.562915447)
        z3, z4 = z3 * -fix(1.961570560) + z5, z4 * -fix(0.390180644) + z5
        out[7], out[5] = down(t4 * fix(0.298631336) + z1 + z3), down(t5 * fix(2.053119869) + z2 + z4)
        out[3], out[1] = down(t6 * fix(3.072711026) + z2 + z3), down(t7 * fix(1.501321110) + z1 + z4)
        return np.stack(out, axis=-1)

    rows = one(x, True)
    return one(rows.swapaxes(1, 2), False).swapaxes(1, 2).reshape(-1, 64)


def quantise_value(c: Column, q: Column, bits: int = 26) -> Column:
    """c / (q 2^bits) to the nearest whole number, halves away from zero."""
    half, unit = q.cast("long") * F.lit(1 << (bits - 1)), q.cast("long") * F.lit(1 << bits)
    size = F.abs(c) + half
    return F.when(c < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long") * ((size - F.pmod(size, unit)) / unit).cast("long")


def quantise(blocks: DataFrame, table: list[int], bits: int = 26) -> DataFrame:
    """z: the coefficients c by the table, in zigzag order."""
    keep = [x for x in blocks.columns if x != "c"]
    ordered = F.transform(longs(ZIGZAG), lambda k: F.get("c", k.cast("int")))
    return blocks.select(*keep, F.zip_with(ordered, longs([table[k] for k in ZIGZAG]), lambda c, q: quantise_value(c, q, bits)).alias("z"))


#: Strengths are held to 5 places and multipliers to 4, so thresholds are whole numbers of this part.
BIAS_UNIT = 10**9


def quantise_zero_bias(blocks: DataFrame, strength: str, table: list[int], multipliers: list[int], offsets: list[int], bits: int = 26) -> DataFrame:
    """z, zigzag order, and how many values the bias ``killed``: c / (q 2^bits)
    to the nearest whole number where its size reaches offset + multiplier *
    strength of the block, else 0. Offsets count in 1 / BIAS_UNIT, multipliers
    in 10^-4; ``strength`` is a column of each block."""
    keep = [x for x in blocks.columns if x not in ("c", strength)]
    scaled = F.round(F.col(strength) * 100000).cast("long")
    at = [longs([x[k] for k in ZIGZAG]) for x in (table, multipliers, offsets)]
    ordered = F.transform(longs(ZIGZAG), lambda k: F.get("c", k.cast("int")))
    plain = F.zip_with(ordered, at[0], lambda c, q: quantise_value(c, q, bits))
    least = F.zip_with(at[2], F.transform(at[1], lambda m: m * F.col("scaled")), lambda o, m: o + m)
    unit = F.transform(at[0], lambda q: (q * F.lit(1 << bits)).cast("double"))
    reached = F.zip_with(F.transform("ordered", lambda c: F.abs(c).cast("double") * float(BIAS_UNIT)), F.zip_with(unit, least, lambda u, t: u * t.cast("double")), lambda c, t: c >= t)
    b = blocks.select(*keep, ordered.alias("ordered"), plain.alias("plain"), scaled.alias("scaled"))
    b = b.select(*keep, "plain", F.zip_with("plain", reached, lambda v, r: F.when(r, v).otherwise(F.lit(0).cast("long"))).alias("z"))
    lost = F.size(F.filter(F.arrays_zip("plain", "z"), lambda x: (x["plain"] != 0) & (x["z"] == 0)))
    return b.select(*keep, "z", lost.alias("killed"))

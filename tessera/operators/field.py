"""The adaptive quantisation field in 32-bit floats.

Every step rounds to 32 bits and sums run in one order, so results do not hang
on how a plan adds. Blocks stay rows of 64 samples: they get their neighbours'
edges by one window over the image, give four cells of pre-erosion each, get
the cells around them by a second one, and end as one strength. Square roots
are exact; logarithm and power are rounded from 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_f = np.float32

# Fixed values of the masking model, folded in 32 bits in the order written.
SCALING = _f(1) / _f(255)
INV_LOG2E = _f(0.6931471805599453)
MATCH_OFFSET = _f(0.019) / SCALING
LIMIT = _f(0.2)
MASKING = np.sqrt(_f(211.50759899638012) * _f(1e8))
MASKING_OFFSET = _f(28)
NUM_MUL = _f(1) / _f(73.377132366608819) * _f(18.6580932135) * INV_LOG2E * _f(3) * _f(226.0480446705883)
NUM_OFFSET = _f(1e-2) / SCALING / SCALING
DEN_MUL = INV_LOG2E * _f(226.0480446705883) * SCALING * SCALING
DEN_OFFSET = (_f(7.14672470003) * INV_LOG2E + _f(1e-2)) / SCALING
MASK_BASE, MASK_MUL0, MASK_MUL2, MASK_MUL3, MASK_MUL4 = _f(-0.74174993), _f(0.74760422233706747), _f(12.906028311180409), _f(5.0220313103171232), _f(3.2353257320940401)
MASK_OFFSET2, MASK_OFFSET3 = _f(305.04035728311436), _f(2.1925739705298404)
MASK_OFFSET4 = _f(0.25) * MASK_OFFSET3
EROSION = (_f(0.125), _f(0.075), _f(0.06), _f(0.05))
HF_MUL = _f(-2.0052193233688884) * SCALING / _f(112)
GAMMA = _f(-0.15526878023684174) * INV_LOG2E
GAMMA_BIAS, GAMMA_SCALE = _f(0.16) / SCALING, SCALING / _f(64)
LOG2_E = _f(1.442695041)
AC_QUANT, BASE_LEVEL = _f(0.841), _f(0.48) * _f(0.841)
RAMP_START, RAMP_END = _f(9), _f(65)


def ratio(v: np.ndarray, inverse: bool) -> np.ndarray:
    """Slope of the cubic-root response over that of the simple gamma, or its inverse."""
    v = np.maximum(v, _f(0))
    square = v * v
    num, den = NUM_MUL * square + NUM_OFFSET, (DEN_MUL * v) * square + DEN_OFFSET
    return num / den if inverse else den / num


def dampening(first_ac: float) -> tuple[np.float32, np.float32]:
    """Factor and addend of a field whose table has this first AC step."""
    first = _f(first_ac)
    dampen = max(_f(1) - (first - RAMP_START) / (RAMP_END - RAMP_START), _f(0)) if first >= RAMP_START else _f(1)
    return AC_QUANT * dampen, (_f(1) - dampen) * BASE_LEVEL


def pre_erosion(s: np.ndarray, west: np.ndarray, east: np.ndarray, north: np.ndarray, south: np.ndarray) -> np.ndarray:
    """Cells of four by four samples, m x 2 x 2, of blocks m x 8 x 8 and the samples beyond their four sides."""
    w, e = np.concatenate([west[:, :, None], s[:, :, :-1]], axis=2), np.concatenate([s[:, :, 1:], east[:, :, None]], axis=2)
    n, d = np.concatenate([north[:, None], s[:, :-1]], axis=1), np.concatenate([s[:, 1:], south[:, None]], axis=1)
    diff = ratio(s + MATCH_OFFSET, False) * (s - _f(0.25) * (((w + e) + n) + d))
    masked = _f(0.25) * np.sqrt(np.minimum(diff * diff, LIMIT) * MASKING + MASKING_OFFSET)
    cells = masked.reshape(-1, 2, 4, 2, 4)
    columns = ((cells[:, :, 0] + cells[:, :, 1]) + cells[:, :, 2]) + cells[:, :, 3]
    return (((columns[..., 0] + columns[..., 1]) + columns[..., 2]) + columns[..., 3]) * _f(0.25)


def texture(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks m x 8 x 8: differences of neighbours, whole numbers, and the ratios summed row by row."""
    differences = np.abs(np.diff(s, axis=1)).sum(axis=(1, 2)) + np.abs(np.diff(s, axis=2)).sum(axis=(1, 2))
    ratios = ratio(s + GAMMA_BIAS, True).reshape(-1, 64)
    total = ratios[:, 0]
    for i in range(1, 64):
        total = total + ratios[:, i]
    return differences.astype(_f), total


def fuzzy_erosion(cells: np.ndarray) -> np.ndarray:
    """Of cells m x 4 x 4, the block's four in the middle: each the weighted four least of nine, summed."""
    parts = []
    for y in (0, 1):
        for x in (0, 1):
            least = np.sort(cells[:, y : y + 3, x : x + 3].reshape(-1, 9), axis=1)[:, :4]
            parts.append(((EROSION[0] * least[:, 0] + EROSION[1] * least[:, 1]) + EROSION[2] * least[:, 2]) + EROSION[3] * least[:, 3])
    return ((parts[0] + parts[1]) + parts[2]) + parts[3]


def strength(fuzzy: np.ndarray, differences: np.ndarray, ratios: np.ndarray, first_ac: float) -> np.ndarray:
    v = np.maximum(fuzzy * MASK_MUL0, _f(1e-3))
    out = ((MASK_BASE + MASK_MUL4 * (_f(1) / (v * v + MASK_OFFSET4))) + MASK_MUL2 * (_f(1) / (v + MASK_OFFSET2))) + MASK_MUL3 * (_f(1) / (v * v + MASK_OFFSET3))
    out = out + differences * HF_MUL
    out = out + GAMMA * np.log2((ratios * GAMMA_SCALE).astype(float)).astype(_f)
    mul, add = dampening(first_ac)
    field = np.exp2((out * LOG2_E).astype(float)).astype(_f) * mul + add
    return np.maximum(_f(0.6) / field - _f(1), _f(0))


def _numbers(b: pa.RecordBatch, name: str, *shape: int) -> np.ndarray:
    values = b.column(b.schema.get_field_index(name))
    return (values.flatten() if shape else values).to_numpy(zero_copy_only=False).reshape(-1, *shape)


def aq_field(blocks: DataFrame, first_ac: float, wide: int = 8) -> DataFrame:
    """image_id, n, fuzzy, ratios and aq_strength of every block (image_id, n, s)
    of images ``wide`` blocks across, whole blocks only.

    Beyond the border stands the sample, or cell, nearest to it.
    """
    image = Window.partitionBy("image_id").orderBy("n")
    bx = F.col("n") % wide
    row = lambda y: F.slice("s", y * 8 + 1, 8)
    column = lambda x: F.array(*[F.get("s", F.lit(y * 8 + x)) for y in range(8)])

    def beside(name: str, step: int, x: int = 0) -> Column:
        """The value ``step`` blocks on, null beyond the border; x: how many columns that goes."""
        found = F.lead(name, step).over(image) if step > 0 else F.lag(name, -step).over(image)
        return F.when(bx >= 1, found) if x < 0 else F.when(bx < wide - 1, found) if x > 0 else found

    b = blocks.select("image_id", "n", "s", row(0).alias("top"), row(7).alias("bottom"), column(0).alias("left"), column(7).alias("right"))
    b = b.select("image_id", "n", "s", F.coalesce(beside("right", -1, -1), "left").alias("west"), F.coalesce(beside("left", 1, 1), "right").alias("east"), F.coalesce(beside("bottom", -wide), "top").alias("north"), F.coalesce(beside("top", wide), "bottom").alias("south"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _numbers(b, "s", 8, 8).astype(_f)
            found = pre_erosion(s, *[_numbers(b, side, 8).astype(_f) for side in ("west", "east", "north", "south")])
            differences, ratios = texture(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(s) + 1, 4, dtype=np.int32)), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(differences), pa.array(ratios)], ["image_id", "n", "cells", "differences", "ratios"])

    c = b.mapInArrow(cells, "image_id int, n long, cells array<float>, differences float, ratios float")
    around = {"w": (-1, -1), "e": (1, 1), "n": (-wide, 0), "s": (wide, 0), "nw": (-wide - 1, -1), "ne": (1 - wide, 1), "sw": (wide - 1, -1), "se": (wide + 1, 1)}
    none = F.array(*[F.lit(float("nan")).cast("float")] * 4)
    c = c.select("image_id", "n", "cells", "differences", "ratios", *[F.coalesce(beside("cells", *step), none).alias(f"at_{k}") for k, step in around.items()])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _numbers(b, "cells", 2, 2)
            k = {name: _numbers(b, f"at_{name}", 2, 2) for name in around}
            grid = np.empty((len(own), 4, 4), _f)
            or_else = lambda first, then: np.where(np.isnan(first), then, first)
            grid[:, 1:3, 1:3] = own
            grid[:, 0, 1:3], grid[:, 3, 1:3] = or_else(k["n"][:, 1], own[:, 0]), or_else(k["s"][:, 0], own[:, 1])
            grid[:, 1:3, 0], grid[:, 1:3, 3] = or_else(k["w"][:, :, 1], own[:, :, 0]), or_else(k["e"][:, :, 0], own[:, :, 1])
            for y, x, corner, side in ((0, 0, k["nw"][:, 1, 1], k["w"][:, 0, 1]), (0, 3, k["ne"][:, 1, 0], k["e"][:, 0, 0]), (3, 0, k["sw"][:, 0, 1], k["w"][:, 1, 1]), (3, 3, k["se"][:, 0, 0], k["e"][:, 1, 0])):
                grid[:, y, x] = or_else(corner, or_else(side, grid[:, y, 1 if x == 0 else 2]))
            fuzzy, ratios = fuzzy_erosion(grid), _numbers(b, "ratios")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fuzzy), pa.array(ratios), pa.array(strength(fuzzy, _numbers(b, "differences"), ratios, first_ac))], ["image_id", "n", "fuzzy", "ratios", "aq_strength"])

    return c.mapInArrow(whole, "image_id int, n long, fuzzy float, ratios float, aq_strength float")

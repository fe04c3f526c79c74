"""Rate-distortion optimal quantisation and deringing of blocks.

All arithmetic is on arrays of blocks at once: a block is a row of the arrays,
so a batch costs one pass of the dynamic program whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType

from tessera.operators.transform import loeffler_dct, map_blocks
from tessera.plans.tables import ZIGZAG

_Z = np.array(ZIGZAG)
SCALE_1, SCALE_2 = 14.75, 16.5


@dataclass(frozen=True)
class Settings:
    """Which values are chosen by rate and error, and how much error weighs.

    ``ac`` and ``dc``: the values of blocks and the chain of their first ones;
    rounded where false. ``runs``: blocks are emptied to join runs of empty ones.
    """

    ac: bool = True
    dc: bool = True
    runs: bool = True
    scale_1: float = SCALE_1
    scale_2: float = SCALE_2


ROUNDED = Settings(ac=False, dc=False, runs=False)


class Band(NamedTuple):
    """Blocks quantised in a band of positions, and what that costs.

    ``zero_cost``: error of an empty band; ``cost``: rate and error of the
    chosen values; ``skip_cost``: the same without the code that ends a block;
    ``status``: 2 empty, 1 ends in zeros, 0 ends in a value.
    """

    z: np.ndarray
    zero_cost: np.ndarray
    cost: np.ndarray
    skip_cost: np.ndarray
    status: np.ndarray


def block_lambda(raw: np.ndarray, scale_1: float = SCALE_1, scale_2: float = SCALE_2) -> np.ndarray:
    """Weight of distortion by a block's activity; ``raw`` is scaled by 8, natural order."""
    if scale_2 <= 0:
        return np.full(len(raw), 2.0 ** (scale_1 - 12))
    return 2.0**scale_1 / (2.0**scale_2 + (raw[:, 1:].astype(float) ** 2).mean(axis=1))


def bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(float))[1]


def round_to_table(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    q = 8 * table
    return np.sign(raw) * ((np.abs(raw) + q // 2) // q)


def trellis_band(raw: np.ndarray, table: list[int], lengths: list[int], first: int = 1, last: int = 63, settings: Settings = Settings()) -> Band:
    """Blocks quantised from zigzag position ``first`` to ``last`` with the least
    rate plus weighted error; values outside the band are 0.

    State: the last position with a value. Candidates of a position are the
    rounded value and 2^k - 1 below it; a value's cost is its code and extra
    bits, the codes of sixteen zeros before it and its squared error over q^2;
    zeros in between cost their own error. Ends with the cheapest tail.
    """
    n, s = len(raw), first - 1
    q = np.array(table)[_Z]
    x = raw[:, _Z].astype(np.int64)
    size, sign = np.abs(x), np.where(x < 0, -1, 1)
    weight = block_lambda(raw, settings.scale_1, settings.scale_2)[:, None] / (q.astype(float) ** 2)[None, :]
    zero = size.astype(float) ** 2 * weight
    zero[:, :first] = 0
    zeros = np.cumsum(zero, axis=1)
    top = np.minimum((size + 4 * q) // (8 * q), 1023)
    code = np.where(np.array(lengths) > 0, np.array(lengths, float), np.inf)
    cost = np.full((n, 64), np.inf)
    cost[:, s] = 0
    value, origin = np.zeros((n, 64), np.int64), np.zeros((n, 64), np.int64)
    for i in range(first, last + 1):
        bits = bit_length(top[:, i])
        run = i - 1 - np.arange(s, i)
        reach = cost[:, s:i] + zeros[:, i - 1 : i] - zeros[:, s:i] + np.where(run >= 16, (run // 16) * code[0xF0], 0.0)
        for k in range(1, int(bits.max(initial=0)) + 1):
            held = bits >= k
            v = np.where(bits == k, top[:, i], (1 << k) - 1)
            error = (v * 8 * q[i] - size[:, i]).astype(float) ** 2 * weight[:, i]
            total = reach + (code[(run % 16) * 16 + k] + k)[None, :] + error[:, None]
            j = total.argmin(axis=1)
            best = total[np.arange(n), j]
            better = held & (best < cost[:, i])
            cost[better, i], origin[better, i], value[better, i] = best[better], j[better] + s, v[better]
    ends = cost[:, s : last + 1] + zeros[:, last : last + 1] - zeros[:, s : last + 1]
    closed = ends + np.where(np.arange(s, last + 1) < last, code[0], 0.0)
    end = closed.argmin(axis=1)
    rows, at = np.arange(n), end + s
    status = np.where(at == s, 2, np.where(at == last, 0, 1))
    out = np.zeros((n, 64), np.int64)
    for _ in range(first, last + 1):
        live = np.flatnonzero(at > s)
        if not len(live):
            break
        out[live, at[live]] = value[live, at[live]] * sign[live, at[live]]
        at[live] = origin[live, at[live]]
    return Band(out, zeros[:, last], closed[rows, end], ends[rows, end], status)


def trellis_ac(raw: np.ndarray, table: list[int], lengths: list[int], settings: Settings = Settings()) -> np.ndarray:
    """Quantised blocks, zigzag order: the AC band by ``trellis_band``, the DC value rounded."""
    out = trellis_band(raw, table, lengths, settings=settings).z
    out[:, 0] = round_to_table(raw[:, 0].astype(np.int64), np.int64(table[0]))
    return out


def block_cost(z: np.ndarray, raw: np.ndarray, table: list[int], lengths: list[int]) -> np.ndarray:
    """Rate plus weighted error of the AC values of quantised blocks."""
    q = np.array(table)[_Z]
    weight = block_lambda(raw)[:, None] / (q.astype(float) ** 2)[None, :]
    total = (((z * 8 * q - raw[:, _Z]).astype(float) ** 2) * weight)[:, 1:].sum(axis=1)
    for b, row in enumerate(z):
        last = 0
        for i in np.flatnonzero(row[1:]) + 1:
            run, k = i - 1 - last, int(abs(row[i])).bit_length()
            total[b] += (run // 16) * lengths[0xF0] + lengths[(run % 16) * 16 + k] + k
            last = i
        total[b] += lengths[0] if last < 63 else 0
    return total


def dc_candidates(dc_step: int) -> int:
    return min(9, (2 + 60 // dc_step) | 1)


def trellis_dc(raw: np.ndarray, dc_step: int, lengths: list[int], before: int = 0) -> np.ndarray:
    """DC values of a chain of blocks with the least rate of differences plus weighted error."""
    return dc_chain(raw[:, 0].astype(np.int64), block_lambda(raw), dc_step, lengths, before)


def dc_chain(dc: np.ndarray, weight: np.ndarray, dc_step: int, lengths: list[int], before: int = 0) -> np.ndarray:
    """As ``trellis_dc``, of the raw DC values (scaled by 8) and the blocks' weights of error."""
    count, q = dc_candidates(dc_step), 8 * dc_step
    weight = weight / dc_step**2
    offsets = np.arange(count) - count // 2
    size, sign = np.abs(dc), np.where(dc < 0, -1, 1)
    near = np.clip(((size + q // 2) // q)[:, None] + offsets, -1023, 1023)
    error = (near * q - size[:, None]).astype(float) ** 2 * weight[:, None]
    values = near * sign[:, None]
    rate_of = np.array([n + k if n else 2 * k + 1 for k, n in enumerate(lengths[:17])], float)
    total = error[0] + rate_of[bit_length(values[0] - before)]
    back = np.zeros(values.shape, int)
    for i in range(1, len(values)):
        steps = rate_of[bit_length(values[i][:, None] - values[i - 1][None, :])] + total[None, :]
        back[i] = steps.argmin(axis=1)
        total = error[i] + steps[np.arange(count), back[i]]
    k, out = int(total.argmin()), np.zeros(len(values), np.int64)
    for i in range(len(values) - 1, -1, -1):
        out[i] = values[i, k]
        k = back[i, k]
    return out


def zero_blocks(empty_cost: list[float], full_cost: list[float], status: list[int], lengths: list[int]) -> list[bool]:
    """Which blocks of a band to empty so that runs of empty blocks join.

    status: 2 empty already, 1 ends in zeros, 0 ends in a value. Shortest path
    over the blocks that stay: between two of them all are empty and coded as
    one run, whose code and extra bits count with what emptying loses.
    """
    n = len(status)
    run_bits = np.array([0.0] + [(lengths[16 * k] or 16) + k for r in range(1, n + 2) for k in [r.bit_length() - 1]])
    lost = np.append(0.0, np.cumsum([0.0 if s == 2 else e for e, s in zip(empty_cost, status, strict=True)]))
    stay = np.array([-1, *(i for i in range(n) if status[i] != 2)])
    ends_in_zeros = np.array([0, *(int(status[i] == 1) for i in stay[1:])])
    best, back = np.zeros(len(stay) + 1), [0] * (len(stay) + 1)
    for k, i in enumerate([*stay[1:].tolist(), n], 1):
        before = stay[:k]
        options = best[:k] + lost[i] - lost[before + 1] + run_bits[i - before - 1 + ends_in_zeros[:k]]
        back[k] = int(options.argmin())
        best[k] = options[back[k]] + (full_cost[i] if i < n else 0.0)
    kept, k = set(), back[len(stay)]
    while k:
        kept.add(int(stay[k]))
        k = back[k]
    return [i not in kept for i in range(n)]


def dering(s: np.ndarray, dc_step: int) -> np.ndarray:
    """Level-shifted samples whose runs at the top, in zigzag order, follow a
    curve above it; how far is bounded by 31, two DC steps and the room that
    the block's mean leaves."""
    top = 127
    x = s.astype(np.int64)[:, _Z] - 128
    for row in x:
        high = row >= top
        if not high.any() or high.all():
            continue
        limit = top + min(31, 2 * dc_step, (top * 64 - int(row.sum())) // int(high.sum()))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], high.astype(int), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            slope = lambda near, far: max(near - far, top - near)
            rise = slope(row[max(a - 1, 0)], row[max(a - 2, 0)])
            fall = slope(row[min(b, 63)], row[min(b + 1, 63)])
            rise, fall = (fall if a == 0 else rise), (rise if b == 64 else fall)
            length = b - a
            f = np.float32
            t = np.cumsum(np.full(length, f(1) / f(length + 1), f), dtype=f)
            t2, t3 = t * t, t * t * t
            # Hermite curve between two points at the top, with the tangents of the slopes outside
            ends = (f(2) * t3 - f(3) * t2 + f(1), f(3) * t2 - f(2) * t3)
            curve = f(top) * ends[0] + f(rise * length) * (t3 - f(2) * t2 + t) + f(top) * ends[1] - f(fall * length) * (t3 - t2)
            row[a:b] = np.minimum(np.ceil(curve).astype(np.int64), limit)
    out = np.empty_like(x)
    out[:, _Z] = x
    return out


def quantise_trellis(blocks: DataFrame, table: list[int], lengths: list[int], settings: Settings = Settings()) -> DataFrame:
    """``z`` from ``raw``, the transform scaled by 8; a narrow stage."""
    if not settings.ac:
        return map_blocks(blocks, "raw", "z", "long", lambda raw: round_to_table(raw, np.array(table))[:, _Z])
    return map_blocks(blocks, "raw", "z", "long", lambda raw: trellis_ac(raw, table, lengths, settings))


def quantise_dc_rows(blocks: DataFrame, dc_step: int, lengths: list[int], settings: Settings = Settings()) -> DataFrame:
    """image_id, by, bx and dc: one chain for each row of blocks, which starts
    from 0; a row of blocks is a group."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bx")
        raw = np.stack(g["raw"].to_numpy())
        dc = trellis_dc(raw, dc_step, lengths) if settings.dc else round_to_table(raw[:, 0], np.int64(dc_step))
        return g[["image_id", "by", "bx"]].assign(dc=dc)

    return blocks.groupBy("image_id", "by").applyInPandas(one, "image_id int, by long, bx long, dc long")


def band_costs(blocks: DataFrame, table: list[int], lengths: list[int], bands: list[tuple[int, int]], settings: Settings = Settings()) -> DataFrame:
    """image_id, by, bx, first, last, status and costs of every block in every
    band (``Band``); a narrow stage, a batch of blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            for first, last in bands:
                found = trellis_band(raw, table, lengths, first, last, settings)
                edges = [pa.array(np.full(len(raw), x, np.int32)) for x in (first, last)]
                costs = [pa.array(x) for x in (found.zero_cost, found.cost, found.skip_cost)]
                keys = [b.column(c).cast(t) for c, t in (("image_id", pa.int32()), ("by", pa.int64()), ("bx", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*keys, *edges, pa.array(found.status.astype(np.int32)), *costs], ["image_id", "by", "bx", "first", "last", "status", "zero_cost", "cost", "skip_cost"])

    return blocks.select("image_id", "by", "bx", "raw").mapInArrow(run, "image_id int, by long, bx long, first int, last int, status int, zero_cost double, cost double, skip_cost double")


def empty_in_rows(costs: DataFrame, lengths: list[int], settings: Settings = Settings()) -> DataFrame:
    """``costs`` (``band_costs``) with ``emptied``: which blocks of a row of
    blocks go so that runs of empty ones join. Only costs are shuffled."""
    if not settings.runs:
        return costs.withColumn("emptied", costs["status"] == 2)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bx")
        return g.assign(emptied=zero_blocks(g["zero_cost"].tolist(), g["skip_cost"].tolist(), g["status"].tolist(), lengths))

    return costs.groupBy("image_id", "by", "first").applyInPandas(one, StructType([*costs.schema.fields, StructField("emptied", BooleanType())]))


def scaled_table(table: list[int], multiplier: float) -> list[int]:
    """The table by a block's multiplier, from 1 to 255, halves up."""
    return [int(min(255, max(1, np.floor(q * multiplier + 0.5)))) for q in table]


def choose_ac(blocks: DataFrame, table: list[int], lengths: list[int], settings: Settings = Settings(), deringing: bool = False) -> DataFrame:
    """image_id, by, bx, z, raw_dc and weight: the first of two passes over
    blocks (image_id, by, bx, s, multiplier), a narrow stage.

    Samples are deringed if asked to, transformed once, and quantised by the
    table times the block's multiplier. What the second pass needs of the
    transform goes with z: the raw DC value and the block's weight of error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda name, b=b: b.column(b.schema.get_field_index(name))
            s = column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            raw = loeffler_dct(dering(s, table[0]) + 128 if deringing else s)
            multipliers, z = column("multiplier").to_numpy(zero_copy_only=False), np.zeros((len(raw), 64), np.int64)
            for m in np.unique(multipliers):
                own, scaled = multipliers == m, scaled_table(table, m)
                z[own] = trellis_ac(raw[own], scaled, lengths, settings) if settings.ac else round_to_table(raw[own], np.array(scaled))[:, _Z]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, 64, dtype=np.int32)), pa.array(z.reshape(-1)))
            keys = [column(c).cast(t) for c, t in (("image_id", pa.int32()), ("by", pa.int64()), ("bx", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*keys, lists, pa.array(raw[:, 0].astype(np.int64)), pa.array(block_lambda(raw, settings.scale_1, settings.scale_2))], ["image_id", "by", "bx", "z", "raw_dc", "weight"])

    return blocks.select("image_id", "by", "bx", "s", "multiplier").mapInArrow(run, "image_id int, by long, bx long, z array<long>, raw_dc long, weight double")


def choose_dc(chosen: DataFrame, dc_step: int, lengths: list[int], settings: Settings = Settings()) -> DataFrame:
    """image_id, by, bx and the final z: the second pass takes the blocks as the
    first one left them and puts the cheapest chain of DC values in, one chain
    for each row of blocks, from 0. The step is that of the table itself: a
    block's multiplier holds for its own rounding only."""
    if not settings.dc:
        return chosen.select("image_id", "by", "bx", "z")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bx")
        z = np.stack(g["z"].to_numpy())
        z[:, 0] = dc_chain(g["raw_dc"].to_numpy(), g["weight"].to_numpy(), dc_step, lengths)
        return g[["image_id", "by", "bx"]].assign(z=list(z))

    return chosen.groupBy("image_id", "by").applyInPandas(one, "image_id int, by long, bx long, z array<long>")

"""Rate-distortion points: exact sizes of quantised blocks at many qualities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import transform
from tessera.plans import tables

QUALITIES = (20, 40, 60, 80, 95)
CODECS = ("plain", "zero_bias")
#: Strength that the zero-bias thresholds are taken at, in hundredths.
STRENGTH = 8


def code_array(table: str) -> list[int]:
    """Length of the code of each symbol 0 to 255; 0 for those without one."""
    lengths = tables.code_lengths(*tables.STANDARD_CODES[table])
    return [lengths.get(s, 0) for s in range(256)]


def thresholds(codec: str) -> list[int]:
    """Least size of each coefficient that is kept, in units of 10^-7 of a quantiser step."""
    if codec == "plain":
        return [0] * 64
    offset = round(tables.ZERO_BIAS_OFFSET_AC[0] * 10**7)
    return [(offset if k else 0) + round(tables.ZERO_BIAS_LQ[k] * 10000) * STRENGTH * 10 for k in range(64)]


def _quantised(c: np.ndarray, table: np.ndarray, least: np.ndarray) -> np.ndarray:
    step = table << 26
    z = np.sign(c) * ((np.abs(c) + (step >> 1)) // step)
    return np.where(np.abs(c) * 10_000_000 >= step * least, z, 0)


def _ac_bits(z: np.ndarray, lengths: np.ndarray) -> int:
    """Bits of the run-length symbols of blocks z (rows of 63 values in zigzag order)."""
    row, at = np.nonzero(z)
    before = np.where(np.append(False, row[1:] == row[:-1])[: len(row)], np.append(-1, at[:-1])[: len(at)], -1)
    run, size = at - before - 1, np.frexp(np.abs(z[row, at]).astype(float))[1]
    bits = int((lengths[run % 16 * 16 + size] + size + run // 16 * lengths[0xF0]).sum())
    return bits + int((z[:, -1] == 0).sum()) * int(lengths[0])


def rd_points(blocks: DataFrame, qualities: Iterable[int] = QUALITIES, codecs: Iterable[str] = CODECS) -> DataFrame:
    """image_id, codec, q, blocks, bytes, bpp and metric (mean absolute error
    of the coefficients) of every image of ``blocks`` (image_id, n, s).

    Codecs: plain rounding, and rounding behind the luma zero-bias thresholds.
    Each block is transformed once and goes with the DC coefficient before it
    through all settings, a batch of blocks at a time; only sums per batch,
    image and setting are shuffled.
    """
    settings = [(codec, q, np.array([tables.quant_table(tables.IMAGE_MAGICK_LUMA, q)[k] for k in tables.ZIGZAG]), np.array([thresholds(codec)[k] for k in tables.ZIGZAG])) for codec in codecs for q in qualities]
    ac, dc = (np.array(code_array(t)) for t in ("ac_luma", "dc_luma"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("c").flatten().to_numpy().reshape(-1, 64)[:, tables.ZIGZAG]
            images, before = b.column("image_id").to_numpy(), b.column("before").to_numpy(zero_copy_only=False)
            rows = []
            for image in np.unique(images):
                c, first = every[images == image], np.isnan(before[images == image].astype(float))
                last = np.where(first, 0, np.nan_to_num(before[images == image].astype(float))).astype(np.int64)
                for codec, q, table, least in settings:
                    z = _quantised(c, table, least)
                    size = np.frexp(np.abs(z[:, 0] - _quantised(last, table[0], least[0])).astype(float))[1]
                    bits = int((dc[size] + size).sum()) + _ac_bits(z[:, 1:], ac)
                    rows.append((int(image), codec, q, len(c), bits, int(np.abs(c - (z * table << 26)).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["image_id", "codec", "q", "blocks", "bits", "error"])

    b = transform.dct_blocks(blocks.select("image_id", "n", "s")).select("image_id", "n", "c", F.get("c", F.lit(0)).alias("dc"))
    # whole numbers of this size are exact as doubles, where a null is told by NaN
    b = b.withColumn("before", F.lag("dc").over(Window.partitionBy("image_id").orderBy("n")).cast("double")).select("image_id", "c", "before")
    total = b.mapInArrow(sums, "image_id int, codec string, q int, blocks long, bits long, error long")
    total = total.groupBy("image_id", "codec", "q").agg(*[F.sum(c).alias(c) for c in ("blocks", "bits", "error")])
    unit = 1 << 26
    size_bytes = F.floor((F.col("bits") + 7) / 8).cast("long")
    return total.select("image_id", "codec", "q", "blocks", size_bytes.alias("bytes"), (size_bytes * 8 / (F.col("blocks") * 64)).alias("bpp"), (F.col("error") / (F.col("blocks") * 64.0 * unit)).alias("metric"))

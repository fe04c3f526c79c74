"""Deringing with and without, side by side.

Both arms of every quality come from one pass over the blocks: the plain
transform is shared by all qualities, only deringed samples, whose bound hangs on
the table, are transformed again. A block hands on a few numbers for each arm;
the rate of the first coefficients follows from one window over an image, and
sums of images are paired by quality.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import rd
from tessera.operators.transform import idct, integer_dct
from tessera.operators.trellis import dering
from tessera.plans import tables

QUALITIES = (30, 50, 70, 85, 95)
RESULT = "image_id int, quality int, with_bytes long, without_bytes long, size_diff_pct double, with_error double, without_error double, error_diff double"


def _block_numbers(c: np.ndarray, s: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: quantised first coefficient, bits of the rest, and how far decoded samples lie from s in all."""
    order = np.array(tables.ZIGZAG)
    step = table << 26
    z = np.sign(c) * ((np.abs(c) + (step >> 1)) // step)
    back = np.clip(np.floor(idct((z * table)[:, np.argsort(order)]) + 0.5), 0, 255).astype(np.int64)
    bits = np.array([rd._ac_bits(row[None, 1:], lengths) for row in z], np.int64) if len(z) else np.zeros(0, np.int64)
    return z[:, 0], bits, np.abs(back - s).sum(axis=1)


def dering_arms(blocks: DataFrame, qualities: Sequence[int] = QUALITIES) -> DataFrame:
    """``RESULT`` for every image of the blocks (image_id, n, s) and quality:
    bytes of the scan under the standard codes and mean absolute error of the
    decoded samples, with deringing and without it, and their differences."""
    order = np.array(tables.ZIGZAG)
    table_of = [tables.quant_table(tables.IMAGE_MAGICK_LUMA, q) for q in qualities]
    ac = np.array(rd.code_array("ac_luma"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.schema.get_field_index("s")).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64).astype(np.int64)
            plain, found = integer_dct(s), []
            for table in table_of:
                for c in (plain, integer_dct(dering(s, table[0]) + 128)):
                    found.append(_block_numbers(c[:, order], s, np.array(table)[order], ac))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(s) * len(found) + 1, len(found), dtype=np.int32)), pa.array(np.stack([f[k] for f in found], axis=1).reshape(-1))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["image_id", "n", "dcs", "bits", "errors"])

    numbers = blocks.select("image_id", "n", "s").mapInArrow(run, "image_id int, n long, dcs array<long>, bits array<long>, errors array<long>")
    before = F.lag("dcs").over(Window.partitionBy("image_id").orderBy("n"))
    rate = tables.longs([n + k for k, n in enumerate(rd.code_array("dc_luma")[:16])])
    numbers = numbers.withColumn("before", F.coalesce(before, F.transform("dcs", lambda _: F.lit(0).cast("long"))))
    size = F.transform(F.zip_with("dcs", "before", lambda a, b: F.abs(a - b)), lambda d: F.when(d == 0, 0).otherwise(F.length(F.bin(d))))
    whole = F.zip_with("bits", F.transform(size, lambda k: F.get(rate, k)), lambda a, d: a + d)
    rows = numbers.select("image_id", F.posexplode(F.arrays_zip(whole.alias("bits"), F.col("errors"))).alias("arm", "x"))
    rows = rows.select("image_id", F.floor(F.col("arm") / 2).cast("int").alias("at"), (F.col("arm") % 2).alias("deringed"), F.col("x.bits").alias("bits"), F.col("x.errors").alias("error"))
    arm = lambda c, d: F.sum(F.when(F.col("deringed") == d, F.col(c)))
    sums = rows.groupBy("image_id", "at").agg(arm("bits", 1).alias("with_bits"), arm("bits", 0).alias("without_bits"), arm("error", 1).alias("with_sum"), arm("error", 0).alias("without_sum"), (F.count(F.lit(1)) / 2 * 64).alias("samples"))
    quality = F.get(F.array(*[F.lit(q) for q in qualities]), F.col("at"))
    paired = sums.select("image_id", quality.alias("quality"), *[F.ceil(F.col(f"{a}_bits") / 8).cast("long").alias(f"{a}_bytes") for a in ("with", "without")], *[(F.col(f"{a}_sum") / F.col("samples")).alias(f"{a}_error") for a in ("with", "without")])
    return with_differences(paired)


def with_differences(paired: DataFrame) -> DataFrame:
    """``RESULT`` from the numbers of both arms."""
    percent = 100.0 * (F.col("with_bytes") - F.col("without_bytes")) / F.col("without_bytes")
    return paired.withColumns({"size_diff_pct": percent, "error_diff": F.col("with_error") - F.col("without_error")}).select(*[c.split()[0] for c in RESULT.split(", ")])


def summed_up(results: DataFrame) -> DataFrame:
    """quality and image_id (null: all), images, mean differences and how many
    pairs got better: by quality, by image and over all."""
    better = F.sum(F.when(F.col("error_diff") < 0, 1).otherwise(0))
    sets = results.groupingSets([["quality"], ["image_id"], []], "quality", "image_id")
    return sets.agg(F.count(F.lit(1)).alias("pairs"), F.avg("size_diff_pct").alias("size_diff_pct"), F.avg("error_diff").alias("error_diff"), better.alias("better"))


def write_arms(results: DataFrame, folder: str) -> None:
    """CSV with a header, a folder for each quality."""
    results.write.partitionBy("quality").option("header", True).csv(folder)

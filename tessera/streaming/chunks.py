"""Rows of pixels as a stream of events, coded in bands of eight rows.

Each band of an image has its own state, so one large image spreads over many
tasks and state stays below eight rows. A band is coded as soon as its rows are
there, whatever order they came in; a timer on event time closes bands whose
rows never come, and takes away the mark of coded ones, which until then keeps
repeated rows from being coded again. What links blocks of different bands, the
differences of their first coefficients, is computed on the coded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.transform import integer_dct
from tessera.plans.tables import ZIGZAG

OUT = "image_id int, band int, bx int, width int, height int, missing int, z array<int>"
STATE = "width int, height int, until long, coded boolean, present binary, held binary"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def band_blocks(rows: dict[int, np.ndarray], width: int, table: np.ndarray) -> np.ndarray:
    """Quantised blocks in zigzag order of a band's rows (by place, 0 to 7).

    A row that is not there is that above it, else that below; the last sample
    of a row repeats to the end of its block.
    """
    known = sorted(rows)
    source = [max((k for k in known if k <= i), default=known[0]) for i in range(8)]
    band = np.stack([rows[k] for k in source])
    band = np.pad(band, ((0, 0), (0, -width % 8)), mode="edge")
    s = band.reshape(8, -1, 8).swapaxes(0, 1).reshape(-1, 64)
    c = integer_dct(s)[:, ZIGZAG]
    step = table << 26
    return np.sign(c) * ((np.abs(c) + (step >> 1)) // step)


class BandCoder(StatefulProcessor):
    """State and timers of one (image_id, band)."""

    def __init__(self, table: list[int], patience_ms: int) -> None:
        self.table, self.patience = np.array([table[k] for k in ZIGZAG], np.int64), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("band", STATE)

    def _frame(self, key: tuple, rows: dict[int, np.ndarray], width: int, height: int) -> pd.DataFrame:
        z = band_blocks(rows, width, self.table)
        missing = min(8, height - int(key[1]) * 8) - len(rows)
        n = len(z)
        return pd.DataFrame({"image_id": [int(key[0])] * n, "band": [int(key[1])] * n, "bx": range(n), "width": [width] * n, "height": [height] * n, "missing": [missing] * n, "z": [b.tolist() for b in z]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width, height, until, coded, present, held = self.state.get() if self.state.exists() else (None, None, None, False, b"", b"")
        if coded or key[1] < 0:
            for _ in rows:
                pass
            return
        known = dict(zip(present, np.frombuffer(held, np.int16).reshape(-1, width), strict=True)) if present else {}
        first = int(key[1]) * 8
        earliest = None
        for f in rows:
            for y, v, w, h, at in zip(f["y"], f["v"], f["width"], f["height"], f["at_ms"], strict=True):
                place = int(y) - first
                if v is None or len(v) != w or not 0 <= place < min(8, h - first) or (width, height) not in ((None, None), (w, h)):
                    continue  # no row of this image
                width, height = int(w), int(h)
                known.setdefault(place, np.asarray(v, np.int16))
                earliest = int(at) if earliest is None else min(earliest, int(at))
        if not known:
            return
        if until is None:
            until = max(earliest, timerValues.getCurrentWatermarkInMs()) + self.patience
            self.handle.registerTimer(until)
        if len(known) == min(8, height - first):
            yield self._frame(key, known, width, height)
            self.state.update((width, height, until, True, b"", b""))
        else:
            places = sorted(known)
            self.state.update((width, height, until, False, bytes(places), b"".join(known[p].tobytes() for p in places)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            width, height, _, coded, present, held = self.state.get()
            if not coded:
                yield self._frame(key, dict(zip(present, np.frombuffer(held, np.int16).reshape(-1, width), strict=True)), width, height)
            self.state.clear()

    def close(self) -> None:
        pass


def encode_rows(rows: DataFrame, table: list[int], patience: int = 60, late: str = "10 seconds") -> DataFrame:
    """image_id, band, bx, width, height, missing and z of every block of a
    stream of pixel rows (image_id, width, height, y, at, v: ``width`` samples).

    A band is out once: when its rows are there, or, with the number of rows
    ``missing``, when the watermark (``late`` behind the newest event) has gone
    ``patience`` seconds beyond its first row. Of two rows of one place the one
    that came first counts. Rows without samples, of another size than their
    image's first, or outside of it, count as missing; rows without an image or
    with a negative place are left out. A row that comes after
    its band is closed and is not dropped as late opens the band again.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # timers need it
    # rows of no image stay, as their time moves the watermark: they are spread over bands below 0, for null keys of a group turn all its keys into floats
    band = F.when(F.col("image_id").isNotNull() & (F.col("y") >= 0), F.floor(F.col("y") / 8)).otherwise(-1 - F.pmod(F.xxhash64("at", "y"), F.lit(1024)))
    known = rows.withWatermark("at", late)
    known = known.select(F.coalesce(F.col("image_id").cast("int"), F.lit(0)).alias("image_id"), band.cast("int").alias("band"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")], "y", "v", "at", F.coalesce(F.unix_millis("at"), F.lit(0)).alias("at_ms"))
    return known.groupBy("image_id", "band").transformWithStateInPandas(BandCoder(table, patience * 1000), OUT, "append", "EventTime")


def in_order(coded: DataFrame) -> DataFrame:
    """Coded blocks with their place n in the image and ``d``, the first
    coefficient less that of the block before."""
    wide = F.ceil(F.col("width") / 8)
    n = (F.col("band") * wide + F.col("bx")).cast("long")
    before = F.lag(F.get("z", F.lit(0)), 1, 0).over(Window.partitionBy("image_id").orderBy("n"))
    return coded.withColumn("n", n).withColumn("d", F.get("z", F.lit(0)) - before)


def finished() -> Column:
    """Whether all bands of an image are out, as an aggregate over its coded blocks."""
    return F.count_distinct("band") == F.ceil(F.max("height") / 8)

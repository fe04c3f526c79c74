"""Rows of pixels as a stream: complete bands of eight rows are coded as they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.trellis import round_to_table
from tessera.operators.transform import loeffler_dct

OUT = "image_id int, band int, bx int, dc int, nonzero int"
STATE = "last_dc int, band int, held binary"


def _code(quant: np.ndarray):
    def code(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, band, held = state.get if state.exists else (0, 0, b"")
        buffer = np.frombuffer(held, np.int32).reshape(-1, 65) if held else np.zeros((0, 65), np.int32)
        rows = {int(r[0]): r[1:] for r in buffer}
        for f in frames:
            for y, v in zip(f["y"], f["v"], strict=True):
                rows[int(y)] = np.asarray(v, np.int32)
        out = []
        while all(band * 8 + i in rows for i in range(8)):
            block_row = np.stack([rows.pop(band * 8 + i) for i in range(8)])
            s = block_row.reshape(8, 8, 8).swapaxes(0, 1).reshape(8, 64)
            z = round_to_table(loeffler_dct(s), quant)
            for bx in range(8):
                out.append((key[0], band, bx, int(z[bx, 0]) - last, int((z[bx, 1:] != 0).sum())))
                last = int(z[bx, 0])
            band += 1
        left = np.array([[y, *v] for y, v in sorted(rows.items())], np.int32)
        state.update((last, band, left.tobytes()))
        yield pd.DataFrame(out, columns=["image_id", "band", "bx", "dc", "nonzero"])

    return code


def code_bands(rows: DataFrame, quant: list[int]) -> DataFrame:
    """image_id, band, bx, dc (difference to the block before) and nonzero of
    every block of a stream of pixel rows (image_id, y, v: 64 samples).

    State of an image: the last DC value, the next band and the rows that came
    ahead of it; rows may come in any order, and a band is emitted once.
    """
    return rows.groupBy("image_id").applyInPandasWithState(_code(np.array(quant)), OUT, STATE, "append", GroupStateTimeout.NoTimeout)

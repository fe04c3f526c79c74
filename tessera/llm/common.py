"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table with rows of a few numbers may be broadcast.
BROADCAST_ROWS = 100_000
#: Numbers that the arrays of a broadcast table may hold in all.
BROADCAST_VALUES = 2_000_000
#: Characters of text that one numpy pass inside a task handles at once.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    serves a local master, as in tests, and a folder of the warehouse, which
    is shared, a cluster; it is set for later calls.
    """
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        local = spark.sparkContext.master.startswith("local")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there,
    and a lost executor costs no recomputation of what stands before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, values: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and, where
    rows hold arrays, ``BROADCAST_VALUES`` of their ``values`` in all; beyond
    that the join is left to a shuffle. ``df`` should be a written table."""
    if df.limit(rows + 1).count() > rows:
        return df
    if values is not None and (df.agg(F.sum(values)).first()[0] or 0) > BROADCAST_VALUES:
        return df
    return F.broadcast(df)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], most: int = SLICE_CHARS, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows with about ``most`` bytes each; a longer text stands alone."""
    begin = held = 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if held and held + size > most or i - begin >= rows:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)

"""Sizes of images, checked before anything is read or allocated for them.

A size that does not fit in 64 bits is an error code of its row, as is any
other fault; the job goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest side and most samples of an image.
MOST_SIDE = 65500
MOST_PIXELS = 100_000_000


def product(*factors: str | Column) -> Column:
    """The product of whole numbers, null where it outgrows 64 bits."""
    total = F.lit(1).cast("long")
    for f in factors:
        total = F.try_multiply(total, (F.col(f) if isinstance(f, str) else f).cast("long"))
    return total


def with_limits(images: DataFrame, most_side: int | None = MOST_SIDE, most_pixels: int | None = MOST_PIXELS) -> DataFrame:
    """pixels, bytes and error_code beside the columns width, height, depth
    (bytes of a sample) and payload_bytes; error_code is null if all is well.

    INVALID_DIMENSIONS: a side is null, below 1 or above ``most_side``;
    INVALID_DEPTH: so is the depth, but for the limit; SIZE_OVERFLOW: pixels or
    bytes outgrow 64 bits; IMAGE_TOO_LARGE: more than ``most_pixels``;
    MISSING_PAYLOAD, WRONG_PAYLOAD_SIZE: there is none, or it has another size.
    The first that holds is named, in this order but for pixels before bytes.
    """
    bad = lambda c, most: F.coalesce((F.col(c) < 1) | (F.col(c) > most if most else F.lit(False)), F.lit(True))
    rows = images.withColumns({"pixels": product("width", "height"), "bytes": product("width", "height", "depth")})
    code = F.when(bad("width", most_side) | bad("height", most_side), "INVALID_DIMENSIONS").when(bad("depth", None), "INVALID_DEPTH").when(F.col("pixels").isNull(), "SIZE_OVERFLOW")
    if most_pixels:
        code = code.when(F.col("pixels") > most_pixels, "IMAGE_TOO_LARGE")
    code = code.when(F.col("bytes").isNull(), "SIZE_OVERFLOW").when(F.col("payload_bytes").isNull(), "MISSING_PAYLOAD").when(F.col("payload_bytes") != F.col("bytes"), "WRONG_PAYLOAD_SIZE")
    return rows.withColumn("error_code", code)

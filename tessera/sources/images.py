"""Image files as rows, and the writers of the analytics tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import jpeg

PNG_SIGN = b"\x89PNG\r\n\x1a\n"
#: Bytes of samples, and pixels as rows, that a task hands on at once, if one image or line does not hold more.
HANDED_BYTES, HANDED_PIXELS = 1 << 22, 1 << 16


def find_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of the png, jpg and jpeg files of a folder, not of those below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(folder)
    return files.select("path", "length", "content").orderBy("path")


def read_png(data: bytes) -> np.ndarray:
    """Height x width x channels of an 8-bit PNG without interlace: gray, gray
    with alpha, RGB or RGBA."""
    if not data.startswith(PNG_SIGN):
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        head = body if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[9])
    if head[8] != 8 or channels is None or head[12]:
        raise ValueError("unsupported PNG")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int64)  # a row above and a pixel to the left of zeros
    for y in range(height):
        line, kind = lines[y, 1:].reshape(width, channels).astype(np.int64), lines[y, 0]
        up = out[y]
        if kind in (0, 2):
            out[y + 1, 1:] = (line + (up[1:] if kind == 2 else 0)) & 255
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        else:
            for x in range(width):
                a, b, c = out[y + 1, x], up[x + 1], up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    """An unfiltered PNG of height x width x 1 or 3 samples."""
    height, width, channels = pixels.shape
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2}[channels], 0, 0, 0])
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels)
    return PNG_SIGN + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def load_images(files: DataFrame) -> DataFrame:
    """path, width, height, payload (interleaved RGB) and error_code of image
    files: gray is repeated over three channels, alpha is dropped. What cannot
    be read has a null payload and says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows.append(_loaded(path.as_py(), content.as_py()))
                held += len(rows[-1]["payload"] or b"")
                if held >= HANDED_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _LOADED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _LOADED)

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, payload binary, error_code string")


_LOADED = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("payload", pa.binary()), ("error_code", pa.string())])


def _loaded(path: str, data: bytes) -> dict:
    try:
        p = read_png(data)
    except (ValueError, zlib.error) as error:
        return {"path": path, "width": None, "height": None, "payload": None, "error_code": f"UNREADABLE: {error}"}
    rgb = p[..., :3] if p.shape[2] >= 3 else np.repeat(p[..., :1], 3, axis=2)
    return {"path": path, "width": rgb.shape[1], "height": rgb.shape[0], "payload": rgb.tobytes(), "error_code": None}


def pixels_of(images: DataFrame, channels: int = 3) -> DataFrame:
    """path, y, x and one column for each channel of interleaved payloads."""
    names = "rgba"[:channels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, w, h, payload in zip(*(b.column(c) for c in ("path", "width", "height", "payload")), strict=True):
                yield from _lines(path, w.as_py(), np.frombuffer(payload.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), channels), names)

    return images.filter("payload IS NOT NULL").select("path", "width", "height", "payload").mapInArrow(run, _pixel_kinds(names))


def read_pixels(files: DataFrame) -> DataFrame:
    """``pixels_of`` the images that ``load_images`` reads, by one worker a task
    instead of two, with no payload on its way between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                image = _loaded(path.as_py(), content.as_py())
                if image["payload"] is not None:
                    yield from _lines(path, image["width"], np.frombuffer(image["payload"], np.uint8).reshape(image["height"], image["width"], 3), "rgb")

    return files.select("path", "content").mapInArrow(run, _pixel_kinds("rgb"))


def _pixel_kinds(names: str) -> str:
    return "path string, y int, x int, " + ", ".join(f"{c} smallint" for c in names)


def _lines(path: pa.Scalar, width: int, pixels: np.ndarray, names: str) -> Iterator[pa.RecordBatch]:
    """The pixels of an image as rows, some lines at a time."""
    step = max(1, HANDED_PIXELS // max(1, width))
    for top in range(0, len(pixels), step):
        p = pixels[top : top + step]
        y, x = np.indices(p.shape[:2], np.int32)
        planes = [p[..., i].ravel().astype(np.int16) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.repeat(path, y.size), *(pa.array(a) for a in (y.ravel() + np.int32(top), x.ravel(), *planes))], ["path", "y", "x", *names])


def as_pngs(blocks: DataFrame) -> DataFrame:
    """path, length and content, as of files, of gray PNG images of ``blocks``
    (image_id, n, s), eight blocks a row, named by their ids."""
    return blocks.groupBy("image_id").applyInArrow(_png_of, "path string, length long, content binary")


def _png_of(group: pa.Table) -> pa.Table:
    group = group.sort_by("n")
    s = group.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8, 8)
    data = write_png(s.swapaxes(1, 2).reshape(-1, 64, 1).astype(np.uint8))
    return pa.table({"path": [f"image-{group.column('image_id')[0].as_py()}.png"], "length": [len(data)], "content": pa.array([data], pa.binary())})


def write_curves(points: DataFrame, folder: str, qualities: Sequence[int] | None = None) -> None:
    """One CSV row for each image, a pair of columns for each quality."""
    qualities = list(qualities) if qualities else [r["q"] for r in points.select("q").distinct().orderBy("q").collect()]
    wide = points.groupBy("image_id").pivot("q", qualities).agg(F.first("bpp").alias("bpp"), F.first("metric").alias("metric"))
    wide.write.option("header", True).csv(folder)


def write_front(points: DataFrame, front: DataFrame, folder: str) -> None:
    """All points as CSV and those on the front as JSON lines."""
    points.write.option("header", True).csv(f"{folder}/all_points")
    front.write.json(f"{folder}/front")


def icc_of(images: DataFrame) -> DataFrame:
    """path, profile and is_xyb of JPEG payloads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [jpeg.extract_icc(bytes(p)) for p in b["payload"]]
            yield pd.DataFrame({"path": b["path"], "profile": found, "is_xyb": [p is not None and jpeg.is_xyb_profile(p) for p in found]})

    return images.select("path", "payload").mapInPandas(run, "path string, profile binary, is_xyb boolean")

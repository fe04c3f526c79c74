"""Faults of sizes, distances of tables, and slices between restarts."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import quality
from tessera.operators import refine, tokens
from tessera.plans import numeric, scans, tables
from tessera.sources import images, limits, views

BIG = 1 << 62


def test_each_fault_has_its_code(spark):
    rows = [
        (1, 10, 20, 3, 600, None, 600), (2, 0, 20, 3, 0, "INVALID_DIMENSIONS", 0), (3, None, 20, 3, 60, "INVALID_DIMENSIONS", None), (4, 65500, 1, 1, 65500, None, 65500),
        (5, 65501, 1, 1, 65501, "INVALID_DIMENSIONS", 65501), (6, 20000, 5000, 1, 10**8, None, 10**8), (7, 20001, 5000, 1, 1, "IMAGE_TOO_LARGE", 20001 * 5000),
        (8, 10, 20, 3, None, "MISSING_PAYLOAD", 600), (9, 10, 20, 3, 599, "WRONG_PAYLOAD_SIZE", 600), (10, 10, 20, 0, 1, "INVALID_DEPTH", 0), (11, 10, 20, None, 1, "INVALID_DEPTH", None),
    ]
    shape = "id int, width long, height long, depth long, payload_bytes long, code string, size long"
    got = limits.with_limits(spark.createDataFrame(rows, shape)).collect()
    assert len(got) == len(rows) and all((r["error_code"], r["bytes"]) == (r["code"], r["size"]) for r in got)
    huge = [(1, BIG, 4, 1, 1), (2, BIG, 1, 4, 1), (3, BIG, 1, 1, BIG)]
    free = limits.with_limits(spark.createDataFrame(huge, "id int, width long, height long, depth long, payload_bytes long"), None, None)
    assert [(r["error_code"], r["pixels"]) for r in free.orderBy("id").collect()] == [("SIZE_OVERFLOW", None), ("SIZE_OVERFLOW", BIG), (None, BIG)]
    assert limits.with_limits(free.limit(0)).count() == 0


def test_distance_of_tables_is_that_of_the_query(spark):
    found = {r["q"]: r["distance"] for r in catalogue.QUERIES["q_quant_vals_to_distance"](spark, DATA).collect()}
    rows = [[r for r in tables.perceptual_rows() if r[0] == i] for i in range(3)]
    for q in (30, 50, 75, 95, 99):
        d = 0.1 + (100 - q) * 0.09
        built = [[quality.perceptual_number(x[2], d, x[3], tables.GLOBAL_SCALE) for x in r] for r in rows]
        assert quality.effective_distance(built, [[x[2] for x in r] for r in rows], tables.FREQUENCY_EXPONENT) == pytest.approx(found[q], abs=2e-5)
    ones = [[1] * 64] * 3
    assert 0 < quality.effective_distance(ones, [[x[2] for x in r] for r in rows], tables.FREQUENCY_EXPONENT) < 1
    assert quality.blended(0.5, [4.0], [2.0]) == [2.0] and quality.blended(2.0, [4.0], [2.0]) == [3.0] and quality.blended(9.0, [4.0], [2.0]) == [4.0]


def test_blended_settings_differ_by_quality():
    low, mid, high = (numeric._blend_settings(q)[1][0] for q in numeric.BLEND_QUALITIES)
    assert low != high and all(min(a, c) <= b <= max(a, c) for a, b, c in zip(low, mid, high, strict=True))


def test_slices_replay_the_scan(spark):
    """Tokens of the slices, laid end to end, are those of a replay from the start that resets at each restart."""
    b = views.quantised(spark, DATA).filter("image_id = 3").select("image_id", "n", "z").cache()
    cut = b.withColumn("slice", F.floor(F.col("n") / scans.RESTART))
    sent = tokens.tokens(cut, "slice")
    slices = refine.sliced(sent.select("image_id", "slice", "n", "symbol")).orderBy("slice").collect()
    replay, last = [], 0
    for r in b.orderBy("n").collect():
        last = 0 if r["n"] % scans.RESTART == 0 else last
        d, last = r["z"][0] - last, r["z"][0]
        replay.append((r["n"], abs(d).bit_length()))
        run = 0
        for v in r["z"][1:]:
            if v:
                replay += [(r["n"], 0xF0)] * (run // 16) + [(r["n"], run % 16 * 16 + abs(v).bit_length())]
            run = 0 if v else run + 1
        replay += [(r["n"], 0)] if run else []
    for s in slices:
        part = replay[s["begin"] : s["begin"] + s["length"]]
        assert {n // scans.RESTART for n, _ in part} == {s["slice"]} and sum(x for _, x in part) == s["symbols"]
    assert slices[0]["begin"] == 0 and slices[-1]["begin"] + slices[-1]["length"] == len(replay)


def test_images_and_pixels_are_handed_on_in_parts(spark, monkeypatch):
    """Neither all images of a batch nor all pixels of an image leave a task at once."""
    sides = [(300, 400), (2, 3), (500, 700), (300, 400)]
    rng = np.random.default_rng(8)
    pixels = {f"{i}.png": rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for i, (h, w) in enumerate(sides)}
    files = spark.createDataFrame([(k, bytearray(images.write_png(p))) for k, p in pixels.items()], "path string, content binary")
    both, read = images.pixels_of(images.load_images(files)), images.read_pixels(files)
    assert both.count() == sum(h * w for h, w in sides)
    small = pixels["1.png"]
    assert {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in both.filter("path = '1.png'").collect()} == {(y, x): tuple(small[y, x].tolist()) for y in range(2) for x in range(3)}
    assert read.schema == both.schema and read.exceptAll(both).count() == both.exceptAll(read).count() == 0
    # the functions alone, on one batch of each image four times
    runs = []
    kept = type(files).mapInArrow
    monkeypatch.setattr(type(files), "mapInArrow", lambda df, run, schema: (runs.append(run), kept(df, run, schema))[1])
    images.pixels_of(images.load_images(files))
    images.read_pixels(files)
    load, spread, read_and_spread = runs
    batch = pa.RecordBatch.from_pylist([{"path": k, "content": images.write_png(p)} for k, p in pixels.items()] * 4)
    loaded = list(load([batch]))
    payloads = [sum(len(x) for x in b.column("payload").to_pylist()) for b in loaded]
    assert sum(map(len, loaded)) == 16 and len(loaded) > 1 and max(payloads) < images.HANDED_BYTES + 500 * 700 * 3
    for parts in (spread(loaded), read_and_spread([batch])):
        sizes = [len(b) for b in parts]
        assert max(sizes) <= images.HANDED_PIXELS and sum(sizes) == 4 * sum(h * w for h, w in sides)

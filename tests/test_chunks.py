"""Bands of rows that come late, twice, in any order, damaged or never."""

import datetime as dt
import tempfile

import numpy as np

from tessera.operators.transform import integer_dct
from tessera.plans import tables
from tessera.streaming import chunks

SIZES = {1: (5, 8), 2: (16, 13), 3: (33, 20), 4: (8, 16)}
TABLE = tables.quant_table(tables.IMAGE_MAGICK_LUMA, 60)
ROWS = "image_id int, width int, height int, y int, at timestamp, v array<int>"


def picture(i):
    w, h = SIZES[i]
    return np.random.default_rng(i).integers(0, 256, (h, w))


def event(i, y, second, v="own"):
    w, h = SIZES[i]
    samples = [int(x) for x in picture(i)[y]] if v == "own" else v
    return (i, w, h, y, dt.datetime.fromtimestamp(1000 + second, dt.UTC), samples)


def expected(i, lost=()):
    """image, band, bx, missing and z, sample by sample."""
    image, (w, h) = picture(i), SIZES[i]
    steps = np.array([TABLE[k] for k in tables.ZIGZAG])
    for band in range(-(-h // 8)):
        there = [y for y in range(band * 8, min(h, band * 8 + 8)) if y not in lost]
        if not there:
            continue
        for bx in range(-(-w // 8)):
            s = [image[max([t for t in there if t <= y], default=there[0])][min(x, w - 1)] for y in range(band * 8, band * 8 + 8) for x in range(bx * 8, bx * 8 + 8)]
            c = integer_dct(np.array([s]))[0][tables.ZIGZAG]
            z = [int(np.sign(a)) * int((abs(int(a)) + (int(q) << 25)) // (int(q) << 26)) for a, q in zip(c, steps, strict=True)]
            yield (i, band, bx, min(8, h - band * 8) - len(there), z)


def run(spark, batches):
    """The coded rows, and how many rows of state there were after each batch."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/rows-{k}")
    query = None
    states = []
    for k in range(len(batches)):
        spark.read.schema(ROWS).parquet(f"{folder}/rows-{k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        coded = chunks.encode_rows(spark.readStream.schema(ROWS).parquet(f"{folder}/in"), TABLE, patience=20, late="30 seconds")
        query = coded.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]))
    return spark.read.schema(coded.schema).parquet(f"{folder}/out"), states


def test_bands_of_odd_streams(spark):
    rng = np.random.default_rng(7)
    first = [event(i, y, int(rng.integers(0, 10))) for i in (1, 2, 3) for y in range(SIZES[i][1]) if (i, y) not in ((2, 9), (3, 0), (3, 18))]
    rng.shuffle(first)
    cut = len(first) // 2
    twice = [event(1, 0, 12), event(2, 3, 12), event(3, 10, 9)]
    damaged = [event(2, 9, 5, None), event(2, 9, 5, [1, 2]), (2, 7, 13, 9, *event(2, 9, 5)[4:]), (2, 16, 13, 40, *event(2, 9, 5)[4:]), (None, 5, 8, 0, *event(1, 0, 5)[4:]), (2, None, 13, 9, *event(2, 9, 5)[4:]), (2, 16, None, 9, *event(2, 9, 5)[4:]), (2, 16, 13, None, *event(2, 9, 5)[4:]), (1, 5, 8, -1, *event(1, 0, 5)[4:])]
    ahead = [event(4, y, 100) for y in range(8)]  # moves the watermark beyond the others' patience
    late = [event(3, 0, 2), event(2, 9, 3)]
    coded, states = run(spark, [first[:cut] + twice[:1], first[cut:] + twice[1:] + damaged, ahead, late, [event(4, y, 500) for y in range(8, 16)]])
    got = sorted(tuple(r) for r in coded.select("image_id", "band", "bx", "missing", "z").collect())
    want = [*expected(1), *expected(2, {9}), *expected(3, {0, 18}), *expected(4)]
    assert got == sorted(want)
    assert states[0] > 0 and states[-1] < states[1]  # closed bands leave nothing behind

    blocks = chunks.in_order(coded)
    order = [(r["n"], r["d"], r["z"][0]) for r in blocks.filter("image_id = 3").orderBy("n").collect()]
    assert [n for n, _, _ in order] == list(range(15))
    assert np.cumsum([d for _, d, _ in order]).tolist() == [z for _, _, z in order]
    done = {r["image_id"]: r["done"] for r in coded.groupBy("image_id").agg(chunks.finished().alias("done")).collect()}
    assert done == {1: True, 2: True, 3: True, 4: True}
    some = coded.filter("image_id <> 3 OR band <> 1").groupBy("image_id").agg(chunks.finished().alias("done"))
    assert {r["image_id"] for r in some.collect() if not r["done"]} == {3}


def test_rows_fill_from_above_or_below():
    rows = {2: np.full(3, 10, np.int16), 5: np.full(3, 90, np.int16)}
    z = chunks.band_blocks(rows, 3, np.ones(64, np.int64))
    s = np.repeat([10] * 5 + [90] * 3, 8)
    c = integer_dct(s[None])[:, tables.ZIGZAG]
    assert (z == np.sign(c) * ((np.abs(c) + (1 << 25)) // (1 << 26))).all()

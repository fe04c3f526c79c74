"""Blocks of units against loops over samples, for images of any size."""

import numpy as np

from tessera.operators import units


def expected(planes):
    """(uy, ux, place) -> 64 values."""
    (h, w), out = planes[0].shape, {}
    at = lambda p, y, x: int(p[min(y, h - 1), min(x, w - 1)])
    small = [[sum(at(planes[2], 2 * y + i, 2 * x + j) for i in (0, 1) for j in (0, 1)) for x in range((w + 1) // 2)] for y in range((h + 1) // 2)]
    middle = 128 << units.SHIFT_BITS
    for uy in range(-(-h // 16)):
        for ux in range(-(-w // 16)):
            for place in range(8):
                top, left = uy * 16 + place % 4 // 2 * 8, ux * 16 + place % 2 * 8
                out[uy, ux, place] = [at(planes[place // 4], top + k // 8, left + k % 8) * 4 - middle for k in range(64)]
            out[uy, ux, 8] = [small[min(uy * 8 + k // 8, len(small) - 1)][min(ux * 8 + k % 8, len(small[0]) - 1)] - middle for k in range(64)]
    return out


def test_units_of_all_sizes(spark):
    sizes = [(16, 16), (17, 3), (30, 20), (1, 1), (33, 47), (8, 9)]
    rng = np.random.default_rng(1)
    images = {i: [rng.integers(0, 255 * units.PART, (h, w)) for _ in range(3)] for i, (w, h) in enumerate(sizes)}
    rows = [(i, y, x, p[0].shape[1], p[0].shape[0], *(int(q[y, x]) for q in p)) for i, p in images.items() for y in range(p[0].shape[0]) for x in range(p[0].shape[1])]
    rng.shuffle(rows)
    planes = spark.createDataFrame([tuple(map(int, r)) for r in rows], "image_id int, y int, x int, w int, h int, p0 long, p1 long, p2 long").repartition(5)
    blocks = units.unit_blocks(planes)
    got = {}
    for r in blocks.collect():
        got.setdefault(r["image_id"], {})[r["uy"], r["ux"], r["place"]] = r["s"]
        assert r["comp"] == r["place"] // 4
    assert got == {i: expected(p) for i, p in images.items()}
    assert units.unit_blocks(planes.limit(0)).count() == 0


def test_units_quantise_to_the_nearest(spark):
    flat = [(1, 0, 0, place, place // 4, [(3 << units.SHIFT_BITS) + (1 << units.SHIFT_BITS - 1)] * 64) for place in range(9)]
    blocks = spark.createDataFrame(flat, "image_id int, uy long, ux long, place int, comp int, s array<long>")
    z = {r["place"]: r["z"] for r in units.quantised_units(blocks, [[5] * 64, [7] * 64, [16] * 64]).collect()}
    # a flat block of 3.5 has a first coefficient of 28, but for the rounding of the basis
    assert [z[p][0] for p in (0, 4)] == [6, 4] and z[8][0] == 2 and all(v == 0 for x in z.values() for v in x[1:])

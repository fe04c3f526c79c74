"""The 32-bit field against scalars, sample by sample, and values worked out by hand."""

import numpy as np
import pytest

from tessera.operators import field

f = np.float32


def scalar_field(image, first_ac):
    """(fuzzy, ratios, strength) of each block, in order, with one rounding a step."""
    h, w = image.shape
    at = lambda y, x: f(image[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])

    def slope(v):
        v = max(v, f(0))
        return f(f(field.DEN_MUL * v) * f(v * v)) + field.DEN_OFFSET, f(field.NUM_MUL * f(v * v)) + field.NUM_OFFSET

    cells = np.zeros((h // 4, w // 4), f)
    for cy in range(h // 4):
        for cx in range(w // 4):
            total = f(0)
            for x in range(cx * 4, cx * 4 + 4):
                column = f(0)
                for y in range(cy * 4, cy * 4 + 4):
                    den, num = slope(at(y, x) + field.MATCH_OFFSET)
                    base = f(0.25) * (at(y, x - 1) + at(y, x + 1) + at(y - 1, x) + at(y + 1, x))
                    diff = f(den / num) * (at(y, x) - base)
                    column += f(0.25) * np.sqrt(min(diff * diff, f(0.2)) * field.MASKING + f(28))
                total += column
            cells[cy, cx] = total * f(0.25)
    fuzzy = np.zeros_like(cells)
    for cy in range(h // 4):
        for cx in range(w // 4):
            nine = sorted(cells[min(max(cy + i, 0), h // 4 - 1), min(max(cx + j, 0), w // 4 - 1)] for i in (-1, 0, 1) for j in (-1, 0, 1))
            fuzzy[cy, cx] = f(0.125) * nine[0] + f(0.075) * nine[1] + f(0.06) * nine[2] + f(0.05) * nine[3]
    out = []
    for by in range(h // 8):
        for bx in range(w // 8):
            e = fuzzy[2 * by, 2 * bx] + fuzzy[2 * by, 2 * bx + 1] + fuzzy[2 * by + 1, 2 * bx] + fuzzy[2 * by + 1, 2 * bx + 1]
            total, ratios = f(0), f(0)
            for y in range(by * 8, by * 8 + 8):
                for x in range(bx * 8, bx * 8 + 8):
                    total += abs(at(y, x) - at(y, x + 1)) if x % 8 < 7 else f(0)
                    total += abs(at(y, x) - at(y + 1, x)) if y % 8 < 7 else f(0)
                    den, num = slope(at(y, x) + field.GAMMA_BIAS)
                    ratios += f(num / den)
            v = max(e * field.MASK_MUL0, f(1e-3))
            o = field.MASK_BASE + field.MASK_MUL4 * (f(1) / (v * v + field.MASK_OFFSET4)) + field.MASK_MUL2 * (f(1) / (v + field.MASK_OFFSET2)) + field.MASK_MUL3 * (f(1) / (v * v + field.MASK_OFFSET3))
            o = o + total * field.HF_MUL
            o = o + field.GAMMA * f(np.log2(float(ratios * field.GAMMA_SCALE)))
            mul, add = field.dampening(first_ac)
            out.append((e, ratios, max(f(0.6) / (f(np.exp2(float(o * field.LOG2_E))) * mul + add) - f(1), f(0))))
    return out


@pytest.mark.parametrize("first_ac", [8.0, 30.0])
def test_field_matches_scalars(spark, first_ac):
    rng = np.random.default_rng(3)
    images = {1: rng.integers(0, 256, (16, 64)), 2: np.cumsum(rng.integers(-2, 3, (8, 64)), axis=1) + 100, 3: np.full((24, 64), 7)}
    rows = [(i, by * 8 + bx, [int(v) for v in image[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8].ravel()]) for i, image in images.items() for by in range(image.shape[0] // 8) for bx in range(8)]
    blocks = spark.createDataFrame(rows, "image_id int, n long, s array<int>").repartition(3)
    got = {}
    for r in field.aq_field(blocks, first_ac).orderBy("image_id", "n").collect():
        got.setdefault(r["image_id"], []).append((f(r["fuzzy"]), f(r["ratios"]), f(r["aq_strength"])))
    assert got == {i: scalar_field(image, first_ac) for i, image in images.items()}


def test_flat_image_by_hand():
    """No sample differs from its neighbours, so masking gives a quarter of the root of 28 everywhere."""
    flat = np.full((1, 8, 8), 128, f)
    sides = [np.full((1, 8), 128, f)] * 4
    cells = field.pre_erosion(flat, *sides)
    assert cells == pytest.approx(np.full((1, 2, 2), 16 * 0.25 * 28**0.5 / 4), rel=1e-6)
    grid = np.full((1, 4, 4), cells[0, 0, 0], f)
    assert field.fuzzy_erosion(grid)[0] == pytest.approx(4 * 0.31 * 28**0.5, rel=1e-6)
    differences, ratios = field.texture(flat)
    v = 128 + 0.16 * 255
    k = 0.6931471805599453
    num = 18.6580932135 / 73.377132366608819 * k * 3 * 226.0480446705883 * v * v + 0.01 * 255 * 255
    den = k * 226.0480446705883 / 255 / 255 * v**3 + (7.14672470003 * k + 0.01) * 255
    assert differences[0] == 0 and ratios[0] == pytest.approx(64 * num / den, rel=1e-5)
    assert field.dampening(8.0) == (f(0.841), f(0)) and field.dampening(65.0) == (f(0), f(0.48) * f(0.841))
    assert field.dampening(37.0) == (f(0.841) * f(0.5), f(0.5) * (f(0.48) * f(0.841)))


def test_no_blocks_give_no_field(spark):
    assert field.aq_field(spark.createDataFrame([], "image_id int, n long, s array<int>"), 8.0).count() == 0

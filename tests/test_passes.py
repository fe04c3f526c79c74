"""Two passes over blocks: what the chain of DC values does to what the AC pass leaves."""

from itertools import product

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.operators import rd, transform, trellis
from tessera.plans import numeric, tables

AC, DC = rd.code_array("ac_luma"), rd.code_array("dc_luma")
TABLE = tables.quant_table(tables.IMAGE_MAGICK_LUMA, 60)
SHAPE = "image_id int, by long, bx long, s array<int>, multiplier double"


def row_of_blocks(seed, n):
    rng = np.random.default_rng(seed)
    return np.clip(128 + rng.normal(0, rng.choice([3, 15, 60]), (n, 64)).cumsum(axis=1) / 4 + rng.integers(-90, 90, (n, 1)), 0, 255).astype(int)


def table_of(spark, rows):
    return spark.createDataFrame([(i, y, x, [int(v) for v in s], float(m)) for i, y, x, s, m in rows], SHAPE).repartition(3)


def test_final_blocks_are_the_cheapest_chain_over_the_ac_choice(spark):
    """Every chain of candidates is tried for rows of four blocks."""
    rows, multipliers = [], (1.3, 1.0, 0.8, 1.0)
    for i in range(3):
        for y in range(2):
            rows += [(i, y, x, s, multipliers[x]) for x, s in enumerate(row_of_blocks(10 * i + y, 4))]
    blocks = table_of(spark, rows)
    chosen = {(r["image_id"], r["by"], r["bx"]): r for r in trellis.choose_ac(blocks, TABLE, AC).collect()}
    final = {(r["image_id"], r["by"], r["bx"]): r["z"] for r in trellis.choose_dc(trellis.choose_ac(blocks, TABLE, AC), TABLE[0], DC).collect()}
    q, n = 8 * TABLE[0], trellis.dc_candidates(TABLE[0])
    for i, y in product(range(3), range(2)):
        part = [chosen[i, y, x] for x in range(4)]
        raw = transform.loeffler_dct(np.array([s for a, b, _, s, _ in rows if (a, b) == (i, y)]))
        assert [r["raw_dc"] for r in part] == raw[:, 0].tolist()
        assert [r["weight"] for r in part] == pytest.approx(trellis.block_lambda(raw).tolist())
        for x, r in enumerate(part):
            assert r["z"][1:] == trellis.trellis_ac(raw[x : x + 1], trellis.scaled_table(TABLE, multipliers[x]), AC)[0, 1:].tolist() == final[i, y, x][1:]

        def cost(chain, part=part):
            total, before = 0.0, 0
            for v, r in zip(chain, part, strict=True):
                k = abs(v - before).bit_length()
                total, before = total + DC[k] + k + (v * q - r["raw_dc"]) ** 2 * r["weight"] / TABLE[0] ** 2, v
            return total

        near = [[(1 if r["raw_dc"] >= 0 else -1) * ((abs(r["raw_dc"]) + q // 2) // q + o) for o in range(-(n // 2), n // 2 + 1)] for r in part]
        assert cost([final[i, y, x][0] for x in range(4)]) <= min(map(cost, product(*near))) + 1e-9


def test_passes_without_choices_round(spark):
    rows = [(1, 0, x, s, 1.0) for x, s in enumerate(row_of_blocks(5, 6))]
    blocks = table_of(spark, rows)
    out = trellis.choose_dc(trellis.choose_ac(blocks, TABLE, AC, trellis.ROUNDED), TABLE[0], DC, trellis.ROUNDED)
    raw = transform.loeffler_dct(np.array([s for *_, s, _ in rows]))
    expected = trellis.round_to_table(raw, np.array(TABLE))[:, tables.ZIGZAG]
    assert {r["bx"]: r["z"] for r in out.collect()} == {x: z for x, z in enumerate(expected.tolist())}
    assert trellis.choose_dc(trellis.choose_ac(blocks.limit(0), TABLE, AC), TABLE[0], DC).count() == 0


def test_deringing_and_multipliers_reach_the_transform(spark):
    s = np.where(np.arange(64) % 8 < 4, 255, 40)
    blocks = table_of(spark, [(1, 0, 0, s, 1.0), (1, 0, 1, np.full(64, 9), 1.0)])
    plain, curved = (trellis.choose_ac(blocks, TABLE, AC, deringing=d).orderBy("bx").collect() for d in (False, True))
    assert curved[0]["raw_dc"] == transform.loeffler_dct(trellis.dering(s[None], TABLE[0]) + 128)[0, 0] > plain[0]["raw_dc"]
    assert curved[1]["raw_dc"] == plain[1]["raw_dc"]
    assert trellis.scaled_table([1, 10, 250], 1.3) == [1, 13, 255] and trellis.scaled_table([1, 10, 5], 0.5) == [1, 5, 3]


def test_query_has_all_blocks_of_images(spark):
    got = catalogue.QUERIES["q_trellis_blocks"](spark, DATA)
    assert got.count() > 0 and got.filter("v = 0 OR z < 0 OR z > 63").count() == 0
    flat = spark.createDataFrame([([7] * 64,), ([0, 30] * 32,), ([0, 255] * 32,)], "s array<int>")
    assert [r["multiplier"] for r in numeric._with_multiplier(flat).orderBy(F.col("multiplier").desc()).collect()] == [1.3, 1.0, 0.8]

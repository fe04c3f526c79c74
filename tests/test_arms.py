"""Deringing arms against rate-distortion points, plain loops and SQL."""

import duckdb
import numpy as np
import pytest
from conftest import DATA

from tessera import catalogue
from tessera.operators import arms, rd, transform, trellis
from tessera.plans import tables
from tessera.sources import views


def test_plain_arm_is_that_of_the_points_and_the_other_that_of_deringed_blocks(spark):
    blocks = views.blocks(spark, DATA, 900).filter("image_id IN (2, 5)").select("image_id", "n", "s").cache()
    got = {(r["image_id"], r["quality"]): r for r in arms.dering_arms(blocks, (30, 85)).collect()}
    points = {(r["image_id"], r["q"]): r["bytes"] for r in rd.rd_points(blocks, (30, 85), ("plain",)).collect()}
    assert {k: r["without_bytes"] for k, r in got.items()} == points
    for q in (30, 85):
        table = np.array(tables.quant_table(tables.IMAGE_MAGICK_LUMA, q))
        s = np.array([r["s"] for r in blocks.filter("image_id = 2").orderBy("n").collect()])
        for name, x in (("without", s), ("with", trellis.dering(s, table[0]) + 128)):
            c = transform.integer_dct(x)
            z = np.sign(c) * ((np.abs(c) + (table << 25)) // (table << 26))
            back = np.clip(np.floor(transform.idct(z * table) + 0.5), 0, 255)
            assert got[2, q][f"{name}_error"] == pytest.approx(np.abs(back - s).mean())
            bits, before, dc, ac = 0, 0, rd.code_array("dc_luma"), rd.code_array("ac_luma")
            for row in z[:, tables.ZIGZAG].tolist():
                k, before = abs(row[0] - before).bit_length(), row[0]
                bits += dc[k] + k + rd._ac_bits(np.array([row[1:]]), np.array(ac))
            assert got[2, q][f"{name}_bytes"] == -(-bits // 8)


def test_differences_and_sums_by_sql(spark):
    rows = catalogue.QUERIES["q_dering_ab"](spark, DATA).toPandas()
    assert sorted(set(rows["quality"])) == list(arms.QUALITIES) and len(rows) == 5 * rows["image_id"].nunique()
    assert (rows["with_bytes"] != rows["without_bytes"]).any()
    con = duckdb.connect()
    con.register("r", rows)
    off = con.execute("SELECT count(*) FROM r WHERE abs(size_diff_pct - 100.0 * (with_bytes - without_bytes) / without_bytes) > 1e-5 OR abs(error_diff - (with_error - without_error)) > 3e-6").fetchall()
    assert off == [(0,)]
    want = con.execute("SELECT quality, image_id, count(*), avg(size_diff_pct), avg(error_diff), sum(CASE WHEN error_diff < 0 THEN 1 ELSE 0 END) FROM r GROUP BY GROUPING SETS ((quality), (image_id), ())").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    got = sorted((tuple(r) for r in catalogue.QUERIES["q_dering_ab_summary"](spark, DATA).collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[5] == b[5] and a[3:5] == pytest.approx(b[3:5], abs=1e-5)


def test_no_blocks_have_no_arms(spark):
    none = spark.createDataFrame([], "image_id int, n long, s array<int>")
    assert arms.dering_arms(none).count() == 0

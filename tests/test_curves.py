"""Clusters of curves against all pairs, and how much is compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import curves

THRESHOLD = 0.10


def families(seed, n, groups):
    """Curves of ten values, some groups with many alike."""
    rng = np.random.default_rng(seed)
    centres = np.exp(rng.normal(0, 0.35, (groups, 10)))
    which = np.minimum(rng.geometric(0.15, n) - 1, groups - 1)
    return centres[which] * np.exp(rng.normal(0, 0.06, (n, 10)))


def gap(a, b):
    with np.errstate(invalid="ignore"):
        return np.where(a == b, 0, np.abs(a - b) / ((a + b) / 2)).mean(axis=-1)


def one_by_one(ids, v):
    """Each curve's leader, in the order of ids."""
    leaders, out = [], {}
    for k in np.argsort(ids):
        near = [m for m in leaders if gap(v[m], v[k]) < THRESHOLD]
        out[int(ids[k])] = int(ids[near[0]]) if near else int(ids[k])
        if not near:
            leaders.append(k)
    return out


def table(spark, ids, v):
    rows = [(int(i), [float(x) for x in c]) for i, c in zip(ids, v, strict=True)]
    return curves.in_cells(spark.createDataFrame(rows, "image_id int, v array<double>"), THRESHOLD, 10).cache()


@pytest.mark.parametrize("heads", [2, 64])
def test_leaders_are_those_of_one_pass_over_all(spark, heads):
    v = families(1, 160, 9)
    v[20], v[21] = v[20] * 0, v[20] * 0  # curves of nothing but zeros
    v[22, 3] = 0
    ids = np.random.default_rng(2).permutation(1000)[: len(v)]
    cells = table(spark, ids, v)
    led = curves.leaders(cells, THRESHOLD, heads)
    got = {r["image_id"]: r["cluster"] for r in curves.clusters(cells, led, THRESHOLD).collect()}
    assert got == one_by_one(ids, v)


def test_pairs_are_all_that_are_near(spark):
    v, ids = families(3, 300, 25), np.arange(300)
    got = {(r["image_a"], r["image_b"]) for r in curves.near_pairs(table(spark, ids, v), THRESHOLD).collect()}
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if gap(v[a], v[b]) < THRESHOLD}


def test_near_curves_lie_in_neighbouring_cells():
    """The bound behind the grid, at its worst: one value takes all the difference."""
    w = curves.width_of(THRESHOLD, 10)
    rng = np.random.default_rng(4)
    for _ in range(2000):
        a = np.exp(rng.normal(0, 1, 10))
        b = a * np.exp(rng.normal(0, rng.choice([0.05, 0.15]), 10) * (rng.random(10) < rng.choice([0.1, 0.5, 1])))
        b[0] = a[0] * np.exp(rng.choice([0, 0.9, 1.09]))
        if gap(a, b) < THRESHOLD:
            assert np.abs(np.log(a) - np.log(b)).sum() < w
    with pytest.raises(ValueError):
        curves.width_of(0.2, 10)


def test_comparisons_grow_with_curves_not_with_pairs(spark):
    """Five times the curves of the same families: the pairs grow by 25, leaders hardly, and so what is compared by about five."""
    compared = []
    for n in (200, 1000):
        v, ids = families(5, n, 12), np.arange(n)
        cells = table(spark, ids, v)
        led = curves.leaders(cells, THRESHOLD)
        compared.append(cells.join(curves._around(led, "leader"), ["cx", "cy"]).count())
        assert cells.count() == curves.clusters(cells, led, THRESHOLD).count()
    assert compared[1] < 9 * compared[0] and compared[1] < 1000 * 999 / 2 / 5


def test_no_curves_have_no_leaders(spark):
    none = spark.createDataFrame([], "image_id int, v array<double>")
    cells = curves.in_cells(none, THRESHOLD, 10)
    assert curves.leaders(cells, THRESHOLD).count() == 0
    points = spark.createDataFrame([(1, 40, 2.0, 3.0), (1, 20, 1.0, 5.0)], "image_id int, q int, bpp double, metric double")
    assert curves.curves_of(points, "bpp", "metric").first()["v"] == [1.0, 2.0, 5.0, 3.0]
    assert curves.curves_of(points.filter(F.lit(False)), "bpp", "metric").count() == 0

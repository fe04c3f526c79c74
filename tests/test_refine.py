"""Refinement tokens against loops that go block by block, coefficient by coefficient."""

import numpy as np
import pytest

from tessera.operators import refine


def sparse_blocks(seed, n):
    rng = np.random.default_rng(seed)
    share = rng.choice([0.0, 0.0, 0.02, 0.1, 0.6, 1.0], n)
    z = rng.integers(-6, 7, (n, 64)) * (rng.random((n, 64)) < share[:, None])
    z[rng.random(n) < 0.1] = 4  # blocks of known values alone
    z[:, 0] = rng.integers(-50, 50, n)
    return z


class Scan:
    """Sends tokens as (n, symbol, bits, extra)."""

    def __init__(self, longest):
        self.longest, self.out, self.run = longest, [], 0

    def end(self, n, bits=""):
        if self.run:
            size = self.run.bit_length() - 1
            self.out.append((n, size << 4, bits, self.run - (1 << size)))
        self.run = 0


def replayed(blocks, first, last, high, low, longest):
    s, waiting, at = Scan(longest), "", 0
    for n, z in enumerate(blocks):
        size = [abs(int(v)) for v in z]
        if not any(size[k] >> high or size[k] >> low & 1 for k in range(first, last + 1)):
            if waiting:
                s.end(at, waiting)
                waiting = ""
            s.run, at = s.run + 1, n
            if s.run == longest:
                s.end(n, waiting)
            continue
        s.end(at, waiting)
        run, bits = 0, ""
        for k in range(first, last + 1):
            if size[k] >> high:
                bits += str(size[k] >> low & 1)
            elif size[k] >> low & 1:
                while run >= 16:
                    s.out.append((n, 0xF0, bits, 0))
                    run, bits = run - 16, ""
                s.out.append((n, run << 4 | 1, ("0" if z[k] < 0 else "1") + bits, 0))
                run, bits = 0, ""
            else:
                run += 1
        waiting = bits
        if run or waiting:
            s.run, at = s.run + 1, n
    s.end(at, waiting)
    return s.out


def direct(blocks, first, last, high, low, longest, runs):
    s, at = Scan(longest), 0
    for n, z in enumerate(blocks):
        run, bits = 0, ""
        for k in range(first, last + 1):
            v, size = int(z[k]), abs(int(z[k]))
            if v >> high:
                bits += str(size >> low & 1)
            elif size >> low == 1:
                s.end(at)
                s.out.append((n, run << 4 | 1, ("0" if v < 0 else "1") + bits, 0))
                run, bits = 0, ""
            else:
                run += 1
                if run == 16:
                    s.end(at)
                    s.out.append((n, 0xF0, bits, 0))
                    run, bits = 0, ""
        if run:
            s.run, at = s.run + 1, n
            if not runs or s.run == longest:
                s.end(n, bits)
        elif bits:
            s.end(at, bits)
    s.end(at)
    return s.out


@pytest.fixture(scope="module")
def images():
    return {i: sparse_blocks(i, n) for i, n in ((1, 90), (2, 40), (3, 1))}


@pytest.fixture(scope="module")
def blocks(spark, images):
    rows = [(i, n, [int(v) for v in z]) for i, b in images.items() for n, z in enumerate(b)]
    return spark.createDataFrame(rows, "image_id int, n long, z array<long>").repartition(3).cache()


def found(tokens):
    got = {}
    for r in tokens.orderBy("image_id", "n", "seq").collect():
        got.setdefault(r["image_id"], []).append((r["n"], r["symbol"], r["bits"], r["extra"]))
    return got


@pytest.mark.parametrize(("scan", "longest"), [((1, 63, 1, 0), 0x7FFF), ((1, 63, 2, 1), 4), ((6, 40, 2, 1), 3)])
def test_tokens_match_plain_loops(monkeypatch, blocks, images, scan, longest):
    monkeypatch.setattr(refine, "LONGEST_RUN", longest)
    want = lambda f, *more: {i: out for i, b in images.items() if (out := f(b, *scan, longest, *more))}
    assert found(refine.tokens_replayed(blocks, *scan)) == want(replayed)
    assert found(refine.tokens_direct(blocks, *scan)) == want(direct, True)
    assert found(refine.tokens_direct(blocks, *scan, runs=False)) == want(direct, False)


def test_no_blocks_give_no_tokens(blocks):
    assert refine.tokens_replayed(blocks.limit(0), 1, 63, 1, 0).count() == 0


@pytest.mark.parametrize("tokens", [refine.tokens_replayed, refine.tokens_direct])
def test_blocks_are_folded_once_for_tokens_and_once_for_ends(spark, blocks, tokens):
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 24)
    plan = tokens(blocks, 1, 63, 1, 0)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.maxPlanStringLength")
    # a fold has three: the code of a place, the step and what is left at the end
    assert plan.count("lambdafunction(") == 2 * 3

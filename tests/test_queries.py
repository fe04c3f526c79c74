"""Every query against its SQL, and those without one against rules they must keep."""

import __spark_entry__
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.operators import huffman, rd, tokens, transform, trellis
from tessera.plans import numeric, tables
from tessera.plans.scans import script
from tessera.sources import images, jpeg, progressive, views


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    expected = duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and len(got) == len(expected)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and all(r["bits"] > 0 for r in rows)


def test_fixture_of_the_slice(spark):
    """Tokens and bits at sf0.01, as DuckDB gave them, with the last row of blocks filled up."""
    got = {r["image_id"]: (r["tokens"], r["bits"]) for r in catalogue.QUERIES["q_scan_bits"](spark, "/root/testdata/sf0.01").collect()}
    assert got[0] == (2020, 9321) and got[3] == (2335, 10657) and got[9] == (2022, 9308)


def test_every_row_is_a_block(spark):
    b = views.blocks(spark, DATA)
    assert b.select("vec_id").distinct().count() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert b.groupBy("image_id").count().filter("count % 8 <> 0").count() == 0


def test_points_of_batches_match_block_by_block(spark):
    """Bits and errors against plain loops over the symbols of each block."""
    b = views.blocks(spark, DATA).filter("image_id = 4").select("image_id", "n", "s")
    rows = b.orderBy("n").collect()
    c = transform.integer_dct(np.array([r["s"] for r in rows]))[:, tables.ZIGZAG]
    ac, dc = rd.code_array("ac_luma"), rd.code_array("dc_luma")
    for r in rd.rd_points(b, (10, 77, 100)).collect():
        table, least = (np.array([t[k] for k in tables.ZIGZAG]) for t in (tables.quant_table(tables.IMAGE_MAGICK_LUMA, r["q"]), rd.thresholds(r["codec"])))
        bits = before = 0
        for z in rd._quantised(c, table, least).tolist():
            for symbol, size in [(abs(z[0] - before).bit_length(),) * 2]:
                bits, before = bits + dc[symbol] + size, z[0]
            run = 0
            for v in z[1:]:
                if v:
                    bits += run // 16 * ac[0xF0] + ac[run % 16 * 16 + abs(v).bit_length()] + abs(v).bit_length()
                run = 0 if v else run + 1
            bits += ac[0] if run else 0
        assert (r["bytes"], r["blocks"]) == ((bits + 7) // 8, len(rows))


def test_zigzag_is_a_permutation_along_diagonals():
    assert sorted(tables.ZIGZAG) == list(range(64))
    assert tables.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and tables.ZIGZAG[-3:] == [55, 62, 63]


def random_blocks(seed, n=40):
    return np.random.default_rng(seed).integers(0, 256, (n, 64))


def test_transforms_agree_and_invert():
    s = random_blocks(1)
    c = transform.integer_dct(s) / (1 << 26)
    assert np.abs(transform.loeffler_dct(s) / 8 - c).max() < 0.2
    assert np.abs(transform.idct(c) - s).max() < 0.05
    flat = transform.loeffler_dct(np.full((1, 64), 200))
    assert flat[0, 0] == 72 * 64 and not flat[0, 1:].any()


def kraft(lengths):
    return sum(2.0**-n for n in lengths.values())


def test_code_lengths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 30, 200):
        counts = dict(enumerate((rng.pareto(0.5, n) * 5 + 1).astype(int).tolist()))
        lengths = huffman.code_lengths(counts)
        assert set(lengths) == set(counts) and max(lengths.values()) <= 16 and kraft(lengths) < 1
        floor = huffman.two_pointer_lengths(counts)
        assert max(floor.values()) <= 16 and (n < 2 or abs(kraft(floor) - 1) < 1e-9)
    steep = {i: 2**i for i in range(30)}
    assert max(huffman.code_lengths(steep).values()) == 16
    assert huffman.code_lengths({}) == {}


def test_optimal_tables_beat_the_standard_ones(spark):
    t = numeric._lengths(spark, DATA).filter("is_dc = 0").collect()
    standard = rd.code_array("ac_luma")
    assert sum(r["n"] * r["len"] for r in t) <= sum(r["n"] * standard[r["symbol"]] for r in t)


def test_tables_of_components(spark):
    h = numeric._component_histogram(spark, DATA)
    total = h.agg(F.sum("n")).first()[0]
    slots = huffman.clustered_slots(h, "image_id", "comp", 2, 2)
    images_found = h.select("image_id").distinct().count()
    rows = slots.collect()
    assert len(rows) == 6 * images_found
    for image in {r["image_id"] for r in rows}:
        dc, ac = ([r["slot"] for r in rows if r["image_id"] == image and r["is_dc"] == d] for d in (1, 0))
        assert min(dc) == 0 and min(ac) == max(dc) + 1 and len(set(dc)) <= 2 and len(set(ac)) <= 2
    for found in (huffman.slot_tables(h, slots, "image_id", "comp"), huffman.luma_chroma_tables(h, "image_id", "comp")):
        t = found.toPandas()
        key = [c for c in t.columns if c not in ("symbol", "n", "len")]
        assert t["n"].sum() == total and t["len"].between(1, 16).all()
        assert (t.assign(share=0.5 ** t["len"]).groupby(key)["share"].sum() < 1).all()  # the code of ones stays free
    assert set(huffman.luma_chroma_tables(h.filter("comp = 0"), "image_id", "comp").toPandas()["chroma"]) == {0}


def test_halved_chroma_comes_back(spark):
    components = views.component_blocks(spark, DATA)
    halved = views.halved_chroma(components).toPandas()
    whole = components.toPandas()
    for image, part in whole.groupby("image_id"):
        mine = halved[halved["image_id"] == image]
        plane = lambda f, c, across: np.vstack([np.hstack([np.reshape(s, (8, 8)) for s in row]) for row in np.array(f[f["comp"] == c].sort_values("n")["s"].tolist()).reshape(-1, across, 64)])
        luma = plane(part, 0, 8)
        assert (plane(mine, 0, 8)[: len(luma)] == luma).all() and len(plane(mine, 0, 8)) % 16 == 0
        chroma = plane(part, 1, 8)
        chroma = np.vstack([chroma, *[chroma[-1:]] * (-len(chroma) % 16)]).astype(int)
        means = (chroma[::2, ::2] + chroma[::2, 1::2] + chroma[1::2, ::2] + chroma[1::2, 1::2] + 2) // 4
        assert (plane(mine, 1, 4) == means).all()
    blocks = views.quantised_components(spark, DATA, halved=True)
    for optimise in (True, False):
        streams = jpeg.encode_colour_images(blocks, numeric._KK_75, optimise, 4, 2)
        back = {(r["image_id"], r["comp"], r["n"]): r["z"] for r in jpeg.decode_components(streams).collect()}
        assert back == {(r["image_id"], r["comp"], r["n"]): r["z"] for r in blocks.collect()}
    head = dict(jpeg.segments(bytes(streams.first()["payload"])))
    assert head[0xC0][5] == 3 and head[0xC0][7] == 0x22 and head[0xC0][10] == 0x11


def test_trellis_never_costs_more_than_rounding():
    table, lengths = tables.quant_table(tables.IMAGE_MAGICK_LUMA, 40), rd.code_array("ac_luma")
    raw = transform.loeffler_dct(np.clip(random_blocks(3) // 3 + 60, 0, 255))
    best = trellis.trellis_ac(raw, table, lengths)
    plain = trellis.round_to_table(raw, np.array(table))[:, tables.ZIGZAG]
    plain = np.clip(plain, -1023, 1023)
    assert (trellis.block_cost(best, raw, table, lengths) <= trellis.block_cost(plain, raw, table, lengths) + 1e-6).all()
    assert (best[:, 0] == plain[:, 0]).all()


def test_trellis_finds_the_cheapest_of_all():
    """Against every choice of candidates on blocks with four values."""
    from itertools import product

    table, lengths = tables.quant_table(tables.IMAGE_MAGICK_LUMA, 30), rd.code_array("ac_luma")
    rng = np.random.default_rng(5)
    for _ in range(10):
        raw = np.zeros((1, 64), np.int64)
        places = np.sort(rng.choice(np.arange(1, 64), 4, replace=False))
        for p in places:
            k = tables.ZIGZAG[p]
            raw[0, k] = int(rng.integers(-4, 5)) * 8 * table[k] + int(rng.integers(-40, 41))
        options = []
        for p in places:
            k = tables.ZIGZAG[p]
            top = (abs(raw[0, k]) + 4 * table[k]) // (8 * table[k])
            sign = -1 if raw[0, k] < 0 else 1
            options.append(sorted({0, *(sign * min(top, 2**b - 1) for b in range(1, int(top).bit_length())), sign * top}))
        costs = []
        for choice in product(*options):
            z = np.zeros((1, 64), np.int64)
            z[0, places] = choice
            costs.append(trellis.block_cost(z, raw, table, lengths)[0])
        got = trellis.block_cost(trellis.trellis_ac(raw, table, lengths), raw, table, lengths)[0]
        assert got <= min(costs) + 1e-9


def test_dc_chain_is_the_cheapest_of_all():
    from itertools import product

    raw, step, lengths = transform.loeffler_dct(random_blocks(6, 4)), 50, rd.code_array("dc_luma")
    got = trellis.trellis_dc(raw, step, lengths)
    n, q = trellis.dc_candidates(step), 8 * step
    weight = trellis.block_lambda(raw) / step**2

    def cost(chain):
        total, before = 0.0, 0
        for i, v in enumerate(chain):
            k = abs(int(v) - before).bit_length()
            total += lengths[k] + k + (int(v) * q - int(raw[i, 0])) ** 2 * weight[i]
            before = int(v)
        return total

    near = [[int(np.sign(r[0]) or 1) * ((abs(int(r[0])) + q // 2) // q + o) for o in range(-(n // 2), n // 2 + 1)] for r in raw]
    assert cost(got) <= min(map(cost, product(*near))) + 1e-9


def test_deringing_touches_only_the_top():
    s = np.where(random_blocks(7) > 128, 255, random_blocks(7))
    out = trellis.dering(s, 16)
    same = out == s - 128
    assert (s[~same] == 255).all() and out.max() <= 127 + 31 and (out[s == 255] >= 127).any()
    full = np.full((1, 64), 255)
    assert (trellis.dering(full, 16) == 127).all()


def test_emptied_blocks_never_cost_more():
    lengths = rd.code_array("ac_luma")
    assert trellis.zero_blocks([0.1, 50.0, 0.1], [30.0, 2.0, 30.0], [1, 1, 1], lengths) == [True, False, True]
    assert trellis.zero_blocks([0.0, 0.0], [0.0, 0.0], [2, 2], lengths) == [True, True]


def test_emptied_blocks_are_the_cheapest_choice_of_all():
    from itertools import product

    lengths, rng = rd.code_array("ac_luma"), np.random.default_rng(9)

    def cost(emptied, empty, full, status):
        total, run = 0.0, 0
        bits = lambda r: 0.0 if not r else (lengths[16 * (r.bit_length() - 1)] or 16) + r.bit_length() - 1
        for gone, e, f, s in zip(emptied, empty, full, status, strict=True):
            if gone:
                total, run = total + (0.0 if s == 2 else e), run + 1
            else:
                total, run = total + bits(run) + f, int(s == 1)
        return total + bits(run)

    for _ in range(40):
        status = rng.integers(0, 3, 7).tolist()
        empty, full = (rng.uniform(0, 30, 7).tolist() for _ in range(2))
        options = [c for c in product([False, True], repeat=7) if all(gone or s != 2 for gone, s in zip(c, status, strict=True))]
        got = trellis.zero_blocks(empty, full, status, lengths)
        assert cost(got, empty, full, status) <= min(cost(c, empty, full, status) for c in options) + 1e-9


def test_band_costs_agree_with_the_values_chosen():
    table, lengths = tables.quant_table(tables.IMAGE_MAGICK_LUMA, 40), rd.code_array("ac_luma")
    raw = transform.loeffler_dct(np.clip(random_blocks(3) // 3 + 60, 0, 255))
    raw[0, 1:] = 0
    whole = trellis.trellis_band(raw, table, lengths)
    z = trellis.trellis_ac(raw, table, lengths)
    assert (whole.z[:, 1:] == z[:, 1:]).all() and not whole.z[:, 0].any()
    np.testing.assert_allclose(whole.cost, trellis.block_cost(z, raw, table, lengths))
    np.testing.assert_allclose(whole.zero_cost, trellis.block_cost(np.zeros_like(z), raw, table, lengths) - lengths[0])
    np.testing.assert_allclose(whole.cost - whole.skip_cost, np.where(whole.status == 0, 0, lengths[0]))
    assert whole.status[0] == 2 and (whole.status == 2).tolist() == (~whole.z.any(axis=1)).tolist()
    for first, last in ((1, 5), (6, 63)):
        part = trellis.trellis_band(raw, table, lengths, first, last)
        assert not part.z[:, :first].any() and not part.z[:, last + 1 :].any()
        assert ((part.status == 0) == (part.z[:, last] != 0)).all()
        assert (part.cost <= part.zero_cost + lengths[0] + 1e-9).all() and (part.skip_cost <= part.cost + 1e-9).all()


def test_settings_without_a_search_round(spark):
    blocks = numeric._loeffler(spark, DATA)
    lengths, table = rd.code_array("ac_luma"), numeric._LUMA_75
    z = trellis.quantise_trellis(blocks.withColumn("copy", F.col("raw")), table, lengths, trellis.ROUNDED).limit(50).collect()
    assert all((trellis.round_to_table(np.array([r["copy"]]), np.array(table))[0, tables.ZIGZAG] == r["z"]).all() for r in z)
    costs = trellis.band_costs(blocks, table, lengths, [(1, 63)])
    plain = trellis.empty_in_rows(costs, lengths, trellis.ROUNDED)
    assert plain.count() == blocks.count() and plain.filter("emptied <> (status = 2)").isEmpty()
    assert trellis.empty_in_rows(costs, lengths).filter("status = 2 AND NOT emptied").isEmpty()


def test_stream_decodes_to_the_same_blocks():
    rng = np.random.default_rng(9)
    parts = [[np.where(rng.random(64) < 0.2, rng.integers(-60, 60, 64), 0) for _ in range(6)] for _ in range(3)]
    q = tables.quant_table(tables.ANNEX_K_LUMA, 80)
    for optimise, restart in ((True, 0), (False, 0), (True, 2)):
        stream = jpeg.assemble(parts, 24, 16, [q, q, q], optimise, restart, icc=b"XYB" + bytes(70_000))
        assert stream.startswith(jpeg.SOI) and stream.endswith(jpeg.EOI)
        width, height, back = jpeg.decode(stream)
        assert (width, height) == (24, 16)
        assert all((a == b).all() for c, d in zip(parts, back, strict=True) for a, b in zip(c, d, strict=True))
        assert jpeg.extract_icc(stream) == b"XYB" + bytes(70_000) and jpeg.is_xyb_profile(jpeg.extract_icc(stream))
        assert {(t, k): v for t, k, v in jpeg.read_dqt(stream)} == {(t, k): q[k] for t in range(3) for k in range(64)}


def test_sizes_match_the_packed_stream(spark):
    """Bits counted on tables are those of the packed scan."""
    b = views.quantised(spark, DATA).select("image_id", "n", "z")
    bits = {r["image_id"]: r["bits"] for r in tokens.scan_bits(b).collect()}
    codes = [jpeg._wire_codes(*tables.STANDARD_CODES[t]) for t in ("dc_luma", "ac_luma")]
    rows = b.filter("image_id = 3").orderBy("n").collect()
    raw = jpeg.scan_bytes([(0, np.array(r["z"])) for r in rows], [(codes[1], codes[0])])
    assert len(raw.replace(b"\xff\x00", b"\xff")) == -(-bits[3] // 8)


def test_images_are_read(spark, tmp_path):
    rgb = np.random.default_rng(4).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.write_png(rgb))
    (tmp_path / "b.png").write_bytes(images.write_png(rgb[..., :1]))
    (tmp_path / "c.png").write_bytes(b"no image")
    (tmp_path / "d.txt").write_text("no image")
    loaded = images.load_images(images.find_images(spark, str(tmp_path))).orderBy("path").collect()
    assert [(r["width"], r["height"], r["error_code"] is None) for r in loaded] == [(7, 5, True), (7, 5, True), (None, None, False)]
    assert bytes(loaded[0]["payload"]) == rgb.tobytes()
    px = images.pixels_of(images.load_images(images.find_images(spark, str(tmp_path)))).filter(F.col("path").endswith("a.png"))
    assert {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in px.collect()} == {(y, x): tuple(int(v) for v in rgb[y, x]) for y in range(5) for x in range(7)}


def test_png_filters():
    import zlib

    rgb = np.random.default_rng(5).integers(0, 256, (5, 6, 3)).astype(np.int64)
    lines = b""
    for y in range(5):
        up = rgb[y - 1] if y else np.zeros((6, 3), np.int64)
        left = np.vstack([np.zeros((1, 3), np.int64), rgb[y][:-1]])
        corner = np.vstack([np.zeros((1, 3), np.int64), up[:-1]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, near][y]
        lines += bytes([y]) + ((rgb[y] - guess) & 255).astype(np.uint8).tobytes()
    plain = images.write_png(rgb.astype(np.uint8))
    at = plain.index(b"IDAT")
    body = zlib.compress(lines)
    data = plain[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + bytes(4) + plain[plain.index(b"IEND") - 4 :]
    assert (images.read_png(data) == rgb).all()


def test_stream_of_rows_equals_the_batch(spark):
    got = {(r["image_id"], r["band"] * 8 + r["bx"]): (r["dc"], r["nonzero"]) for r in catalogue.QUERIES["q_band_stream"](spark, DATA).collect()}
    b = numeric._loeffler(spark, DATA).select("image_id", "n", "raw").collect()
    quant, before, expected = np.array(numeric._LUMA_75), {}, {}
    for r in sorted(b, key=lambda r: (r["image_id"], r["n"])):
        z = trellis.round_to_table(np.array([r["raw"]]), quant)[0]
        expected[r["image_id"], r["n"]] = (int(z[0]) - before.get(r["image_id"], 0), int((z[1:] != 0).sum()))
        before[r["image_id"]] = int(z[0])
    assert got == expected


def test_curves_are_written(spark, tmp_path):
    points = rd.rd_points(views.blocks(spark, DATA).filter("image_id < 2"), (20, 80), ("plain",))
    images.write_curves(points, str(tmp_path / "curves"))
    assert spark.read.option("header", True).csv(str(tmp_path / "curves")).columns == ["image_id", "20_bpp", "20_metric", "80_bpp", "80_metric"]
    images.write_front(points, points.limit(1), str(tmp_path / "front"))
    assert spark.read.json(str(tmp_path / "front/front")).count() == 1


def test_validation(spark):
    df = spark.createDataFrame([(1, 1, b"x"), (0, 5, b"x"), (70000, 5, b"x"), (8, 8, None)], "width int, height int, payload binary")
    assert [r["error_code"] for r in jpeg.validated(df).collect()] == [None, "INVALID_DIMENSIONS", "INVALID_DIMENSIONS", "MISSING_PAYLOAD"]


@pytest.mark.parametrize("density", [0, 0.02, 0.2, 0.7])
def test_progressive_streams_decode(density):
    rng, q = np.random.default_rng(11), tables.quant_table(tables.ANNEX_K_LUMA, 80)
    for n in (1, 3):
        parts = [[np.where(rng.random(64) < density, rng.integers(-90, 90, 64), 0) for _ in range(24)] for _ in range(n)]
        for kind in ("minimal", "simple", "standard"):
            width, height, back = progressive.decode(progressive.assemble(parts, 48, 32, [q] * n, script(kind, n)))
            assert (width, height) == (48, 32)
            assert all((a == b).all() for c, d in zip(parts, back, strict=True) for a, b in zip(c, d, strict=True))


def test_runs_of_empty_blocks_are_capped():
    blocks = [np.zeros(64, np.int64)] * 40_000
    runs = [t for t in progressive.ac_first(blocks, 1, 63, 0) if t[0] is not None]
    assert [(1 << (s >> 4)) + v for s, _, v in runs] == [0x7FFF, 40_000 - 0x7FFF]

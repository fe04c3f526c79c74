"""Queries over steps that have one order within a block, a table or an image."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import colour, quality
from tessera.functions.colour import num
from tessera.operators import arms, curves, field, huffman, rd, tokens, transform, trellis
from tessera.plans import analysis, rates, tables
from tessera.plans.scans import script
from tessera.plans.registry import Registry
from tessera.sources import images, jpeg, limits, progressive, views
from tessera.sources.scratch import kept as _kept
from tessera.sources.scratch import shared_dir

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle
_LUMA_75 = tables.quant_table(tables.IMAGE_MAGICK_LUMA, 75)
#: Curves nearer than this are alike.
CURVE_SIMILARITY = 0.10
_AC, _DC = rd.code_array("ac_luma"), rd.code_array("dc_luma")


def _loeffler(spark, sf_dir, gain=views.GAIN):
    return transform.map_blocks(views.blocks(spark, sf_dir, gain), "s", "raw", "long", transform.loeffler_dct)


def _loeffler_pass(source: str, by: str, at: str, first: bool) -> str:
    """One pass of the integer transform over the eight values ``s`` of each ``by``, as rows of (at, s); DuckDB text."""
    fix = lambda v: int(v * 8192 + 0.5)
    half, unit = (1024, 11) if first else (16384, 15)
    down = lambda e: f"(({e}) + {half}) >> {unit}"
    flat = lambda e: f"({e}) * 4" if first else f"({e} + 2) >> 2"
    names = "abcdefgh"
    row = f"SELECT image_id, n, {by}, " + ", ".join(f"max(CASE WHEN {at} = {i} THEN s END) AS {c}" for i, c in enumerate(names)) + f" FROM {source} GROUP BY image_id, n, {by}"
    # sums and differences of opposite values
    sums = f"SELECT image_id, n, {by}, a + h AS s0, b + g AS s1, c + f AS s2, d + e AS s3, a - h AS t0, b - g AS t1, c - f AS t2, d - e AS t3 FROM ({row})"
    parts = f"SELECT *, ((s1 - s2) + (s0 - s3)) * {fix(0.541196100)} AS z, ((t3 + t1) + (t2 + t0)) * {fix(1.175875602)} AS z5, (t3 + t0) * -{fix(0.899976223)} AS m1, (t2 + t1) * -{fix(2.562915447)} AS m2 FROM ({sums})"
    parts = f"SELECT *, (t3 + t1) * -{fix(1.961570560)} + z5 AS m3, (t2 + t0) * -{fix(0.390180644)} + z5 AS m4 FROM ({parts})"
    out = [
        flat("(s0 + s3) + (s1 + s2)"),
        down(f"t0 * {fix(1.501321110)} + m1 + m4"),
        down(f"z + (s0 - s3) * {fix(0.765366865)}"),
        down(f"t1 * {fix(3.072711026)} + m2 + m3"),
        flat("(s0 + s3) - (s1 + s2)"),
        down(f"t2 * {fix(2.053119869)} + m2 + m4"),
        down(f"z - (s1 - s2) * {fix(1.847759065)}"),
        down(f"t3 * {fix(0.298631336)} + m1 + m3"),
    ]
    return f"SELECT image_id, n, {by}, unnest(range(8)) AS u, unnest([{', '.join(out)}]) AS s FROM ({parts})"


LOEFFLER = f"""{views.duck('px')}, level AS (SELECT image_id, y // 8 * 8 + x // 8 AS n, y % 8 AS y, x % 8 AS x, v - 128 AS s FROM px),
across AS ({_loeffler_pass('level', 'y', 'x', True)}),
down AS ({_loeffler_pass('(SELECT image_id, n, u AS v, y, s FROM across)', 'v', 'y', False)})
SELECT image_id, n, CAST(u * 8 + v AS INTEGER) AS k, s AS c FROM down"""


@_R.frame("q_dct_loeffler", LOEFFLER)
def _dct(spark, sf_dir):
    return _loeffler(spark, sf_dir).select("image_id", "n", F.posexplode("raw").alias("k", "c"))


# The integer transform stays within one unit, at its scale of 8, of the basis form.
@_R.frame("q_dct_agreement", f"{views.duck('coef')}\nSELECT count(DISTINCT image_id * 100000 + n) AS blocks, count(*) AS coefficients, true AS within_one FROM coef")
def _agree(spark, sf_dir):
    pair = transform.map_blocks(views.blocks(spark, sf_dir).withColumn("copy", F.col("s")), "s", "raw", "long", transform.loeffler_dct)
    pair = transform.map_blocks(pair, "copy", "c", "long", transform.integer_dct)
    worst = F.aggregate(F.zip_with("raw", "c", lambda r, c: F.abs(r - c / (1 << 23))), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return pair.select(worst.alias("worst")).agg(F.count(F.lit(1)).alias("blocks"), (F.count(F.lit(1)) * 64).alias("coefficients"), (F.max("worst") <= 1.5).alias("within_one"))


_IDCT = "cosine AS (SELECT u, x, (CASE WHEN u = 0 THEN sqrt(0.125e0) ELSE 0.5e0 END) * cos((2 * x + 1) * u * pi() / 16) AS w FROM range(8) AS a(u), range(8) AS b(x))"


@_R.frame(
    "q_idct_mse",
    f"""{views.duck('qz', 'px')}, {_IDCT},
deq AS (SELECT image_id, n, k, v * q AS c FROM qz JOIN zigzag USING (z) JOIN quant USING (k)),
cols AS (SELECT image_id, n, k // 8 AS u, x, sum(c * w) AS t FROM deq JOIN cosine ON cosine.u = k % 8 GROUP BY ALL),
back AS (SELECT image_id, n, c.x AS y, cols.x AS x, sum(t * w) + 128 AS s FROM cols JOIN cosine c USING (u) GROUP BY ALL)
SELECT back.image_id AS image_id, round(avg((s - v) * (s - v)), 4) AS mse, round(avg(abs(s - v)), 4) AS mae, round(10 * log10(65025 / avg((s - v) * (s - v))), 4) AS psnr
FROM back JOIN px ON px.image_id = back.image_id AND px.y = n // 8 * 8 + back.y AND px.x = n % 8 * 8 + back.x GROUP BY back.image_id""",
)
def _mse(spark, sf_dir):
    b = views.blocks(spark, sf_dir).select("image_id", "n", "s", F.col("s").alias("original"))
    b = transform.quantise(transform.dct_blocks(b), _LUMA_75)
    q = tables.longs([_LUMA_75[k] for k in tables.ZIGZAG])
    place = tables.longs([tables.ZIGZAG.index(k) for k in range(64)])
    b = b.withColumn("c", F.transform(place, lambda i: F.get(F.zip_with("z", q, lambda v, s: v * s), i.cast("int"))))
    b = transform.map_blocks(b.drop("z"), "c", "back", "double", transform.idct)
    errors = b.select("image_id", F.explode(F.zip_with("back", "original", lambda x, y: x - y)).alias("e"))
    mse = F.avg(F.col("e") * F.col("e"))
    return errors.groupBy("image_id").agg(F.round(mse, 4).alias("mse"), F.round(F.avg(F.abs("e")), 4).alias("mae"), F.round(10 * F.log10(65025 / mse), 4).alias("psnr"))


# The two lightest trees merge until one is left; the log names every symbol once for each merge it takes part in.
# Lengths are dealt in order, without the longest one of all. At this size no code needs to be shortened to 16 bits.
def _merged(tokens_sql: str, keys: str) -> str:
    """``coded``: keys, symbol, n and len of the relation ``tok`` (keys, symbol) that ``tokens_sql`` ends with."""
    return f"""{tokens_sql.replace("WITH ", "WITH RECURSIVE ", 1)},
hist AS MATERIALIZED (SELECT {keys}, CAST(symbol AS INTEGER) AS symbol, count(*) AS n FROM tok GROUP BY ALL),
leaf AS (SELECT * FROM hist UNION ALL SELECT DISTINCT {keys}, 256, CAST(1 AS BIGINT) FROM hist),
merge_ AS (SELECT {keys}, list_sort(list({{'n': CAST(n AS BIGINT), 'place': -symbol, 'members': [symbol]}})) AS trees, CAST([] AS INTEGER[]) AS log FROM leaf GROUP BY {keys}
  UNION ALL SELECT {keys}, list_sort(list_append(trees[3:], {{'n': CAST(trees[1].n + trees[2].n AS BIGINT), 'place': trees[1].place, 'members': list_concat(trees[1].members, trees[2].members)}})), list_concat(log, list_concat(trees[1].members, trees[2].members)) FROM merge_ WHERE len(trees) > 1),
depth AS MATERIALIZED (SELECT {keys}, symbol, count(*) AS depth FROM (SELECT {keys}, unnest(log) AS symbol FROM merge_ WHERE len(trees) = 1) GROUP BY ALL),
lens AS (SELECT {keys}, depth AS len, row_number() OVER (PARTITION BY {keys} ORDER BY depth) AS i FROM depth),
turn AS (SELECT {keys}, symbol, row_number() OVER (PARTITION BY {keys} ORDER BY depth, symbol) AS i FROM depth WHERE symbol < 256),
coded AS (SELECT {keys}, symbol, n, CAST(len AS INTEGER) AS len FROM turn JOIN lens USING ({keys}, i) JOIN hist USING ({keys}, symbol))"""


_MERGED = _merged(views.duck("tok"), "image_id, is_dc")


@_R.frame("q_huffman_lengths", f"{_MERGED} SELECT image_id, is_dc, symbol, n, len FROM coded")
def _lengths(spark, sf_dir):
    h = tokens.tokens(views.quantised(spark, sf_dir)).groupBy("image_id", "is_dc", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return huffman.optimal_tables(h, "image_id", "is_dc")


# Two queues: of equal counts symbols come before trees, higher symbols first, trees as they were made. No code is too long here.
_TWO_QUEUES = f"""{views.duck('tok').replace("WITH ", "WITH RECURSIVE ", 1)},
hist AS MATERIALIZED (SELECT image_id, is_dc, CAST(symbol AS INTEGER) AS symbol, count(*) AS n FROM tok GROUP BY ALL),
merge_ AS (SELECT image_id, is_dc, 0 AS i, list_sort(list({{'n': CAST(n AS BIGINT), 'tree': 0, 'place': -symbol, 'members': [symbol]}})) AS trees, CAST([] AS INTEGER[]) AS log FROM hist GROUP BY image_id, is_dc
  UNION ALL SELECT image_id, is_dc, i + 1, list_sort(list_append(trees[3:], {{'n': CAST(trees[1].n + trees[2].n AS BIGINT), 'tree': 1, 'place': i, 'members': list_concat(trees[1].members, trees[2].members)}})), list_concat(log, list_concat(trees[1].members, trees[2].members)) FROM merge_ WHERE len(trees) > 1),
depth AS (SELECT image_id, is_dc, symbol, count(*) AS depth FROM (SELECT image_id, is_dc, unnest(log) AS symbol FROM merge_ WHERE len(trees) = 1) GROUP BY ALL)"""


@_R.frame("q_huffman_lengths_floor", f"{_TWO_QUEUES} SELECT image_id, is_dc, symbol, n, CAST(coalesce(depth, 1) AS INTEGER) AS len FROM hist LEFT JOIN depth USING (image_id, is_dc, symbol)")
def _floor(spark, sf_dir):
    h = tokens.tokens(views.quantised(spark, sf_dir)).groupBy("image_id", "is_dc", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return huffman.optimal_tables(h, "image_id", "is_dc", lengths=huffman.two_pointer_lengths)


@_R.frame("q_size_optimal", f"{_MERGED} SELECT image_id, is_dc, count(*) AS symbols, CAST(sum(n * len) AS BIGINT) AS code_bits, 136 + 8 * count(*) AS header_bits FROM coded GROUP BY image_id, is_dc")
def _size(spark, sf_dir):
    return huffman.table_cost(_lengths(spark, sf_dir), "image_id", "is_dc")


def _component_histogram(spark, sf_dir):
    t = tokens.tokens(views.quantised_components(spark, sf_dir), "comp")
    return _kept(t.groupBy("image_id", "is_dc", "comp", "symbol").agg(F.count(F.lit(1)).alias("n")), "component-histogram")


_YCC = [colour.sample(e) for e in colour.ycbcr("r", "g", "b")]


@_R.frame(
    "q_component_blocks",
    f"""{views.duck('rgb')}, planes AS ({" UNION ALL ".join(f"SELECT image_id, y, x, {i} AS comp, {e} AS v FROM rgb" for i, e in enumerate(_YCC))})
SELECT image_id, comp, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y % 8 * 8 + x % 8 + 1)) AS BIGINT) AS placed FROM planes GROUP BY image_id, comp""",
)
def _components(spark, sf_dir):
    b = views.component_blocks(spark, sf_dir).select("image_id", "comp", F.posexplode("s").alias("p", "v"))
    return b.groupBy("image_id", "comp").agg(F.count(F.lit(1)).alias("samples"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("p") + 1)).alias("placed"))


# The field comes from the luma plane and holds for all components; at this quality the multipliers are those of low quality.
_AQ_TABLES = [tables.quant_table(t, 30) for t in (tables.ANNEX_K_LUMA, tables.ANNEX_K_CHROMA, tables.ANNEX_K_CHROMA)]
_AQ_OFFSETS = [[0] + [round(o * transform.BIAS_UNIT)] * 63 for o in tables.ZERO_BIAS_OFFSET_AC]
_AQ_MULTIPLIERS = [[round(lq * 10000) for comp, _, _, _, lq, _ in tables.perceptual_rows() if comp == i] for i in range(3)]
_AQ_FIELD = analysis.strength_sql(float(_AQ_TABLES[0][1]))
_AQ_ROWS = tables.values_sql("bias", "comp, k, q, mul, off", [(i, k, _AQ_TABLES[i][k], _AQ_MULTIPLIERS[i][k], _AQ_OFFSETS[i][k]) for i in range(3) for k in range(64)])


@_R.frame(
    "q_quantize_aq",
    f"""{views.duck('rgb', 'basis', 'zigzag')}, {_AQ_ROWS}, planes AS ({" UNION ALL ".join(f"SELECT image_id, y, x, {i} AS comp, {e} AS v FROM rgb" for i, e in enumerate(_YCC))}),
luma AS (SELECT image_id, y, x, v FROM planes WHERE comp = 0),
part AS (SELECT image_id, comp, planes.y // 8 * 8 + planes.x // 8 AS n, planes.y % 8 AS row, u, sum((v - 128) * w) AS t FROM planes JOIN basis ON basis.x = planes.x % 8 GROUP BY ALL),
comps AS (SELECT image_id, comp, n, b.u * 8 + h.u AS k, CAST(sum(t * w) AS BIGINT) AS c FROM part h JOIN basis b ON b.x = h.row GROUP BY ALL),
field AS ({_AQ_FIELD[1].format(px="luma")}),
whole AS (SELECT image_id, comp, n, z, CAST(abs(c) AS DOUBLE) * 1e9 >= CAST(q * CAST(67108864 AS BIGINT) AS DOUBLE) * CAST(off + mul * CAST(round(aq_strength * 100000) AS BIGINT) AS DOUBLE) AS reached,
  CAST(sign(c) AS BIGINT) * ((abs(c) + q * CAST(33554432 AS BIGINT)) // (q * CAST(67108864 AS BIGINT))) AS plain FROM comps JOIN field USING (image_id) JOIN bias USING (comp, k) JOIN zigzag USING (k) WHERE brow = n // 8 AND bcol = n % 8)
SELECT image_id, comp, count(DISTINCT n) AS blocks, CAST(sum(CASE WHEN reached THEN abs(plain) ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN reached THEN plain * (z + 1) ELSE 0 END) AS BIGINT) AS placed, CAST(sum(CASE WHEN plain <> 0 AND NOT reached THEN 1 ELSE 0 END) AS BIGINT) AS killed FROM whole GROUP BY image_id, comp""",
)
def _quantised_by_field(spark, sf_dir):
    planes = _kept(views.component_blocks(spark, sf_dir), "component-blocks")
    luma = planes.filter("comp = 0").select("image_id", "n", F.posexplode("s").alias("p", "v"))
    luma = luma.selectExpr("image_id", "n div 8 * 8 + p div 8 AS y", "n % 8 * 8 + p % 8 AS x", "v")
    field = views.select({"px": luma}, _AQ_FIELD[0].replace(" // ", " div ")).selectExpr("image_id", "brow * 8 + bcol AS n", "aq_strength")
    b = transform.dct_blocks(planes).join(field, ["image_id", "n"])
    parts = [transform.quantise_zero_bias(b.filter(F.col("comp") == i), "aq_strength", _AQ_TABLES[i], _AQ_MULTIPLIERS[i], _AQ_OFFSETS[i]) for i in range(3)]
    z = parts[0].unionByName(parts[1]).unionByName(parts[2])
    fold = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    size, place = F.transform("z", F.abs), F.transform("z", lambda v, i: v * (i + 1))
    return z.groupBy("image_id", "comp").agg(F.count(F.lit(1)).alias("blocks"), F.sum(fold(size)).alias("total"), F.sum(fold(place)).alias("placed"), F.sum("killed").alias("killed"))

# --- blocks of all components at several qualities: tables from the distance, multipliers blended by the
# distance that the tables stand for, the 32-bit field of the luma plane
BLEND_QUALITIES = (30, 75, 95)


def _blend_settings(q: int) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """Tables, multipliers (10^-4) and offsets of a quality by component."""
    rows = [[r for r in tables.perceptual_rows() if r[0] == i] for i in range(3)]
    d = 0.1 + (100 - q) * 0.09
    found = [[quality.perceptual_number(base, d, exponent, tables.GLOBAL_SCALE) for _, _, base, exponent, _, _ in r] for r in rows]
    effective = quality.effective_distance(found, [[x[2] for x in r] for r in rows], tables.FREQUENCY_EXPONENT)
    multipliers = [[round(m * 10000) for m in quality.blended(effective, [x[4] for x in r], [x[5] for x in r])] for r in rows]
    return found, multipliers, _AQ_OFFSETS


def _blend_sql() -> str:
    """Tables, distances and multipliers worked out again in SQL."""
    entry = f"(qv {{}} 0.5e0) / base / {num(tables.GLOBAL_SCALE)}"
    bound = lambda sign: quality.scale_distance("(" + entry.format(sign) + ")", "exponent")
    kept_low = "CASE WHEN b.lo <= a.hi THEN greatest(a.lo, b.lo) ELSE a.lo END"
    fields = " UNION ALL ".join(f"SELECT {q} AS q, image_id, n, aq_strength FROM ({analysis.field_steps(float(_blend_settings(q)[0][0][1]), 'luma')})" for q in BLEND_QUALITIES)
    return f"""{views.duck('rgb', 'basis', 'zigzag')}, {tables.values_sql('perceptual', 'c, k, base, exponent, lq, hq', tables.perceptual_rows())},
chosen AS (SELECT p.*, q, {quality.perceptual_entry('base', 'd', 'exponent')} AS qv FROM perceptual p, (SELECT q, 0.1e0 + (100 - q) * 0.09e0 AS d FROM (VALUES {', '.join(f'({q})' for q in BLEND_QUALITIES)}) AS t(q)) AS d),
bounds AS (SELECT q, c * 64 + k AS i, CASE WHEN qv > 1 THEN {bound('-')} ELSE 0e0 END AS lo, CASE WHEN qv < 255 THEN {bound('+')} ELSE 1e4 END AS hi FROM chosen),
narrowed AS (SELECT q, list_reduce(list_prepend({{'i': -1, 'lo': 0e0, 'hi': 1e4}}, list({{'i': i, 'lo': lo, 'hi': hi}} ORDER BY i)), lambda a, b: {{'i': b.i, 'lo': {kept_low}, 'hi': CASE WHEN b.hi >= ({kept_low}) THEN least(a.hi, b.hi) ELSE a.hi END}}) AS r FROM bounds GROUP BY q),
effective AS (SELECT q, CASE WHEN r.lo = 0 THEN r.hi WHEN r.hi >= 1e4 THEN r.lo ELSE (r.lo + r.hi) / 2 END AS d FROM narrowed),
setting AS (SELECT c AS comp, k, q, qv, CASE WHEN k = 0 THEN 0 ELSE [{', '.join(str(round(o * transform.BIAS_UNIT)) for o in tables.ZERO_BIAS_OFFSET_AC)}][c + 1] END AS off, CAST(round((lq * {quality.blend('d')} + hq * (1 - {quality.blend('d')})) * 10000) AS BIGINT) AS mul FROM chosen JOIN effective USING (q)),
planes AS MATERIALIZED ({" UNION ALL ".join(f"SELECT image_id, y, x, {i} AS comp, {e} AS v FROM rgb" for i, e in enumerate(_YCC))}),
luma AS (SELECT image_id, y, x, v FROM planes WHERE comp = 0),
part AS (SELECT image_id, comp, planes.y // 8 * 8 + planes.x // 8 AS n, planes.y % 8 AS row, u, sum((v - 128) * w) AS t FROM planes JOIN basis ON basis.x = planes.x % 8 GROUP BY ALL),
comps AS MATERIALIZED (SELECT image_id, comp, n, b.u * 8 + h.u AS k, CAST(sum(t * w) AS BIGINT) AS c FROM part h JOIN basis b ON b.x = h.row GROUP BY ALL),
strengths AS MATERIALIZED ({fields}),
whole AS (SELECT image_id, comp, n, q, z, CAST(abs(c) AS DOUBLE) * 1e9 >= CAST(qv * CAST(67108864 AS BIGINT) AS DOUBLE) * CAST(off + mul * CAST(round(aq_strength * 100000) AS BIGINT) AS DOUBLE) AS reached,
  CAST(sign(c) AS BIGINT) * ((abs(c) + qv * CAST(33554432 AS BIGINT)) // (qv * CAST(67108864 AS BIGINT))) AS plain FROM comps JOIN setting USING (comp, k) JOIN strengths USING (image_id, n, q) JOIN zigzag USING (k))
SELECT q, image_id, comp, count(DISTINCT n) AS blocks, CAST(sum(CASE WHEN reached THEN abs(plain) ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN reached THEN plain * (z + 1) ELSE 0 END) AS BIGINT) AS placed, CAST(sum(CASE WHEN plain <> 0 AND NOT reached THEN 1 ELSE 0 END) AS BIGINT) AS killed FROM whole GROUP BY q, image_id, comp"""


@_R.frame("q_quantize_blended", _blend_sql())
def _quantised_blended(spark, sf_dir):
    """Blocks are transformed once and quantised at each quality where they stand."""
    planes = _kept(transform.dct_blocks(views.component_blocks(spark, sf_dir).withColumn("own", F.when(F.col("comp") == 0, F.col("s")))), "component-coefficients")
    luma = planes.filter("comp = 0").select("image_id", "n", F.col("own").alias("s"))
    fold = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    parts = []
    for q in BLEND_QUALITIES:
        found, multipliers, offsets = _blend_settings(q)
        strength = field.aq_field(luma, float(found[0][1])).select("image_id", "n", F.round(F.col("aq_strength").cast("double"), 5).alias("aq_strength"))
        b = planes.drop("own").join(_kept(strength, "aq-field"), ["image_id", "n"])
        for i in range(3):
            z = transform.quantise_zero_bias(b.filter(F.col("comp") == i), "aq_strength", found[i], multipliers[i], offsets[i])
            parts.append(z.select(F.lit(q).alias("q"), "image_id", "comp", fold(F.transform("z", F.abs)).alias("total"), fold(F.transform("z", lambda v, j: v * (j + 1))).alias("placed"), "killed"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("q", "image_id", "comp").agg(F.count(F.lit(1)).alias("blocks"), *[F.sum(c).alias(c) for c in ("total", "placed", "killed")])


_KK_75 = [tables.quant_table(t, 75) for t in (tables.ANNEX_K_LUMA, tables.ANNEX_K_CHROMA)]


def _decoded(blocks, restart, luma_sampling=1):
    images = jpeg.encode_colour_images(blocks, _KK_75, restart=restart, luma_sampling=luma_sampling)
    return jpeg.decode_components(images)


_PLANE_SUMS = "count(*) AS samples, CAST(sum(abs(v)) AS BIGINT) AS total, CAST(sum(v * (n * 64 + z + 1)) AS BIGINT) AS placed"


_COMPONENTS = f"""{views.duck('rgb', 'basis', 'zigzag')}, {tables.values_sql('steps', 'comp, k, q', [(i, k, _KK_75[min(i, 1)][k]) for i in range(3) for k in range(64)])}, planes AS ({" UNION ALL ".join(f"SELECT image_id, y, x, {i} AS comp, {e} AS v FROM rgb" for i, e in enumerate(_YCC))}),
part AS (SELECT image_id, comp, planes.y // 8 * 8 + planes.x // 8 AS n, planes.y % 8 AS row, u, sum((v - 128) * w) AS t FROM planes JOIN basis ON basis.x = planes.x % 8 GROUP BY ALL),
comps AS (SELECT image_id, comp, n, b.u * 8 + h.u AS k, CAST(sum(t * w) AS BIGINT) AS c FROM part h JOIN basis b ON b.x = h.row GROUP BY ALL),
whole AS (SELECT image_id, comp, n, z, CAST(sign(c) AS BIGINT) * ((abs(c) + q * CAST(33554432 AS BIGINT)) // (q * CAST(67108864 AS BIGINT))) AS v FROM comps JOIN steps USING (comp, k) JOIN zigzag USING (k))"""


@_R.frame("q_jpeg_colour_roundtrip", f"{_COMPONENTS}\nSELECT image_id, comp, {_PLANE_SUMS} FROM whole GROUP BY image_id, comp")
def _colour(spark, sf_dir):
    z = _decoded(views.quantised_components(spark, sf_dir), 3).select("image_id", "comp", "n", F.posexplode("z").alias("z", "v"))
    return views.select({"whole": z}, f"SELECT image_id, comp, {_PLANE_SUMS} FROM {{whole}} GROUP BY image_id, comp")


@_R.frame("q_jpeg_halved_chroma")
def _halved(spark, sf_dir):
    """image_id, comp, n and z, v of values but 0 that a stream with halved chroma gives back."""
    z = _decoded(views.quantised_components(spark, sf_dir, halved=True), 4, 2)
    return z.select("image_id", "comp", "n", F.posexplode("z").alias("z", "v")).filter("v <> 0")


@_R.frame("q_hist_cluster")
def _clusters(spark, sf_dir):
    return huffman.clustered_slots(_component_histogram(spark, sf_dir), "image_id", "comp", 2, 2)


@_R.frame("q_clustered_tables")
def _clustered(spark, sf_dir):
    h = _component_histogram(spark, sf_dir)
    return huffman.slot_tables(h, huffman.clustered_slots(h, "image_id", "comp", 2, 2), "image_id", "comp")


_COMPONENT_TOKENS = f"""{_COMPONENTS},
nz AS (SELECT image_id, comp, n, z, v, z - lag(z, 1, 0) OVER (PARTITION BY image_id, comp, n ORDER BY z) - 1 AS run FROM whole WHERE z > 0 AND v <> 0),
dcs AS (SELECT image_id, comp, v - lag(v, 1, 0) OVER (PARTITION BY image_id, comp ORDER BY n) AS d FROM whole WHERE z = 0),
tok AS (SELECT image_id, 1 AS is_dc, CASE WHEN comp > 0 THEN 1 ELSE 0 END AS chroma, CASE WHEN d = 0 THEN 0 ELSE length(bin(abs(d))) END AS symbol FROM dcs
  UNION ALL SELECT image_id, 0, CASE WHEN comp > 0 THEN 1 ELSE 0 END, run % 16 * 16 + length(bin(abs(v))) FROM nz
  UNION ALL SELECT image_id, 0, CASE WHEN comp > 0 THEN 1 ELSE 0 END, 240 FROM (SELECT image_id, comp, unnest(range(run // 16)) FROM nz)
  UNION ALL SELECT image_id, 0, CASE WHEN comp > 0 THEN 1 ELSE 0 END, 0 FROM (SELECT image_id, comp, n, max(CASE WHEN v <> 0 THEN z ELSE 0 END) AS last FROM whole GROUP BY ALL) WHERE last < 63)"""


@_R.frame("q_luma_chroma_tables", f"{_merged(_COMPONENT_TOKENS, 'image_id, is_dc, chroma')} SELECT image_id, is_dc, chroma, symbol, n, len FROM coded")
def _luma_chroma(spark, sf_dir):
    return huffman.luma_chroma_tables(_component_histogram(spark, sf_dir), "image_id", "comp")


@_R.frame("q_trellis_ac")
def _trellis(spark, sf_dir):
    b = trellis.quantise_trellis(_loeffler(spark, sf_dir), _LUMA_75, _AC)
    return b.select("image_id", "n", F.posexplode("z").alias("z", "v")).filter("v <> 0")


@_R.frame("q_trellis_dc")
def _dc(spark, sf_dir):
    return trellis.quantise_dc_rows(_loeffler(spark, sf_dir), _LUMA_75[0], _DC)


def _with_multiplier(blocks):
    """The multiplier of the plain field, by the spread of a block's samples."""
    mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / 64
    spread = F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v) / 64 - mean * mean
    sd = F.sqrt(F.greatest(spread, F.lit(0.0)))
    return blocks.withColumn("multiplier", F.when(sd < 5, 1.3).when(sd < 20, 1.0).otherwise(0.8))


@_R.frame("q_trellis_blocks")
def _trellis_blocks(spark, sf_dir):
    """Final blocks: adaptive table, deringing, one transform, AC values, then the chain of DC values over them."""
    chosen = trellis.choose_ac(_with_multiplier(views.blocks(spark, sf_dir)), _LUMA_75, _AC, deringing=True)
    final = trellis.choose_dc(chosen, _LUMA_75[0], _DC)
    return final.select("image_id", "by", "bx", F.posexplode("z").alias("z", "v")).filter("v <> 0")


@_R.frame("q_eob_opt")
def _eob(spark, sf_dir):
    # a coarse table, so that whole bands are empty
    coarse = tables.quant_table(tables.IMAGE_MAGICK_LUMA, 10)
    bands = [(first, last) for _, first, last, _, _ in script("simple", 1) if first]
    costs = trellis.band_costs(_loeffler(spark, sf_dir), coarse, _AC, bands)
    rounded = [F.round(c, 6).alias(c) for c in ("zero_cost", "cost", "skip_cost")]
    return trellis.empty_in_rows(costs, _AC).select("image_id", "by", "bx", "first", "last", "status", *rounded, "emptied")


@_R.frame("q_deringing")
def _dering(spark, sf_dir):
    b = views.blocks(spark, sf_dir, 900).select("image_id", "n", "s")
    b = transform.map_blocks(b.withColumn("copy", F.col("s")), "s", "curved", "long", lambda s: trellis.dering(s, _LUMA_75[0]))
    changed = F.zip_with("copy", "curved", lambda s, c: F.when(s - 128 != c, 1).otherwise(0))
    return b.select("image_id", "n", F.aggregate(changed, F.lit(0), lambda a, x: a + x).alias("changed"), F.array_max("curved").alias("highest"), F.aggregate("curved", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

@_R.frame("q_dering_ab")
def _dering_arms(spark, sf_dir):
    """Both arms at all qualities as CSV by quality, read again; samples reach far, so that there is something to dering."""
    folder = f"{shared_dir(spark)}/dering-{uuid.uuid4().hex}"
    arms.write_arms(arms.dering_arms(views.blocks(spark, sf_dir, 900)), folder)
    back = spark.read.schema(arms.RESULT).option("header", True).option("enforceSchema", False).csv(folder)
    return back.select("image_id", "quality", "with_bytes", "without_bytes", *[F.round(c, 6).alias(c) for c in ("size_diff_pct", "with_error", "without_error", "error_diff")])


@_R.frame("q_dering_ab_summary")
def _dering_summary(spark, sf_dir):
    found = arms.summed_up(arms.dering_arms(views.blocks(spark, sf_dir, 900)))
    return found.select("quality", "image_id", "pairs", F.round("size_diff_pct", 6).alias("size_diff_pct"), F.round("error_diff", 6).alias("error_diff"), "better")


@_R.frame(
    "q_ac_refine_tokens",
    f"""{views.duck('qz')}, cell AS (SELECT image_id, n, z, v, coalesce(sum(CASE WHEN abs(v) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, n ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM qz WHERE z > 0),
gaps AS (SELECT image_id, n, gap, count(*) FILTER (v = 0) AS run, count(*) FILTER (abs(v) = 1) AS new, count(*) FILTER (abs(v) > 1) AS old, count(*) FILTER (abs(v) > 1 AND abs(v) % 2 = 1) AS ones FROM cell GROUP BY ALL)
SELECT image_id, n, CAST(sum(new) AS INTEGER) AS new_values, CAST(sum(CASE WHEN new > 0 THEN run // 16 ELSE 0 END) AS INTEGER) AS long_runs, CAST(sum(old) AS INTEGER) AS corrections, CAST(sum(ones) AS BIGINT) AS correction_ones FROM gaps GROUP BY image_id, n""",
)
def _refine(spark, sf_dir):
    """Refinement from bit 1 to 0: values new at this bit with their runs over
    zeros, a correction bit for each value known before, and runs of blocks
    without new values."""
    b = views.quantised(spark, sf_dir).select("image_id", "n", F.slice("z", 2, 63).alias("z"))
    known, new = lambda v: F.abs(v) > 1, lambda v: F.abs(v) == 1
    place = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: new(F.get("z", i)))
    step = lambda a, i: F.struct(i.alias("at"), F.concat(a["runs"], F.array(F.size(F.filter(F.slice("z", a["at"] + 2, i - a["at"] - 1), lambda v: v == 0)))).alias("runs"))
    runs = F.aggregate(place, F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("runs")), step, lambda a: a["runs"])
    b = b.select("image_id", "n", runs.alias("runs"), F.filter("z", known).alias("old"))
    bits = F.aggregate("old", F.lit(0).cast("long"), lambda a, v: a + F.abs(v) % 2)
    return b.select("image_id", "n", F.size("runs").alias("new_values"), F.aggregate("runs", F.lit(0), lambda a, r: a + F.floor(r / 16).cast("int")).alias("long_runs"), F.size("old").alias("corrections"), bits.alias("correction_ones"))


_NEAR = f"near AS MATERIALIZED (SELECT image_a, image_b, distance FROM {rates._DISTANCE.format(rd_points='rd_points')} AS d WHERE distance < {num(CURVE_SIMILARITY)})"


def _in_cells(spark, sf_dir):
    """Points of each image, and its curve of plain points with its cell."""
    points = _kept(rates._points(spark, sf_dir), "rd-points")
    found = curves.curves_of(points.filter("codec = 'plain'"), "bpp", "metric")
    return points, _kept(curves.in_cells(found, CURVE_SIMILARITY, 2 * len(rd.QUALITIES)), "rd-curves")


@_R.frame("q_rd_near", f"{rates.oracle()}, {_NEAR} SELECT image_a, image_b, round(distance, 6) AS distance FROM near")
def _near(spark, sf_dir):
    """All pairs of images whose curves are alike."""
    pairs = curves.near_pairs(_in_cells(spark, sf_dir)[1], CURVE_SIMILARITY)
    return pairs.select("image_a", "image_b", F.round("distance", 6).alias("distance"))


@_R.frame(
    "q_rd_cluster",
    f"""{rates.oracle().replace("WITH ", "WITH RECURSIVE ", 1)}, {_NEAR},
total AS (SELECT image_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM rd_points GROUP BY image_id),
turn AS MATERIALIZED (SELECT image_id, row_number() OVER (ORDER BY image_id) AS i, coalesce((SELECT list(image_a) FROM near WHERE image_b = image_id), []) AS before FROM total),
led AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS leaders
  UNION ALL SELECT turn.i, CASE WHEN list_has_any(leaders, before) THEN leaders ELSE list_append(leaders, image_id) END FROM led JOIN turn ON turn.i = led.i + 1),
last AS (SELECT leaders FROM led ORDER BY i DESC LIMIT 1),
joined AS (SELECT image_id, CASE WHEN list_contains(leaders, image_id) THEN image_id ELSE list_min(list_filter(before, lambda x: list_contains(leaders, x))) END AS cluster FROM turn, last)
SELECT image_id, cluster, bytes, row_number() OVER (PARTITION BY cluster ORDER BY bytes, image_id) = 1 AS is_representative FROM joined JOIN total USING (image_id)""",
)
def _cluster(spark, sf_dir):
    """Images join the first leader, in order of id, whose curve is near; others lead."""
    points, cells = _in_cells(spark, sf_dir)
    out = curves.clusters(cells, curves.leaders(cells, CURVE_SIMILARITY), CURVE_SIMILARITY)
    out = out.join(points.groupBy("image_id").agg(F.sum("bytes").alias("bytes")), "image_id")
    best = F.row_number().over(Window.partitionBy("cluster").orderBy("bytes", "image_id"))
    return out.withColumn("is_representative", best == 1)


# Four halvings around the quality of a distance; the last midpoint counts.
_STEP = "CASE WHEN {d} > target THEN {m} ELSE {lo} END AS lo{i}, CASE WHEN {d} > target THEN {hi} ELSE {m} END AS hi{i}"


def _perceptual() -> str:
    from tessera.functions import quality as f

    text = f"(SELECT target, greatest(10e0, {f.quality('target')} - 15e0) AS lo0, least(100e0, {f.quality('target')} + 15e0) AS hi0 FROM (SELECT t / 4e0 AS target FROM {{targets}}) AS t)"
    for i in range(1, 5):
        m = f"((lo{i - 1} + hi{i - 1}) / 2e0)"
        text = f"(SELECT *, {m} AS m{i}, {_STEP.format(d=f"(CASE WHEN {m} >= 30e0 THEN {f.distance(f'floor({m})')} ELSE {f.distance(m)} END)", m=m, lo=f'lo{i - 1}', hi=f'hi{i - 1}', i=i)} FROM {text} AS s{i})"
    return f"SELECT target, CAST(floor(m4) AS INT) AS q FROM {text} AS r"


_R.rows("q_perceptual_search", _perceptual(), ("targets", "t int", "t", [(t,) for t in range(1, 41)]))


@_R.frame("q_jpeg_bytes")
def _jpeg(spark, sf_dir):
    return jpeg.encode_images(views.quantised(spark, sf_dir).select("image_id", "n", "z"), _LUMA_75)


@_R.frame("q_jpeg_decode_roundtrip", f"{views.duck('qz')}\nSELECT image_id, n, z, v FROM qz")
def _roundtrip(spark, sf_dir):
    images = jpeg.encode_images(views.quantised(spark, sf_dir).select("image_id", "n", "z"), _LUMA_75, restart=5)
    return jpeg.decode_images(images).select("image_id", "n", F.posexplode("z").alias("z", "v"))


@_R.frame("q_jpeg_standard_tables", f"{views.duck('qz')}\nSELECT image_id, n, z, v FROM qz")
def _standard(spark, sf_dir):
    images = jpeg.encode_images(views.quantised(spark, sf_dir).select("image_id", "n", "z"), _LUMA_75, optimise=False)
    return jpeg.decode_images(images).select("image_id", "n", F.posexplode("z").alias("z", "v"))


@_R.frame("q_dqt_parse", f"{views.duck('blk', 'quant')}\nSELECT image_id, 0 AS table_no, k, q FROM (SELECT DISTINCT image_id FROM blk) AS i, quant")
def _dqt(spark, sf_dir):
    return jpeg.quant_tables(_jpeg(spark, sf_dir))


@_R.frame("q_png_pixels", f"{views.duck('px')}\nSELECT image_id, y, x, v FROM px")
def _png(spark, sf_dir):
    """Images coded as PNG and read again."""
    pixels = images.read_pixels(images.as_pngs(views.blocks(spark, sf_dir).select("image_id", "n", "s")))
    name = F.regexp_extract("path", r"image-(-?\d+)\.png$", 1).cast("int")
    return pixels.select(name.alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("r").cast("int").alias("v"))


@_R.frame("q_icc_profiles", f"{views.duck('blk')}\nSELECT image_id, 65519 * (1 + image_id % 2) + image_id AS bytes, image_id % 2 = 0 AS is_xyb FROM (SELECT DISTINCT image_id FROM blk) AS i")
def _icc(spark, sf_dir):
    """Profiles of one segment and more, written into each image's stream and found there."""
    streams = jpeg.encode_images(views.quantised(spark, sf_dir).select("image_id", "n", "z"), _LUMA_75)
    size = 65519 * (1 + F.pmod("image_id", F.lit(2))) + F.col("image_id")
    named = streams.select(F.col("image_id").cast("string").alias("path"), jpeg.with_profile("payload", size.cast("int"), F.pmod("image_id", F.lit(2)) == 0).alias("payload"))
    return images.icc_of(named).select(F.col("path").cast("int").alias("image_id"), F.length("profile").cast("long").alias("bytes"), "is_xyb")


@_R.frame("q_curve_sink", f"{rates.oracle()}\nSELECT image_id, " + ", ".join(f"max(CASE WHEN q = {q} THEN round(bpp, 6) END) AS bpp_{q}, max(CASE WHEN q = {q} THEN round(metric, 6) END) AS metric_{q}" for q in rd.QUALITIES) + " FROM rd_points WHERE codec = 'plain' GROUP BY image_id")
def _curves(spark, sf_dir):
    """The curves as CSV with a pair of columns for each quality, read again."""
    folder = f"{shared_dir(spark)}/curves-{uuid.uuid4().hex}"
    images.write_curves(rates._points(spark, sf_dir).filter("codec = 'plain'"), folder, rd.QUALITIES)
    back = spark.read.option("header", True).csv(folder)
    return back.select(F.col("image_id").cast("int").alias("image_id"), *[F.round(F.col(f"{q}_{c}").cast("double"), 6).alias(f"{c}_{q}") for q in rd.QUALITIES for c in ("bpp", "metric")])


@_R.frame("q_front_sink", f"{rates.oracle()}\n{rates._FRONT.format(key='image_id').format(rd_points='rd_points')}")
def _front(spark, sf_dir):
    """The points on the front as JSON lines beside all points as CSV, read again."""
    points = _kept(rates._points(spark, sf_dir), "rd-points")
    folder = f"{shared_dir(spark)}/front-{uuid.uuid4().hex}"
    images.write_front(points, views.select({"rd_points": points}, rates._FRONT.format(key="image_id")), folder)
    return spark.read.schema("image_id int, codec string, q int, bytes long, metric double").json(f"{folder}/front")


# Sides of an image before it is coded and the bytes of its payload; -1: it has none.
_SIDES = [(w, h, n) for w in (0, 1, 64, 65535, 65536) for h in (-1, 1, 4096, 70000) for n in (-1, 0, 3)]


@_R.frame("q_validate", f"WITH {tables.values_sql('sides', 'width, height, bytes', _SIDES)}\nSELECT width, height, bytes, CASE WHEN width < 1 OR width > 65535 OR height < 1 OR height > 65535 THEN 'INVALID_DIMENSIONS' WHEN bytes < 0 THEN 'MISSING_PAYLOAD' END AS error_code FROM sides")
def _validate(spark, sf_dir):
    sides = tables.frame(spark, "width int, height int, bytes int", _SIDES)
    checked = jpeg.validated(sides.withColumn("payload", F.expr("CASE WHEN bytes >= 0 THEN CAST(repeat('x', bytes) AS BINARY) END")))
    return checked.select("width", "height", "bytes", "error_code")

# Images whose sides come from the line items; the second arm has sides that outgrow 64 bits and no other limits.
_SIZES = "SELECT l_partkey * (l_orderkey % 40) * {n} AS width, l_suppkey * (l_orderkey % 800) * {n} AS height, 1 + l_linenumber % 4 AS depth, CASE WHEN l_quantity < 45 THEN l_partkey * (l_orderkey % 40) * l_suppkey * (l_orderkey % 800) * (1 + l_linenumber % 4) WHEN l_quantity < 49 THEN CAST(7 AS BIGINT) END AS payload_bytes FROM {t}"
_ARMS = (("limited", 1, limits.MOST_SIDE, limits.MOST_PIXELS), ("unlimited", 1_000_000, None, None))


def _limits_sql() -> str:
    big, small = "CAST(width AS HUGEINT) * height", "9223372036854775807"
    text = []
    for arm, n, side, pixels in _ARMS:
        over = "OR width > {0} OR height > {0}".format(side) if side else ""
        large = f"WHEN {big} > {pixels} THEN 'IMAGE_TOO_LARGE'" if pixels else ""
        text.append(f"SELECT '{arm}' AS arm, CASE WHEN width < 1 OR height < 1 {over} THEN 'INVALID_DIMENSIONS' WHEN {big} > {small} THEN 'SIZE_OVERFLOW' {large} WHEN {big} * depth > {small} THEN 'SIZE_OVERFLOW' WHEN payload_bytes IS NULL THEN 'MISSING_PAYLOAD' WHEN payload_bytes <> {big} * depth THEN 'WRONG_PAYLOAD_SIZE' END AS error_code, CASE WHEN {big} <= {small} THEN {big} END AS pixels, CASE WHEN {big} <= {small} AND {big} * depth <= {small} THEN {big} * depth END AS bytes FROM ({_SIZES.format(n=n, t='lineitem')})")
    return "SELECT arm, error_code, count(*) AS images, CAST(coalesce(max(pixels), 0) AS BIGINT) AS most_pixels, CAST(coalesce(max(bytes), 0) AS BIGINT) AS most_bytes, count(bytes) AS sized FROM (" + " UNION ALL ".join(text) + ") GROUP BY arm, error_code"


@_R.frame("q_image_limits", _limits_sql())
def _limits(spark, sf_dir):
    parts = []
    for arm, n, side, pixels in _ARMS:
        sizes = views.select({"t": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}, _SIZES.format(n=n, t="{t}"))
        parts.append(limits.with_limits(sizes, side, pixels).withColumn("arm", F.lit(arm)))
    whole = parts[0].unionByName(parts[1])
    return whole.groupBy("arm", "error_code").agg(F.count(F.lit(1)).alias("images"), *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(f"most_{c}") for c in ("pixels", "bytes")], F.count("bytes").alias("sized"))


_R.rows(
    "q_icc_chunks",
    "SELECT n, (n + 65518) {div} 65519 AS chunks, n - ((n + 65518) {div} 65519 - 1) * 65519 AS last_size FROM {{sizes}}".format(div="div"),
    ("sizes", "n int", "n", [(n,) for n in (1, 720, 65519, 65520, 131038, 131039, 200000)]),
    duck="SELECT n, (n + 65518) // 65519 AS chunks, n - ((n + 65518) // 65519 - 1) * 65519 AS last_size FROM {sizes}",
)


@_R.frame("q_progressive_bytes")
def _progressive(spark, sf_dir):
    return progressive.encode_images(views.quantised(spark, sf_dir).select("image_id", "n", "z"), _LUMA_75, script("standard", 1))


@_R.frame("q_progressive_roundtrip", f"{views.duck('qz')}\nSELECT image_id, n, z, v FROM qz")
def _progressive_back(spark, sf_dir):
    return progressive.decode_images(_progressive(spark, sf_dir)).select("image_id", "n", F.posexplode("z").alias("z", "v"))

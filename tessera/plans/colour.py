"""Colour and transfer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import colour as c
from tessera.functions import quality as q
from tessera.operators import units
from tessera.plans import tables
from tessera.plans.registry import Registry
from tessera.sources import views

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle


def _nested(source: str, steps: list[list[tuple[str, str]]], columns: str, keep: str = "*") -> str:
    """One subquery for each step, so that a step's names serve the next one."""
    text = source
    for i, step in enumerate(steps):
        text = f"(SELECT {keep}, {', '.join(f'{e} AS {n}' for n, e in step)} FROM {text} AS s{i})"
    return f"SELECT {columns} FROM {text} AS last"


def _r6(names: dict[str, str]) -> str:
    return ", ".join(f"round({e}, 6) + 0e0 AS {n}" for n, e in names.items())


_Y, _CB, _CR = map(c.sample, c.ycbcr("r", "g", "b"))
_R.both("q_samples", "SELECT vec_id, label, p, s FROM {samp}", "samp")
_R.both("q_rgb_to_ycbcr", f"SELECT image_id, y, x, {_Y} AS luma, {_CB} AS cb, {_CR} AS cr FROM {{rgb}}", "rgb")
_back = [c.sample(e) for e in c.rgb_from_ycbcr("luma", "cb", "cr")]
_R.both(
    "q_ycbcr_rgb_error",
    f"SELECT image_id, CAST(sum(abs(r - r2) + abs(g - g2) + abs(b - b2)) AS BIGINT) AS total_error, max(greatest(abs(r - r2), abs(g - g2), abs(b - b2))) AS worst, count(*) AS n FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in zip(('r2', 'g2', 'b2'), _back, strict=True))} FROM (SELECT *, {_Y} AS luma, {_CB} AS cb, {_CR} AS cr FROM {{rgb}}) AS a) AS t GROUP BY image_id",
    "rgb",
)
_real = c.ycbcr("r", "g", "b")
_R.both("q_ycbcr_real", f"SELECT image_id, y, x, round({_real[0]}, 4) AS luma, round({_real[1]}, 4) AS cb, round({_real[2]}, 4) AS cr FROM {{rgb}}", "rgb")
_R.both(
    "q_unpivot_planes",
    f"SELECT image_id, y, x, comp, v FROM (SELECT image_id, y, x, stack(3, 'Y', {_Y}, 'Cb', {_CB}, 'Cr', {_CR}) AS (comp, v) FROM {{rgb}}) AS t",
    "rgb",
    duck=f"SELECT image_id, y, x, 'Y' AS comp, {_Y} AS v FROM rgb UNION ALL SELECT image_id, y, x, 'Cb', {_CB} FROM rgb UNION ALL SELECT image_id, y, x, 'Cr', {_CR} FROM rgb",
)
_ink = dict(zip(("c", "m", "ye", "k"), c.cmyk_from_rgb("r", "g", "b"), strict=True))
_light = dict(zip(("r2", "g2", "b2"), c.rgb_from_cmyk("c", "m", "ye", "k"), strict=True))
_R.both(
    "q_cmyk_roundtrip",
    f"SELECT image_id, y, x, c, m, ye, k, r2, g2, b2 FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _light.items())} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _ink.items())} FROM {{rgb}}) AS a) AS t",
    "rgb",
)
_R.both("q_channel_swap_extract", "SELECT image_id, y, x, b AS r_swapped, g AS g_swapped, r AS b_swapped, CASE WHEN (x + y) % 3 = 0 THEN r WHEN (x + y) % 3 = 1 THEN g ELSE b END AS picked FROM {rgb}", "rgb")
_R.both("q_gray_to_ycbcr", "SELECT image_id, y, x, v AS luma, 128 AS cb, 128 AS cr FROM {px}", "px")

_LEVELS = ("levels", "v int", "v", [(v,) for v in range(256)])
_v = "v / 255e0"
_signed = "(v - 128) / 127e0"
_R.rows("q_srgb_linear", f"SELECT v, {_r6({'linear': c.linear_from_srgb(_v), 'back': c.srgb_from_linear(_v)})}, {c.sample('255e0 * (' + c.srgb_from_linear('(' + c.linear_from_srgb(_v) + ')') + ')')} AS roundtrip FROM {{levels}}", _LEVELS)
_R.rows("q_srgb_signed", f"SELECT v, {_r6({'decoded': c.srgb_decode(_signed), 'encoded': c.srgb_encode(_signed)})} FROM {{levels}}", _LEVELS)
_R.rows("q_hlg", f"SELECT v, {_r6({'encoded': c.hlg_encode(_signed), 'decoded': c.hlg_decode(_signed)})}, round({_signed}, 6) AS same_display FROM {{levels}}", _LEVELS)
_R.rows("q_pq", f"SELECT v, {_r6({'encoded': c.pq_encode(_v), 'decoded': c.pq_decode(_v), 'decoded_1000': c.pq_decode(_v, 1000.0), 'encoded_1000': c.pq_encode(_v, 1000.0)})} FROM {{levels}}", _LEVELS)
_R.rows("q_bt709", f"SELECT v, {_r6({'encoded': c.bt709_encode(_v), 'decoded': c.bt709_decode(_v)})} FROM {{levels}}", _LEVELS)

_lin = [(n, c.linear_from_srgb(f"{n[1]} / 255e0")) for n in ("lr", "lg", "lb")]
_xyb = list(zip(("xx", "yy", "bb"), c.xyb_from_linear("lr", "lg", "lb"), strict=True))
_sxyb = list(zip(("sx", "sy", "sb"), c.scaled_xyb("xx", "yy", "bb"), strict=True))
_un = list(zip(("ux", "uy", "ub"), c.unscaled_xyb("sx", "sy", "sb"), strict=True))
_inv = list(zip(("ir", "ig", "ib"), c.linear_from_xyb("ux", "uy", "ub"), strict=True))
_R.both("q_xyb", _nested("{rgb}", [_lin, _xyb], f"image_id, y, x, {_r6({'xyb_x': 'xx', 'xyb_y': 'yy', 'xyb_b': 'bb'})}"), "rgb")
_R.both("q_xyb_scaled", _nested("{rgb}", [_lin, _xyb, _sxyb], f"image_id, y, x, {_r6({'scaled_x': 'sx', 'scaled_y': 'sy', 'scaled_b': 'sb'})}"), "rgb")
_R.both("q_xyb_roundtrip", _nested("{rgb}", [_lin, _xyb, _sxyb, _un, _inv], f"image_id, y, x, {', '.join(f'round({n}, 5) + 0e0 AS {n}' for n in ('ir', 'ig', 'ib'))}"), "rgb")
_unit = [(n, f"{n[1]} / 255e0") for n in ("ur", "ug", "ub")]
_R.both("q_tone_map", _nested("{rgb}", [_unit, list(zip(("tr", "tg", "tb"), c.tone_map("ur", "ug", "ub"), strict=True))], "image_id, y, x, round(tr, 5) + 0e0 AS tr, round(tg, 5) + 0e0 AS tg, round(tb, 5) + 0e0 AS tb"), "rgb")
_R.both("q_hlg_ootf", _nested("{rgb}", [_unit, list(zip(("tr", "tg", "tb"), c.hlg_ootf("ur", "ug", "ub", c.hlg_gamma(300.0, 1000.0)), strict=True))], "image_id, y, x, round(tr, 5) + 0e0 AS tr, round(tg, 5) + 0e0 AS tg, round(tb, 5) + 0e0 AS tb"), "rgb")
_wide = [(n, f"({n[1]} - 40) / 170e0") for n in ("ur", "ug", "ub")]
_R.both("q_gamut_map", _nested("{rgb}", [_wide, *c.gamut_steps("ur", "ug", "ub")], "image_id, y, x, round(out_r, 5) + 0e0 AS out_r, round(out_g, 5) + 0e0 AS out_g, round(out_b, 5) + 0e0 AS out_b"), "rgb")


# --- two full planes and one at half the size under units of 16 by 16 samples; images lose three rows and columns
_XYB_TABLES = [[q.perceptual_number(base, 0.1 + 25 * 0.09, exponent, tables.XYB_GLOBAL_SCALE) for comp, _, base, _, exponent in tables.xyb_rows() if comp == i] for i in range(3)]
_PLANES = _nested("{cut}", [_lin, _xyb, _sxyb], f"image_id, y, x, w, h, {', '.join(f'CAST(round({s} * {255 * units.PART}e0) AS BIGINT) AS p{i}' for i, s in enumerate(('sx', 'sy', 'sb')))}")
_CUT = "(SELECT c.image_id, y, x, r, g, b, 61 AS w, h FROM {rgb} AS c JOIN (SELECT image_id, max(y) - 2 AS h FROM {rgb} GROUP BY image_id) AS s ON s.image_id = c.image_id WHERE x < 61 AND y < h)"
_UNITS_DUCK = f"""{views.duck('rgb', 'basis', 'zigzag')}, {tables.values_sql('steps', 'comp, k, q', [(i, k, v) for i, t in enumerate(_XYB_TABLES) for k, v in enumerate(t)])},
planes AS MATERIALIZED ({_PLANES.format(cut=_CUT.format(rgb='rgb'))}),
small AS (SELECT image_id, (w + 1) // 2 AS sw, (h + 1) // 2 AS sh, w, h FROM (SELECT DISTINCT image_id, w, h FROM planes)),
means AS (SELECT s.image_id, i AS y, j AS x, sum(p.p2) AS v FROM small s, range(4096) AS r(i), range(32) AS c(j), range(2) AS dy(a), range(2) AS dx(b), planes p WHERE i < s.sh AND j < s.sw AND p.image_id = s.image_id AND p.y = least(2 * i + a, s.h - 1) AND p.x = least(2 * j + b, s.w - 1) GROUP BY ALL),
grid AS (SELECT *, (w + 15) // 16 * 16 AS gw, (h + 15) // 16 * 16 AS gh FROM small),
big AS (SELECT g.image_id, i AS y, j AS x, 4 * p.p0 - 2097152 AS v0, 4 * p.p1 - 2097152 AS v1 FROM grid g, range(8192) AS r(i), range(64) AS c(j), planes p WHERE i < gh AND j < gw AND p.image_id = g.image_id AND p.y = least(i, g.h - 1) AND p.x = least(j, g.w - 1)),
third AS (SELECT g.image_id, i AS y, j AS x, m.v - 2097152 AS v FROM grid g, range(4096) AS r(i), range(32) AS c(j), means m WHERE i < gh // 2 AND j < gw // 2 AND m.image_id = g.image_id AND m.y = least(i, g.sh - 1) AND m.x = least(j, g.sw - 1)),
cell AS (SELECT image_id, y // 16 AS uy, x // 16 AS ux, y // 8 % 2 * 2 + x // 8 % 2 AS place, 0 AS comp, y % 8 AS row, x % 8 AS col, v0 AS v FROM big
  UNION ALL SELECT image_id, y // 16, x // 16, 4 + y // 8 % 2 * 2 + x // 8 % 2, 1, y % 8, x % 8, v1 FROM big
  UNION ALL SELECT image_id, y // 8, x // 8, 8, 2, y % 8, x % 8, v FROM third),
half AS (SELECT image_id, uy, ux, place, comp, row, u, sum(v * w) AS t FROM cell JOIN basis ON basis.x = col GROUP BY ALL),
coef AS (SELECT image_id, uy, ux, place, comp, b.u * 8 + h.u AS k, sum(t * w) AS c FROM half h JOIN basis b ON b.x = h.row GROUP BY ALL),
z AS (SELECT image_id, uy, ux, place, z, sign(c) * ((abs(c) + q * CAST({1 << units.BITS - 1} AS HUGEINT)) // (q * CAST({1 << units.BITS} AS HUGEINT))) AS v FROM coef JOIN steps USING (comp, k) JOIN zigzag USING (k))
SELECT image_id, CAST((uy * 4 + ux) * 9 + place AS BIGINT) AS n, CAST(max(CASE WHEN z = 0 THEN v END) AS BIGINT) AS dc, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS nonzero, CAST(sum(v * (z + 1)) AS BIGINT) AS placed FROM z GROUP BY ALL"""


@_R.frame("q_xyb_units", _UNITS_DUCK)
def _units(spark, sf_dir):
    """Quantised blocks of XYB planes in coding order, the third plane at half its size."""
    planes = views.select({"rgb": views.colours(spark, sf_dir)}, _PLANES.replace("{cut}", _CUT))
    z = units.coding_order(units.quantised_units(units.unit_blocks(planes), _XYB_TABLES), F.lit(4))
    fold = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    return z.select("image_id", F.col("n").cast("long").alias("n"), F.get("z", F.lit(0)).alias("dc"), F.size(F.filter("z", lambda v: v != 0)).alias("nonzero"), fold(F.transform("z", lambda v, i: v * (i + 1))).alias("placed"))

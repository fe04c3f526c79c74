"""Block geometry, image statistics, adaptive quantisation and coder choice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import quality as f
from tessera.functions.colour import num
from tessera.operators import field
from tessera.plans import tables
from tessera.plans.registry import Registry
from tessera.sources import views

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle

# --- geometry: cropped images are padded by repeating their last row and column
_PAD_DUCK = "SELECT c.image_id, py AS y, px AS x, v FROM (SELECT image_id, w, h, unnest(range((h + 7) // 8 * 8)) AS py FROM (SELECT DISTINCT image_id, w, h FROM {crop})) AS r, range(64) AS t(px), {crop} AS c WHERE c.image_id = r.image_id AND c.y = least(py, r.h - 1) AND c.x = least(px, r.w - 1)"
_PAD = "SELECT image_id, py AS y, px AS x, v FROM (SELECT *, explode(CASE WHEN y = h - 1 THEN sequence(y, (h + 7) // 8 * 8 - 1) ELSE array(y) END) AS py FROM {crop}) AS r LATERAL VIEW explode(CASE WHEN x = w - 1 THEN sequence(x, (w + 7) // 8 * 8 - 1) ELSE array(x) END) AS px"
_GROUP = "SELECT image_id, y // 8 AS brow, x // 8 AS bcol, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y % 8 * 8 + x % 8 + 1)) AS BIGINT) AS placed FROM ({pad}) AS p GROUP BY image_id, y // 8, x // 8"
_R.both("q_block_extract_padded", _GROUP.replace("{pad}", _PAD), "crop", duck=_GROUP.replace("{pad}", _PAD_DUCK))
_LIM = "(SELECT image_id AS i, (max(h) + 1) // 2 AS hh FROM {crop} GROUP BY image_id)"
_HALF = "SELECT image_id, y, x, four_times FROM (SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(sum(v) AS BIGINT) AS four_times FROM ({pad}) AS p WHERE x < 62 GROUP BY image_id, y // 2, x // 2) AS s JOIN {lim} AS l ON l.i = image_id WHERE y < hh"
_R.both("q_downsample_2x2", _HALF.replace("{pad}", _PAD).replace("{lim}", _LIM), "crop", duck=_HALF.replace("{pad}", _PAD_DUCK).replace("{lim}", _LIM))
# Blocks in coding order: three components side by side, and 16x16 units of four, four and one.
_UNITS = "SELECT image_id, comp, brow, bcol, row_number() OVER (PARTITION BY image_id ORDER BY brow, bcol, comp) - 1 AS plain, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN comp = 2 THEN brow ELSE brow // 2 END, CASE WHEN comp = 2 THEN bcol ELSE bcol // 2 END, comp, brow % 2, bcol % 2) - 1 AS units FROM (SELECT DISTINCT image_id, y // 8 AS brow, x // 8 AS bcol FROM {px}) AS b CROSS JOIN (SELECT 0 AS comp UNION ALL SELECT 1 UNION ALL SELECT 2) AS c WHERE comp < 2 OR (brow % 2 = 0 AND bcol % 2 = 0)"
_R.both("q_mcu_order", _UNITS.replace("CASE WHEN comp = 2 THEN brow ELSE brow // 2 END", "brow // 2").replace("CASE WHEN comp = 2 THEN bcol ELSE bcol // 2 END", "bcol // 2"), "px")

# --- statistics over a grid of every fourth block or pixel
_LUMA = "(SELECT image_id, y, x, (r + 2 * g + b) // 4 AS l FROM {rgb})"
_BLOCK_VAR = f"(SELECT image_id, CAST(sum(l * l) AS BIGINT) // 64 - (CAST(sum(l) AS BIGINT) // 64) * (CAST(sum(l) AS BIGINT) // 64) AS var FROM {_LUMA} AS l WHERE (y // 8) % 4 = 0 AND (x // 8) % 4 = 0 GROUP BY image_id, y // 8, x // 8)"
_LUMA_METRICS = f"SELECT image_id, least(1e0, avg(CAST(var AS DOUBLE)) / 2000e0) AS luma_complexity, 100e0 * avg(CASE WHEN var < 100 THEN 1e0 ELSE 0e0 END) AS flat_pct FROM {_BLOCK_VAR} AS v GROUP BY image_id"
_R.both("q_luma_metrics", f"SELECT image_id, round(luma_complexity, 6) AS luma_complexity, round(flat_pct, 4) AS flat_pct FROM ({_LUMA_METRICS}) AS m", "rgb")
_R.both("q_block_variance", f"SELECT image_id, var, count(*) AS n FROM {_BLOCK_VAR} AS v GROUP BY image_id, var", "rgb")
_NEAR = f"(SELECT image_id, y, x, l, lag(l) OVER (PARTITION BY image_id, y ORDER BY x) AS lw, lead(l) OVER (PARTITION BY image_id, y ORDER BY x) AS le, lag(l) OVER (PARTITION BY image_id, x ORDER BY y) AS ln, lead(l) OVER (PARTITION BY image_id, x ORDER BY y) AS ls FROM {_LUMA} AS a)"
_GRID = "(y - 1) % 4 = 0 AND (x - 1) % 4 = 0 AND y >= 1 AND x >= 1 AND le IS NOT NULL AND ls IS NOT NULL"
_EDGE = f"SELECT image_id, avg(CASE WHEN abs(le - lw) + abs(ls - ln) > 30 THEN 1e0 ELSE 0e0 END) AS edge_density, avg(CAST(abs(le - lw) + abs(ls - ln) AS DOUBLE)) AS edge_strength, avg(CAST(greatest(l, lw, le, ln, ls) - least(l, lw, le, ln, ls) AS DOUBLE)) AS local_contrast FROM {_NEAR} AS n WHERE {_GRID} GROUP BY image_id"
_R.both("q_edge_metrics", f"SELECT image_id, round(edge_density, 6) AS edge_density, round(edge_strength, 6) AS edge_strength, round(local_contrast, 6) AS local_contrast FROM ({_EDGE}) AS e", "rgb")
_R.both(
    "q_dering_benefit",
    f"SELECT image_id, round(least(1e0, sqrt(10e0 * avg(CASE WHEN (l >= 250 OR l <= 5) AND greatest(abs(l - lw), abs(l - le), abs(l - ln), abs(l - ls)) > 30 THEN 1e0 ELSE 0e0 END))), 6) AS benefit, least(1e0, sqrt(10e0 * avg(CASE WHEN (l >= 250 OR l <= 5) AND greatest(abs(l - lw), abs(l - le), abs(l - ln), abs(l - ls)) > 30 THEN 1e0 ELSE 0e0 END))) > 0.1e0 AS use_deringing FROM {_NEAR} AS n WHERE {_GRID} GROUP BY image_id",
    "rgb",
    gain=900,
)
_STATS = f"(SELECT a.image_id, luma_complexity, flat_pct, edge_density, edge_strength, local_contrast FROM ({_LUMA_METRICS}) AS a JOIN ({_EDGE}) AS b ON a.image_id = b.image_id)"
_R.both("q_analyze_image", f"SELECT image_id, round(luma_complexity, 6) AS luma_complexity, round(flat_pct, 4) AS flat_pct, round(edge_density, 6) AS edge_density, round(edge_strength, 6) AS edge_strength, round(local_contrast, 6) AS local_contrast, round(least(1e0, 0.5e0 + 0.5e0 * luma_complexity + 0.2e0 * edge_density), 6) AS aq_strength FROM {_STATS} AS s", "rgb")
_GRID_Q = "(SELECT 20e0 AS q UNION ALL SELECT 40e0 UNION ALL SELECT 60e0 UNION ALL SELECT 75e0 UNION ALL SELECT 85e0 UNION ALL SELECT 95e0)"
_METRICS = "(SELECT 'butteraugli' AS metric UNION ALL SELECT 'dssim' UNION ALL SELECT 'ssimulacra2' UNION ALL SELECT 'file_size')"
_RECOMMEND = f"SELECT image_id, q, metric, bpp, {f.approach('metric', 'bpp', 'flat_pct', '(edge_strength + local_contrast)')} AS approach, luma_complexity, edge_density FROM (SELECT *, {f.bpp_estimate('q', 'flat_pct')} AS bpp FROM {_STATS} AS s CROSS JOIN {_GRID_Q} AS q CROSS JOIN {_METRICS} AS m) AS t"
_R.both("q_bpp_estimate", f"SELECT image_id, q, round({f.bpp_estimate('q', 'flat_pct')}, 6) AS bpp FROM {_STATS} AS s CROSS JOIN {_GRID_Q} AS q", "rgb")
_R.both("q_recommend", f"SELECT image_id, q, metric, approach FROM ({_RECOMMEND}) AS r", "rgb")
_R.both(
    "q_strategy_for_image",
    f"SELECT image_id, q, approach, approach = 'trellis' AS ac_trellis, approach = 'trellis' AND q < 50 AS dc_trellis, approach = 'adaptive' AS aq, round(CASE WHEN approach = 'adaptive' THEN least(1e0, 0.5e0 + 0.5e0 * luma_complexity + 0.2e0 * edge_density) ELSE 0e0 END, 6) AS aq_strength, approach = 'trellis' AND q < 90 AS progressive FROM ({_RECOMMEND}) AS r WHERE metric = 'butteraugli'",
    "rgb",
)
# What each way of coding an image would be set to, whichever is recommended: both ways together take the field at seven tenths.
_WAYS = "(SELECT 'trellis' AS approach UNION ALL SELECT 'adaptive' UNION ALL SELECT 'hybrid')"
_FROM_IMAGE = "least(1e0, 0.5e0 + 0.5e0 * luma_complexity + 0.2e0 * edge_density)"
_R.both(
    "q_strategy_ways",
    f"SELECT image_id, q, approach, approach <> 'adaptive' AS ac_trellis, approach = 'trellis' AND q < 50 AS dc_trellis, approach <> 'trellis' AS aq, round(CASE approach WHEN 'adaptive' THEN {_FROM_IMAGE} WHEN 'hybrid' THEN {_FROM_IMAGE} * 0.7e0 ELSE 0e0 END, 6) AS aq_strength, (approach = 'trellis' AND q < 90) OR (approach = 'hybrid' AND q < 80) AS progressive FROM {_STATS} AS s CROSS JOIN {_GRID_Q} AS q CROSS JOIN {_WAYS} AS w",
    "rgb",
)
_R.rows(
    "q_strategy",
    "SELECT strategy, q, CASE WHEN strategy IN ('trellis', 'auto', 'simple') THEN 'trellis' ELSE strategy END AS approach, strategy IN ('trellis', 'auto', 'hybrid') AS ac_trellis, strategy IN ('trellis', 'auto') AND q < 50 AS dc_trellis, (strategy IN ('trellis', 'auto') AND q < 90) OR (strategy = 'hybrid' AND q < 80) AS progressive, strategy <> 'simple' AS optimise_codes, round(CASE WHEN strategy IN ('adaptive', 'hybrid') THEN (CASE WHEN q >= 90 THEN 1e0 WHEN q >= 80 THEN 0.8e0 WHEN q >= 70 THEN 0.6e0 ELSE 0.4e0 END) * (CASE WHEN strategy = 'hybrid' THEN 0.7e0 ELSE 1e0 END) ELSE 0e0 END, 6) AS aq_strength FROM {strategies} CROSS JOIN {qualities}",
    ("strategies", "strategy string", "strategy", [(s,) for s in ("trellis", "adaptive", "hybrid", "auto", "simple")]),
    ("qualities", "q int", "q", [(q,) for q in range(1, 101)]),
)

# --- adaptive quantisation
_STD = "(SELECT image_id, y // 8 AS brow, x // 8 AS bcol, sqrt(greatest(0e0, CAST(sum(v * v) AS DOUBLE) / count(*) - (CAST(sum(v) AS DOUBLE) / count(*)) * (CAST(sum(v) AS DOUBLE) / count(*)))) AS sd FROM {px} GROUP BY image_id, y // 8, x // 8)"
_LEGACY = "CASE WHEN sd < 5e0 THEN 1.3e0 WHEN sd < 20e0 THEN 1e0 ELSE 0.8e0 END"
_R.both("q_aq_variance", f"SELECT image_id, brow, bcol, round(sd, 6) AS sd, {_LEGACY} AS multiplier FROM {_STD} AS s", "px")
_STEP = "(SELECT image_id, y, x, v, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS e, lead(v) OVER (PARTITION BY image_id, x ORDER BY y) AS s FROM {px})"
_SIMPLE = f"(SELECT a.image_id, a.brow, a.bcol, greatest(0.5e0, least(2e0, (CASE WHEN sd < 10e0 THEN 1.2e0 WHEN sd > 30e0 THEN 0.8e0 ELSE 1.2e0 - 0.4e0 * (sd - 10e0) / 20e0 END) * (CASE WHEN steep > 2500 THEN 0.9e0 ELSE 1e0 END))) AS multiplier FROM {_STD} AS a JOIN (SELECT image_id, y // 8 AS brow, x // 8 AS bcol, max((e - v) * (e - v) + (s - v) * (s - v)) AS steep FROM {_STEP} AS p WHERE x % 8 < 7 AND y % 8 < 7 GROUP BY image_id, y // 8, x // 8) AS b ON a.image_id = b.image_id AND a.brow = b.brow AND a.bcol = b.bcol)"
_R.both("q_aq_simplified", f"SELECT image_id, brow, bcol, round(multiplier, 6) AS multiplier FROM {_SIMPLE} AS s", "px")
_R.both("q_apply_aq", f"SELECT image_id, brow, bcol, q, CAST(least(255e0, greatest(1e0, round(q * multiplier))) AS INT) AS scaled, CAST(least(255e0, greatest(1e0, round(q * multiplier * CASE WHEN k = 0 THEN 1e0 WHEN k < 10 THEN 1.1e0 ELSE 1.2e0 END))) AS INT) AS banded, k FROM (SELECT image_id, brow, bcol, {_LEGACY} AS multiplier FROM {_STD} AS s) AS t CROSS JOIN (SELECT 0 AS k, 16 AS q UNION ALL SELECT 5, 37 UNION ALL SELECT 20, 43) AS d", "px")

# Constants of the masking model.
_INV_LOG2E = 0.6931471805599453
_SG_MUL, _SG_MUL2, _SG_RET, _SG_VOFF, _EPS = 226.0480446705883, 1 / 73.377132366608819, 18.6580932135, 7.14672470003, 1e-2
_NUM_MUL = _SG_MUL2 * _SG_RET * _INV_LOG2E * 3 * _SG_MUL
_NUM_OFF = _EPS * 255 * 255
_DEN_MUL = _INV_LOG2E * _SG_MUL / 255 / 255
_DEN_OFF = (_SG_VOFF * _INV_LOG2E + _EPS) * 255
_MASK_BASE, _MASK_MUL0, _MASK_MUL2, _MASK_MUL3, _MASK_MUL4, _MASK_OFF2, _MASK_OFF3 = -0.74174993, 0.74760422233706747, 12.906028311180409, 5.0220313103171232, 3.2353257320940401, 305.04035728311436, 2.1925739705298404
_HF, _GAMMA = -2.0052193233688884, -0.15526878023684174


def ratio(v: str, inverse: bool) -> str:
    """Slope of the cubic-root response over that of the simple gamma."""
    n = f"({num(_NUM_MUL)} * {v} * {v} + {num(_NUM_OFF)})"
    d = f"({num(_DEN_MUL)} * {v} * {v} * {v} + {num(_DEN_OFF)})"
    return f"({n} / {d})" if inverse else f"({d} / {n})"


_SIDES = "(SELECT image_id, y, x, CAST(v AS DOUBLE) AS v, coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), v) + coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x), v) + coalesce(lag(v) OVER (PARTITION BY image_id, x ORDER BY y), v) + coalesce(lead(v) OVER (PARTITION BY image_id, x ORDER BY y), v) AS around FROM {px})"
_DIFF = f"({ratio('(v + ' + num(0.019 * 255) + ')', False)} * (v - 0.25e0 * around))"
_MASKED = f"0.25e0 * sqrt(least(0.2e0, {_DIFF} * {_DIFF}) * {num((211.50759899638012 * 1e8) ** 0.5)} + 28e0)"
_PRE = f"(SELECT image_id, y // 4 AS y, x // 4 AS x, 0.25e0 * sum({_MASKED}) AS e FROM {_SIDES} AS s GROUP BY image_id, y // 4, x // 4)"
_R.both("q_pre_erosion", f"SELECT image_id, y, x, round(e, 5) AS pre_erosion FROM {_PRE} AS p", "px")
_ROW3 = f"(SELECT image_id, y, x, e AS c, coalesce(lag(e) OVER (PARTITION BY image_id, y ORDER BY x), e) AS l, coalesce(lead(e) OVER (PARTITION BY image_id, y ORDER BY x), e) AS r FROM {_PRE} AS p)"
_up = ", ".join(f"coalesce(lag({n}) OVER w, {n}) AS u{n}, coalesce(lead({n}) OVER w, {n}) AS d{n}" for n in "lcr")
_ALL9 = "l, c, r, ul, uc, ur, dl, dc, dr"


def _fuzzy(sort: str, at: str) -> str:
    weighted = " + ".join(f"{w} * {at.format(i)}" for i, w in enumerate(("0.125e0", "0.075e0", "0.06e0", "0.05e0"), 1))
    return f"(SELECT image_id, y // 2 AS brow, x // 2 AS bcol, sum({weighted}) AS fuzzy FROM (SELECT image_id, y, x, {sort} AS a FROM (SELECT *, {_up} FROM {_ROW3} AS h WINDOW w AS (PARTITION BY image_id, x ORDER BY y)) AS n) AS f GROUP BY image_id, y // 2, x // 2)"


_FUZZY, _FUZZY_DUCK = _fuzzy(f"array_sort(array({_ALL9}))", "element_at(a, {})"), _fuzzy(f"list_sort([{_ALL9}])", "a[{}]")
_R.both("q_fuzzy_erosion", f"SELECT image_id, brow, bcol, round(fuzzy, 5) AS fuzzy FROM {_FUZZY} AS f", "px", duck=f"SELECT image_id, brow, bcol, round(fuzzy, 5) AS fuzzy FROM {_FUZZY_DUCK} AS f")
_TEXTURE = f"(SELECT image_id, y // 8 AS brow, x // 8 AS bcol, CAST(sum(CASE WHEN x % 8 < 7 THEN abs(v - e) ELSE 0 END + CASE WHEN y % 8 < 7 THEN abs(v - s) ELSE 0 END) AS BIGINT) AS hf, sum({ratio('(v + ' + num(0.16 * 255) + ')', True)}) AS g FROM {_STEP} AS p GROUP BY image_id, y // 8, x // 8)"


def _strength(fuzzy: str, first_ac: float) -> str:
    dampen = max(0.0, 1 - (first_ac - 9) / 56) if first_ac >= 9 else 1.0
    v1 = f"greatest(fuzzy * {num(_MASK_MUL0)}, 1e-3)"
    mask = f"({num(_MASK_BASE)} + {num(_MASK_MUL4)} / ({v1} * {v1} + {num(0.25 * _MASK_OFF3)}) + {num(_MASK_MUL2)} / ({v1} + {num(_MASK_OFF2)}) + {num(_MASK_MUL3)} / ({v1} * {v1} + {num(_MASK_OFF3)}))"
    out = f"{mask} + hf * {num(_HF / 255 / 112)} + {num(_GAMMA * _INV_LOG2E)} * ln(greatest(g * {num(1 / 255 / 64)}, 1e-300)) / {num(_INV_LOG2E)}"
    field = f"(exp({out}) * {num(0.841 * dampen)} + {num((1 - dampen) * 0.48 * 0.841)})"
    return f"SELECT a.image_id, a.brow, a.bcol, round(greatest(0e0, 0.6e0 / {field} - 1e0), 5) AS aq_strength FROM {fuzzy} AS a JOIN {_TEXTURE} AS t ON a.image_id = t.image_id AND a.brow = t.brow AND a.bcol = t.bcol"


def strength_sql(first_ac: float) -> tuple[str, str]:
    """The field of a table whose first AC step is ``first_ac``, for Spark and for DuckDB; ``{px}`` is the plane."""
    return _strength(_FUZZY, first_ac), _strength(_FUZZY_DUCK, first_ac)


for _name, _first in (("q_aq_strength", 8.0), ("q_aq_strength_coarse", 30.0)):
    _R.both(_name, strength_sql(_first)[0], "px", duck=strength_sql(_first)[1])


# --- the field in 32-bit floats; in DuckDB every step is REAL and sums are folded in order
def _r(value) -> str:
    return f"CAST('{value!r}' AS REAL)".replace("np.float32(", "").replace(")'", "'")


def _ratio_real(v: str, inverse: bool) -> str:
    num = f"({_r(field.NUM_MUL)} * ({v} * {v}) + {_r(field.NUM_OFFSET)})"
    den = f"(({_r(field.DEN_MUL)} * {v}) * ({v} * {v}) + {_r(field.DEN_OFFSET)})"
    return f"({num} / {den})" if inverse else f"({den} / {num})"


def _in_order(x: str, order: str) -> str:
    return f"list_reduce(list({x} ORDER BY {order}), lambda a, b: CAST(a + b AS REAL))"


def field_steps(first_ac: float, plane: str = "px") -> str:
    """The field of the relation ``plane`` (image_id, y, x, v); its own steps stand in a WITH of their own."""
    mul, add = (_r(v) for v in field.dampening(first_ac))
    weights = " + ".join(f"{_r(w)} * a[{i}]" for i, w in enumerate(field.EROSION, 1))
    v = "greatest(fuzzy * " + _r(field.MASK_MUL0) + ", " + _r(np.float32(1e-3)) + ")"
    return f"""WITH near AS (SELECT image_id, y, x, CAST(v AS REAL) AS v, CAST(coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) AS REAL) AS around FROM {plane} WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
diff AS (SELECT image_id, y, x, {_ratio_real(f'(v + {_r(field.MATCH_OFFSET)})', False)} * (v - CAST(0.25 AS REAL) * around) AS d FROM near),
masked AS (SELECT image_id, y, x, CAST(0.25 AS REAL) * CAST(sqrt(CAST(least(d * d, {_r(field.LIMIT)}) * {_r(field.MASKING)} + {_r(field.MASKING_OFFSET)} AS DOUBLE)) AS REAL) AS m FROM diff),
col AS (SELECT image_id, y // 4 AS y, x, {_in_order('m', 'y')} AS m FROM masked GROUP BY image_id, y // 4, x),
cell AS MATERIALIZED (SELECT image_id, y, x // 4 AS x, CAST({_in_order('m', 'x')} * CAST(0.25 AS REAL) AS REAL) AS e FROM col GROUP BY image_id, y, x // 4),
size AS (SELECT image_id, max(y) AS h, max(x) AS w FROM cell GROUP BY image_id),
nine AS (SELECT c.image_id, c.y, c.x, list_sort(list(o.e)) AS a FROM cell c JOIN size s ON s.image_id = c.image_id, range(-1, 2) AS dy(i), range(-1, 2) AS dx(j), cell o WHERE o.image_id = c.image_id AND o.y = greatest(0, least(s.h, c.y + i)) AND o.x = greatest(0, least(s.w, c.x + j)) GROUP BY c.image_id, c.y, c.x),
eroded AS (SELECT image_id, y // 2 AS b_y, x // 2 AS b_x, {_in_order('t', 'y, x')} AS fuzzy FROM (SELECT image_id, y, x, CAST({weights} AS REAL) AS t FROM nine) GROUP BY image_id, y // 2, x // 2),
step AS (SELECT image_id, y, x, v, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS e, lead(v) OVER (PARTITION BY image_id, x ORDER BY y) AS s FROM {plane}),
texture AS (SELECT image_id, y // 8 AS b_y, x // 8 AS b_x, CAST(sum(CASE WHEN x % 8 < 7 THEN abs(v - e) ELSE 0 END + CASE WHEN y % 8 < 7 THEN abs(v - s) ELSE 0 END) AS REAL) AS hf, {_in_order(_ratio_real(f'(CAST(v AS REAL) + {_r(field.GAMMA_BIAS)})', True), 'y, x')} AS ratios FROM step GROUP BY image_id, y // 8, x // 8),
mask AS (SELECT image_id, b_y, b_x, fuzzy, ratios, hf, ((({_r(field.MASK_BASE)} + {_r(field.MASK_MUL4)} * (CAST(1 AS REAL) / ({v} * {v} + {_r(field.MASK_OFFSET4)}))) + {_r(field.MASK_MUL2)} * (CAST(1 AS REAL) / ({v} + {_r(field.MASK_OFFSET2)}))) + {_r(field.MASK_MUL3)} * (CAST(1 AS REAL) / ({v} * {v} + {_r(field.MASK_OFFSET3)}))) + hf * {_r(field.HF_MUL)} AS o FROM eroded JOIN texture USING (image_id, b_y, b_x)),
gamma AS (SELECT *, o + {_r(field.GAMMA)} * CAST(log2(CAST(ratios * {_r(field.GAMMA_SCALE)} AS DOUBLE)) AS REAL) AS g FROM mask),
final AS (SELECT *, CAST(pow(2e0, CAST(g * {_r(field.LOG2_E)} AS DOUBLE)) AS REAL) * {mul} + {add} AS f FROM gamma)
SELECT image_id, b_y * 8 + b_x AS n, CAST(fuzzy AS DOUBLE) AS fuzzy, CAST(ratios AS DOUBLE) AS ratios, round(CAST(greatest({_r(np.float32(0.6))} / f - CAST(1 AS REAL), CAST(0 AS REAL)) AS DOUBLE), 5) AS aq_strength FROM final"""


def field_real(first_ac: float) -> str:
    return f"{views.duck('px')}, found AS ({field_steps(first_ac)}) SELECT * FROM found"


def _field_query(first_ac: float):
    def query(spark, sf_dir):
        found = field.aq_field(views.blocks(spark, sf_dir).select("image_id", "n", "s"), first_ac)
        return found.select("image_id", "n", *[F.col(c).cast("double").alias(c) for c in ("fuzzy", "ratios")], F.round(F.col("aq_strength").cast("double"), 5).alias("aq_strength"))

    return query


for _name, _first in (("q_aq_field", 8.0), ("q_aq_field_coarse", 30.0)):
    _R.frame(_name, field_real(_first))(_field_query(_first))

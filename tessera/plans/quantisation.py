"""Quality scales, quantisation tables and quantisers."""

from __future__ import annotations

from tessera.functions import quality as f
from tessera.functions.colour import num
from tessera.plans import tables
from tessera.plans.registry import Registry
from tessera.sources import views

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle

_QUALITIES = ("qualities", "q int", "q", [(q,) for q in range(1, 101)])
_BASES = ("bases", "variant int, comp string, k int, b int", "variant, comp, k, b", tables.variant_rows())
_PERCEPTUAL = ("perceptual", "c int, k int, base double, exponent double, lq double, hq double", "c, k, base, exponent, lq, hq", tables.perceptual_rows())

_R.rows(
    "q_quality_maps",
    f"SELECT q, round({f.distance('q')}, 6) AS distance, round({f.quality('(' + f.distance('q') + ')')}, 4) AS back, 20e0 + 0.75e0 * q AS from_linear, greatest(0e0, least(100e0, (least(95, greatest(20, q)) - 20e0) / 0.75e0)) AS to_linear, q < 70 AS prefers_trellis, q >= 70 AS prefers_adaptive, round(CASE WHEN q / 10e0 >= 15e0 THEN 1e0 ELSE 100e0 - least(99e0, 6.6e0 * q / 10e0) END, 6) AS crude_inverse FROM {{qualities}}",
    _QUALITIES,
)
_R.rows("q_linear_scale", f"SELECT q * 50 AS scale, round({f.linear_distance('(q * 50)', 'div')}, 6) AS distance FROM {{qualities}}", _QUALITIES, duck=f"SELECT q * 50 AS scale, round({f.linear_distance('(q * 50)', '//')}, 6) AS distance FROM {{qualities}}")
_TABLE = "SELECT variant, comp, q, k, {} AS qv, CAST(least(255e0, greatest(1e0, round((b * (CASE WHEN q < 50 THEN 5000e0 / q ELSE 200e0 - 2e0 * q END) + 50e0) / 100e0))) AS INT) AS qv_real FROM {{bases}} CROSS JOIN {{qualities}}"
_R.rows("q_quant_tables", _TABLE.format(f.standard_entry("b", "q", "div")), _BASES, _QUALITIES, duck=_TABLE.format(f.standard_entry("b", "q", "//")))
_R.rows("q_perceptual_tables", f"SELECT c, q, k, {f.perceptual_entry('base', 'd', 'exponent')} AS qv FROM {{perceptual}} CROSS JOIN (SELECT q, {f.distance('q')} AS d FROM {{qualities}}) AS x", _PERCEPTUAL, _QUALITIES)
_XYB = ("xyb", "c int, k int, base double, annex double, exponent double", "c, k, base, annex, exponent", tables.xyb_rows())
_R.rows("q_xyb_tables", f"SELECT c, q, k, {f.perceptual_entry('base', 'd', 'exponent', tables.XYB_GLOBAL_SCALE)} AS qv, {f.perceptual_entry('annex', 'd', 'exponent', 1.0)} AS annex_qv FROM {{xyb}} CROSS JOIN (SELECT q, {f.distance('q')} AS d FROM {{qualities}}) AS x", _XYB, _QUALITIES)
_R.rows("q_scale_inverse", f"SELECT c, q, k, round({f.scale_distance('(' + f.distance_scale('d', 'exponent') + ')', 'exponent')}, 5) AS back FROM {{perceptual}} CROSS JOIN (SELECT q, q / 10e0 AS d FROM {{qualities}}) AS x", _PERCEPTUAL, _QUALITIES)
_R.rows(
    "q_zero_bias",
    f"SELECT c, q, k, round(lq * {f.blend('d')} + hq * (1e0 - {f.blend('d')}), 8) AS mul, CASE WHEN k = 0 THEN 0e0 WHEN c = 0 THEN {num(tables.ZERO_BIAS_OFFSET_AC[0])} WHEN c = 1 THEN {num(tables.ZERO_BIAS_OFFSET_AC[1])} ELSE {num(tables.ZERO_BIAS_OFFSET_AC[2])} END AS off FROM {{perceptual}} CROSS JOIN (SELECT q, {f.distance('q')} AS d FROM {{qualities}}) AS x",
    _PERCEPTUAL,
    _QUALITIES,
)

# The distance that a set of tables stands for narrows an interval entry by
# entry in the order of components and frequencies; a bound that contradicts
# the interval is passed over.
_ENTRY = f"(qv {{}} 0.5e0) / base / {num(tables.GLOBAL_SCALE)}"
_BOUNDS = f"""SELECT q, c * 64 + k AS i, CASE WHEN qv > 1 THEN {f.scale_distance('(' + _ENTRY.format('-') + ')', 'exponent')} ELSE 0e0 END AS lo,
CASE WHEN qv < 255 THEN {f.scale_distance('(' + _ENTRY.format('+') + ')', 'exponent')} ELSE 1e4 END AS hi
FROM (SELECT p.*, q, {f.perceptual_entry('base', 'd', 'exponent')} AS qv FROM {{perceptual}} AS p CROSS JOIN (SELECT q, {f.distance('q')} AS d FROM {{qualities}}) AS x) AS t"""
_R.rows(
    "q_quant_vals_to_distance",
    f"""SELECT q, round(CASE WHEN r.lo = 0e0 THEN r.hi WHEN r.hi >= 1e4 THEN r.lo ELSE 0.5e0 * (r.lo + r.hi) END, 5) AS distance FROM (
SELECT q, aggregate(bounds, named_struct('lo', 0e0, 'hi', 1e4), (a, b) -> named_struct(
  'lo', CASE WHEN b.lo <= a.hi THEN greatest(a.lo, b.lo) ELSE a.lo END,
  'hi', CASE WHEN b.hi >= (CASE WHEN b.lo <= a.hi THEN greatest(a.lo, b.lo) ELSE a.lo END) THEN least(a.hi, b.hi) ELSE a.hi END)) AS r
FROM (SELECT q, array_sort(collect_list(struct(i, lo, hi))) AS bounds FROM ({_BOUNDS}) AS b GROUP BY q) AS g) AS f""",
    _PERCEPTUAL,
    _QUALITIES,
    duck=f"""SELECT q, round(CASE WHEN r.lo = 0e0 THEN r.hi WHEN r.hi >= 1e4 THEN r.lo ELSE 0.5e0 * (r.lo + r.hi) END, 5) AS distance FROM (
SELECT q, list_reduce(list_prepend({{{{'i': -1, 'lo': 0e0, 'hi': 1e4}}}}, bounds), lambda a, b: {{{{'i': b.i,
  'lo': CASE WHEN b.lo <= a.hi THEN greatest(a.lo, b.lo) ELSE a.lo END,
  'hi': CASE WHEN b.hi >= (CASE WHEN b.lo <= a.hi THEN greatest(a.lo, b.lo) ELSE a.lo END) THEN least(a.hi, b.hi) ELSE a.hi END}}}}) AS r
FROM (SELECT q, list({{{{'i': i, 'lo': lo, 'hi': hi}}}} ORDER BY i) AS bounds FROM ({_BOUNDS}) AS b GROUP BY q))""",
)

_R.both("q_dct_int_basis", "SELECT image_id, n, k, c FROM {coef}", "coef")
_R.both("q_level_shift", "SELECT image_id, y, x, v - 128 AS shifted FROM {px}", "px")
# sign(c) (|c| + half) div unit, at several qualities: one pass over the coefficients, tables broadcast.
_PLAIN = "SELECT q, k, CAST(sum(abs(v)) AS BIGINT) AS total, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero, CAST(sum(abs(c - v * qv * CAST(67108864 AS BIGINT))) AS BIGINT) AS error FROM (SELECT t.q, k, c, qv, CAST(sign(c) AS BIGINT) * ((abs(c) + qv * CAST(33554432 AS BIGINT)) {div} (qv * CAST(67108864 AS BIGINT))) AS v FROM {{coef}} AS c JOIN (SELECT q, k, {entry} AS qv FROM {{bases}} CROSS JOIN {{qualities}} WHERE variant = 3 AND comp = 'luma' AND q IN (20, 40, 60, 80, 95)) AS t USING (k)) AS v GROUP BY q, k"


def _quantiser(name: str, body: str, **parts: str) -> None:
    def query(spark, sf_dir):
        frames = {"coef": views.coefficients(spark, sf_dir), "bases": tables.frame(spark, _BASES[1], _BASES[3]), "qualities": tables.frame(spark, _QUALITIES[1], _QUALITIES[3]), "perceptual": tables.frame(spark, _PERCEPTUAL[1], _PERCEPTUAL[3])}
        return views.select(frames, body.format(div="div", entry=f.standard_entry("b", "q", "div"), **parts))

    _R.queries[name] = query
    ctes = ", ".join(tables.values_sql(n, columns, rows) for n, _, columns, rows in (_BASES, _QUALITIES, _PERCEPTUAL))
    text = body.format(div="//", entry=f.standard_entry("b", "q", "//"), **parts).format(coef="coef", bases="bases", qualities="qualities", perceptual="perceptual")
    _R.oracle[name] = f"{views.duck('coef')}, {ctes}\n{text}"


_quantiser("q_quantize_plain", _PLAIN)
# abs(c / q) against off + mul * aq with aq = 0.08 and the multipliers at low quality: all factors are whole at 10^-7.
_OFFSET = round(tables.ZERO_BIAS_OFFSET_AC[0] * 10**7)
_ZERO = "SELECT k, v, plain FROM (SELECT image_id, n, p.k, CAST(sign(t.c) AS BIGINT) * ((abs(t.c) + qv * CAST(33554432 AS BIGINT)) {div} (qv * CAST(67108864 AS BIGINT))) AS plain, CASE WHEN CAST(abs(t.c) AS DECIMAL(30, 0)) * 10000000 >= CAST(qv * CAST(67108864 AS BIGINT) AS DECIMAL(30, 0)) * (CASE WHEN p.k = 0 THEN 0 ELSE " + str(_OFFSET) + " END + CAST(round(lq * 10000) AS BIGINT) * 80) THEN CAST(sign(t.c) AS BIGINT) * ((abs(t.c) + qv * CAST(33554432 AS BIGINT)) {div} (qv * CAST(67108864 AS BIGINT))) ELSE 0 END AS v FROM {{coef}} AS t JOIN {{perceptual}} AS p ON p.k = t.k AND p.c = 0 JOIN (SELECT k, {entry} AS qv FROM {{bases}} CROSS JOIN {{qualities}} WHERE variant = 3 AND comp = 'luma' AND q = 75) AS q ON q.k = t.k) AS z"
_quantiser("q_quantize_zero_bias", "SELECT k, CAST(sum(abs(v)) AS BIGINT) AS total, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero FROM (" + _ZERO + ") AS a GROUP BY k")
_quantiser("q_zero_bias_kills", "SELECT k, CAST(sum(CASE WHEN plain <> 0 AND v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS killed, CAST(sum(CASE WHEN plain <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS before FROM (" + _ZERO + ") AS a GROUP BY k")
_quantiser("q_dequantize", "SELECT k, CAST(sum(abs(v * qv)) AS BIGINT) AS total, max(abs(c - v * qv * CAST(67108864 AS BIGINT))) AS worst FROM (SELECT t.k, c, qv, CAST(sign(c) AS BIGINT) * ((abs(c) + qv * CAST(33554432 AS BIGINT)) {div} (qv * CAST(67108864 AS BIGINT))) AS v FROM {{coef}} AS t JOIN (SELECT k, {entry} AS qv FROM {{bases}} CROSS JOIN {{qualities}} WHERE variant = 0 AND comp = 'luma' AND q = 50) AS q ON q.k = t.k) AS z GROUP BY k")

"""Rate-distortion queries: sweeps, fronts, comparisons and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import rd
from tessera.plans import tables
from tessera.plans.registry import Registry
from tessera.sources import views

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle


def _setting_rows(qualities) -> list[tuple]:
    rows = []
    for codec in rd.CODECS:
        for q in qualities:
            t = tables.quant_table(tables.IMAGE_MAGICK_LUMA, q)
            rows += [(codec, q, k, t[k], rd.thresholds(codec)[k]) for k in range(64)]
    return rows


_CODES = tables.values_sql("code", "table_id, ord, len, symbol", tables.standard_code_rows())


def oracle(qualities=rd.QUALITIES) -> str:
    """The points of every setting, with windows over the coefficients' rows."""
    return f"""{views.duck('coef', 'zigzag')}, {tables.values_sql('setting', 'codec, q, k, qv, least', _setting_rows(qualities))}, {_CODES},
qz AS (SELECT image_id, codec, q, n, z, c, qv, CASE WHEN abs(c) * 10000000 >= CAST(qv AS BIGINT) * 67108864 * least THEN CAST(sign(c) AS BIGINT) * ((abs(c) + CAST(qv AS BIGINT) * 33554432) // (CAST(qv AS BIGINT) * 67108864)) ELSE 0 END AS v FROM coef JOIN setting USING (k) JOIN zigzag USING (k)),
nz AS (SELECT *, z - lag(z, 1, 0) OVER (PARTITION BY image_id, codec, q, n ORDER BY z) - 1 AS run, length(bin(abs(v))) AS size FROM qz WHERE z > 0 AND v <> 0),
dcs AS (SELECT image_id, codec, q, v - lag(v, 1, 0) OVER (PARTITION BY image_id, codec, q ORDER BY n) AS d FROM qz WHERE z = 0),
tok AS (SELECT image_id, codec, q, 'dc_luma' AS table_id, CASE WHEN d = 0 THEN 0 ELSE length(bin(abs(d))) END AS symbol, CASE WHEN d = 0 THEN 0 ELSE length(bin(abs(d))) END AS nbits, 1 AS times FROM dcs
  UNION ALL SELECT image_id, codec, q, 'ac_luma', run % 16 * 16 + size, size, 1 FROM nz
  UNION ALL SELECT image_id, codec, q, 'ac_luma', 240, 0, run // 16 FROM nz
  UNION ALL SELECT image_id, codec, q, 'ac_luma', 0, 0, 1 FROM (SELECT image_id, codec, q, n, max(CASE WHEN v <> 0 THEN z ELSE 0 END) AS last FROM qz GROUP BY ALL) WHERE last < 63),
size AS (SELECT image_id, codec, q, CAST((sum(times * (len + nbits)) + 7) // 8 AS BIGINT) AS bytes FROM tok JOIN code USING (table_id, symbol) GROUP BY ALL),
err AS (SELECT image_id, codec, q, count(*) // 64 AS blocks, sum(abs(c - v * qv * 67108864)) AS error FROM qz GROUP BY ALL),
rd_points AS (SELECT image_id, codec, q, blocks, bytes, bytes * 8 / (blocks * 64) AS bpp, error / (blocks * 64e0 * 67108864) AS metric FROM size JOIN err USING (image_id, codec, q))"""


def _points(spark, sf_dir, qualities=rd.QUALITIES) -> DataFrame:
    return rd.rd_points(views.blocks(spark, sf_dir), qualities)


def _query(name: str, body: str, duck: str | None = None, qualities=rd.QUALITIES) -> None:
    _R.queries[name] = lambda spark, sf_dir: views.select({"rd_points": _points(spark, sf_dir, qualities)}, body.replace(" // ", " div "))
    _R.oracle[name] = f"{oracle(qualities)}\n{(duck or body).format(rd_points='rd_points')}"


_query("q_rd_points", "SELECT image_id, codec, q, blocks, bytes, round(bpp, 6) AS bpp, round(metric, 6) AS metric FROM {rd_points}")
_query("q_rd_monotone", "SELECT image_id, codec, q, bytes >= lag(bytes, 1, CAST(0 AS BIGINT)) OVER w AS grows, metric <= 1.1e0 * coalesce(lag(metric) OVER w, metric) AS improves FROM {rd_points} WINDOW w AS (PARTITION BY image_id, codec ORDER BY q)")
_query("q_log_deltas", "SELECT image_id, codec, round(max(step), 5) AS widest, round(min(step), 5) AS narrowest FROM (SELECT image_id, codec, abs(ln(metric) - ln(lag(metric) OVER (PARTITION BY image_id, codec ORDER BY q))) AS step FROM {rd_points}) AS d WHERE step IS NOT NULL GROUP BY image_id, codec")
_DISTANCE = "(SELECT a.image_id AS image_a, b.image_id AS image_b, avg((abs(a.bpp - b.bpp) / ((a.bpp + b.bpp) / 2e0) + abs(a.metric - b.metric) / ((a.metric + b.metric) / 2e0)) / 2e0) AS distance FROM {rd_points} AS a JOIN {rd_points} AS b ON a.q = b.q AND a.codec = b.codec AND a.image_id < b.image_id WHERE a.codec = 'plain' GROUP BY a.image_id, b.image_id)"
_query("q_rd_distance", f"SELECT image_a, image_b, round(distance, 6) AS distance FROM {_DISTANCE} AS d")
_query(
    "q_rd_signature",
    "SELECT image_id, codec, array_join(transform(array_sort(collect_list(struct(q, CAST(floor(bpp * 10) AS INT) AS b, CAST(floor(metric * 10) AS INT) AS m))), x -> concat(x.b, ':', x.m)), '_') AS signature FROM {rd_points} GROUP BY image_id, codec",
    duck="SELECT image_id, codec, string_agg(CAST(CAST(floor(bpp * 10) AS INT) AS VARCHAR) || ':' || CAST(CAST(floor(metric * 10) AS INT) AS VARCHAR), '_' ORDER BY q) AS signature FROM {rd_points} GROUP BY image_id, codec",
)
# A point is on the front if no other has at most its rate and a lower error.
_FRONT = "SELECT image_id, codec, q, bytes, round(metric, 6) AS metric FROM (SELECT *, min(metric) OVER (PARTITION BY {key} ORDER BY bytes, metric, codec, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {{rd_points}}) AS p WHERE before IS NULL OR metric < before"
_query("q_pareto", _FRONT.format(key="image_id"))
_query("q_pareto_per_codec", _FRONT.format(key="image_id, codec"))
_query("q_best_at_quality", "SELECT image_id, min_by(codec, bytes * 10 + CASE WHEN codec = 'plain' THEN 0 ELSE 1 END) AS codec, min(bytes) AS bytes FROM {rd_points} WHERE q >= 80 GROUP BY image_id")
_query("q_quality_match", "SELECT image_id, codec, min(q) AS least_q, min(bytes) AS bytes FROM {rd_points} WHERE metric <= 2.5e0 GROUP BY image_id, codec")
_query("q_pairwise_winner", "SELECT a.image_id, a.q, CASE WHEN a.metric < b.metric THEN 'plain' WHEN b.metric < a.metric THEN 'zero_bias' ELSE 'tie' END AS winner, round(100e0 * (b.bytes - a.bytes) / a.bytes, 4) AS size_diff_pct FROM {rd_points} AS a JOIN {rd_points} AS b ON a.image_id = b.image_id AND a.q = b.q WHERE a.codec = 'plain' AND b.codec = 'zero_bias'")
# Each plain point against the nearest point of the other codec at most its rate.
_MATCHED = "(SELECT a.image_id, a.q, a.bpp, a.metric, max(CASE WHEN b.bytes <= a.bytes THEN b.bytes END) AS at FROM {rd_points} AS a JOIN {rd_points} AS b ON a.image_id = b.image_id AND b.codec = 'zero_bias' WHERE a.codec = 'plain' GROUP BY a.image_id, a.q, a.bpp, a.metric)"
_query("q_bpp_matched_wins", f"SELECT CAST(floor(m.bpp * 2) AS INT) AS bpp_bin, count(*) AS n, CAST(sum(CASE WHEN m.metric < 0.95e0 * b.metric THEN 1 ELSE 0 END) AS BIGINT) AS plain_wins, CAST(sum(CASE WHEN b.metric < 0.95e0 * m.metric THEN 1 ELSE 0 END) AS BIGINT) AS other_wins FROM {_MATCHED} AS m JOIN (SELECT image_id, bytes, min(metric) AS metric FROM {{rd_points}} WHERE codec = 'zero_bias' GROUP BY image_id, bytes) AS b ON b.image_id = m.image_id AND b.bytes = m.at GROUP BY CAST(floor(m.bpp * 2) AS INT)")
_query("q_predictor_accuracy", "SELECT q, avg(CASE WHEN (b.bytes < a.bytes) = (a.bpp < 3e0) THEN 1e0 ELSE 0e0 END) AS accuracy, avg(CASE WHEN b.bytes < a.bytes THEN 1e0 ELSE 0e0 END) AS constant_rule, count(*) AS n FROM {rd_points} AS a JOIN {rd_points} AS b USING (image_id, q) WHERE a.codec = 'plain' AND b.codec = 'zero_bias' GROUP BY q")
_query(
    "q_size_ratio_matrix",
    "SELECT image_id, r20, r40, r60, r80, r95 FROM (SELECT a.image_id, a.q, round(b.bytes / a.bytes, 6) AS r FROM {rd_points} AS a JOIN {rd_points} AS b ON a.image_id = b.image_id AND a.q = b.q WHERE a.codec = 'plain' AND b.codec = 'zero_bias') PIVOT (max(r) FOR q IN (20 AS r20, 40 AS r40, 60 AS r60, 80 AS r80, 95 AS r95))",
    duck="SELECT image_id, max(CASE WHEN q = 20 THEN r END) AS r20, max(CASE WHEN q = 40 THEN r END) AS r40, max(CASE WHEN q = 60 THEN r END) AS r60, max(CASE WHEN q = 80 THEN r END) AS r80, max(CASE WHEN q = 95 THEN r END) AS r95 FROM (SELECT a.image_id, a.q, round(b.bytes / a.bytes, 6) AS r FROM {rd_points} AS a JOIN {rd_points} AS b ON a.image_id = b.image_id AND a.q = b.q WHERE a.codec = 'plain' AND b.codec = 'zero_bias') AS x GROUP BY image_id",
)
_query("q_ab_summary", "SELECT coalesce(q, 0) AS q, round(avg(100e0 * (b.bytes - a.bytes) / a.bytes), 5) AS size_diff_pct, round(avg(b.metric - a.metric), 6) AS metric_diff, count(*) AS n FROM {rd_points} AS a JOIN {rd_points} AS b USING (image_id, q) WHERE a.codec = 'plain' AND b.codec = 'zero_bias' GROUP BY ROLLUP (q)")
# The highest of all qualities that fits in 24 bytes a block; 10 where none does. Quality and size travel as one number.
_FIT = "SELECT image_id, codec, coalesce(max(CASE WHEN bytes <= blocks * 24 THEN q * CAST(1000000000000 AS BIGINT) + bytes END), max(CASE WHEN q = 10 THEN q * CAST(1000000000000 AS BIGINT) + bytes END)) AS best FROM {rd_points} GROUP BY image_id, codec"
_query("q_target_size", f"SELECT image_id, codec, CAST(best // 1000000000000 AS INT) AS q, best % 1000000000000 AS bytes FROM ({_FIT}) AS f", qualities=tuple(range(10, 101)))
_query("q_corpus_summary", "SELECT coalesce(codec, 'all') AS codec, coalesce(q, 0) AS q, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(blocks * 64 - bytes) AS BIGINT) AS saved FROM {rd_points} GROUP BY GROUPING SETS ((codec, q), (codec), ())")


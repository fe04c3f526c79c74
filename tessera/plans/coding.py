"""Symbol streams, histograms and code tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import tokens
from tessera.plans import tables
from tessera.plans.registry import Registry
from tessera.sources import views

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle

_CODES = tables.values_sql("code", "table_id, ord, len, symbol", tables.standard_code_rows())


@_R.frame("q_zigzag", f"{views.duck('qz')}\nSELECT image_id, n, z, v FROM qz")
def _zigzag(spark, sf_dir):
    return views.quantised(spark, sf_dir).select("image_id", "n", F.posexplode("z").alias("z", "v"))


@_R.frame("q_dc_dpcm", f"{views.duck('tok')}\nSELECT image_id, n, v AS d, nbits FROM tok WHERE is_dc = 1")
def _dc(spark, sf_dir):
    return tokens.tokens(views.quantised(spark, sf_dir)).filter("is_dc = 1").select("image_id", "n", F.col("v").alias("d"), "nbits")


@_R.frame("q_dc_dpcm_restart", f"{views.duck('qz')}\nSELECT image_id, n, n // 3 % 8 AS rst, v - lag(v, 1, 0) OVER (PARTITION BY image_id, n // 3 ORDER BY n) AS d FROM qz WHERE z = 0")
def _dc_restart(spark, sf_dir):
    d = tokens.dc_differences(views.quantised(spark, sf_dir), restart=3)
    return d.select("image_id", "n", (F.floor(F.col("n") / 3) % 8).alias("rst"), "d")


@_R.frame("q_ac_tokens", f"{views.duck('tok')}\nSELECT image_id, n, pos, symbol, nbits, v, count(*) AS times FROM tok WHERE is_dc = 0 GROUP BY ALL")
def _ac(spark, sf_dir):
    t = tokens.tokens(views.quantised(spark, sf_dir)).filter("is_dc = 0")
    return t.groupBy("image_id", "n", "pos", "symbol", "nbits", "v").agg(F.count(F.lit(1)).alias("times"))


@_R.frame("q_additional_bits", f"{views.duck('tok')}\nSELECT v, nbits, CASE WHEN v >= 0 THEN v ELSE v + CAST(pow(2, nbits) AS BIGINT) - 1 END AS bits, v AS decoded FROM tok WHERE nbits > 0 GROUP BY v, nbits")
def _extra(spark, sf_dir):
    t = tokens.tokens(views.quantised(spark, sf_dir)).filter("nbits > 0").select("v", "nbits").distinct()
    t = t.withColumn("bits", tokens.additional_bits(F.col("v"), F.col("nbits")))
    return t.withColumn("decoded", tokens.decode_value(F.col("bits"), F.col("nbits")))


@_R.frame("q_symbol_hist", f"{views.duck('tok')}\nSELECT image_id, is_dc, symbol, count(*) AS n, CAST(sum(nbits) AS BIGINT) AS extra_bits FROM tok GROUP BY ALL")
def _hist(spark, sf_dir):
    return tokens.histogram(tokens.tokens(views.quantised(spark, sf_dir)), "image_id")


@_R.frame("q_symbol_hist_total", f"{views.duck('tok')}\nSELECT is_dc, least(symbol, CASE WHEN is_dc = 1 THEN 11 ELSE 255 END) AS symbol, count(*) AS n FROM tok GROUP BY ALL")
def _hist_total(spark, sf_dir):
    t = tokens.tokens(views.quantised(spark, sf_dir)).withColumn("symbol", F.least("symbol", F.when(F.col("is_dc") == 1, 11).otherwise(255)))
    return t.groupBy("is_dc", "symbol").agg(F.count(F.lit(1)).alias("n"))


@_R.frame("q_scan_bits", f"{views.duck('tok')}, {_CODES}\nSELECT image_id, count(*) AS tokens, CAST(sum(len + nbits) AS BIGINT) AS bits FROM tok JOIN code ON code.symbol = tok.symbol AND table_id = CASE WHEN is_dc = 1 THEN 'dc_luma' ELSE 'ac_luma' END GROUP BY image_id")
def _bits(spark, sf_dir):
    return tokens.scan_bits(views.quantised(spark, sf_dir))


_R.rows(
    "q_canonical_codes",
    "SELECT table_id, symbol, len, CAST(coalesce(sum(CAST(pow(2, 16 - len) AS BIGINT)) OVER (PARTITION BY table_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) {div} CAST(pow(2, 16 - len) AS BIGINT) AS code FROM {{code}}".format(div="div"),
    ("code", "table_id string, ord int, len int, symbol int", "table_id, ord, len, symbol", tables.standard_code_rows()),
    duck="SELECT table_id, symbol, len, CAST(coalesce(sum(CAST(pow(2, 16 - len) AS BIGINT)) OVER (PARTITION BY table_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // CAST(pow(2, 16 - len) AS BIGINT) AS code FROM {code}",
)
_R.rows(
    "q_wire_tables",
    "SELECT table_id, len, count(*) AS codes, min(symbol) AS lowest, max(symbol) AS highest FROM {code} GROUP BY table_id, len",
    ("code", "table_id string, ord int, len int, symbol int", "table_id, ord, len, symbol", tables.standard_code_rows()),
)

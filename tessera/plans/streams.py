"""The band coders over streams of pixel rows, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans import numeric, tables
from tessera.plans.registry import Registry
from tessera.sources import views
from tessera.sources.scratch import kept, shared_dir
from tessera.streaming.bands import code_bands
from tessera.streaming.chunks import encode_rows, in_order

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle


@_R.frame(
    "q_band_stream",
    f"""{numeric.LOEFFLER.replace('SELECT image_id, n, CAST(u * 8 + v', ', raw AS (SELECT image_id, n, CAST(u * 8 + v')}), {views.duck('quant').removeprefix('WITH ')},
z AS (SELECT image_id, n, k, CAST(sign(c) * ((abs(c) + q * 4) // (q * 8)) AS BIGINT) AS v FROM raw JOIN quant USING (k))
SELECT image_id, CAST(n // 8 AS INTEGER) AS band, CAST(n % 8 AS INTEGER) AS bx, CAST(dc - lag(dc, 1, 0) OVER (PARTITION BY image_id ORDER BY n) AS INTEGER) AS dc, nonzero
FROM (SELECT image_id, n, max(CASE WHEN k = 0 THEN v END) AS dc, CAST(sum(CASE WHEN k > 0 AND v <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS nonzero FROM z GROUP BY ALL)""",
)
def _bands(spark, sf_dir):
    folder = f"{shared_dir(spark)}/bands-{uuid.uuid4().hex}"
    rows = views.pixels(spark, sf_dir).groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("v"))
    rows.write.parquet(f"{folder}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/rows")
    coded = code_bands(stream, tables.quant_table(tables.IMAGE_MAGICK_LUMA, 75))
    coded.writeStream.format("parquet").option("path", f"{folder}/coded").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(coded.schema).parquet(f"{folder}/coded")


# Rows as events: images of different widths and heights; rows come out of order, some twice, some never.
_EVENTS = """SELECT c.image_id, c.y, c.x, c.v, c.w, c.h FROM (SELECT p.image_id, y, x, v, 64 - 5 * (p.image_id % 4) AS w, h FROM {px} AS p JOIN (SELECT image_id, max(y) - 2 AS h FROM {px} GROUP BY image_id) AS s ON s.image_id = p.image_id) AS c WHERE y < h AND x < w AND (y * 7 + c.image_id) % 23 <> 5"""
_CODED = f"""{views.duck('px', 'basis', 'zigzag', 'quant')}, events AS MATERIALIZED ({_EVENTS.format(px='px')}),
there AS (SELECT DISTINCT image_id, y, y // 8 AS band, w, h FROM events),
places AS (SELECT image_id, band, w, h, band * 8 + unnest(range(8)) AS py FROM (SELECT DISTINCT image_id, band, w, h FROM there)),
source AS (SELECT p.image_id, p.band, p.w, p.py, coalesce(max(t.y) FILTER (t.y <= p.py), min(t.y)) AS y FROM places p JOIN there t ON t.image_id = p.image_id AND t.band = p.band GROUP BY ALL),
lost AS (SELECT image_id, band, max(least(8, h - band * 8)) - count(*) AS missing FROM there GROUP BY ALL),
filled AS (SELECT s.image_id, s.band, s.py % 8 AS row, t.px // 8 AS bx, t.px % 8 AS col, e.v FROM source s, range(64) AS t(px), events e WHERE t.px < (s.w + 7) // 8 * 8 AND e.image_id = s.image_id AND e.y = s.y AND e.x = least(t.px, s.w - 1)),
half AS (SELECT image_id, band, bx, row, u, sum((v - 128) * basis.w) AS t FROM filled JOIN basis ON basis.x = col GROUP BY ALL),
coef AS (SELECT image_id, band, bx, b.u * 8 + h.u AS k, CAST(sum(t * b.w) AS BIGINT) AS c FROM half h JOIN basis b ON b.x = h.row GROUP BY ALL),
z AS (SELECT image_id, band, bx, z, CAST(sign(c) * ((abs(c) + q * CAST(33554432 AS BIGINT)) // (q * CAST(67108864 AS BIGINT))) AS BIGINT) AS v FROM coef JOIN quant USING (k) JOIN zigzag USING (k))
SELECT image_id, CAST(band AS INTEGER) AS band, CAST(bx AS INTEGER) AS bx, CAST(missing AS INTEGER) AS missing, CAST(dc - lag(dc, 1, 0) OVER (PARTITION BY image_id ORDER BY band, bx) AS INTEGER) AS d, nonzero, placed
FROM (SELECT image_id, band, bx, max(CASE WHEN z = 0 THEN v END) AS dc, CAST(sum(CASE WHEN z > 0 AND v <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS nonzero, CAST(sum(v * (z + 1)) AS BIGINT) AS placed FROM z GROUP BY ALL) JOIN lost USING (image_id, band)"""


def row_events(spark, sf_dir):
    """image_id, width, height, y, at and v of the rows of ``_EVENTS``, one in six twice, each some seconds off its turn."""
    px = views.select({"px": views.pixels(spark, sf_dir)}, _EVENTS)
    rows = px.groupBy("image_id", "y", F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("v"))
    twice = rows.withColumn("again", F.explode(F.when(F.col("y") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    seconds = F.col("y") + F.pmod(F.xxhash64("image_id", "y", "again"), F.lit(20))
    return twice.select("image_id", "width", "height", F.col("y").cast("int").alias("y"), F.timestamp_seconds(seconds).alias("at"), "v", "again")


@_R.frame("q_chunk_stream", _CODED)
def _chunks(spark, sf_dir):
    """Blocks of a stream of row events in several batches; a last event far
    ahead moves the watermark, so that bands with lost rows are closed."""
    folder = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    events = kept(row_events(spark, sf_dir), "row-events")
    shape = events.drop("again").schema
    for part in ("again = 0 AND y % 2 = 0", "again = 1", "again = 0 AND y % 2 = 1"):
        events.filter(part).drop("again").write.mode("append").parquet(f"{folder}/rows")
    spark.range(1).select(*[(F.timestamp_seconds(F.lit(10**9)) if f.name == "at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in shape]).write.mode("append").parquet(f"{folder}/rows")
    files = max(1, len(events.inputFiles()))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", files).parquet(f"{folder}/rows")
    coded = encode_rows(stream, tables.quant_table(tables.IMAGE_MAGICK_LUMA, 75), patience=3600, late="1 hour")
    coded.writeStream.format("parquet").option("path", f"{folder}/coded").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    blocks = in_order(spark.read.schema(coded.schema).parquet(f"{folder}/coded"))
    fold = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    nonzero = F.size(F.filter("z", lambda v, i: (i > 0) & (v != 0)))
    return blocks.select("image_id", "band", "bx", "missing", F.col("d").cast("int").alias("d"), nonzero.alias("nonzero"), fold(F.transform("z", lambda v, i: v * (i + 1))).alias("placed"))

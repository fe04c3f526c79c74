"""Tables of samples, blocks, pixels and coefficients over the ``embeddings`` table.

A row of 64 numbers is one 8x8 block. The blocks of one label whose ids lie in
one stretch of ``STRETCH`` ids form, in their order, an image of eight blocks a
row, so images are bounded whatever the table holds; the last block repeats to
the end of its row. ``duck`` gives the same views as common table expressions
for the oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import colour
from tessera.operators import transform
from tessera.plans import tables

GAIN = 240
#: Ids that the blocks of one image come from: 4096 rows of blocks at most.
STRETCH = 32768


def blocks(spark: SparkSession, sf_dir: str, gain: int = GAIN) -> DataFrame:
    """image_id, n, by, bx, vec_id and s, the 64 samples of each block."""
    image = (F.col("label") + 1000 * F.floor(F.col("vec_id") / STRETCH)).cast("int")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", image.alias("image_id"), "embedding")
    sample = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.lit(128.0) + F.lit(float(gain)) * x.cast("double")).cast("int")))
    w = Window.partitionBy("image_id")
    e = e.withColumn("n", (F.row_number().over(w.orderBy("vec_id")) - 1).cast("long")).withColumn("count", F.count(F.lit(1)).over(w))
    last = F.when(F.col("n") == F.col("count") - 1, F.ceil(F.col("count") / 8) * 8 - 1).otherwise(F.col("n"))
    e = e.withColumn("n", F.explode(F.sequence("n", last)))
    return e.select("image_id", "n", F.floor(F.col("n") / 8).alias("by"), (F.col("n") % 8).alias("bx"), "vec_id", F.transform("embedding", sample).alias("s"))


def samples(spark: SparkSession, sf_dir: str, gain: int = GAIN) -> DataFrame:
    """vec_id, label, p and s of every sample."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    return e.select("vec_id", "label", "p", F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.lit(128.0) + F.lit(float(gain)) * F.col("e").cast("double")).cast("int"))).alias("s"))


def pixels(spark: SparkSession, sf_dir: str, gain: int = GAIN) -> DataFrame:
    """image_id, y, x and v."""
    b = blocks(spark, sf_dir, gain).select("image_id", "by", "bx", F.posexplode("s").alias("p", "v"))
    return b.select("image_id", (F.col("by") * 8 + F.floor(F.col("p") / 8)).alias("y"), (F.col("bx") * 8 + F.col("p") % 8).alias("x"), "v")


def colours(spark: SparkSession, sf_dir: str, gain: int = GAIN) -> DataFrame:
    """image_id, y, x, r, g and b: three samples of a block, 21 places apart."""
    b = blocks(spark, sf_dir, gain)
    b = b.select("image_id", "by", "bx", "s", F.posexplode("s").alias("p", "r"))
    at = lambda i: F.get("s", (F.col("p") + i) % 64)
    return b.select("image_id", (F.col("by") * 8 + F.floor(F.col("p") / 8)).alias("y"), (F.col("bx") * 8 + F.col("p") % 8).alias("x"), "r", at(21).alias("g"), at(42).alias("b"))


def cropped(spark: SparkSession, sf_dir: str, gain: int = GAIN) -> DataFrame:
    """Pixels without the last three rows and columns, with the image's size: image_id, y, x, v, w, h."""
    p = pixels(spark, sf_dir, gain)
    size = p.groupBy("image_id").agg((F.max("y") - 2).alias("h"))
    return p.join(F.broadcast(size), "image_id").withColumn("w", F.lit(61).cast("long")).filter("y < h AND x < w")


def coefficients(spark: SparkSession, sf_dir: str, gain: int = GAIN) -> DataFrame:
    """image_id, n, k and c, the transform scaled by 2^26."""
    b = transform.dct_blocks(blocks(spark, sf_dir, gain))
    return b.select("image_id", "n", F.posexplode("c").alias("k", "c"))


def quantised(spark: SparkSession, sf_dir: str, quality: int = 75, gain: int = GAIN) -> DataFrame:
    """image_id, n and z: quantised coefficients in zigzag order."""
    b = transform.dct_blocks(blocks(spark, sf_dir, gain))
    return transform.quantise(b, tables.quant_table(tables.IMAGE_MAGICK_LUMA, quality))


def component_blocks(spark: SparkSession, sf_dir: str, gain: int = GAIN) -> DataFrame:
    """image_id, n, comp (0 luma, 1 and 2 chroma) and s: the blocks of each
    component of ``colours``, turned where they stand."""
    picked = colour.ycbcr("s[p]", "s[(p + 21) % 64]", "s[(p + 42) % 64]")
    planes = F.array(*[F.expr(f"transform(sequence(0, 63), p -> {colour.sample(e)})") for e in picked])
    return blocks(spark, sf_dir, gain).select("image_id", "n", F.posexplode(planes).alias("comp", "s"))


def quantised_components(spark: SparkSession, sf_dir: str, quality: int = 75, gain: int = GAIN, halved: bool = False) -> DataFrame:
    """image_id, n, comp and z: luma and chroma blocks quantised by their tables."""
    b = component_blocks(spark, sf_dir, gain)
    b = transform.dct_blocks(halved_chroma(b) if halved else b)
    luma = transform.quantise(b.filter("comp = 0"), tables.quant_table(tables.ANNEX_K_LUMA, quality))
    chroma = transform.quantise(b.filter("comp > 0"), tables.quant_table(tables.ANNEX_K_CHROMA, quality))
    return luma.unionByName(chroma)


def halved_chroma(components: DataFrame) -> DataFrame:
    """Blocks (image_id, n, comp, s) with the chroma planes at half the size a
    side: the means of 2x2 samples, halves up. An odd last row of blocks is
    followed by one of its last samples, so that planes hold whole units."""
    last = components.groupBy("image_id").agg(F.floor(F.max("n") / 8).alias("last"))
    b = components.join(last, "image_id").withColumn("by", F.floor(F.col("n") / 8))
    edge = b.filter("by = last AND last % 2 = 0").withColumn("by", F.col("by") + 1).withColumn("n", F.col("n") + 8)
    edge = edge.withColumn("s", F.expr("transform(sequence(0, 63), p -> s[56 + p % 8])"))
    b = b.unionByName(edge)
    # the sixteen means of a block lie in one quarter of the smaller block
    means = F.expr("transform(sequence(0, 15), p -> (s[p div 4 * 16 + p % 4 * 2] + s[p div 4 * 16 + p % 4 * 2 + 1] + s[p div 4 * 16 + p % 4 * 2 + 8] + s[p div 4 * 16 + p % 4 * 2 + 9] + 2) div 4)")
    c = b.filter("comp > 0").selectExpr("image_id", "comp", "by div 2 * 4 + n % 8 div 2 AS at", "CAST(by % 2 * 2 + n % 2 AS INT) AS quarter", "s").withColumn("m", means)
    c = c.groupBy("image_id", "comp", F.col("at").alias("n")).agg(F.sort_array(F.collect_list(F.struct("quarter", "m"))).alias("q"))  # four quarters
    c = c.selectExpr("image_id", "n", "comp", "transform(sequence(0, 63), p -> CAST(q[p div 32 * 2 + p % 8 div 4].m[p div 8 % 4 * 4 + p % 4] AS INT)) AS s")
    return b.filter("comp = 0").select("image_id", "n", "comp", "s").unionByName(c)


VIEWS = {"samp": samples, "px": pixels, "rgb": colours, "crop": cropped, "coef": coefficients}

_ZIGZAG = tables.values_sql("zigzag", "z, k", list(enumerate(tables.ZIGZAG)))
_BASIS = tables.values_sql("basis", "u, x, w", [(u, x, tables.BASIS[u][x]) for u in range(8) for x in range(8)])
_QUANT = tables.values_sql("quant", "k, q", list(enumerate(tables.quant_table(tables.IMAGE_MAGICK_LUMA, 75))))


def duck(*names: str, gain: int = GAIN) -> str:
    """The named views and what they need, as a WITH clause for DuckDB."""
    text = {
        "samp": f"samp AS (SELECT vec_id, label, p, least(255, greatest(0, CAST(round(128e0 + {gain}e0 * CAST(e AS DOUBLE)) AS INTEGER))) AS s FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))",
        "blk": f"blk AS (SELECT image_id, n, n // 8 AS b_y, n % 8 AS b_x, vec_id FROM (SELECT image_id, vec_id, unnest(range(n, CASE WHEN n = cnt - 1 THEN (cnt + 7) // 8 * 8 ELSE n + 1 END)) AS n FROM (SELECT image_id, vec_id, row_number() OVER (PARTITION BY image_id ORDER BY vec_id) - 1 AS n, count(*) OVER (PARTITION BY image_id) AS cnt FROM (SELECT CAST(label + 1000 * (vec_id // {STRETCH}) AS INTEGER) AS image_id, vec_id FROM embeddings))))",
        "px": "px AS (SELECT image_id, b_y * 8 + p // 8 AS y, b_x * 8 + p % 8 AS x, s AS v FROM blk JOIN samp USING (vec_id))",
        "rgb": "rgb AS (SELECT image_id, b_y * 8 + a.p // 8 AS y, b_x * 8 + a.p % 8 AS x, a.s AS r, b.s AS g, c.s AS b FROM blk JOIN samp a USING (vec_id) JOIN samp b ON b.vec_id = blk.vec_id AND b.p = (a.p + 21) % 64 JOIN samp c ON c.vec_id = blk.vec_id AND c.p = (a.p + 42) % 64)",
        "crop": "crop AS (SELECT px.*, CAST(61 AS BIGINT) AS w, h FROM px JOIN (SELECT image_id, max(y) - 2 AS h FROM px GROUP BY image_id) USING (image_id) WHERE y < h AND x < 61)",
        "basis": _BASIS,
        "zigzag": _ZIGZAG,
        "quant": _QUANT,
        "half": "half AS (SELECT image_id, n, p // 8 AS y, u, sum((s - 128) * w) AS t FROM blk JOIN samp USING (vec_id) JOIN basis ON x = p % 8 GROUP BY ALL)",
        "coef": "coef AS (SELECT image_id, n, b.u * 8 + h.u AS k, CAST(sum(t * w) AS BIGINT) AS c FROM half h JOIN basis b ON b.x = h.y GROUP BY ALL)",
        "qz": "qz AS (SELECT image_id, n, z, CAST(sign(c) * ((abs(c) + q * CAST(33554432 AS BIGINT)) // (q * CAST(67108864 AS BIGINT))) AS BIGINT) AS v FROM coef JOIN quant USING (k) JOIN zigzag USING (k))",
        "tok": """nz AS (SELECT image_id, n, z, v, z - lag(z, 1, 0) OVER (PARTITION BY image_id, n ORDER BY z) - 1 AS run FROM qz WHERE z > 0 AND v <> 0),
dcs AS (SELECT image_id, n, v - lag(v, 1, 0) OVER (PARTITION BY image_id ORDER BY n) AS d FROM qz WHERE z = 0),
tok AS (SELECT image_id, n, 0 AS pos, 1 AS is_dc, CASE WHEN d = 0 THEN 0 ELSE length(bin(abs(d))) END AS symbol, CASE WHEN d = 0 THEN 0 ELSE length(bin(abs(d))) END AS nbits, d AS v FROM dcs
UNION ALL SELECT image_id, n, z, 0, (run % 16) * 16 + length(bin(abs(v))), length(bin(abs(v))), v FROM nz
UNION ALL SELECT image_id, n, z, 0, 240, 0, 0 FROM (SELECT image_id, n, z, unnest(range(run // 16)) FROM nz)
UNION ALL SELECT image_id, n, 64, 0, 0, 0, 0 FROM (SELECT qz.image_id, qz.n, max(CASE WHEN v <> 0 THEN z ELSE 0 END) AS last FROM qz GROUP BY ALL) WHERE last < 63)""",
    }
    needs = {"samp": (), "blk": (), "px": ("blk", "samp"), "rgb": ("blk", "samp"), "crop": ("px",), "basis": (), "zigzag": (), "quant": (), "half": ("blk", "samp", "basis"), "coef": ("half",), "qz": ("coef", "quant", "zigzag"), "tok": ("qz",)}
    order: list[str] = []

    def add(name: str) -> None:
        for other in needs[name]:
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(text[n] for n in order)


def select(df_of: dict[str, DataFrame], body: str) -> DataFrame:
    """Runs SQL text in which ``{name}`` stands for a DataFrame."""
    spark = next(iter(df_of.values())).sparkSession
    names = {n: f"{n}_{uuid.uuid4().hex[:12]}" for n in df_of}
    for n, df in df_of.items():
        df.createOrReplaceTempView(names[n])
    try:
        return spark.sql(body.format(**names))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)

"""Symbol streams of quantised blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import tables


def category(v: Column) -> Column:
    """Bit length of a magnitude; 0 for 0."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(v).cast("long")))).cast("int")


def additional_bits(v: Column, n: Column) -> Column:
    """The value's extra bits; negative values in one's complement."""
    return F.when(v >= 0, v).otherwise(v + F.pow(F.lit(2.0), n).cast("long") - 1)


def decode_value(bits: Column, n: Column) -> Column:
    """The inverse of additional_bits."""
    half = F.pow(F.lit(2.0), n - 1).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).when(bits >= half, bits).otherwise(bits - 2 * half + 1)


def ac_tokens(z: Column, first: int = 1, last: int = 63) -> Column:
    """(pos, symbol, nbits, v) of one block's band: run and size of each value
    but 0, 0xF0 for sixteen zeros, 0x00 if zeros end the band. One fold over
    the array, no rows are exploded."""
    kind = "array<struct<pos:int,symbol:int,nbits:int,v:long>>"
    token = lambda pos, symbol, nbits, v: F.struct(pos.cast("int").alias("pos"), symbol.cast("int").alias("symbol"), nbits.cast("int").alias("nbits"), v.cast("long").alias("v"))
    places = F.filter(F.sequence(F.lit(first), F.lit(last)), lambda i: F.get(z, i) != 0)
    start = F.struct(F.lit(first - 1).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, i: Column) -> Column:
        v, run = F.get(z, i), i - a["at"] - 1
        n = category(v)
        longs = F.when(run >= 16, F.transform(F.sequence(F.lit(1), F.greatest(F.floor(run / 16), F.lit(1))), lambda _: token(i, F.lit(240), F.lit(0), F.lit(0)))).otherwise(F.array().cast(kind))
        return F.struct(i.alias("at"), F.concat(a["out"], longs, F.array(token(i, (run % 16) * 16 + n, n, v))).alias("out"))

    end = lambda a: F.when(a["at"] < last, F.concat(a["out"], F.array(token(F.lit(last + 1), F.lit(0), F.lit(0), F.lit(0))))).otherwise(a["out"])
    return F.aggregate(places, start, step, end)


def dc_differences(blocks: DataFrame, restart: int = 0, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``d``: the first coefficient less that of the block before; 0 stands
    before the first block of ``keys`` and after each restart."""
    key = [*keys] + ([F.floor(F.col("n") / restart)] if restart else [])
    return blocks.withColumn("d", F.get("z", F.lit(0)) - F.lag(F.get("z", F.lit(0)), 1, 0).over(Window.partitionBy(*key).orderBy("n")))


def tokens(blocks: DataFrame, *more: str) -> DataFrame:
    """image_id, ``more`` keys of a chain of blocks (its component), n, is_dc,
    pos, symbol, nbits and v of every token."""
    keys = ("image_id", *more)
    n = category(F.col("d"))
    dc = F.array(F.struct(F.lit(0).alias("pos"), n.alias("symbol"), n.alias("nbits"), F.col("d").cast("long").alias("v")))
    t = dc_differences(blocks, keys=keys).select(*keys, "n", F.posexplode(F.concat(dc, ac_tokens(F.col("z")))).alias("seq", "t"))
    return t.select(*keys, "n", F.when(F.col("seq") == 0, 1).otherwise(0).alias("is_dc"), "t.pos", "t.symbol", "t.nbits", "t.v")


def histogram(tokens_df: DataFrame, *keys: str) -> DataFrame:
    return tokens_df.groupBy(*keys, "is_dc", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("nbits").alias("extra_bits"))


def scan_bits(blocks: DataFrame) -> DataFrame:
    """image_id, tokens and bits under the standard luma codes: the exact size
    of the entropy-coded scan, without packing a bit."""
    spark = blocks.sparkSession
    codes = [(1 if t == "dc_luma" else 0, s, n) for t, _, n, s in tables.standard_code_rows() if t.endswith("luma")]
    code = F.broadcast(tables.frame(spark, "is_dc int, symbol int, len int", codes))  # 174 rows
    counted = histogram(tokens(blocks), "image_id").join(code, ["is_dc", "symbol"])
    return counted.groupBy("image_id").agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("len") + F.col("extra_bits")).alias("bits"))

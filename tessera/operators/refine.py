"""Refinement scans as rows of tokens.

A refinement scan sends one more bit of every coefficient of a band. A value
that was known before adds a correction bit; a value that is new at this bit
gets a symbol with the zeros before it, its sign, and the correction bits that
wait; blocks that end in zeros join a run of ends. Each block turns into its own
tokens by one fold over its places where it stands; what links blocks, the run of
ends with the bits it carries, is a segmented count over windows of an image.

Two ways of sending are in use. ``tokens_replayed`` gathers tokens for a second
pass: sixteen zeros cost a symbol only if a new value follows, and correction
bits behind the last new value go with the run's end. ``tokens_direct`` writes as
it goes: every sixteenth zero sends its symbol with the bits so far, and bits
behind the last symbol are sent only by an end that is written at that block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run of ends has 15 bits.
LONGEST_RUN = 0x7FFF
#: Place of a run's end behind the tokens of its last block.
END = 64
SIXTEEN_ZEROS = 0xF0
_TOKENS = "array<struct<symbol:int,bits:string>>"
#: Codes of places.
ZERO, KNOWN_0, KNOWN_1, NEW_MINUS, NEW_PLUS = range(5)


def _codes(z: Column, first: int, last: int, high: int, low: int, signed: bool) -> Column:
    """What each place of the band first..last of z (zigzag order) is to a scan from
    bit ``high`` to ``low``: a zero, known before with its bit, or new with its sign.
    ``signed``: known by the shift of the signed value, which no negative value leaves at 0."""

    def code(v: Column) -> Column:
        size = F.shiftright(F.abs(v), low)
        bit = size.bitwiseAND(1) == 1
        new = (size == 1) if signed else bit
        known = F.shiftright(v if signed else F.abs(v), high) != 0
        return F.when(known, F.when(bit, KNOWN_1).otherwise(KNOWN_0)).when(new, F.when(v < 0, NEW_MINUS).otherwise(NEW_PLUS)).otherwise(ZERO)

    return F.transform(F.slice(z, first + 1, last - first + 1), code)


def _token(symbol: Column | int, bits: Column) -> Column:
    return F.struct((F.lit(symbol) if isinstance(symbol, int) else symbol).cast("int").alias("symbol"), bits.alias("bits"))


def _folded(codes: Column, sends: Callable[[Column, Column], Column], sent: Callable[[Column, Column], Column]) -> Column:
    """One pass over a block's codes: its tokens, the correction bits and the run
    of zeros behind the last of them, and whether it has known or new values.
    ``sends`` (state, code): this place sends tokens; ``sent``: which."""

    def step(s: Column, c: Column) -> Column:
        now = sends(s, c)
        return F.struct(
            F.when(now, F.concat(s["tokens"], sent(s, c))).otherwise(s["tokens"]).alias("tokens"),
            F.when(now, "").when(c == KNOWN_1, F.concat(s["bits"], F.lit("1"))).when(c == KNOWN_0, F.concat(s["bits"], F.lit("0"))).otherwise(s["bits"]).alias("bits"),
            F.when(now, 0).when(c == ZERO, s["run"] + 1).otherwise(s["run"]).alias("run"),
            (s["values"] | (c != ZERO)).alias("values"),
        )

    start = F.struct(F.array().cast(_TOKENS).alias("tokens"), F.lit("").alias("bits"), F.lit(0).alias("run"), F.lit(False).alias("values"))
    return F.aggregate(codes, start, step)


def _sign(c: Column) -> Column:
    return F.when(c == NEW_MINUS, "0").otherwise("1")


def _with_ends(blocks: DataFrame, keys: list[str], starts: Column, ends: Column, run_bits: Column) -> DataFrame:
    """Ends of runs as rows of keys, n, seq, symbol, bits, extra and extra_bits.

    ``starts``: a new run begins at this block; ``ends``: the block takes part in
    a run; ``run_bits``, aggregated over a run's part: the bits that go with it.
    Runs are cut where their number would outgrow its bits.
    """
    order = Window.partitionBy(*keys).orderBy("n")
    b = blocks.withColumn("segment", F.sum(starts.cast("long")).over(order)).withColumn("takes", ends)
    within = Window.partitionBy(*keys, "segment").orderBy("n")
    b = b.withColumn("count", F.sum(F.col("takes").cast("long")).over(within)).withColumn("part", F.floor(F.greatest(F.col("count") - 1, F.lit(0)) / LONGEST_RUN))
    runs = b.groupBy(*keys, "segment", "part").agg(F.max(F.when(F.col("takes"), F.col("n"))).alias("n"), F.sum(F.col("takes").cast("long")).alias("run"), run_bits.alias("bits")).filter("run > 0")
    size = (F.length(F.bin("run")) - 1).cast("int")
    extra = F.when(size == 0, F.lit(0).cast("long")).otherwise(F.col("run") - F.pow(F.lit(2.0), size).cast("long"))
    return runs.select(*keys, "n", F.lit(END).alias("seq"), F.shiftleft(size, 4).alias("symbol"), "bits", extra.alias("extra"), size.alias("extra_bits"))


def _rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    # by the outer form: for the inner one Spark folds each block again, to filter those without tokens
    own = blocks.select(*keys, "n", F.posexplode_outer("tokens").alias("seq", "t")).filter("t IS NOT NULL")
    return own.select(*keys, "n", "seq", "t.symbol", "t.bits", F.lit(0).cast("long").alias("extra"), F.lit(0).alias("extra_bits"))


def tokens_replayed(blocks: DataFrame, first: int, last: int, high: int, low: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, n, seq, symbol, bits, extra and extra_bits of every token of a scan
    of the blocks (keys, n, z), in the order of n and seq. Blocks should be a
    written table: tokens and ends of runs each read it.

    A block with known or new values closes the run before it; its own tail of
    zeros or bits opens one. A tail with bits stands alone, since the bits of
    one run belong to one block.
    """
    keys = list(keys)

    def sent(s: Column, c: Column) -> Column:
        value = lambda bits: F.array(_token(s["run"] % 16 * 16 + 1, F.concat(_sign(c), bits)))
        longs = F.concat(F.array(_token(SIXTEEN_ZEROS, s["bits"])), F.array_repeat(_token(SIXTEEN_ZEROS, F.lit("")), F.floor(s["run"] / 16).cast("int") - 1))
        return F.when(s["run"] < 16, value(s["bits"])).otherwise(F.concat(longs, value(F.lit(""))))

    folded = _folded(_codes(F.col("z"), first, last, high, low, signed=False), lambda s, c: c >= NEW_MINUS, sent)
    b = blocks.select(*keys, "n", folded.alias("s"))
    b = b.select(*keys, "n", "s.tokens", F.col("s.values").alias("content"), (F.col("s.run") > 0).alias("zeros"), F.col("s.bits").alias("tail"))
    order = Window.partitionBy(*keys).orderBy("n")
    takes = ~F.col("content") | F.col("zeros") | (F.col("tail") != "")
    b = b.withColumns({"alone": F.col("content") & (~takes | (F.col("tail") != ""))})
    starts = F.col("content") | F.coalesce(F.lag("alone").over(order), F.lit(False))
    b = b.withColumn("starts", starts)
    return _rows(b, keys).unionByName(_with_ends(b, keys, F.col("starts"), takes, F.max("tail")))


def tokens_direct(blocks: DataFrame, first: int, last: int, high: int, low: int, runs: bool = True, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """As ``tokens_replayed``, for the coder that writes as it goes. Without
    ``runs`` every block that ends in zeros has an end of its own, with its bits."""
    keys = list(keys)

    def sent(s: Column, c: Column) -> Column:
        return F.array(F.when(c == ZERO, _token(SIXTEEN_ZEROS, s["bits"])).otherwise(_token(s["run"] * 16 + 1, F.concat(_sign(c), s["bits"]))))

    sends = lambda s, c: (c >= NEW_MINUS) | ((c == ZERO) & (s["run"] == 15))
    b = blocks.select(*keys, "n", _folded(_codes(F.col("z"), first, last, high, low, signed=True), sends, sent).alias("s"))
    b = b.select(*keys, "n", "s.tokens", (F.size("s.tokens") > 0).alias("content"), (F.col("s.run") > 0).alias("zeros"), F.col("s.bits").alias("tail"))
    if not runs:
        return _rows(b, keys).unionByName(_with_ends(b, keys, F.lit(True), F.col("zeros"), F.max("tail")))
    # a block of known values alone closes the run before it and gives it its bits
    closes = ~F.col("content") & ~F.col("zeros")
    order = Window.partitionBy(*keys).orderBy("n")
    b = b.withColumn("starts", F.col("content") | F.coalesce(F.lag(closes).over(order), F.lit(False)))
    full = F.sum(F.col("zeros").cast("long")) == LONGEST_RUN
    last_tail = F.max_by("tail", F.when(F.col("takes"), F.col("n")))
    closing = F.coalesce(F.max(F.when(closes, F.col("tail"))), F.lit(""))
    return _rows(b, keys).unionByName(_with_ends(b, keys, F.col("starts"), F.col("zeros"), F.when(full, last_tail).otherwise(closing)))


def sliced(tokens: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Restart positions of token tables (keys, slice, n, symbol): keys, slice,
    begin, length, blocks and the sum of symbols of each slice, counted in tokens
    from the first of the scan.

    Tokens must come from blocks keyed by slice, so that no difference and no
    run goes across a restart. A slice begins where the lengths before it end:
    slices can be coded one by one, anywhere, and laid end to end.
    """
    counts = tokens.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("length"), F.count_distinct("n").alias("blocks"), F.sum("symbol").alias("symbols"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("begin", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select(*keys, "slice", "begin", "length", "blocks", "symbols")

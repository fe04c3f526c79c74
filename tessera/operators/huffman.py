"""Optimal code lengths of grouped histograms.

Merging is sequential over at most 257 symbols, so a histogram is one group of
a grouped-map function; groups are images, contexts or tables, never rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 16


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Length of each symbol's code, at most 16 bits, with one code of the
    longest length left unused, so that no code is all ones.

    The unused one is a symbol 256 of count 1 while merging. Of equal counts
    the higher symbol is merged first; a tree keeps the place of the lighter of
    its two halves. Lengths beyond 16 are brought up two at a time and dealt
    again by (length, symbol).
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return {}
    heap = [(n, -s, [s]) for s, n in (counts | {256: 1}).items()]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, 256], 0)
    while len(heap) > 1:
        n1, place, a = heapq.heappop(heap)
        n2, _, b = heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n1 + n2, place, a + b))
    level = [0] * (max(max(depth.values()), LONGEST) + 2)
    for d in depth.values():
        level[d] += 1
    for d in range(len(level) - 1, LONGEST, -1):
        while level[d] > 0:
            j = max(x for x in range(1, d - 1) if level[x])
            level[d] -= 2
            level[d - 1] += 1
            level[j + 1] += 2
            level[j] -= 1
    level[max(d for d in range(1, LONGEST + 1) if level[d])] -= 1
    order = iter(sorted(counts, key=lambda s: (depth[s], s)))
    return {next(order): d for d in range(1, LONGEST + 1) for _ in range(level[d])}


def two_pointer_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Code lengths by merging two sorted queues; counts are raised to a floor
    that doubles until no code is longer than ``longest``."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    floor = 1
    while True:
        leaves = sorted(((max(n, floor), s) for s, n in counts.items()), key=lambda x: (x[0], -x[1]))
        queue: list[tuple[int, list[int]]] = []
        depth, i, j = dict.fromkeys(counts, 0), 0, 0
        for _ in range(len(leaves) - 1):
            pair = []
            for _ in range(2):
                if j >= len(queue) or i < len(leaves) and leaves[i][0] <= queue[j][0]:
                    pair.append((leaves[i][0], [leaves[i][1]]))
                    i += 1
                else:
                    pair.append(queue[j])
                    j += 1
            members = pair[0][1] + pair[1][1]
            for s in members:
                depth[s] += 1
            queue.append((pair[0][0] + pair[1][0], members))
        if max(depth.values()) <= longest:
            return depth
        floor *= 2


def optimal_tables(histogram: DataFrame, *keys: str, lengths: Callable[[dict[int, int]], dict[int, int]] = code_lengths) -> DataFrame:
    """keys, symbol, n and len of each (keys) group of ``histogram`` (keys, symbol, n)."""
    kinds = {f.name: f.dataType.simpleString() for f in histogram.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", symbol int, n long, len int"

    def one(g: pd.DataFrame) -> pd.DataFrame:
        found = lengths(dict(zip(g["symbol"].astype(int), g["n"].astype(int), strict=True)))
        g = g.assign(len=g["symbol"].map(found).fillna(0).astype(int))
        return g[[*keys, "symbol", "n", "len"]]

    return histogram.groupBy(*keys).applyInPandas(one, schema)


def encoding_cost(counts: dict[int, int]) -> int:
    """Bits of a table's header, 136, 8 for each symbol, and of its codes."""
    found = code_lengths(counts)
    return 136 + 8 * len(found) + sum(n * counts[s] for s, n in found.items())


def cluster_histograms(histogram: DataFrame, key: str, context: str, most: int) -> DataFrame:
    """key, context and slot: contexts in order join the slot whose cost they
    raise least, or open one if that is cheaper and fewer than ``most`` are
    open. A key's contexts, a few dozen at most, are one group."""
    kinds = {f.name: f.dataType.simpleString() for f in histogram.schema.fields}

    def one(g: pd.DataFrame) -> pd.DataFrame:
        slots: list[tuple[dict[int, int], int]] = []
        rows = []
        for c, part in sorted(g.groupby(context)):
            own = dict(zip(part["symbol"].astype(int), part["n"].astype(int), strict=True))
            offers = [(encoding_cost(merged) - cost, i, merged) for i, (held, cost) in enumerate(slots) for merged in [{s: held.get(s, 0) + own.get(s, 0) for s in {*held, *own}}]]
            alone = encoding_cost(own)
            best = min(offers, key=lambda x: x[:2], default=None)
            if best is None or len(slots) < most and best[0] >= alone:
                slots.append((own, alone))
                rows.append((g[key].iloc[0], c, len(slots) - 1))
            else:
                slots[best[1]] = (best[2], slots[best[1]][1] + best[0])
                rows.append((g[key].iloc[0], c, best[1]))
        return pd.DataFrame(rows, columns=[key, context, "slot"])

    return histogram.groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, {context} {kinds[context]}, slot int")


def clustered_slots(histogram: DataFrame, key: str, context: str, most_dc: int, most_ac: int) -> DataFrame:
    """key, is_dc, context and slot: which of a key's tables each context uses.

    ``histogram`` has key, is_dc, context, symbol and n. DC and AC contexts
    are clustered apart; DC tables come first, AC tables are numbered on."""
    kinds = [(1, most_dc), (0, most_ac)]
    dc, ac = (cluster_histograms(histogram.filter(F.col("is_dc") == is_dc).drop("is_dc"), key, context, most).withColumn("is_dc", F.lit(is_dc)) for is_dc, most in kinds)
    # the DC slots of a key are counted where they are made, and joined on the key that both are dealt by
    first = dc.groupBy(key).agg((F.max("slot") + 1).alias("first"))
    ac = ac.join(first, key, "left").withColumn("slot", F.col("slot") + F.coalesce("first", F.lit(0))).drop("first")
    return dc.unionByName(ac).select(key, "is_dc", context, "slot")


def slot_tables(histogram: DataFrame, slots: DataFrame, key: str, context: str) -> DataFrame:
    """key, is_dc, slot, symbol, n and len: the table of every slot, from the
    sum of the histograms that use it."""
    summed = histogram.join(slots, [key, "is_dc", context]).groupBy(key, "is_dc", "slot", "symbol").agg(F.sum("n").alias("n"))
    return optimal_tables(summed, key, "is_dc", "slot")


def luma_chroma_tables(histogram: DataFrame, key: str, component: str) -> DataFrame:
    """key, is_dc, chroma, symbol, n and len: exactly one DC and one AC table
    for luma (component 0) and for chroma, the rest. A key without chroma has
    luma tables alone, which then serve both."""
    grouped = histogram.withColumn("chroma", (F.col(component) > 0).cast("int")).groupBy(key, "is_dc", "chroma", "symbol").agg(F.sum("n").alias("n"))
    return optimal_tables(grouped, key, "is_dc", "chroma")


def table_cost(tables: DataFrame, *keys: str) -> DataFrame:
    """keys, symbols, code_bits and header_bits of each table."""
    return tables.groupBy(*keys).agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.col("n") * F.col("len")).alias("code_bits"), (F.lit(136) + 8 * F.count(F.lit(1))).alias("header_bits"))

"""N-gram Jaccard self-join by a size-aware heavy-light plan.

A document's set holds its distinct ``N``-word shingles; two documents link if
``100 * |A & B| >= SIMILARITY * |A | B|``. Equal sets are joined by a digest
first, one of each goes on.

*Small sets* enumerate subsets of fixed size: sets of n and n' shingles that
link share at least ``c = ceil(SIMILARITY (n + n') / (100 + SIMILARITY))`` of
them, so they share a c-subset, and its hash is their key. *Large sets* scan
inverted lists: their keys are the shingles that any linking set must meet, the
first ``n - ceil(SIMILARITY n / 100) + 1`` in one order of all shingles, in
which shingles common in the corpus come last. Sets close to the boundary have
both kinds of keys. The boundary is the size up to which enumeration makes no
more rows than lists of the measured length would.

Groups of near copies share all their keys, so lists are not expanded into
pairs at once. In a round every member of a list is compared with one pivot of
the list; what links joins a component, and only lists that still hold several
components go on, with another pivot. Pairs within one component need no
comparison and no other pair is left out. When pivots join little, or few pairs
are left, the others are compared one by one: members of a list meet only those
of their own and the next bands of sizes, as sizes of linking sets differ by
``SIMILARITY`` at most, in cells of ``CELL`` members. A pair that shares several
keys is made where it shares the first of them: each member brings the ``BEFORE``
keys that precede the list's key in its own order, and a pair with a common one
among them is left to that list.

Documents are told apart by their sets, not by ids: a node is a distinct set.

In a list, the shingles behind the shared one bound what two sets can share;
the first shingle that a linking pair shares always passes that bound. Then
the lowest ``LEAST_KNOWN`` shingles of both (or all keys) are compared: up to
the lower of the two last ones both sets are fully known, too many differences
there rule the pair out, and sets known as a whole are decided. The others are
compared as whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, slices, small, written
from tessera.llm.components import components
from tessera.llm.substrings import _BASE, _mix, word_hashes

N = 4
SIMILARITY = 85
#: Shingles taken for common, and so put last in the order, at most. The order only steers the cost.
MOST_COMMON = 1_000_000
COMMON_COUNT = 24
CENSUS_SHINGLES = 1 << 21
STAR_ROUNDS = 6
#: A further round with pivots must be promised this share of links among its pairs by the round before.
STAR_YIELD = 0.05
#: Lowest shingles of a set that are kept at least, for comparisons without the text.
LEAST_KNOWN = 96
LARGEST_SMALL = 24
#: Members of a list that one cell of pairs holds from either side, nearly.
CELL = 1000
#: Keys before that of its list which a member brings along; fewer only make some pairs again.
BEFORE = 8
#: Pairs between components that are compared one by one at most while rounds are left.
FEW_PAIRS = 200_000


def shingle_sets(texts: list[bytes | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text, A-Z in lower case."""
    h, sizes = word_hashes([t.lower() if t else t for t in texts])
    out, at = [], 0
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        grams = grams * _BASE + h[j : j + len(grams)]
    grams = _mix(grams) >> np.uint64(1)
    for size in sizes.tolist():
        if size >= n:
            out.append(np.unique(grams[at : at + size - n + 1]))
        elif size:
            x = np.uint64(size)
            for w in h[at : at + size]:
                x = _mix(np.array([x], np.uint64))[0] ^ w
            out.append(_mix(np.array([x ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def least_overlap(n: int, similarity: int) -> int:
    return -(-similarity * n // 100)


def subset_sizes(n: int, boundary: int, similarity: int) -> list[int]:
    """Sizes of the subsets that a small set of n enumerates."""
    partners = range(least_overlap(n, similarity), min(boundary, 100 * n // similarity) + 1)
    return sorted({c for p in partners if p and (c := -(-similarity * (n + p) // (100 + similarity))) <= min(n, p)})


def choose_boundary(sizes: dict[int, int], list_length: float, similarity: int, most: int = LARGEST_SMALL) -> int:
    """The largest size up to which subsets make no more rows than postings,
    each of which costs itself and the list that it scans."""
    best = subsets = postings = 0
    for n in range(1, most + 1):
        subsets += sizes.get(n, 0) * sum(math.comb(n, c) for c in subset_sizes(n, n, similarity))
        postings += sizes.get(n, 0) * (n - least_overlap(n, similarity) + 1) * (1 + list_length)
        if subsets <= postings:
            best = n
    return best


def _census(n: int):
    """Sizes of sets and shingles met often among a bounded number of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sizes = np.zeros(LARGEST_SMALL + 1, np.int64)
        total = different = 0

        def often() -> pa.RecordBatch:
            nonlocal total, different
            values, times = np.unique(np.concatenate(held), return_counts=True)
            total, different = total + int(times.sum()), different + len(values)
            keep = times >= np.where(values < np.uint64(1 << 61), 2, 4)  # the lowest quarter of hashes fills most keys
            return _census_batch("shingle", values[keep].view(np.int64), times[keep])

        for b in batches:
            texts = as_bytes(b.column("text"))
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], n)
                sizes += np.bincount([min(len(s), LARGEST_SMALL + 1) for s in sets], minlength=LARGEST_SMALL + 2)[:-1]
                held += sets
                if sum(map(len, held)) >= CENSUS_SHINGLES:
                    yield often()
                    held.clear()
        if held:
            yield often()
        yield _census_batch("size", np.arange(len(sizes)), sizes)
        yield _census_batch("all", np.arange(2), np.array([total, different]))

    return count


def _census_batch(kind: str, value: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(value), pa.string()), pa.array(value, pa.int64()), pa.array(times, pa.int64())], ["kind", "value", "times"])


def _keys(n: int, similarity: int, boundary: int, common: np.ndarray):
    nearly = least_overlap(boundary + 1, similarity)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, digests = as_bytes(b.column("text")), b.column("doc_id"), b.column("digest")
            for i, j in slices(texts):
                rows = []
                for s in shingle_sets(texts[i:j], n):
                    size = len(s)
                    node = int(_mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
                    subsets: list[int] = []
                    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(size, bool)
                    prefix = size - least_overlap(size, similarity) + 1
                    known = np.concatenate([s[~last], s[last] | np.uint64(1 << 63)])[: max(prefix, LEAST_KNOWN)]
                    listed = prefix if size and size >= nearly or size > boundary else 0
                    if 0 < size <= boundary:
                        mixed = [int(x) for x in _mix(s + np.uint64(77))]
                        for c in subset_sizes(size, boundary, similarity):
                            subsets += [(sum(x) * 0x9E3779B97F4A7C15 + c) % (1 << 64) - (1 << 63) for x in combinations(mixed, c)]
                    rows.append((size, node - (1 << 63), known.view(np.int64), listed, subsets))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids[i:j], digests[i:j], pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int64())), pa.array(c[3], pa.int32()), pa.array(c[4], pa.list_(pa.int64()))], ["doc_id", "digest", "n", "node", "known", "listed", "subsets"])

    return keys


def _possible(similarity: int):
    """Pairs that what is known of them does not rule out; ``sure`` if that is all of both."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sure = [], []
            for na, nb, ka, kb in zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("ka"), b.column("kb"), strict=True):
                x, y = (k.values.to_numpy().view(np.uint64) for k in (ka, kb))
                whole = len(x) == na and len(y) == nb
                if not whole:
                    top = min(x[-1], y[-1])
                    x, y = x[: np.searchsorted(x, top, side="right")], y[: np.searchsorted(y, top, side="right")]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                apart = len(x) + len(y) - 2 * shared
                keep.append((100 + similarity) * apart <= (100 - similarity) * (na + nb))
                sure.append(whole)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask), pa.array(sure, pa.bool_()).filter(mask)], ["a", "b", "sure"])

    return possible


def _linked(n: int, similarity: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [b.column(c).to_pylist() for c in ("a", "b")], [as_bytes(b.column(c)) for c in ("ta", "tb")]
            keep, last, held = [], None, None
            for i in range(b.num_rows):
                x = shingle_sets([texts[0][i]], n)[0]
                if ids[1][i] != last or held is None:
                    last, held = ids[1][i], shingle_sets([texts[1][i]], n)[0]
                both = len(np.intersect1d(x, held, assume_unique=True))
                keep.append(both > 0 and 100 * both >= similarity * (len(x) + len(held) - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return linked


def jaccard_classes(docs: DataFrame, n: int = N, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, digest (``xxhash64(text)``), n_shingles, class and component_id of every row.

    ``class`` is a number that linked rows share, ids or not; component_id is
    the lowest doc_id of the class, null if it has none.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    census = written(d.select("text").mapInArrow(_census(n), "kind string, value long, times long").groupBy("kind", "value").agg(F.sum("times").alias("times")).filter((F.col("kind") != "shingle") | (F.col("times") >= COMMON_COUNT)), "jaccard-census")
    few = {(r["kind"], r["value"]): r["times"] for r in census.filter("kind <> 'shingle'").collect()}  # LARGEST_SMALL + 3 rows
    list_length = few.get(("all", 0), 0) / max(1, few.get(("all", 1), 1))
    boundary = choose_boundary({k[1]: v for k, v in few.items() if k[0] == "size"}, list_length, similarity)
    common = census.filter("kind = 'shingle'").orderBy(F.desc("times"), "value").limit(MOST_COMMON).select("value").toArrow()
    common = np.sort(common.column("value").to_numpy().view(np.uint64))

    sets = d.mapInArrow(_keys(n, similarity, boundary, common), "doc_id long, digest long, n long, node long, known array<long>, listed int, subsets array<long>")
    sets = written(sets.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    nodes = sets.groupBy("n", "node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    # a set goes by its lowest doc_id, so the first pivot of a list is the oldest text; where different sets share that one, all but one go by their hash
    firsts = nodes.filter("n > 0 AND least IS NOT NULL").groupBy("least").agg(F.min("node").alias("first"))
    nodes = nodes.join(firsts, "least", "left").withColumn("id", F.when((F.col("n") > 0) & (F.col("node") == F.col("first")), F.col("least")).otherwise(F.col("node")))
    nodes = written(nodes.select("n", "node", "least", "row", "id"), "jaccard-nodes")
    keyed = written(sets.join(nodes.filter("n > 0").select("row", "id"), "row").select("id", "digest", sets["n"], "known", "listed", "subsets"), "jaccard-keys")
    # a subset's key has place 0: its pairs are bounded by their sizes alone
    in_lists = keyed.select("id", "n", F.posexplode(F.slice("known", F.lit(1), F.col("listed"))).alias("place", "key"))
    in_subsets = keyed.filter(F.size("subsets") > 0).select("id", "n", F.lit(0).alias("place"), F.explode("subsets").alias("key"))
    posted = written(in_lists.unionByName(in_subsets), "jaccard-postings")
    again = written(posted.groupBy("key").count().filter("count > 1").select("key"), "jaccard-again")
    lists = written(posted.join(again, "key").withColumn("component", F.col("id")), "jaccard-lists")
    slim = keyed.select("id", "known")

    def fits(na: str, nb: str, pa: str, pb: str):
        """Sizes and places that leave room for the shingles a link needs."""
        room = F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb))
        return (100 + similarity) * room >= similarity * (F.col(na) + F.col(nb))

    def compare(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, na, b, nb)."""
        x = slim.select(F.col("id").alias("a"), F.col("known").alias("ka"))
        y = slim.select(F.col("id").alias("b"), F.col("known").alias("kb"))
        left = pairs.join(x, "a").join(y, "b").select("a", "na", "ka", "b", "nb", "kb").mapInArrow(_possible(similarity), "a long, b long, sure boolean")
        left = written(left.groupBy("a", "b").agg(F.max("sure").alias("sure")), "jaccard-possible")
        sure, open_pairs = left.filter("sure").select("a", "b"), left.filter("NOT sure").select("a", "b")
        wanted = open_pairs.select(F.col("a").alias("id")).union(open_pairs.select("b")).distinct()
        wanted = small(written(keyed.select("id", "digest").join(wanted, "id", "left_semi"), "jaccard-wanted"))
        texts = written(d.select("digest", "text").join(wanted, "digest").groupBy("id").agg(F.first("text").alias("text")), "jaccard-texts")
        held = open_pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        found = held.select("a", "b", "ta", "tb").mapInArrow(_linked(n, similarity), "a long, b long").distinct()
        return written(found.unionByName(sure), "jaccard-links")

    def all_pairs(lists: DataFrame, counted: DataFrame) -> DataFrame:
        """Pairs of different components; in long lists those in the same or in
        adjacent bands of sizes, in the first list that they share (``BEFORE``)."""
        before = F.slice("known", F.greatest(F.col("place") - (BEFORE - 1), F.lit(1)), F.least("place", F.lit(BEFORE)))
        lists = written(lists.join(slim, "id").select(*lists.columns, before.alias("before")), "jaccard-before")
        right = ["key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("component").alias("cb"), F.col("before").alias("bb")]
        first = ~F.arrays_overlap("before", "bb") & fits("n", "nb", "place", "pb")
        long = counted.filter(F.col("rows") > CELL).select("key", F.ceil(F.col("rows") / CELL).alias("cells"))
        if long.isEmpty():
            return lists.join(lists.select(*right), "key").filter(F.expr("component < cb") & first)
        long = small(long)
        short = lists.join(long, "key", "left_anti")
        cells = lists.join(long, "key").withColumn("own", F.pmod(F.xxhash64("id"), "cells"))
        cells = cells.withColumn("band", F.floor(F.log("n") / math.log(100 / similarity)).cast("int"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
        one = cells.withColumn("i", F.col("own")).withColumn("j", every).withColumn("met", F.explode(F.array(F.col("band"), F.col("band") - 1)))
        two = cells.withColumn("j", F.col("own")).withColumn("i", every).select("i", "j", F.col("band").alias("met"), *right)
        far = one.join(two, ["key", "i", "j", "met"]).filter(((F.col("component") < F.col("cb")) | ((F.col("component") > F.col("cb")) & (F.col("met") < F.col("band")))) & first)
        columns = [*lists.columns, "b", "nb", "pb", "cb"]
        return short.join(short.select(*right), "key").filter(F.expr("component < cb") & first).select(*columns).unionByName(far.select(*columns))

    links = labels = tested = None
    promised, turn = 1.0, 0
    while True:
        counted = lists.groupBy("key", "component").count().groupBy("key").agg(F.sum("count").alias("rows"), F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"), F.count(F.lit(1)).alias("parts"))
        counted = written(counted.filter("parts > 1").select("key", "rows", ((F.col("rows").cast("double") * F.col("rows") - F.col("squares")) / 2).alias("pairs")), "jaccard-counted")
        pairs = counted.agg(F.sum("pairs")).first()[0]
        if not pairs:
            break
        lists = written(lists.join(counted.select("key"), "key"), "jaccard-lists")
        every = pairs <= FEW_PAIRS or turn >= STAR_ROUNDS or promised < STAR_YIELD
        if every:
            met_pairs = all_pairs(lists, counted)
        else:
            pivots = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.lit(0).cast("long"), "id", "n", "place", "component")).alias("p"))
            pivots = pivots.select("key", F.col("p.id").alias("b"), F.col("p.n").alias("nb"), F.col("p.place").alias("pb"), F.col("p.component").alias("cb"))
            met_pairs = lists.join(pivots, "key").filter("component <> cb")
        met_pairs = met_pairs.filter(fits("n", "nb", "place", "pb")).select(F.col("id").alias("a"), F.col("n").alias("na"), "b", "nb").distinct()
        if tested is not None:
            met_pairs = met_pairs.join(tested, ["a", "b"], "left_anti")
        met_pairs = written(met_pairs, "jaccard-pairs")
        tested = met_pairs.select("a", "b") if tested is None else tested.unionByName(met_pairs.select("a", "b"))
        found = compare(met_pairs)
        links = found if links is None else links.unionByName(found)
        labels = written(components(links), "jaccard-components")
        if every:
            break
        promised, turn = found.count() / max(1, met_pairs.count()), turn + 1
        lists = lists.drop("component").join(labels, lists["id"] == labels["node"], "left").select("key", "id", "n", "place", F.coalesce("component", "id").alias("component"))
    named = nodes.select("n", "node", "least", "id")
    if labels is not None:
        labels = labels.select(F.col("node").alias("linked"), "component")
        named = written(named.join(labels, (F.col("n") > 0) & (named["id"] == labels["linked"]), "left"), "jaccard-named")
        linked = named.filter("component IS NOT NULL")
        least = small(written(linked.groupBy("component").agg(F.min("least").alias("lowest")), "jaccard-least"))
        alone = named.filter("component IS NULL").select("n", "node", F.col("id").alias("class"), "least")
        named = alone.unionByName(linked.join(least, "component").select("n", "node", F.col("component").alias("class"), F.col("lowest").alias("least")))
    else:
        named = named.select("n", "node", F.col("id").alias("class"), "least")
    out = sets.select("doc_id", "digest", "n", "node").join(named, ["n", "node"])
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), "class", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, n: int = N, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id (the lowest doc_id reached by links,
    itself included) of every row.

    Fewer than n words form one shingle; null texts and texts without words
    have an empty set and link with nothing. Rows are judged by their texts:
    rows that repeat an id are in one class only if their texts are linked. A
    row without an id has the class of its texts, null if nothing there has an
    id. Other columns are ignored; an empty table gives no rows.
    """
    return jaccard_classes(docs, n, similarity).select("doc_id", "n_shingles", "component_id")

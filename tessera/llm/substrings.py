"""Exact substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Among the hashes of its ``m``-word
sequences the lowest one (the leftmost of equals) is its minimiser; consecutive
windows that share it form a super-k-mer, and equal windows always lie in
super-k-mers of the same minimiser. So:

1. every text is cut into super-k-mers of which only (minimiser, hash of the
   whole, place, length) travel;
2. minimisers met once in the corpus are dropped: none of their windows repeats;
3. super-k-mers met twice as a whole need no comparison, all their windows
   repeat; one of each stands for the rest;
4. different super-k-mers of one minimiser travel as packed strings to its
   bucket, where their windows are sorted and counted;
5. minimisers with more than ``HOT`` different super-k-mers (a common line in
   ever different surroundings) have their windows counted one by one under a
   128-bit hash instead, which splits such a bucket over all tasks.

A word goes if a repeated window covers it. Counting happens on the input only.

Texts that stand in the table more than once lose all windows at once; one of
each goes through these steps, with its number of rows.

On Spark: texts are told apart by 128-bit hashes, so ids play no part. Sums
are taken per task before a shuffle. In the joins that carry counts back, keys
of more than ``HOT`` rows go to a broadcast table behind a check of its size,
so no task gets all rows of a frequent passage; no group but a text's own
windows is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, slices, small, written

K = 35
M = 6
HOT = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE_BITS = 24
_SEGMENT = 1 << _PLACE_BITS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts and the number of words of each."""
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            own = t.split()
            words += own
            sizes[i] = len(own)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), sizes


def range_hashes(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of h[begin:end] for each pair."""
    upto = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_mix(h) * _powers(_BASE, len(h))[:-1], out=upto[1:])
    return _mix((upto[end] - upto[begin]) * _powers(_BACK, len(h))[begin])


def super_kmers(h: np.ndarray, doc: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """(start, windows, minimiser, hash) of the super-k-mers of words ``h`` of
    texts ``doc``, laid end to end. Those beyond a segment's length are cut there."""
    found = []
    span = k - m + 1
    for base in range(0, max(1, len(h) - k + 1), _SEGMENT - k + 1):
        x, d = h[base : base + _SEGMENT], doc[base : base + _SEGMENT]
        if len(x) < k:
            continue
        n = len(x) - m + 1
        g = np.zeros(n, np.uint64)
        for j in range(m):
            g = g * _BASE + x[j : j + n]
        g = _mix(g)
        low = (g >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        wide = 1
        while 2 * wide <= span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if span > wide:
            low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
        at = (low & np.uint64(_SEGMENT - 1)).astype(np.int64)
        whole = d[: len(at)] == d[k - 1 :]
        fresh = whole.copy()
        fresh[1:] &= ~(whole[:-1] & (at[1:] == at[:-1]) & (d[1 : len(at)] == d[: len(at) - 1]))
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], len(at))
        gone = np.append(0, np.cumsum(whole))
        windows = gone[stop] - gone[start]
        found.append((start + base, windows, g[at[start]], range_hashes(x, start, start + windows + k - 1)))
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [[]] * 4))


def _emit(k: int, m: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, k1, k2, rows = as_bytes(b.column("text")), *(b.column(c).to_numpy() for c in ("k1", "k2", "rows"))
            for i, j in slices(texts):
                h, sizes = word_hashes(texts[i:j])
                first = np.cumsum(sizes) - sizes
                start, windows, mini, whole = super_kmers(h, np.repeat(np.arange(j - i), sizes), k, m)
                row = np.searchsorted(first, start, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(k1[i:j][row]), pa.array(k2[i:j][row]), pa.array(rows[i:j][row]), pa.array((start - first[row]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(whole.view(np.int64))], ["k1", "k2", "rows", "start", "windows", "mini", "whole"])

    return emit


def _pack(k: int):
    """Packed strings of a document's wanted super-k-mers; those of hot minimisers window by window."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, text, wanted in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), as_bytes(b.column("text")), b.column("wanted").to_pylist(), strict=True):
                words = (text or b"").split()
                for w in wanted:
                    if not w["hot"]:
                        rows.append((w["mini"], b" ".join(words[w["start"] : w["start"] + w["windows"] + k - 1]), k1, k2, w["start"], w["n"], False))
                        continue
                    for i in range(w["start"], w["start"] + w["windows"]):
                        rows.append((0, hashlib.blake2b(b" ".join(words[i : i + k]), digest_size=16).digest(), k1, k2, i, w["n"], True))
                    if len(rows) > 20_000:
                        yield _packed(rows)
                        rows = []
            yield _packed(rows)

    return pack


_PACKED = pa.schema([("mini", pa.int64()), ("packed", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("n", pa.int64()), ("hot", pa.bool_())])
_FLAGS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(_PACKED), _PACKED, strict=True)], schema=_PACKED)


def repeated_in_bucket(members: list[tuple[bytes, int]], k: int) -> list[list[tuple[int, int]]]:
    """For packed super-k-mers of one minimiser, each met ``n`` times: the
    (first window, length) runs of windows met twice or more."""
    windows = []
    for member, (packed, n) in enumerate(members):
        ends = [i for i, c in enumerate(packed) if c == 0x20] + [len(packed)]
        begins = [0] + [e + 1 for e in ends[:-1]]
        windows += [(packed[begins[i] : ends[i + k - 1]], member, i, n) for i in range(len(begins) - k + 1)]
    windows.sort()
    flagged: list[list[int]] = [[] for _ in members]
    i = 0
    while i < len(windows):
        j, total = i, 0
        while j < len(windows) and windows[j][0] == windows[i][0]:
            total += windows[j][3]
            j += 1
        if total > 1:
            for _, member, at, _ in windows[i:j]:
                flagged[member].append(at)
        i = j
    out = []
    for places in flagged:
        runs: list[tuple[int, int]] = []
        for p in sorted(places):
            if runs and runs[-1][0] + runs[-1][1] == p:
                runs[-1] = runs[-1][0], runs[-1][1] + 1
            else:
                runs.append((p, 1))
        out.append(runs)
    return out


def _count_buckets(k: int):
    """Rows come sorted by minimiser; a bucket may run over several batches."""

    def flags(held: list[tuple]) -> Iterator[tuple]:
        for (_, _, k1, k2, start, _), runs in zip(held, repeated_in_bucket([(h[1], h[5]) for h in held], k), strict=True):
            for at, n in runs:
                yield k1, k2, start + at, n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*[b.column(c).to_pylist() for c in ("mini", "packed", "k1", "k2", "start", "n")], strict=True):
                if held and held[-1][0] != row[0]:
                    out += flags(held)
                    held = []
                held.append(row)
            yield _flag_batch(out)
        yield _flag_batch(list(flags(held)))

    return count


def _flag_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 4, _FLAGS, strict=True)], schema=_FLAGS)


def _keep(k: int, with_text: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, again, runs in zip(as_bytes(b.column("text")), b.column("again").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = (text or b"").split()
                kept = words
                if again and len(words) >= k:
                    kept = []
                elif runs:
                    depth = np.zeros(len(words) + 1, np.int32)
                    for r in runs:
                        depth[r["start"]] += 1
                        depth[r["start"] + r["windows"] + k - 1] -= 1
                    kept = list(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))
                line = b" ".join(kept)
                for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode() if with_text else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return keep


def met(rows: DataFrame, counted: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """The rows whose keys stand in ``counted``, a written table of keys and
    their ``n`` rows. Keys of more than ``hot`` rows do not go through a shuffle."""
    frequent = counted.filter(F.col("n") > hot).select(*keys)
    if frequent.isEmpty():
        return rows.join(counted.select(*keys), keys, "left_semi")
    frequent = small(frequent)
    rare = rows.join(frequent, keys, "left_anti").join(counted.filter(F.col("n") <= hot).select(*keys), keys, "left_semi")
    return rows.join(frequent, keys, "left_semi").unionByName(rare)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words kept, joined
    by one space; null unless ``with_text``) of every row.

    Words are maximal runs of bytes other than ASCII white space. Null texts
    have no words; texts shorter than ``k`` words lose none. Ids may be null or
    repeat; rows of equal texts make each other's windows repeat. Other columns
    are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(k), "text").alias("k2"), "text")
    key = ["k1", "k2"]
    again = small(written(d.filter(F.col("text").isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "substrings-again"))
    once = d.filter(F.col("text").isNotNull()).join(again, key, "left_anti")
    copies = d.join(again, key).groupBy(*key).agg(F.first("text").alias("text"), F.first("rows").alias("rows"))
    texts = once.select(*key, "text", F.lit(1).cast("long").alias("rows")).unionByName(written(copies, "substrings-copies").select(*key, "text", "rows"))
    r = written(texts.mapInArrow(_emit(k, m), "k1 long, k2 long, rows long, start int, windows int, mini long, whole long"), "substrings-kmers")
    twice = written(r.groupBy("mini").agg(F.sum("rows").alias("n")).filter("n > 1"), "substrings-twice")
    r = written(met(r, twice, ["mini"], hot), "substrings-met")
    whole = ["mini", "whole", "windows"]
    a = written(r.groupBy(*whole).agg(F.sum("rows").alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "start")]), "substrings-wholes")
    same = met(r.filter("rows = 1"), a.filter("n > 1").select(*whole, "n"), whole, hot).select(*key, "start", "windows")
    apart = written(a.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "substrings-apart")
    any_hot = not apart.filter(F.col("n") > hot).isEmpty()
    mark = small(apart.filter(F.col("n") > hot).select(F.col("mini").alias("hot_mini")))
    wanted = met(a, apart, ["mini"], hot).join(mark, F.col("mini") == F.col("hot_mini"), "left").withColumn("hot", F.col("hot_mini").isNotNull())
    wanted = wanted.groupBy(*key).agg(F.collect_list(F.struct("mini", "start", "windows", "n", "hot")).alias("wanted"))
    packed = texts.join(wanted, key).select(*key, "text", "wanted").mapInArrow(_pack(k), "mini long, packed binary, k1 long, k2 long, start int, n long, hot boolean")
    flags = packed.filter(~F.col("hot")).repartition("mini").sortWithinPartitions("mini").mapInArrow(_count_buckets(k), "k1 long, k2 long, start int, windows int")
    if any_hot:
        single = written(packed.filter("hot").select("packed", *key, "start", "n"), "substrings-single")
        often = written(single.groupBy("packed").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n")).filter("total > 1"), "substrings-often")
        flags = flags.unionByName(met(single.drop("n"), often, ["packed"], hot).select(*key, "start", F.lit(1).alias("windows")))
    runs = flags.unionByName(same).groupBy(*key).agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    kept = once.join(runs, key, "left").select("doc_id", "text", F.lit(False).alias("again"), "runs")
    whole = d.join(again, key, "left_semi").withColumn("again", F.lit(True)).unionByName(d.filter(F.col("text").isNull()).withColumn("again", F.lit(False)))
    kept = kept.unionByName(whole.select("doc_id", "text", "again", F.lit(None).cast("array<struct<start:int,windows:int>>").alias("runs")))
    return kept.mapInArrow(_keep(k, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")

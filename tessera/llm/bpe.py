"""Byte-level BPE: whole texts to token ids and back.

A text is split into pre-tokens by the tokenizer's pattern. Each pre-token goes
through two tiers:

1. A minimal perfect hash over the vocabulary: one probe, one comparison of
   bytes. ``n`` tokens take ``n`` slots without a gap; keys share buckets, and each
   bucket has a displacement under which all its keys fall on free slots.
2. What is no token goes byte by byte into a linked list; a heap gives the
   adjacent pair of lowest rank, leftmost first, and pairs that a merge has
   made stale are skipped when they come up. Time grows as n log n with the
   pre-token, whatever its length.

The vocabulary is read and hashed on the driver and broadcast: its size is that
of the rank file. Pre-tokens of a slice of texts are looked up once each, in
numpy; ids and bytes are laid out by Arrow. One pass, no shuffle.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.common import slices

#: Keys that share a bucket on average, and displacements tried at once.
BUCKET_KEYS = 4
TRIES = 64
#: Pre-tokens of the second tier that a Python worker remembers in each of two memories.
MOST_PIECES = 1 << 18
#: Bits for the place of a pair in its piece, below its rank, in an entry of the heap.
PLACE = 32
PLACES = (1 << PLACE) - 1
AFTER, BEFORE = list(range(1, 1 << 12)), list(range(-1, 1 << 12))
#: Characters that are looked up together, and those of one text that are split at once.
SLICE = 1 << 21
STRETCH = 1 << 20

# Hashing of bytes. Offset and prime of FNV-1a with 64 bits, multipliers of the SplitMix64 finaliser.
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def _layout(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of an Arrow string or binary array without nulls."""
    _, bounds, data = values.buffers()
    bounds = np.frombuffer(bounds, np.int32)[values.offset : values.offset + len(values) + 1]
    return bounds, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def hash_bytes(bounds: np.ndarray, data: np.ndarray, longest: int) -> np.ndarray:
    """A 64-bit hash of each string, byte by byte for all at once; longer ones than ``longest`` are hashed so far."""
    begin, sizes = bounds[:-1].astype(np.int64), np.diff(bounds)
    h = np.full(len(sizes), FNV_OFFSET)
    left = np.flatnonzero(sizes > 0)
    for j in range(longest):
        if not len(left):
            break
        h[left] = (h[left] ^ data[begin[left] + j]) * FNV_PRIME
        left = left[sizes[left] > j + 1]
    return _mix(h)


class PerfectHash(NamedTuple):
    """Displacement of each bucket; below 0: the slot of its only key, as -1 - slot."""

    displacements: np.ndarray
    slots: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; keys that were not hashed fall on any slot."""
        d = self.displacements[(h % np.uint64(len(self.displacements))).astype(np.int64)]
        return np.where(d < 0, -1 - d, _slot(h, np.maximum(d, 0).astype(np.uint64), self.slots))


def _slot(h: np.ndarray, d: np.ndarray, slots: int) -> np.ndarray:
    return (_mix(h + d * MIX_1) % np.uint64(slots)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> PerfectHash:
    """A minimal perfect hash of different 64-bit hashes, largest buckets first."""
    n = len(h)
    buckets = max(1, -(-n // BUCKET_KEYS))
    order = np.argsort(h % np.uint64(buckets), kind="stable")
    sizes = np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    ends = np.cumsum(sizes)
    out, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[sizes[by_size] > 1].tolist():
        keys, d = h[order[ends[b] - sizes[b] : ends[b]]], 0
        while True:
            tried = _slot(keys, np.arange(d, d + TRIES, dtype=np.uint64)[:, None], n)
            free = ~taken[tried].any(axis=1)
            for i in np.flatnonzero(free).tolist():
                if len(set(tried[i].tolist())) == len(keys):
                    break
            else:
                d += TRIES
                continue
            taken[tried[i]] = True
            out[b] = d + i
            break
    alone = by_size[sizes[by_size] == 1]
    out[alone] = -1 - np.flatnonzero(~taken)
    return PerfectHash(out, n)


class Vocabulary(NamedTuple):
    """Tokens by slot of their perfect hash, with their ids."""

    hashed: PerfectHash
    tokens: list[bytes]
    ids: np.ndarray
    longest: int
    pattern: str


@lru_cache(4)
def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: lines of a token in base 64 and its id, which is its rank."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, filter(bytes.strip, f))]
    if len({t for t, _ in pairs}) < len(pairs) or any(bytes([b]) not in {t for t, _ in pairs if len(t) == 1} for b in range(256)):
        raise ValueError("a vocabulary has each token once, and every single byte")
    tokens, longest = pa.array([t for t, _ in pairs], pa.binary()), max(len(t) for t, _ in pairs)
    h = hash_bytes(*_layout(tokens), longest)
    hashed = perfect_hash(h)
    by_slot = np.argsort(hashed.find(h))
    return Vocabulary(hashed, [pairs[i][0] for i in by_slot], np.array([pairs[i][1] for i in by_slot], np.int32), longest, pattern)


def merge_bytes(piece: bytes, tokens: list[int], pairs: list[int], heap: list[int], rank: dict[bytes, int]) -> list[int]:
    """The tokens of a piece: pairs merge by rank, of equal ranks the leftmost.

    ``tokens`` and ``pairs`` hold the token at each byte and the rank of its
    pair with the next one, -1 for none; ``heap`` has rank and place of each
    pair in one number. A token stands at its first byte, ``after`` and
    ``before`` link it to its neighbours. An entry of the heap is stale if
    another pair begins at its place by now.
    """
    n, get = len(piece), rank.get
    after = AFTER[:n] if n < len(AFTER) else list(range(1, n + 1))
    before = BEFORE[: n + 1] if n < len(AFTER) else list(range(-1, n))
    heapify(heap)
    while heap:
        first = heappop(heap)
        r, i = first >> PLACE, first & PLACES
        if pairs[i] != r:
            continue
        j = after[i]
        end = after[j]
        after[i], tokens[i], pairs[j], before[end] = end, r, -1, i
        if end < n:
            pairs[i] = x = get(piece[i : after[end]], -1)
            if x >= 0:
                heappush(heap, x << PLACE | i)
        else:
            pairs[i] = -1
        left = before[i]
        if left >= 0:
            pairs[left] = x = get(piece[left:end], -1)
            if x >= 0:
                heappush(heap, x << PLACE | left)
    out, i = [], 0
    while i < n:
        out.append(tokens[i])
        i = after[i]
    return out


def narrowed(pattern: str) -> re.Pattern | None:
    """The pattern with its classes cut to ASCII, for the standard library, which
    is faster; None if it uses anything but letters, numbers and white space."""
    members = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": "\t-\r "}
    out, inside = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        inside = part == "[" or inside and part != "]"
        if part == r"\S" and not inside:
            out += f"[^{members[chr(92) + 's']}]"
        elif part in members:
            out += members[part] if inside else f"[{members[part]}]"
        elif part.startswith("\\"):
            return None
        else:
            out += part
    return re.compile(out)


class Encoder:
    """Looks pre-tokens up in both tiers; one per Python worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern)
        self.narrow = narrowed(vocabulary.pattern) or self.split
        self.rank = dict(zip(vocabulary.tokens, vocabulary.ids.tolist(), strict=True))
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.double = np.array([self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.words = [array("i", [i]).tobytes() for i in vocabulary.ids.tolist()]
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """All pre-tokens. Texts of ASCII only take the narrow pattern. Long texts are split by stretches that end where white
        space follows something else, which is a border under any pattern
        whose pieces have white space in front only."""
        split = self.narrow if text.isascii() else self.split
        if len(text) <= STRETCH:
            return split.findall(text)
        found, begin = [], 0
        while begin < len(text):
            cut = CUT.search(text, begin + STRETCH)
            end = cut.start() + 1 if cut else len(text)
            found += split.findall(text[begin:end])
            begin = end
        return found

    def look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pre-tokens, end to end, and the number of each's."""
        v = self.vocabulary
        slots = v.hashed.find(hash_bytes(*_layout(pieces), v.longest))
        raw = pieces.cast(pa.binary()).to_pylist()
        ids = [w if v.tokens[s] == p else self.recent.get(p) for p, s, w in zip(raw, slots.tolist(), map(self.words.__getitem__, slots.tolist()), strict=True)]
        missing = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(missing, self.merge([raw[k] for k in missing]), strict=True):
            ids[k] = x
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), np.int32), counts

    def remembered(self, piece: bytes) -> bytes | None:
        """Pieces met lately: a full memory becomes the older one, and what is used of that moves up."""
        found = self.older.get(piece)
        if found is not None:
            self.recent[piece] = found
        return found

    def merge(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids, four bytes each, of pieces that are no tokens; what their heaps start from is found for all of them at once."""
        if not pieces:
            return
        if len(self.recent) >= MOST_PIECES:
            self.recent, self.older = {}, self.recent
        data, sizes = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.fromiter(map(len, pieces), np.int64, len(pieces))
        bounds = np.append(0, np.cumsum(sizes))
        pairs = np.append(self.double[data[:-1] << 8 | data[1:]], -1)
        pairs[bounds[1:] - 1] = -1
        kept = np.flatnonzero(pairs >= 0)
        entries = (pairs << PLACE | np.arange(len(data)) - np.repeat(bounds[:-1], sizes))[kept].tolist()
        marks, bounds = np.searchsorted(kept, bounds).tolist(), bounds.tolist()
        tokens, pairs = self.single[data].tolist(), pairs.tolist()
        for k, piece in enumerate(pieces):
            a, b = bounds[k], bounds[k + 1]
            if (found := self.remembered(piece)) is not None:
                yield found
                continue
            found = array("i", merge_bytes(piece, tokens[a:b], pairs[a:b], entries[marks[k] : marks[k + 1]], self.rank)).tobytes()
            if b - a <= self.vocabulary.longest:
                self.recent[piece] = found
            yield found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the bounds of each text's."""
        pieces, sizes = [], [0]
        for t in texts:
            pieces += self.pieces(t)
            sizes.append(len(pieces))
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        ids, counts = self.look_up(coded.dictionary)
        which = coded.indices.to_numpy()
        lengths = counts[which]
        ends = np.append(0, np.cumsum(lengths))
        starts = (np.cumsum(counts) - counts)[which]
        flat = ids[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        return flat, ends[sizes]


CUT = regex.compile(r"\S(?=\s)")
_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    found = _ENCODERS.get(id(shared.value))
    if found is None or found.vocabulary is not shared.value:
        _ENCODERS.clear()
        found = _ENCODERS[id(shared.value)] = Encoder(shared.value)
    return found


def _shared(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_vocabulary(path, pattern))


def _encoded(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(shared)
    for b in batches:
        texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        for begin, end in slices(texts, SLICE):
            ids, bounds = encoder.encode(texts[begin:end])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).slice(begin, end - begin), lists], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], shared: Broadcast, ids_col: str) -> Iterator[pa.RecordBatch]:
    v = shared.value
    slot = np.full(int(v.ids.max()) + 2, -1, np.int64)
    slot[v.ids] = np.arange(len(v.ids))
    tokens = pa.array(v.tokens, pa.binary())
    for b in batches:
        lists = b.column(b.schema.get_field_index(ids_col))
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = slot[np.where((ids < 0) | (ids >= len(slot)), -1, ids)]
        ends = np.append(0, np.cumsum(sizes))
        unknown = np.append(0, np.cumsum(at < 0))
        bad = (unknown[ends[1:]] > unknown[ends[:-1]]) | lists.is_null().to_numpy(zero_copy_only=False)
        begin = 0
        while begin < len(sizes):  # so many rows at once that their bytes stay bounded
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + STRETCH, "right")) - 1)
            bounds, data = _layout(tokens.take(pa.array(np.maximum(at[ends[begin] : ends[end]], 0))))
            whole = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(bounds[ends[begin : end + 1] - ends[begin]].copy()), pa.py_buffer(data[: bounds[-1]])])
            if bad[begin:end].any():
                whole = pa.compute.if_else(pa.array(bad[begin:end]), pa.scalar(None, pa.binary()), whole)
            yield pa.RecordBatch.from_arrays([*b.slice(begin, end - begin).columns, whole], schema=pa.schema([*b.schema, pa.field("decoded", pa.binary())]))
            begin = end


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null texts count as empty.

    Special strings inside texts are ordinary text. Rows with null or repeated
    ids each have their own result; other columns are ignored.
    """
    shared = _shared(docs.sparkSession, path, pattern)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, shared), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and the bytes ``decoded``; a column of that name
    is replaced. Null arrays and those with a null or an id that is not in the
    vocabulary give null."""
    shared = _shared(encoded.sparkSession, path, pattern)
    rows = encoded.drop("decoded")
    return rows.mapInArrow(lambda batches: _decoded(batches, shared, ids_col), StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded: ``encode`` and ``decode`` of its ids in one pass, under their rules."""
    shared = _shared(docs.sparkSession, path, pattern)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: _decoded(_encoded(batches, shared), shared, "ids"), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows with ids and decoded bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

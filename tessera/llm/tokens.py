"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is compiled from its published JSON file into two
deterministic transducers.

*Splitter.* 13 states over 12 character classes. It reads a text once and
emits where pieces (runs of letters, of digits, of other signs, contractions,
white space) begin; a transition tells whether a piece begins at the character
just read, at the one before, or both. Texts of a batch are laid end to end and
cut into chunks; for each chunk the map from every state to the state behind
the chunk is computed for all chunks at once, the maps are composed by a
parallel prefix scan, and from the then known first states a last pass emits
the beginnings. No chunk waits for another and no text is cut.

*Merger.* States stand for the bytes of a piece read so far, transitions carry
the change in the number of tokens. The tokens of a piece are the only sequence
in which every adjacent pair stays unmerged, so the last token of a prefix
follows from the last tokens of shorter prefixes. Transitions are compiled when
first met and kept, up to ``MOST_STATES`` of them.

Added special tokens found in a text count one token each, as the library does
by default, and cut the text where they stand.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, slices

#: Bounds of what a Python worker keeps between batches.
MOST_STATES = 1 << 20
MOST_PIECES = 1 << 19
LONG_PIECE = 48
CHUNK = 64

# Classes of characters. The letters that end contractions and the code points of White_Space.
STMD, R, V, LL, E, LETTER, NUMBER, APOSTROPHE, OTHER, SPACE, WHITE, STOP = range(12)
CONTRACTION = {"s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": R, "v": V, "l": LL, "e": E}
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# States of the splitter.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, SPACE_1, SPACE_N, WHITE_1, WHITE_N, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CLOSED = range(13)
HERE, BEFORE = 1, 2
LETTERS = (STMD, R, V, LL, E, LETTER)


def _begin(c: int) -> tuple[int, int]:
    """A piece begins at the character just read."""
    if c == STOP:
        return START, 0
    state = IN_LETTERS if c in LETTERS else {NUMBER: IN_NUMBERS, APOSTROPHE: QUOTE, OTHER: IN_OTHER, SPACE: SPACE_1, WHITE: WHITE_1}[c]
    return state, HERE


def _step(state: int, c: int) -> tuple[int, int]:
    letter, space = c in LETTERS, c in (SPACE, WHITE)
    if state == IN_LETTERS and letter or state == IN_NUMBERS and c == NUMBER or state == IN_OTHER and c in (OTHER, APOSTROPHE):
        return state, 0
    if state in (SPACE_1, SPACE_N, WHITE_1, WHITE_N) and space:
        return (SPACE_N if c == SPACE else WHITE_N), 0
    if state in (SPACE_1, SPACE_N) and c != STOP:
        return (IN_LETTERS if letter else IN_NUMBERS if c == NUMBER else IN_OTHER), (BEFORE if state == SPACE_N else 0)
    if state == WHITE_N and c != STOP:
        return _begin(c)[0], HERE | BEFORE
    if state == QUOTE:
        if c == STMD:
            return CLOSED, 0
        if c in (R, V, LL):
            return {R: QUOTE_R, V: QUOTE_V, LL: QUOTE_L}[c], 0
        if c in (OTHER, APOSTROPHE):
            return IN_OTHER, 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (LL if state == QUOTE_L else E):
            return CLOSED, 0
        return (IN_LETTERS, BEFORE) if letter else (_begin(c)[0], _begin(c)[1] | BEFORE)
    return _begin(c)


@lru_cache(1)
def _splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state and emission by (state * 12 + class), and the class of every code point."""
    steps = [_step(s, c) for s in range(13) for c in range(12)]
    kind = np.full(0x110000, OTHER, np.uint8)
    names = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    kind[names == "L"], kind[names == "N"] = LETTER, NUMBER
    kind[list(WHITE_SPACE)] = WHITE
    kind[ord(" ")], kind[ord("'")] = SPACE, APOSTROPHE
    for letter, c in CONTRACTION.items():
        kind[ord(letter)] = c
    return np.array([x[0] for x in steps], np.uint8), np.array([x[1] for x in steps], np.uint8), kind


def chunk_maps(kinds: np.ndarray, go: np.ndarray) -> np.ndarray:
    """kinds: chunks x CHUNK. The state behind each chunk for each first state."""
    states = np.broadcast_to(np.arange(13, dtype=np.uint8), (len(kinds), 13)).copy()
    for j in range(8):
        states = go[states * np.uint8(12) + kinds[:, j, None]]
    apart = np.flatnonzero((states != states[:, :1]).any(axis=1))
    one, rest = states[:, 0].copy(), states[apart]  # where all states have met, one is enough
    for j in range(8, kinds.shape[1]):
        one = go[one * np.uint8(12) + kinds[:, j]]
        rest = go[rest * np.uint8(12) + kinds[apart, j, None]]
    states[:] = one[:, None]
    states[apart] = rest
    return states


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of the first i maps, for every i, in log2(n) rounds."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def beginnings(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in a text given by code points; 0x110000 is STOP."""
    go, emit, kind = _splitter()
    kinds = np.full(-(-len(points) // CHUNK) * CHUNK + CHUNK, STOP, np.uint8)
    kinds[: len(points)] = np.append(kind, np.uint8(STOP))[points]
    kinds = kinds.reshape(-1, CHUNK)
    state = np.zeros(len(kinds), np.uint8)
    state[1:] = prefix_scan(chunk_maps(kinds, go))[:-1, START]
    marks = np.zeros(kinds.shape, np.uint8)
    for j in range(CHUNK):
        at = state * np.uint8(12) + kinds[:, j]
        marks[:, j], state = emit[at], go[at]
    marks = marks.ravel()
    found = (marks & HERE) > 0
    found[:-1] |= (marks[1:] & BEFORE) > 0
    return np.flatnonzero(found[: len(points)])


class Merger:
    """The transducer of one vocabulary: tokens of a piece, counted byte by byte."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        rank = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.rank, self.longest = rank, max(map(len, rank))
        self.parts = {i: (i, i) for i in range(256)}
        self.joined: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            if rank[a + b] == 256 + i:
                self.parts[256 + i] = rank[a], rank[b]
                self.joined[rank[a], rank[b]] = 256 + i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.last, self.count = [-1], [0]

    def stays(self, a: int, b: int) -> bool:
        """Whether the pair a, b survives: undoing merges from the latest one
        on, none across the border may come earlier than one inside."""
        limit = 1 << 60
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            for _ in range(2):
                if a > b:
                    if (right := self.parts[a][1]) != a:
                        limit, a = a, right
                        break
                    limit = b + 1
                    if (left := self.parts[b][0]) == b:
                        return True
                    b = left
                    break
                if (left := self.parts[b][0]) != b:
                    limit, b = b + 1, left
                    break
                limit = a
                if (right := self.parts[a][1]) == a:
                    return True
                a = right
                break

    def _ending(self, piece: bytes, end: int, last: list[int], base: int) -> int:
        """Length of the last token of piece[:end]; last[i - base] is that of piece[:i]."""
        for begin in range(max(0, end - self.longest), end):
            t = self.rank.get(piece[begin:end])
            if t is not None:
                if begin == 0:
                    return end
                pair = (last[begin - base], t)
                if (ok := self.pairs.get(pair)) is None:
                    if len(self.pairs) > MOST_STATES:
                        self.pairs.clear()
                    ok = self.pairs[pair] = self.stays(*pair)
                if ok:
                    return end - begin
        raise ValueError("no token ends here")

    def tokens(self, piece: bytes) -> int:
        if len(piece) > LONG_PIECE:
            return self._long(piece)
        if len(self.last) > MOST_STATES:
            self.clear()
        state, go, i, n = 0, self.next, 0, len(piece)
        path = [0]
        for byte in piece:
            if (to := go.get(state << 8 | byte)) is None:
                break
            state = to
            path.append(state)
            i += 1
        if i == n:
            return self.count[state]
        last, count = [self.last[s] for s in path], [self.count[s] for s in path]
        while i < n:
            size = self._ending(piece, i + 1, last, 0)
            last.append(self.rank[piece[i + 1 - size : i + 1]])
            count.append(count[i + 1 - size] + 1)
            to = go[state << 8 | piece[i]] = len(self.last)
            self.last.append(last[-1])
            self.count.append(count[-1])
            state = to
            i += 1
        return count[-1]

    def _long(self, piece: bytes) -> int:
        """As tokens(), keeping only the states within reach of a token."""
        last, count, base, keep = [-1], [0], 0, 4 * self.longest
        for end in range(1, len(piece) + 1):
            size = self._ending(piece, end, last, base)
            last.append(self.rank[piece[end - size : end]])
            count.append(count[end - size - base] + 1)
            if len(last) > keep:
                cut = len(last) - self.longest - 1
                del last[:cut], count[:cut]
                base += cut
        return count[-1]

    def of(self, piece: str) -> int:
        if (n := self.pieces.get(piece)) is None:
            if len(self.pieces) > MOST_PIECES:
                self.pieces.clear()
            n = self.pieces[piece] = self.tokens(piece.encode())
        return n


@lru_cache(2)
def compiled(path: str) -> tuple[Merger, re.Pattern | None]:
    """The merger of a tokenizer file and the pattern of its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    raw = lambda s: bytes(as_byte[c] for c in s)
    added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
    vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    return Merger(vocab, merges), re.compile("|".join(map(re.escape, added))) if added else None


def count_texts(texts: list[bytes | None], path: str) -> np.ndarray:
    """Tokens of each text; null and empty: 0."""
    merger, added = compiled(path)
    out = np.zeros(len(texts), np.int64)
    for a, b in slices(texts):
        parts: list[str] = []
        ends = np.zeros(b - a, np.int64)
        at = 0
        for i in range(a, b):
            text = (texts[i] or b"").decode()
            if added is not None and added.search(text):
                pieces = added.split(text)
                out[i] += len(pieces) - 1
            else:
                pieces = [text]
            for p in pieces:
                parts.append(p)
                at += len(p) + 1
            ends[i - a] = at
        # a private sign between parts, marked as STOP, keeps positions in step with the joined text
        joined = "\x00".join(parts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        points[stops] = 0x110000
        begins = beginnings(points)
        finish = np.append(begins[1:], len(points))
        last = np.searchsorted(stops, begins)  # a piece ends at its part's end at the latest
        finish = np.minimum(finish, stops[last]) if len(begins) else finish[:0]
        pieces = [joined[x:y] for x, y in zip(begins.tolist(), finish.tolist(), strict=True)]
        found = list(map(merger.pieces.get, pieces))
        for i in [i for i, n in enumerate(found) if n is None]:
            found[i] = merger.of(pieces[i])
        counts = np.array(found, np.int64)
        upto = np.append(0, np.cumsum(counts))[np.searchsorted(begins, ends)]
        out[a:b] += np.diff(upto, prepend=0)
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, in one pass
    without a shuffle. Null texts count as empty; ids may be null or repeat;
    other columns are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text"))
            n = count_texts(texts, path)
            size = np.array([len(t or b"") for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

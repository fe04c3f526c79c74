"""JPEG streams: marker segments, entropy-coded scans, and their decoder.

Blocks are transformed and quantised on tables. A stream is then written by one
group of a grouped-map job per image, symbols, histogram, code lengths and bits
alike, so an image is bounded by what one task holds (32,768 blocks here).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.huffman import code_lengths
from tessera.plans import tables
from tessera.plans.tables import ZIGZAG

SOI, EOI = b"\xff\xd8", b"\xff\xd9"
ICC_NAME, ICC_MOST = b"ICC_PROFILE\x00", 65519


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload


def jfif() -> bytes:
    return segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")


def dqt(named: dict[int, list[int]], together: bool = False) -> bytes:
    """Quantisation tables, natural order in, zigzag order in the stream."""
    bodies = [bytes([i]) + bytes(t[k] for k in ZIGZAG) for i, t in named.items()]
    return segment(0xDB, b"".join(bodies)) if together else b"".join(segment(0xDB, b) for b in bodies)


def frame_header(width: int, height: int, components: int, progressive: bool = False, luma_sampling: int = 0x11) -> bytes:
    body = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([components])
    for c in range(components):
        body += bytes([c + 1, luma_sampling if c == 0 else 0x11, min(c, 1)])
    return segment(0xC2 if progressive else 0xC0, body)


def dht(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    """kind: 0 for DC, 1 for AC."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return segment(0xC4, bytes([kind << 4 | slot]) + bytes(sum(n == d for n in lengths.values()) for d in range(1, 17)) + bytes(order))


def wire_table(kind: int, slot: int, bits: Iterable[int], symbols: Iterable[int]) -> bytes:
    return segment(0xC4, bytes([kind << 4 | slot, *bits, *symbols]))


def scan_header(components: list[int], tables_of: list[int], ss: int = 0, se: int = 63, ah: int = 0, al: int = 0) -> bytes:
    body = bytes([len(components)])
    for c, t in zip(components, tables_of, strict=True):
        body += bytes([c + 1, t])
    return segment(0xDA, body + bytes([ss, se, ah << 4 | al]))


def restart_interval(units: int) -> bytes:
    return segment(0xDD, units.to_bytes(2, "big"))


def icc_segments(profile: bytes) -> bytes:
    parts = [profile[i : i + ICC_MOST] for i in range(0, len(profile), ICC_MOST)]
    return b"".join(segment(0xE2, ICC_NAME + bytes([i + 1, len(parts)]) + p) for i, p in enumerate(parts))


def extract_icc(stream: bytes) -> bytes | None:
    parts = sorted((body[12], body[14:]) for marker, body in segments(stream) if marker == 0xE2 and body.startswith(ICC_NAME))
    return b"".join(p for _, p in parts) if parts else None


def is_xyb_profile(profile: bytes) -> bool:
    return b"XYB" in profile


def segments(stream: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) up to the first scan, whose payload ends the list with the rest of the stream."""
    at = 2
    while at + 4 <= len(stream) and stream[at] == 0xFF:
        marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
        body = stream[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            yield marker, body + b"\x00" * 0
            yield -1, stream[at:]
            return
        yield marker, body


def read_dqt(stream: bytes) -> list[tuple[int, int, int]]:
    """(table, k, q) of every quantisation table, 8 or 16 bits, in natural order."""
    rows = []
    for marker, body in segments(stream):
        at = 0
        while marker == 0xDB and at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            values = np.frombuffer(body[at + 1 : at + 1 + 64 * (1 + wide)], ">u2" if wide else "u1")
            rows += [(number, ZIGZAG[i], int(v)) for i, v in enumerate(values)]
            at += 1 + 64 * (1 + wide)
    return rows


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol, codes counting up by length and symbol."""
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code = code << (lengths[s] - last)
        last = lengths[s]
        out[s] = code, last
        code += 1
    return out


def pack(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Codes of the given sizes, highest bit first, ones to the end of the last
    byte, and a zero byte after each byte of ones."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    place = np.arange(total)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bits = (codes[owner] >> (ends[owner] - 1 - place)) & 1
    raw = np.packbits(np.append(bits, np.ones(-total % 8, bits.dtype)).astype(np.uint8)).tobytes()
    return raw.replace(b"\xff", b"\xff\x00")


def symbols_of(z: np.ndarray, before: int = 0) -> list[tuple[int, int, int, int]]:
    """(is_dc, symbol, nbits, extra) of one block in zigzag order."""
    extra = lambda v, n: v if v >= 0 else v + (1 << n) - 1
    d = int(z[0]) - before
    n = abs(d).bit_length()
    out, last = [(1, n, n, extra(d, n))], 0
    for i in np.flatnonzero(z[1:]) + 1:
        run, v = int(i) - 1 - last, int(z[i])
        out += [(0, 0xF0, 0, 0)] * (run // 16)
        n = abs(v).bit_length()
        out.append((0, run % 16 * 16 + n, n, extra(v, n)))
        last = int(i)
    return out if last == 63 else [*out, (0, 0, 0, 0)]


Codes = tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int]]]


def scan_bytes(blocks: list[tuple[int, np.ndarray]], codes_of: list[Codes], restart: int = 0, per_unit: int = 1) -> bytes:
    """Blocks (component, values) in coding order, each component by its (AC,
    DC) codes; every ``restart`` units of ``per_unit`` blocks the bits are
    closed, a restart marker follows and predictions start from 0."""
    out, codes, sizes, before, marker = [], [], [], {}, 0
    for i, (c, z) in enumerate(blocks):
        if restart and i and i % (restart * per_unit) == 0:
            out += [pack(np.array(codes, np.int64), np.array(sizes, np.int64)), bytes([0xFF, 0xD0 + marker])]
            codes, sizes, before, marker = [], [], {}, (marker + 1) % 8
        for is_dc, symbol, n, extra in symbols_of(z, before.get(c, 0)):
            code, size = codes_of[c][is_dc][symbol]
            codes.append(code << n | extra)
            sizes.append(size + n)
        before[c] = int(z[0])
    out.append(pack(np.array(codes, np.int64), np.array(sizes, np.int64)))
    return b"".join(out)


def unit_order(across: int, down: int, sampling: list[int]) -> list[tuple[int, int]]:
    """(component, block) in coding order of ``across`` by ``down`` units: in a
    unit a component has ``sampling`` squared blocks, row by row; its blocks
    are numbered along the rows of its own plane."""
    return [(c, (uy * s + y) * across * s + ux * s + x) for uy in range(down) for ux in range(across) for c, s in enumerate(sampling) for y in range(s) for x in range(s)]


def assemble(components: list[list[np.ndarray]], width: int, height: int, quant: list[list[int]], optimise: bool = True, restart: int = 0, icc: bytes = b"", luma_sampling: int = 1) -> bytes:
    """A baseline stream of one or three components. Chroma has tables and codes
    of its own; with ``luma_sampling`` 2 it has half the samples a side. The
    planes hold whole units."""
    n = len(components)
    sampling, slots = [luma_sampling] + [1] * (n - 1), [min(c, 1) for c in range(n)]
    across, down = (-(-side // (8 * luma_sampling)) for side in (width, height))
    order = [(c, components[c][i]) for c, i in unit_order(across, down, sampling)]
    per_unit = sum(s * s for s in sampling)
    names = [("ac_luma", "dc_luma"), ("ac_chroma", "dc_chroma")][: max(slots) + 1]
    if optimise:
        counts: list[tuple[dict, dict]] = [({}, {}) for _ in names]
        before: dict[int, int] = {}
        for i, (c, z) in enumerate(order):
            if restart and i % (restart * per_unit) == 0:
                before = {}
            for is_dc, symbol, _, _ in symbols_of(z, before.get(c, 0)):
                held = counts[slots[c]][is_dc]
                held[symbol] = held.get(symbol, 0) + 1
            before[c] = int(z[0])
        lengths = [[code_lengths(x) for x in pair] for pair in counts]
        tables_out = b"".join(dht(1 - is_dc, slot, pair[is_dc]) for slot, pair in enumerate(lengths) for is_dc in (1, 0))
        codes = [(canonical(ac), canonical(dc)) for ac, dc in lengths]
    else:
        tables_out = b"".join(wire_table(1 - is_dc, slot, *tables.STANDARD_CODES[pair[is_dc]]) for slot, pair in enumerate(names) for is_dc in (1, 0))
        codes = [(_wire_codes(*tables.STANDARD_CODES[ac]), _wire_codes(*tables.STANDARD_CODES[dc])) for ac, dc in names]
    head = SOI + jfif() + (icc_segments(icc) if icc else b"") + dqt(dict(enumerate(quant))) + frame_header(width, height, n, luma_sampling=luma_sampling * 0x11) + tables_out
    head += restart_interval(restart) if restart else b""
    return head + scan_header(list(range(n)), [s * 0x11 for s in slots]) + scan_bytes(order, [codes[s] for s in slots], restart, per_unit) + EOI


def _wire_codes(bits: Iterable[int], symbols: Iterable[int]) -> dict[int, tuple[int, int]]:
    out, code, it = {}, 0, iter(symbols)
    for length, count in enumerate(bits, 1):
        for _ in range(count):
            out[next(it)] = code, length
            code += 1
        code <<= 1
    return out


class BitReader:
    """Bits of an entropy-coded scan; stuffed zeros and restart markers are passed over."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.have = data, 0, 0, 0

    def bit(self) -> int:
        if not self.have:
            if self.at >= len(self.data):
                raise EOFError("the scan has ended")
            self.held, self.have = self.data[self.at], 8
            if self.held == 0xFF:
                follows = self.data[self.at + 1] if self.at + 1 < len(self.data) else 0xD9
                if follows:
                    raise EOFError("a marker ends the scan")
                self.at += 1
            self.at += 1
        self.have -= 1
        return self.held >> self.have & 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def restart(self) -> None:
        """To the first bit behind a restart marker."""
        self.have = 0
        if self.data[self.at : self.at + 1] == b"\xff" and 0xD0 <= self.data[self.at + 1] <= 0xD7:
            self.at += 2

    def symbol(self, decode: dict[tuple[int, int], int]) -> int:
        code = length = 0
        while length < 16:
            code, length = code << 1 | self.bit(), length + 1
            if (s := decode.get((length, code))) is not None:
                return s
        raise ValueError("no such code")


def signed(bits: int, n: int) -> int:
    return 0 if n == 0 else bits if bits >> (n - 1) else bits - (1 << n) + 1


def decode(stream: bytes) -> tuple[int, int, list[list[np.ndarray]]]:
    """Width, height and the blocks of each component, in zigzag order, of a
    baseline stream; planes are those of whole units."""
    codes: dict[int, dict[tuple[int, int], int]] = {}
    width = height = interval = 0
    sampling, slots, data = [1], [0], b""
    for marker, body in segments(stream):
        if marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            sampling = [body[7 + 3 * c] & 15 for c in range(body[5])]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC4:
            count = sum(body[1:17])
            codes[body[0]] = {(length, code): s for s, (code, length) in _wire_codes(body[1:17], body[17 : 17 + count]).items()}
        elif marker == 0xDA:
            slots = [body[2 + 2 * c] for c in range(body[0])]
        elif marker == -1:
            data = body
    across, down = (-(-side // (8 * max(sampling))) for side in (width, height))
    n, per_unit = len(sampling), sum(s * s for s in sampling)
    reader, before = BitReader(data), [0] * n
    out: list[list[np.ndarray]] = [[np.zeros(64, np.int64)] * (across * down * s * s) for s in sampling]
    for turn, (c, place) in enumerate(unit_order(across, down, sampling)):
        if interval and turn and turn % (interval * per_unit) == 0:
            reader.restart()
            before = [0] * n
        dc, ac = codes[slots[c] >> 4], codes[0x10 | slots[c] & 15]
        z = np.zeros(64, np.int64)
        size = reader.symbol(dc)
        before[c] += signed(reader.bits(size), size)
        z[0], i = before[c], 1
        while i < 64:
            s = reader.symbol(ac)
            if s == 0:
                break
            i += s >> 4
            if s & 15:
                z[i] = signed(reader.bits(s & 15), s & 15)
            i += 1
        out[c][place] = z
    return width, height, out


def encode_images(blocks: DataFrame, quant: list[int], optimise: bool = True, restart: int = 0) -> DataFrame:
    """image_id, width, height and payload of each image of ``blocks``
    (image_id, n, z), eight blocks a row, one component."""
    return encode_colour_images(blocks.withColumn("comp", F.lit(0)), [quant], optimise, restart)


def encode_colour_images(blocks: DataFrame, quant: list[list[int]], optimise: bool = True, restart: int = 0, luma_sampling: int = 1) -> DataFrame:
    """As ``encode_images``, of blocks (image_id, comp, n, z) with one or three
    components, luma eight blocks a row; ``quant`` holds the luma and the
    chroma table. With ``luma_sampling`` 2 chroma has four blocks a row."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        planes = [[np.asarray(v) for v in part.sort_values("n")["z"]] for _, part in sorted(g.groupby("comp"))]
        width, height = 64, 8 * (len(planes[0]) // 8)
        payload = assemble(planes, width, height, quant, optimise, restart, luma_sampling=luma_sampling)
        return pd.DataFrame({"image_id": [g["image_id"].iloc[0]], "width": [width], "height": [height], "payload": [payload]})

    return blocks.groupBy("image_id").applyInPandas(one, "image_id int, width int, height int, payload binary")


def decode_components(images: DataFrame) -> DataFrame:
    """image_id, comp, n and z: the blocks of each component of each payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, p in zip(b["image_id"], b["payload"], strict=True):
                rows = [(i, c, n, z) for c, plane in enumerate(decode(bytes(p))[2]) for n, z in enumerate(plane)]
                yield pd.DataFrame(rows, columns=["image_id", "comp", "n", "z"])

    return images.select("image_id", "payload").mapInPandas(run, "image_id int, comp int, n long, z array<long>")


def decode_images(images: DataFrame) -> DataFrame:
    """image_id, n and z: the blocks of the first component of each payload."""
    return decode_components(images).filter("comp = 0").select("image_id", "n", "z")


def quant_tables(images: DataFrame) -> DataFrame:
    """image_id, table_no, k and q of every quantisation table of the payloads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, p in zip(b["image_id"], b["payload"], strict=True) for r in read_dqt(bytes(p))], columns=["image_id", "table_no", "k", "q"])

    return images.select("image_id", "payload").mapInPandas(run, "image_id int, table_no int, k int, q int")


def with_profile(payload: str, size: Column, xyb: Column) -> Column:
    """Streams with a made-up profile of ``size`` bytes behind their first marker."""

    @F.pandas_udf("binary")
    def put(p: pd.Series, n: pd.Series, named: pd.Series) -> pd.Series:
        body = [(b"XYB" if x else b"RGB") + bytes(int(k) - 3) for k, x in zip(n, named, strict=True)]
        return pd.Series([bytes(s[:2]) + icc_segments(b) + bytes(s[2:]) for s, b in zip(p, body, strict=True)])

    return put(payload, size, xyb)


def validated(images: DataFrame, most: int = 65535) -> DataFrame:
    """``error_code`` names what is wrong with an image's sides or payload; null if nothing is."""
    side = lambda c: (F.col(c) < 1) | (F.col(c) > most)
    return images.withColumn("error_code", F.when(side("width") | side("height"), "INVALID_DIMENSIONS").when(F.col("payload").isNull(), "MISSING_PAYLOAD"))

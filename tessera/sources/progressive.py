"""Progressive streams: banded scans with successive approximation, and their decoder.

A scan is first written as symbols, extra bits and raw bits, then its own code
table is built from the symbols' counts and the whole is packed, so a token
list stands between coefficients and bytes as it does for baseline scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators.huffman import code_lengths
from tessera.sources import jpeg

#: (symbol, size of the bits that follow it, those bits); None for bits without a symbol.
Token = tuple[int | None, int, int]
LONGEST_RUN = 0x7FFF
Scan = tuple[list[int], int, int, int, int]


def dc_first(units: list[list[np.ndarray]], comps: list[int], low: int) -> list[Token]:
    out, before = [], dict.fromkeys(comps, 0)
    for unit in zip(*(units[c] for c in comps), strict=True):
        for c, z in zip(comps, unit, strict=True):
            v = int(z[0]) >> low
            d = v - before[c]
            n = abs(d).bit_length()
            out.append((n, n, d if d >= 0 else d + (1 << n) - 1))
            before[c] = v
    return out


def dc_refine(units: list[list[np.ndarray]], comps: list[int], low: int) -> list[Token]:
    return [(None, 1, int(z[0]) >> low & 1) for unit in zip(*(units[c] for c in comps), strict=True) for z in unit]


class _Runs:
    """Blocks that end in zeros are counted; their correction bits wait with them."""

    def __init__(self) -> None:
        self.out: list[Token] = []
        self.run, self.waiting = 0, []

    def flush(self) -> None:
        if self.run:
            n = self.run.bit_length() - 1
            self.out.append((n << 4, n, self.run - (1 << n)))
            self.raw(self.waiting)
            self.run, self.waiting = 0, []

    def raw(self, bits: list[int]) -> None:
        self.out += [(None, 1, b) for b in bits]

    def ended(self, bits: list[int]) -> None:
        self.run += 1
        self.waiting += bits
        if self.run == LONGEST_RUN:
            self.flush()


def ac_first(blocks: list[np.ndarray], first: int, last: int, low: int) -> list[Token]:
    runs = _Runs()
    for z in blocks:
        at = first - 1
        for k in range(first, last + 1):
            size = abs(int(z[k])) >> low
            if size:
                runs.flush()
                zeros, n = k - at - 1, size.bit_length()
                runs.out += [(0xF0, 0, 0)] * (zeros // 16)
                runs.out.append((zeros % 16 << 4 | n, n, size if z[k] > 0 else size ^ ((1 << n) - 1)))
                at = k
        if at < last:
            runs.ended([])
    runs.flush()
    return runs.out


def ac_refine(blocks: list[np.ndarray], first: int, last: int, low: int) -> list[Token]:
    """Values known before give one correction bit each, behind the symbol that
    passes over them; values new at this bit give a symbol and a sign."""
    runs = _Runs()
    for z in blocks:
        size = np.abs(z) >> low
        new = [k for k in range(first, last + 1) if size[k] == 1]
        end, zeros, bits = (new[-1] if new else -1), 0, []
        for k in range(first, last + 1):
            if size[k] == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= end:
                runs.flush()
                runs.out.append((0xF0, 0, 0))
                runs.raw(bits)
                zeros, bits = zeros - 16, []
            if size[k] > 1:
                bits.append(int(size[k]) & 1)
                continue
            runs.flush()
            runs.out.append((zeros << 4 | 1, 1, int(z[k] > 0)))
            runs.raw(bits)
            zeros, bits = 0, []
        if zeros or bits:
            runs.ended(bits)
    runs.flush()
    return runs.out


def scan_tokens(units: list[list[np.ndarray]], scan: Scan) -> list[Token]:
    comps, first, last, high, low = scan
    if first == 0:
        return dc_refine(units, comps, low) if high else dc_first(units, comps, low)
    return (ac_refine if high else ac_first)(units[comps[0]], first, last, low)


def pack_tokens(tokens: list[Token]) -> tuple[dict[int, int], bytes]:
    """Code lengths by the tokens' own counts, and the packed bits."""
    counts: dict[int, int] = {}
    for symbol, _, _ in tokens:
        if symbol is not None:
            counts[symbol] = counts.get(symbol, 0) + 1
    lengths = code_lengths(counts)
    codes = jpeg.canonical(lengths)
    values = [((codes[s][0] << n | v), codes[s][1] + n) if s is not None else (v, n) for s, n, v in tokens]
    return lengths, jpeg.pack(np.array([v for v, _ in values], np.int64), np.array([n for _, n in values], np.int64))


def assemble(units: list[list[np.ndarray]], width: int, height: int, quant: list[list[int]], scans: list[Scan]) -> bytes:
    """A progressive stream of one or three components without subsampling."""
    out = jpeg.SOI + jpeg.jfif() + jpeg.dqt(dict(enumerate(quant))) + jpeg.frame_header(width, height, len(units), progressive=True)
    for scan in scans:
        comps, first, last, high, low = scan
        lengths, body = pack_tokens(scan_tokens(units, scan))
        out += jpeg.dht(int(first > 0), 0, lengths) if lengths else b""
        out += jpeg.scan_header(comps, [0] * len(comps), first, last, high, low) + body
    return out + jpeg.EOI


def _parts(stream: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(marker, payload, entropy-coded bytes behind it)."""
    at = 2
    while at + 2 <= len(stream) and stream[at + 1] != 0xD9:
        marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
        body, at = stream[at + 4 : at + 2 + size], at + 2 + size
        end = at
        if marker == 0xDA:
            while stream[end] != 0xFF or stream[end + 1] == 0 or 0xD0 <= stream[end + 1] <= 0xD7:
                end += 1
        yield marker, body, stream[at:end]
        at = end


def _read_ac_first(reader: jpeg.BitReader, codes: dict, blocks: list[np.ndarray], first: int, last: int, low: int) -> None:
    run = 0
    for z in blocks:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = reader.symbol(codes)
            zeros, n = s >> 4, s & 15
            if n:
                k += zeros
                z[k] = jpeg.signed(reader.bits(n), n) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + reader.bits(zeros) - 1
                break


def _read_ac_refine(reader: jpeg.BitReader, codes: dict, blocks: list[np.ndarray], first: int, last: int, low: int) -> None:
    bit, run = 1 << low, 0

    def correct(z: np.ndarray, k: int) -> None:
        if reader.bit():
            z[k] += bit if z[k] > 0 else -bit

    for z in blocks:
        k = first
        while not run and k <= last:
            s = reader.symbol(codes)
            zeros, value = s >> 4, 0
            if s & 15:
                value = bit if reader.bit() else -bit
            elif zeros < 15:
                run = (1 << zeros) + reader.bits(zeros)
                break
            while k <= last:
                if z[k]:
                    correct(z, k)
                elif zeros == 0:
                    if value:
                        z[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            for j in range(k, last + 1):
                if z[j]:
                    correct(z, j)
            run -= 1


def decode(stream: bytes) -> tuple[int, int, list[list[np.ndarray]]]:
    """Width, height and the blocks of each component in zigzag order."""
    width = height = 0
    units: list[list[np.ndarray]] = []
    codes: dict[int, dict[tuple[int, int], int]] = {}
    for marker, body, data in _parts(stream):
        if marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            units = [[np.zeros(64, np.int64) for _ in range(-(-width // 8) * -(-height // 8))] for _ in range(body[5])]
        elif marker == 0xC4:
            codes[body[0]] = {(n, code): s for s, (code, n) in jpeg._wire_codes(body[1:17], body[17 : 17 + sum(body[1:17])]).items()}
        elif marker == 0xDA:
            comps = [body[1 + 2 * i] - 1 for i in range(body[0])]
            first, last, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            reader = jpeg.BitReader(data)
            if first:
                (_read_ac_refine if high else _read_ac_first)(reader, codes[0x10], units[comps[0]], first, last, low)
                continue
            before = dict.fromkeys(comps, 0)
            for unit in zip(*(units[c] for c in comps), strict=True):
                for c, z in zip(comps, unit, strict=True):
                    if high:
                        z[0] |= reader.bit() << low
                    else:
                        n = reader.symbol(codes[0x00])
                        before[c] += jpeg.signed(reader.bits(n), n)
                        z[0] = before[c] << low
    return width, height, units


def encode_images(blocks: DataFrame, quant: list[int], scans: list[Scan]) -> DataFrame:
    """image_id, width, height and payload of each image of ``blocks``
    (image_id, n, z), eight blocks a row, one component; an image is a group."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        z = [np.asarray(v) for v in g.sort_values("n")["z"]]
        height = 8 * (len(z) // 8)
        return pd.DataFrame({"image_id": [g["image_id"].iloc[0]], "width": [64], "height": [height], "payload": [assemble([z], 64, height, [quant], scans)]})

    return blocks.groupBy("image_id").applyInPandas(one, "image_id int, width int, height int, payload binary")


def decode_images(images: DataFrame) -> DataFrame:
    """image_id, n and z: the blocks of each progressive payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, z) for i, p in zip(b["image_id"], b["payload"], strict=True) for n, z in enumerate(decode(bytes(p))[2][0])]
            yield pd.DataFrame(rows, columns=["image_id", "n", "z"])

    return images.select("image_id", "payload").mapInPandas(run, "image_id int, n long, z array<long>")

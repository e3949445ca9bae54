"""Decompressors that neither Python nor Spark has: LZW in both dialects, PackBits, the run lengths of BMP and PCX."""

from __future__ import annotations

import zlib

import numpy as np

from rasterlake.operators.reader import Broken


def inflate(data: bytes, most: int, raw: bool = False) -> bytes:
    """zlib (or raw deflate) data, at most `most` bytes of output."""
    d = zlib.decompressobj(-15 if raw else 15)
    try:
        out = d.decompress(data, most + 1)
    except zlib.error as e:
        raise Broken(f"deflate: {e}") from e
    if len(out) > most:
        raise Broken("deflate: more data than the picture holds")
    if not d.eof:
        raise Broken("deflate: data end early")
    return out


def lzw_gif(data: bytes, min_code: int, most: int) -> bytes:
    """GIF's LZW: codes from the low bits up, of at most 12 bits."""
    if not 2 <= min_code <= 11:
        raise Broken(f"LZW code size {min_code}")
    clear, end = 1 << min_code, (1 << min_code) + 1
    fresh = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, previous = list(fresh), min_code + 1, None
    out, size = [], 0
    acc = bits = 0
    for byte in data:
        acc |= byte << bits
        bits += 8
        while bits >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            bits -= width
            if code == clear:
                table, width, previous = list(fresh), min_code + 1, None
                continue
            if code == end:
                return b"".join(out)[:most]
            if previous is None:
                if code >= clear:
                    raise Broken("LZW: first code is none of the alphabet")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = previous + previous[:1]
                else:
                    raise Broken("LZW: code beyond the table")
                if len(table) < 4096:
                    table.append(previous + entry[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
            out.append(entry)
            size += len(entry)
            previous = entry
            if size >= most:
                return b"".join(out)[:most]
    if not out:
        raise Broken("LZW: no data")
    return b"".join(out)


def lzw_tiff(data: bytes, most: int) -> bytes:
    """TIFF's LZW: codes from the high bits down, growing one code early."""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, previous = list(fresh), 9, None
    out, size = [], 0
    acc = bits = 0
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFFFF
        bits += 8
        while bits >= width:
            bits -= width
            code = acc >> bits & ((1 << width) - 1)
            if code == 257:
                return b"".join(out)[:most]
            if code == 256:
                table, width, previous = list(fresh), 9, None
                continue
            if previous is None:
                if code > 255:
                    raise Broken("LZW: first code is none of the alphabet")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = previous + previous[:1]
                else:
                    raise Broken("LZW: code beyond the table")
                if len(table) < 4096:
                    table.append(previous + entry[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
            out.append(entry)
            size += len(entry)
            previous = entry
            if size >= most:
                return b"".join(out)[:most]
    return b"".join(out)[:most]


def packbits(data: bytes, most: int) -> bytes:
    out = bytearray()
    at, n = 0, len(data)
    while at < n and len(out) < most:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128 and at < n:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out[:most])


def rle_bmp(data: bytes, width: int, height: int, four_bits: bool) -> np.ndarray:
    """Rows of indexes, bottom row first; what isn't written is index 0, what lies outside is dropped."""
    out = np.zeros((height, width), np.uint8)
    x = y = at = 0
    n = len(data)

    def put(values: bytes) -> None:
        nonlocal x
        if 0 <= y < height and x < width:
            part = values[: width - x]
            out[y, x : x + len(part)] = np.frombuffer(part, np.uint8)
        x += len(values)

    def nibbles(packed: bytes, count: int) -> bytes:
        return bytes(v for b in packed for v in (b >> 4, b & 15))[:count]

    while at + 1 < n:
        count, value = data[at], data[at + 1]
        at += 2
        if count:
            put(nibbles(bytes([value]) * ((count + 1) // 2), count) if four_bits else bytes([value]) * count)
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            return out
        elif value == 2:
            if at + 1 >= n:
                raise Broken("RLE: data end in a delta")
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = (value + 1) // 2 if four_bits else value
            if at + size > n:
                raise Broken("RLE: data end in a literal")
            put(nibbles(data[at : at + size], value) if four_bits else data[at : at + size])
            at += size + size % 2
        if y >= height and x:
            continue
    if y < height - 1 or (y == height - 1 and x < width):
        raise Broken("RLE: data end before the picture does")
    return out


def rle_pcx(data: bytes, size: int) -> bytes:
    out = bytearray()
    at, n = 0, len(data)
    while at < n and len(out) < size:
        b = data[at]
        at += 1
        if b >= 0xC0:
            if at >= n:
                break
            out += data[at : at + 1] * (b & 0x3F)
            at += 1
        else:
            out.append(b)
    return bytes(out[:size])


def unpack_bits(rows: np.ndarray, bits: int, count: int) -> np.ndarray:
    """rows of bytes to `count` samples of 1, 2, 4 or 8 bits each, high bits first."""
    if bits == 8:
        return rows[:, :count]
    if bits == 1:
        return np.unpackbits(rows, axis=1)[:, :count]
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits
    return (rows[:, :, None] >> shifts & np.uint8((1 << bits) - 1)).reshape(len(rows), -1)[:, :count]

"""PNG: chunks with checksums, all colour types and depths, filters, Adam7."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from rasterlake.functions import labels as L
from rasterlake.operators.codecs import inflate, unpack_bits
from rasterlake.operators.reader import Broken, Limited, Limits, Reader, Record

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Checksums are verified for chunks that lie in the head.
HEAD = 64 * 1024
#: Adam7's passes as first column and row, steps between columns and rows.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(reader: Reader):
    """(type, offset of the data, length) of each chunk; stops at the first that the file can't hold."""
    at = 8
    while at + 12 <= reader.size:
        head = reader.read(at, 8)
        length, kind = struct.unpack(">I4s", head)
        yield kind.decode("latin-1"), at + 8, length
        if at + 12 + length > reader.size:
            return
        at += 12 + length
        if kind == b"IEND":
            return


def _printable(data: bytes, most: int = 90) -> str:
    return re.sub(r"[^\x20-\x7e]", ".", data.split(b"\0")[0].decode("latin-1"))[:most]


def parse(reader: Reader, record: Record) -> None:
    if reader.size < 8:
        return record.problem("PNG_SHORT", "CORRUPTED", "file is too short for a PNG signature")
    if reader.read(0, 8) != SIGNATURE:
        return record.problem("PNG_SIGNATURE", "CORRUPTED", "no PNG signature")
    ihdr, idat, idat_bytes, texts, checked, wrong, end = None, 0, 0, 0, 0, 0, False
    for kind, at, length in chunks(reader):
        record.chunks[kind] = record.chunks.get(kind, 0) + 1
        if at + length + 4 > reader.size:
            record.problem("PNG_CHUNK", "CORRUPTED", f"chunk {kind} goes beyond the end")
            break
        data = b""
        if kind == "IDAT":
            idat, idat_bytes = idat + 1, idat_bytes + length
        elif at + length + 4 <= HEAD and not idat:
            body = reader.read(at, length + 4)
            data, crc = body[:-4], struct.unpack(">I", body[-4:])[0]
            checked += 1
            if zlib.crc32(kind.encode("latin-1") + data) != crc:
                wrong += 1
                record.problem("PNG_CRC", "CORRUPTED", f"checksum of {kind} is wrong")
        if kind == "IHDR":
            if length != 13:
                record.problem("PNG_IHDR", "CORRUPTED", f"IHDR of {length} bytes")
            elif ihdr is None:
                ihdr = struct.unpack(">IIBBBBB", data or reader.read(at, 13))
        elif kind == "PLTE":
            record.detail("Colour", "palette entries", length // 3)
        elif kind == "tRNS":
            record.detail("Colour", "transparency bytes", length)
        elif kind == "pHYs" and len(data) == 9:
            x, y, unit = struct.unpack(">IIB", data)
            if unit == 1 and x and y:
                record.dpi(x * 0.0254, y * 0.0254, "pixels per metre")
            else:
                record.resolution_unit = "aspect ratio only"
            record.detail("Resolution", "pHYs", f"{x} x {y}, unit {unit}")
        elif kind == "gAMA" and len(data) == 4:
            record.detail("Colour", "gamma", f"{struct.unpack('>I', data)[0] / 100000:.5f}")
        elif kind == "sRGB" and data:
            record.detail("Colour", "sRGB intent", L.PNG_INTENTS.get(data[0], "unknown"))
        elif kind in ("tEXt", "zTXt", "iTXt"):
            texts += 1
            if data:
                keyword, _, value = data.partition(b"\0")
                record.detail("Extra", f"text {_printable(keyword)}", _printable(value) if kind == "tEXt" else "compressed")
        elif kind == "IEND":
            end = True
    record.measures |= {"idat_chunks": idat, "idat_bytes": idat_bytes, "texts": texts}
    if ihdr is None:
        return record.problem("PNG_NO_IHDR", "CORRUPTED", "no IHDR")
    width, height, depth, colour, method, filtering, interlace = ihdr
    name, channels = L.PNG_COLOURS.get(colour, ("unknown", 0))
    record.width, record.height, record.sample_depth, record.channels = min(width, 2**31 - 1), min(height, 2**31 - 1), depth, channels
    record.bits_per_pixel, record.color_model = depth * channels, name
    record.compression, record.compression_code = "Deflate" if method == 0 else "unknown", f"PNG method {method}"
    if not width or not height:
        record.problem("PNG_GEOMETRY", "CORRUPTED", f"geometry {width} x {height}")
    if interlace > 1:
        record.problem("PNG_INTERLACE", "WARNING", f"interlace method {interlace}")
    if not idat:
        record.problem("PNG_NO_IDAT", "CORRUPTED", "no IDAT")
    if not end and b"IEND" not in reader.tail(32):
        record.problem("PNG_NO_IEND", "CORRUPTED", "no IEND")
    for group, label, value in (
        ("Geometry", "width x height", f"{width} x {height}"), ("Depth", "bits per channel", depth), ("Depth", "bits per pixel", depth * channels), ("Colour", "colour type", f"{colour} {name}"), ("Compression", "filter method", filtering), ("Compression", "IDAT", f"{idat} chunks, {idat_bytes} bytes"),
        ("Geometry", "interlace", "Adam7" if interlace == 1 else "none"), ("Extra", "chunks", ", ".join(f"{k} x {v}" for k, v in sorted(record.chunks.items()))), ("Check", "checksums", f"{checked} verified, {wrong} wrong"),
    ):
        record.detail(group, label, value)
    if idat_bytes:
        record.detail("Compression", "ratio", f"{-(-width * channels * depth // 8) * height / idat_bytes:.2f}")


def _unfilter(data: bytes, rows: int, stride: int, bpp: int) -> np.ndarray:
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        kind = data[y * (stride + 1)]
        line = np.frombuffer(data, np.uint8, stride, y * (stride + 1) + 1)
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + above
        elif kind == 1:
            # each channel byte is a running sum
            pad = -stride % bpp
            row = np.cumsum(np.pad(line, (0, pad)).reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind in (3, 4):
            cur, up, src = bytearray(stride), above.tolist(), line.tolist()
            for x in range(stride):
                a = cur[x - bpp] if x >= bpp else 0
                b = up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - bpp] if x >= bpp else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[x] = (src[x] + guess) & 255
            row = np.frombuffer(bytes(cur), np.uint8)
        else:
            raise Broken(f"filter {kind}")
        out[y] = above = row
    return out


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Samples at full depth, (height, width, channels)."""
    if depth == 16:
        return np.ascontiguousarray(rows[:, : width * channels * 2]).view(">u2").reshape(len(rows), width, channels)
    return unpack_bits(rows, depth, width * channels).reshape(len(rows), width, channels)


def decode(reader: Reader, record: Record, limits: Limits) -> np.ndarray:
    ihdr = plte = trns = None
    parts: list[tuple[int, int]] = []
    for kind, at, length in chunks(reader):
        if at + length > reader.size:
            raise Broken("data end in a chunk")
        if kind == "IHDR" and ihdr is None:
            ihdr = struct.unpack(">IIBBBBB", reader.read(at, 13))
        elif kind == "PLTE":
            plte = reader.read(at, length)
        elif kind == "tRNS":
            trns = reader.read(at, length)
        elif kind == "IDAT":
            parts.append((at, length))
    if ihdr is None:
        raise Broken("no IHDR")
    width, height, depth, colour, _, _, interlace = ihdr
    if depth not in L.PNG_DEPTHS.get(colour, ()):
        raise Limited(f"colour type {colour} of {depth} bits")
    limits.check(width, height, 4)
    limits.compressed(sum(n for _, n in parts))
    channels = L.PNG_COLOURS[colour][1]
    passes = ADAM7 if interlace == 1 else ((0, 0, 1, 1),)
    sizes = [(len(range(x, width, dx)), len(range(y, height, dy))) for x, y, dx, dy in passes]
    strides = [-(-w * channels * depth // 8) for w, _ in sizes]
    total = sum((s + 1) * h for s, (w, h) in zip(strides, sizes, strict=True) if w and h)
    raw = inflate(b"".join(reader.read(a, n) for a, n in parts), max(total, 1) + 65_536)
    if len(raw) < total:
        raise Broken("pixel data are cut off")
    full = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
    at, step = 0, max(1, channels * depth // 8)
    for (x, y, dx, dy), (w, h), stride in zip(passes, sizes, strides, strict=True):
        if w and h:
            rows = _unfilter(raw[at : at + (stride + 1) * h], h, stride, step)
            full[y::dy, x::dx] = _samples(rows, w, channels, depth)
            at += (stride + 1) * h
    if colour == 3:
        entries = np.zeros((256, 3), np.uint8)
        have = min(256, len(plte or b"") // 3)
        entries[:have] = np.frombuffer(plte or b"", np.uint8, have * 3).reshape(have, 3)
        index = full[:, :, 0]
        out = entries[index]
        if trns:
            alpha = np.full(256, 255, np.uint8)
            alpha[: min(256, len(trns))] = np.frombuffer(trns[:256], np.uint8)
            out = np.dstack([out, alpha[index]])
        return out
    if depth == 16:
        eight = (full >> 8).astype(np.uint8)
    else:
        eight = (full.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    key = None
    if trns and colour in (0, 2) and len(trns) >= 2 * channels:
        key = (full != np.frombuffer(trns, ">u2", channels)).any(axis=2).astype(np.uint8) * 255
    if colour == 0:
        eight = np.repeat(eight, 3, axis=2)
    elif colour == 4:
        eight = np.dstack([np.repeat(eight[:, :, :1], 3, axis=2), eight[:, :, 1]])
    return eight if key is None else np.dstack([eight, key])

"""BMP: OS/2 and Windows headers, palettes, bit fields, run lengths."""

from __future__ import annotations

import numpy as np

from rasterlake.functions import labels as L
from rasterlake.operators.codecs import rle_bmp, unpack_bits
from rasterlake.operators.reader import Broken, Cursor, Limited, Limits, Reader, Record


def _header(reader: Reader) -> dict | None:
    head = reader.read(0, 18)
    if len(head) < 18:
        return None
    c = Cursor(head, at=2)
    h = {"file_size": c.u32(), "reserved": c.u32(), "offset": c.u32(), "size": c.u32()}
    if not 12 <= h["size"] <= 124:
        return h | {"bad": True}
    body = reader.read(14, h["size"])
    c = Cursor(body, at=4)
    if h["size"] == 12:
        h |= {"width": c.u16(), "height": c.u16(), "planes": c.u16(), "bits": c.u16(), "compression": 0, "data": 0, "x": 0, "y": 0, "used": 0, "important": 0}
    else:
        h |= {"width": c.i32(), "height": c.i32(), "planes": c.u16(), "bits": c.u16(), "compression": c.u32(), "data": c.u32(), "x": c.i32(), "y": c.i32(), "used": c.u32(), "important": c.u32()}
    h["short"] = len(body) < h["size"]
    h["masks"] = None
    after = 14 + h["size"]
    if h["compression"] in (3, 6):
        count = 4 if h["compression"] == 6 or h["size"] >= 56 else 3
        if h["size"] >= 52:
            c = Cursor(body, at=40)
        else:
            c = Cursor(reader.read(after, 4 * count))
            after += 4 * count
        h["masks"] = [c.u32() for _ in range(count)]
    h["palette_at"], h["entry"] = after, 3 if h["size"] == 12 else 4
    h["colours"] = min(h["used"] or 1 << h["bits"], 1 << h["bits"]) if h["bits"] <= 8 else 0
    return h


def _stride(width: int, bits: int) -> int:
    return (width * bits + 31) // 32 * 4


def parse(reader: Reader, record: Record) -> None:
    h = _header(reader)
    if h is None:
        return record.problem("BMP_SHORT", "CORRUPTED", "file is too short for a BMP header")
    if h.get("bad"):
        return record.problem("BMP_DIB_SIZE", "CORRUPTED", f"DIB header of {h['size']} bytes")
    if h["short"]:
        return record.problem("BMP_NO_DIB", "CORRUPTED", "DIB header is cut off")
    bits, code = h["bits"], h["compression"]
    record.width, record.height = h["width"], abs(h["height"])
    record.bits_per_pixel, record.channels, record.sample_depth = bits, 3 if bits >= 24 else 1, min(8, bits)
    record.color_model = f"palette of {h['colours']} colours" if bits <= 8 else {16: "RGB 5-5-5", 24: "RGB 8-8-8", 32: "RGB 8-8-8"}.get(bits, "")
    if h["masks"]:
        record.color_model = "RGB by bit masks"
    record.compression, record.compression_code = L.BMP_COMPRESSIONS.get(code, "unknown"), f"BI_{code}"
    if record.width <= 0 or record.height == 0:
        record.problem("BMP_GEOMETRY", "CORRUPTED", f"geometry {h['width']} x {h['height']}")
    if h["planes"] not in (0, 1):
        record.problem("BMP_PLANES", "WARNING", f"{h['planes']} planes")
    if bits not in (1, 2, 4, 8, 16, 24, 32):
        record.problem("BMP_DEPTH", "WARNING", f"{bits} bits a pixel")
    if h["x"] > 0 and h["y"] > 0:
        record.dpi(h["x"] * 0.0254, h["y"] * 0.0254, "pixels per metre")
    if h["colours"]:
        want = h["colours"] * h["entry"]
        raw = reader.read(h["palette_at"], want)
        if len(raw) < want:
            record.problem("BMP_PALETTE", "CORRUPTED", "palette is cut off")
        entries = [raw[i : i + 3] for i in range(0, len(raw) - 2, h["entry"])]
        record.detail("Colour", "palette entries", h["colours"])
        record.detail("Colour", "distinct palette colours", len(set(entries)))
        record.detail("Colour", "gray palette", all(e[0] == e[1] == e[2] for e in entries))
    if h["file_size"] > reader.size:
        record.problem("BMP_FILE_SIZE", "CORRUPTED", f"header says {h['file_size']} bytes, file has {reader.size}")
    elif h["file_size"] + 1024 < reader.size:
        record.problem("BMP_EXTRA", "WARNING", f"{reader.size - h['file_size']} bytes behind the picture")
    if h["offset"] > reader.size:
        record.problem("BMP_OFFSET", "CORRUPTED", "pixel data begin beyond the end")
    available = max(0, reader.size - h["offset"])
    if code in (1, 2):
        record.detail("Geometry", "compressed bytes", h["data"] or available)
    elif record.width > 0 and record.height and code in (0, 3, 6):
        stride = _stride(record.width, bits)
        record.detail("Geometry", "row stride", stride)
        if stride * record.height > available:
            record.problem("BMP_TRUNCATED", "CORRUPTED", f"pixel data take {stride * record.height} bytes, {available} are there")
    if h["data"] and code in (1, 2) and h["data"] > available:
        record.problem("BMP_TRUNCATED", "CORRUPTED", f"compressed data take {h['data']} bytes, {available} are there")
    if h["data"] and h["data"] + 512 < available:
        record.problem("BMP_IMAGE_SIZE", "WARNING", "picture size in the header is less than what follows")
    if h["masks"]:
        record.detail("Colour", "mask bits", "/".join(str(m.bit_count()) for m in h["masks"]))
    for group, name, value in (
        ("Format", "signature", "BM"), ("Format", "file size in header", h["file_size"]), ("Format", "DIB header", f"{L.BMP_HEADERS.get(h['size'], 'unknown')} ({h['size']} bytes)"), ("Format", "pixel offset", h["offset"]),
        ("Geometry", "width x height", f"{h['width']} x {h['height']}"), ("Geometry", "rows", "top-down" if h["height"] < 0 else "bottom-up"), ("Depth", "bits per pixel", bits), ("Depth", "bits per channel", record.sample_depth),
        ("Colour", "colour model", record.color_model), ("Resolution", "pixels per metre", f"{h['x']} x {h['y']}"), ("Compression", "compression", record.compression),
    ):
        record.detail(group, name, value)
    if h["important"]:
        record.detail("Colour", "important colours", h["important"])
    if h["data"]:
        record.detail("Compression", "picture size in header", h["data"])


def _masked(values: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(values.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return ((values.astype(np.uint64) & mask) >> np.uint64(shift)).astype(np.uint64) * np.uint64(255) // np.uint64(top)


def decode(reader: Reader, record: Record, limits: Limits) -> np.ndarray:
    h = _header(reader)
    if not h or h.get("bad") or h["short"]:
        raise Broken("no header")
    width, height, bits, code = h["width"], abs(h["height"]), h["bits"], h["compression"]
    limits.check(width, height, 3)
    if code not in (0, 1, 2, 3, 6) or (code == 1 and bits != 8) or (code == 2 and bits != 4) or bits not in (1, 2, 4, 8, 16, 24, 32):
        raise Limited(f"compression {code} of {bits} bits a pixel")
    n = reader.size - h["offset"]
    limits.compressed(n)
    data = reader.read(h["offset"], n)
    if code in (1, 2):
        pixels = rle_bmp(data, width, height, code == 2)
    else:
        stride = _stride(width, bits)
        if len(data) < stride * height:
            raise Broken("pixel data are cut off")
        rows = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)
        if bits <= 8:
            pixels = unpack_bits(rows, bits, width)
        elif bits == 24:
            pixels = rows[:, : 3 * width].reshape(height, width, 3)[:, :, ::-1]
        else:
            values = np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4")
            masks = h["masks"] or ([0x7C00, 0x3E0, 0x1F] if bits == 16 else [0xFF0000, 0xFF00, 0xFF])
            pixels = np.stack([_masked(values, m) for m in masks[:3]], axis=2).astype(np.uint8)
    if bits <= 8:
        raw = reader.read(h["palette_at"], h["colours"] * h["entry"])
        entries = np.zeros((256, 3), np.uint8)
        have = len(raw) // h["entry"]
        entries[:have] = np.frombuffer(raw, np.uint8, have * h["entry"]).reshape(have, h["entry"])[:, 2::-1]
        pixels = entries[np.where(pixels < max(have, 1), pixels, 0)]
    return pixels if h["height"] < 0 else pixels[::-1]

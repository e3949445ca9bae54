"""PCX: run lengths, bit planes, palettes in the header and behind the picture."""

from __future__ import annotations

import numpy as np

from rasterlake.functions import labels as L
from rasterlake.operators.codecs import rle_pcx, unpack_bits
from rasterlake.operators.reader import Broken, Cursor, Limited, Limits, Reader, Record


def _header(reader: Reader) -> dict | None:
    head = reader.read(0, 128)
    if len(head) < 128:
        return None
    c = Cursor(head)
    h = {"maker": c.u8(), "version": c.u8(), "encoding": c.u8(), "bits": c.u8(), "x0": c.u16(), "y0": c.u16(), "x1": c.u16(), "y1": c.u16(), "dpi_x": c.u16(), "dpi_y": c.u16(), "ega": c.take(48)}
    c.skip(1)
    h |= {"planes": c.u8(), "line": c.u16(), "info": c.u16(), "screen_x": c.u16(), "screen_y": c.u16()}
    h["width"], h["height"] = max(0, h["x1"] - h["x0"] + 1), max(0, h["y1"] - h["y0"] + 1)
    return h


def _tail_palette(reader: Reader) -> bytes | None:
    tail = reader.tail(769) if reader.size >= 128 + 769 else b""
    return tail[1:] if len(tail) == 769 and tail[0] == 0x0C else None


def parse(reader: Reader, record: Record) -> None:
    h = _header(reader)
    if h is None:
        return record.problem("PCX_SHORT", "CORRUPTED", "file is too short for a PCX header")
    planes, bits = h["planes"], h["bits"]
    record.width, record.height = h["width"], h["height"]
    record.bits_per_pixel, record.sample_depth, record.channels = bits * planes, bits, planes or 1
    record.color_model = "RGB" if planes == 3 else "RGBA" if planes == 4 and bits == 8 else f"palette of {1 << bits * planes} colours" if bits * planes <= 8 else ""
    record.compression, record.compression_code = "RLE" if h["encoding"] == 1 else "none", f"PCX encoding = {h['encoding']}"
    if h["dpi_x"] and h["dpi_y"]:
        record.dpi(h["dpi_x"], h["dpi_y"], "dots per inch")
    if h["x1"] < h["x0"] or h["y1"] < h["y0"]:
        record.problem("PCX_BOUNDS", "CORRUPTED", "bounds are swapped")
    if not 1 <= planes <= 4:
        record.problem("PCX_PLANES", "CORRUPTED", f"{planes} planes")
    if h["line"] < (record.width * bits + 7) // 8:
        record.problem("PCX_LINE", "CORRUPTED", f"{h['line']} bytes a line are too few")
    raw = h["line"] * planes * record.height
    if raw and h["encoding"] == 1 and reader.size < 128 + raw * 2 // 126:  # a pair of bytes gives 63 at most
        record.problem("PCX_TRUNCATED", "CORRUPTED", "file is too short for its picture")
    if bits == 8 and planes == 1:
        palette = _tail_palette(reader)
        if palette is None:
            record.detail("Colour", "256-colour palette", "missing")
        else:
            entries = [palette[i : i + 3] for i in range(0, 768, 3)]
            record.detail("Colour", "distinct palette colours", len(set(entries)))
            record.detail("Colour", "gray palette", all(e[0] == e[1] == e[2] for e in entries))
    record.measures["raw_bytes"] = raw
    for group, name, value in (
        ("Format", "version", f"{h['version']} — {L.PCX_VERSIONS.get(h['version'], 'unknown')}"), ("Format", "encoding", h["encoding"]), ("Geometry", "bounds", f"{h['x0']},{h['y0']} - {h['x1']},{h['y1']}"), ("Geometry", "width x height", f"{record.width} x {record.height}"),
        ("Depth", "bits per plane", bits), ("Depth", "planes", planes), ("Depth", "bits per pixel", record.bits_per_pixel), ("Resolution", "dots per inch", f"{h['dpi_x']} x {h['dpi_y']}"), ("Geometry", "screen", f"{h['screen_x']} x {h['screen_y']}"),
        ("Geometry", "bytes per line", h["line"]), ("Colour", "picture type", L.PCX_PICTURES.get(h["info"], f"code {h['info']}")), ("Compression", "raw bytes", raw),
    ):
        record.detail(group, name, value)
    if raw and reader.size > 128:
        record.detail("Compression", "ratio", f"{raw / (reader.size - 128):.2f}")


def decode(reader: Reader, record: Record, limits: Limits) -> np.ndarray:
    h = _header(reader)
    if not h:
        raise Broken("no header")
    width, height, planes, bits, line = h["width"], h["height"], h["planes"], h["bits"], h["line"]
    limits.check(width, height, 4)
    if planes not in (1, 3, 4) or bits not in (1, 2, 4, 8) or (planes > 1 and bits != 8 and not (planes == 4 and bits == 1)) and not (planes == 3 and bits == 1):
        raise Limited(f"{planes} planes of {bits} bits")
    if line * 8 < width * bits:
        raise Broken("too few bytes a line")
    limits.compressed(reader.size)
    data = reader.read(128, reader.size - 128)
    size = line * planes * height
    raw = rle_pcx(data, size) if h["encoding"] == 1 else data[:size]
    if len(raw) < size:
        raise Broken("pixel data are cut off")
    rows = np.frombuffer(raw, np.uint8).reshape(height * planes, line)
    samples = unpack_bits(rows, bits, width).reshape(height, planes, width).transpose(0, 2, 1)
    if bits == 8 and planes >= 3:
        return samples
    index = samples[:, :, 0].astype(np.int64)
    for p in range(1, planes):
        index |= samples[:, :, p].astype(np.int64) << p
    if bits == 8:
        palette = _tail_palette(reader)
        entries = np.frombuffer(palette, np.uint8).reshape(256, 3) if palette else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    elif bits == 1 and planes == 1:
        entries = np.array([[0, 0, 0], [255, 255, 255]], np.uint8)
    else:
        entries = np.frombuffer(h["ega"], np.uint8).reshape(16, 3)
    return entries[index]

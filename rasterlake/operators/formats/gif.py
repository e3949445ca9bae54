"""GIF: frames with their control blocks, LZW, interlace. Pixels are those of the first frame on the canvas."""

from __future__ import annotations

import re

import numpy as np

from rasterlake.operators.codecs import lzw_gif
from rasterlake.operators.reader import Broken, Cursor, Limits, Reader, Record, Window


def _blocks(data: bytes | Window, at: int, keep: bool = True) -> tuple[bytes | None, int, int]:
    """A chain of sub-blocks (None if it is cut off, empty if it need not be kept), the place behind it and its length."""
    out, total, end = [], 0, len(data)
    while at < end:
        n = data[at]
        if n == 0:
            return b"".join(out), at + 1, total
        if at + 1 + n > end:
            return None, end, total
        if keep:
            out.append(data[at + 1 : at + 1 + n])
        total += n
        at += 1 + n
    return None, end, total


def walk(data: bytes | Window, pixels: bool = False) -> dict:
    """All blocks of a file; the first frame's data only if pixels are wanted. Of a window, one block is held at a time."""
    c = Cursor(data[6:13])
    g = {"width": c.u16(), "height": c.u16(), "flags": c.u8(), "background": c.u8(), "aspect": c.u8(), "frames": [], "comment": "", "application": "", "loop": None, "trailer": False, "broken": False}
    table = 3 << ((g["flags"] & 7) + 1) if g["flags"] & 0x80 else 0
    g["palette"] = data[13 : 13 + table]
    g["table_cut"] = len(g["palette"]) < table
    at, control = 13 + table, {}
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            g["trailer"] = True
            break
        if kind == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at, _ = _blocks(data, at + 2)
            if body is None:
                g["broken"] = True
                break
            if label == 0xF9 and len(body) >= 4:
                control = {"disposal": body[0] >> 2 & 7, "transparent": body[3] if body[0] & 1 else None, "delay": body[1] | body[2] << 8}
            elif label == 0xFE and not g["comment"]:
                g["comment"] = re.sub(r"[^\x20-\x7e]", ".", body.decode("latin-1"))[:120]
            elif label == 0xFF:
                g["application"] = re.sub(r"[^\x20-\x7e]", ".", body[:11].decode("latin-1"))
                if body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14:
                    g["loop"] = body[12] | body[13] << 8
        elif kind == 0x2C:
            c = Cursor(data[at + 1 : at + 11 + 768])
            f = {"left": c.u16(), "top": c.u16(), "width": c.u16(), "height": c.u16(), "flags": c.u8()}
            local = 3 << ((f["flags"] & 7) + 1) if f["flags"] & 0x80 else 0
            f["palette"] = c.take(local)
            f["min_code"] = c.u8()
            if not c.ok:
                g["broken"] = True
                break
            first = not g["frames"]
            body, at, size = _blocks(data, at + 1 + c.at, pixels and first)
            f |= {"data": body if first else b"", "bytes": 0 if body is None else size, "interlaced": bool(f["flags"] & 0x40), "local": local // 3} | {"disposal": 0, "transparent": None, "delay": None} | control
            control = {}
            g["frames"].append(f)
            if body is None:
                g["broken"] = True
                break
        else:
            g["broken"] = True
            break
    return g


def parse(reader: Reader, record: Record) -> None:
    if reader.size < 13:
        return record.problem("GIF_SHORT", "CORRUPTED", "file is too short for a GIF header")
    data = Window(reader)
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return record.problem("GIF_HEADER", "CORRUPTED", "no GIF header")
    g = walk(data)
    first = g["frames"][0] if g["frames"] else None
    record.width, record.height = (first["width"], first["height"]) if first else (g["width"], g["height"])
    record.bits_per_pixel = record.sample_depth = first["min_code"] if first else 8
    record.channels = 1
    colours = (first["local"] if first and first["local"] else len(g["palette"]) // 3) or 2
    record.color_model = f"palette of {colours} colours"
    record.compression, record.compression_code = "LZW, animated" if len(g["frames"]) > 1 else "LZW", "GIF LZW"
    if g["table_cut"]:
        record.problem("GIF_PALETTE", "CORRUPTED", "global palette is cut off")
    if record.width <= 0 or record.height <= 0:
        record.problem("GIF_GEOMETRY", "CORRUPTED", f"geometry {record.width} x {record.height}")
    if not g["trailer"] and reader.tail(1) != b";":
        record.problem("GIF_TRAILER", "CORRUPTED", "no trailer")
    elif g["broken"]:
        record.problem("GIF_STRUCTURE", "WARNING", "blocks are out of order")
    if not first:
        record.problem("GIF_NO_FRAME", "CORRUPTED", "no frame")
    elif not 2 <= first["min_code"] <= 11:
        record.problem("GIF_LZW", "CORRUPTED", f"LZW code size {first['min_code']}")
    if first and (first["left"] + first["width"] > g["width"] or first["top"] + first["height"] > g["height"]):
        record.problem("GIF_FRAME", "WARNING", "frame goes beyond the canvas")
    delays = [f["delay"] for f in g["frames"] if f["delay"] is not None]
    record.frames = [{k: f[k] for k in ("left", "top", "width", "height", "interlaced", "local", "delay", "disposal", "bytes")} for f in g["frames"]]
    size = sum(f["bytes"] for f in g["frames"])
    record.measures |= {"frames": len(g["frames"]), "lzw_bytes": size, "delay": sum(delays), "local_palettes": sum(f["local"] > 0 for f in g["frames"])}
    for group, name, value in (
        ("Format", "version", data[:6].decode()), ("Geometry", "canvas", f"{g['width']} x {g['height']}"), ("Geometry", "width x height", f"{record.width} x {record.height}"), ("Depth", "bits per pixel", record.bits_per_pixel),
        ("Depth", "colour resolution", (g["flags"] >> 4 & 7) + 1), ("Colour", "global palette", len(g["palette"]) // 3), ("Colour", "local palettes", sum(f["local"] > 0 for f in g["frames"])), ("Compression", "LZW bytes", size), ("Extra", "frames", len(g["frames"])),
    ):
        record.detail(group, name, value)
    if first and first["transparent"] is not None:
        record.detail("Colour", "transparent index", first["transparent"])
    if size:
        record.detail("Compression", "ratio", f"{sum(f['width'] * f['height'] for f in g['frames']) / size:.2f}")
    if len(g["frames"]) > 1:
        record.detail("Extra", "delay", f"{sum(delays)} in all, {min(delays, default=0)} to {max(delays, default=0)}")
        record.detail("Extra", "interlaced frames", sum(f["interlaced"] for f in g["frames"]))
        record.detail("Extra", "loops", "none" if g["loop"] is None else g["loop"] or "endless")
    for name in ("application", "comment"):
        if g[name]:
            record.detail("Extra", name, g[name])


def decode(reader: Reader, record: Record, limits: Limits) -> np.ndarray:
    limits.compressed(reader.size)
    g = walk(Window(reader), pixels=True)
    if not g["frames"] or g["frames"][0]["data"] is None:
        raise Broken("no whole frame")
    f = g["frames"][0]
    limits.check(g["width"], g["height"], 4)
    limits.check(f["width"], f["height"], 1)
    n = f["width"] * f["height"]
    raw = lzw_gif(f["data"], f["min_code"], n)
    if len(raw) < n:
        raise Broken("pixel data are cut off")
    index = np.frombuffer(raw, np.uint8).reshape(f["height"], f["width"])
    if f["interlaced"]:
        order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, f["height"], step)]
        rows = np.empty_like(index)
        rows[order] = index
        index = rows
    colours = f["palette"] or g["palette"]
    entries = np.zeros((256, 3), np.uint8)
    entries[: len(colours) // 3] = np.frombuffer(colours, np.uint8).reshape(-1, 3)
    canvas = np.zeros((g["height"], g["width"], 3), np.uint8)
    part = canvas[f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
    part[:] = entries[index[: part.shape[0], : part.shape[1]]]
    return canvas

"""TIFF and BigTIFF: chains of directories, typed tags, strips in four compressions, palettes, 16 bits, predictor."""

from __future__ import annotations

import struct

import numpy as np

from rasterlake.functions import labels as L
from rasterlake.operators.codecs import inflate, lzw_tiff, packbits, unpack_bits
from rasterlake.operators.reader import Broken, Limited, Limits, Reader, Record

#: Pages that are read, tags that a page may have, characters of a text that are shown.
MAX_PAGES, MAX_TAGS, MAX_TEXT = 64, 4096, 160
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class Directory(dict):
    """tag: values, of one page."""

    def one(self, tag: int, default=None):
        values = self.get(tag)
        return values[0] if values else default


def _values(order: str, kind: int, count: int, data: bytes) -> list:
    if kind == 2:
        return [data.split(b"\0")[0].decode("latin-1")[:MAX_TEXT]]
    if kind == 7:
        return [data[:MAX_TEXT].hex()]
    if kind in (5, 10):
        pair = "I" if kind == 5 else "i"
        n = len(data) // 8
        raw = struct.unpack(f"{order}{2 * n}{pair}", data[: 8 * n])
        return [a / b if b else 0.0 for a, b in zip(raw[::2], raw[1::2], strict=True)]
    form = _FORMATS.get(kind)
    if not form:
        return []
    n = len(data) // struct.calcsize(order + form)
    return list(struct.unpack(f"{order}{n}{form}", data[: n * struct.calcsize(order + form)]))


def directories(reader: Reader, record: Record | None = None) -> tuple[str, int, list[Directory]]:
    """Byte order, magic number and pages. Problems go to record if there is one."""

    def problem(code: str, severity: str, message: str) -> None:
        if record is not None:
            record.problem(code, severity, message)

    head = reader.read(0, 16)
    if len(head) < 8:
        problem("TIFF_SHORT", "CORRUPTED", "file is too short for a TIFF header")
        return "<", 0, []
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order:
        problem("TIFF_ORDER", "CORRUPTED", "no byte order mark")
        return "<", 0, []
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43) or (magic == 43 and len(head) < 16):
        problem("TIFF_MAGIC", "CORRUPTED", f"magic number {magic}")
        return order, magic, []
    big = magic == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    counter, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    size = struct.calcsize(order + counter)
    pages: list[Directory] = []
    seen: set[int] = set()
    while at and len(pages) < MAX_PAGES:
        if at in seen:
            problem("TIFF_CYCLE", "WARNING", "directories form a cycle")
            break
        seen.add(at)
        raw = reader.read(at, size)
        if len(raw) < size:
            problem("TIFF_IFD" if not pages else "TIFF_NEXT_IFD", "CORRUPTED", "a directory lies beyond the end")
            break
        n = struct.unpack(order + counter, raw)[0]
        if n > MAX_TAGS:
            problem("TIFF_TAGS", "CORRUPTED", f"{n} tags in a directory")
            break
        body = reader.read(at + size, n * entry + inline)
        if len(body) < n * entry:
            problem("TIFF_IFD_CUT", "CORRUPTED", "a directory is cut off")
            break
        page = Directory()
        for i in range(n):
            e = body[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 4 + inline])[0]
            each = L.TIFF_TYPES.get(kind, ("", 0))[1]
            value, total, valid = e[-inline:], each * count, True
            if each * count > inline:
                where = struct.unpack(order + ("Q" if big else "I"), value)[0]
                valid = where + each * count <= reader.size
                value = reader.read(where, min(total, 65_536) if kind in (2, 7) else total) if valid else b""
                if not valid:
                    problem("TIFF_TAG_DATA", "WARNING", f"data of tag {tag} lie beyond the end")
            page[tag] = _values(order, kind, count, value[:total]) if valid else []
            if record is not None and not pages:
                values = page[tag]
                record.tags.append({"tag": tag, "type": kind, "count": count, "ints": [v for v in values if isinstance(v, int) and -(2**63) <= v < 2**63][:8], "reals": [float(v) for v in values if isinstance(v, float)][:6], "ascii": values[0] if values and isinstance(values[0], str) else None, "offset_valid": valid})
        pages.append(page)
        at = struct.unpack(order + ("Q" if big else "I"), body[n * entry : n * entry + inline])[0] if len(body) >= n * entry + inline else 0
        if len(body) < n * entry + inline:
            problem("TIFF_CHAIN", "WARNING", "chain of directories is broken")
    return order, magic, pages


def parse(reader: Reader, record: Record) -> None:
    order, magic, pages = directories(reader, record)
    if not pages:
        if record.check == "OK":
            record.problem("TIFF_EMPTY", "CORRUPTED", "no directory")
        return
    page = pages[0]
    bits = page.get(258) or []
    record.width, record.height = (int(page.one(t, 0) or 0) if isinstance(page.one(t, 0), int) else 0 for t in (256, 257))
    record.channels = max(1, page.one(277, len(bits) or 1))
    record.sample_depth = bits[0] if bits else 1
    record.bits_per_pixel = sum(bits) if len(bits) > 1 else record.sample_depth * record.channels
    photometric, compression = page.one(262), page.one(259, 0)
    record.color_model = L.TIFF_PHOTOMETRICS.get(photometric, "unknown") + (" + alpha" if page.one(338, 0) else "")
    record.compression, record.compression_code = L.TIFF_COMPRESSIONS.get(compression, "unknown"), f"TIFF Compression = {compression}"
    x, y, unit = page.one(282, 0), page.one(283, 0), page.one(296, 2)
    if x and y and unit in (2, 3):
        factor = 2.54 if unit == 3 else 1.0
        record.dpi(x * factor, y * factor, L.TIFF_UNITS[unit])
    else:
        record.resolution_unit = L.TIFF_UNITS.get(unit, "") if 296 in page else ""
    if not page:
        record.problem("TIFF_EMPTY", "CORRUPTED", "empty directory")
    elif record.width <= 0 or record.height <= 0:
        record.problem("TIFF_GEOMETRY", "CORRUPTED", "width or height is missing")
    if 259 not in page:
        record.problem("TIFF_COMPRESSION", "WARNING", "no Compression tag")
    offsets, counts = page.get(273) or page.get(324) or [], page.get(279) or page.get(325) or []
    if not offsets:
        record.problem("TIFF_STRIPS", "WARNING", "no strips")
    elif any(o + n > reader.size for o, n in zip(offsets, counts, strict=False)):
        record.problem("TIFF_STRIP", "CORRUPTED", "a strip goes beyond the end")
    size = sum(n for n in counts if isinstance(n, int))
    record.measures |= {"pages": len(pages), "tags": len(page), "strips": len(offsets), "strip_bytes": size}
    for group, name, value in (
        ("Format", "byte order", "little" if order == "<" else "big"), ("Format", "magic", magic), ("Format", "pages", len(pages)), ("Format", "tags", len(page)), ("Geometry", "width x height", f"{record.width} x {record.height}"), ("Depth", "bits per sample", ",".join(map(str, bits[:8]))),
        ("Depth", "bits per pixel", record.bits_per_pixel), ("Depth", "samples", record.channels), ("Colour", "photometric", record.color_model), ("Resolution", "resolution", f"{x:g} x {y:g}, unit {unit}"), ("Compression", "strips", len(offsets)), ("Compression", "strip bytes", size),
        ("Extra", "tag list", ", ".join(L.TIFF_TAGS.get(t, str(t)) for t in list(page)[:14])),
    ):
        record.detail(group, name, value)
    if 320 in page:
        record.detail("Colour", "palette entries", len(page[320]) // 3)
    if page.one(274):
        record.detail("Extra", "orientation", L.ORIENTATIONS.get(page.one(274), "unknown"))
    if size:
        record.detail("Compression", "ratio", f"{record.width * record.height * record.bits_per_pixel / 8 / size:.2f}")
    bad = sum(not t["offset_valid"] for t in record.tags)
    if bad:
        record.detail("Check", "tags with bad offsets", bad)


def decode(reader: Reader, record: Record, limits: Limits) -> np.ndarray:
    order, _, pages = directories(reader)
    if not pages:
        raise Broken("no directory")
    page = pages[0]
    width, height = page.one(256, 0), page.one(257, 0)
    bits, samples = page.one(258, 1), page.one(277, 1)
    compression, photometric = page.one(259, 1), page.one(262, 1)
    if 322 in page or page.one(284, 1) != 1 and samples > 1:
        raise Limited("tiles or planes")
    if bits not in (1, 2, 4, 8, 16) or photometric not in (0, 1, 2, 3, 5) or compression not in (1, 5, 8, 32773, 32946):
        raise Limited(f"{bits} bits, photometric {photometric}, compression {compression}")
    limits.check(width, height, samples * (2 if bits == 16 else 1))
    offsets, counts = page.get(273) or [], page.get(279) or []
    if not offsets:
        raise Broken("no strips")
    if not counts:
        counts = [reader.size - offsets[0]] if len(offsets) == 1 else []
    limits.compressed(sum(counts))
    per, stride = min(page.one(278, height) or height, height), -(-width * samples * bits // 8)
    rows = []
    for k, (o, n) in enumerate(zip(offsets, counts, strict=False)):
        want = stride * min(per, height - k * per)
        if want <= 0:
            break
        data = reader.read(o, n)
        if len(data) < n:
            raise Broken("a strip is cut off")
        if page.one(266, 1) == 2:
            data = np.packbits(np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, 8)[:, ::-1]).tobytes()
        raw = data if compression == 1 else lzw_tiff(data, want) if compression == 5 else packbits(data, want) if compression == 32773 else inflate(data, want + 65_536)
        if len(raw) < want:
            raise Broken("a strip is too short")
        rows.append(np.frombuffer(raw, np.uint8, want).reshape(-1, stride))
    picture = np.concatenate(rows) if rows else np.empty((0, stride), np.uint8)
    if len(picture) < height:
        raise Broken("strips are missing")
    if bits == 16:
        full = np.ascontiguousarray(picture[:, : width * samples * 2]).view(order + "u2").reshape(height, width, samples).astype(np.uint16)
    else:
        full = unpack_bits(picture, bits, width * samples).reshape(height, width, samples)
    if page.one(317, 1) == 2 and bits >= 8:
        full = np.cumsum(full, axis=1, dtype=full.dtype)
    if photometric == 3:
        table = np.array(page.get(320) or [], np.int64)
        n = len(table) // 3
        if not n:
            raise Broken("no palette")
        colours = (table[: 3 * n].reshape(3, n).T >> 8).astype(np.uint8)
        return colours[np.minimum(full[:, :, 0], n - 1)]
    eight = (full >> 8).astype(np.uint8) if bits == 16 else (full.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if photometric == 0:
        eight = 255 - eight
    if photometric in (0, 1):
        gray = np.repeat(eight[:, :, :1], 3, axis=2)
        return np.dstack([gray, eight[:, :, 1]]) if samples > 1 and page.one(338, 0) else gray
    if photometric == 5:
        if samples < 4:
            raise Broken("CMYK of too few samples")
        ink = 255 - eight[:, :, :4].astype(np.uint16)
        return (ink[:, :, :3] * ink[:, :, 3:] // 255).astype(np.uint8)
    if samples < 3:
        raise Broken("RGB of too few samples")
    return eight[:, :, :4] if samples >= 4 and page.one(338, 0) else eight[:, :, :3]

"""JPEG: segments; baseline and extended sequential Huffman pictures of 8 bits with one or three components."""

from __future__ import annotations

import struct

import numpy as np

from rasterlake.functions import labels as L
from rasterlake.operators.reader import Broken, Cursor, Limited, Limits, Reader, Record, Window

FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: How many stray bytes between segments are put up with.
STRAY = 4096
#: Segments whose payload the header needs.
READ = frozenset((0xC4, 0xDA, 0xDB, 0xDD, 0xE0, 0xE1, 0xE2, 0xEE, 0xFE)) | FRAMES


def _zigzag() -> np.ndarray:
    """Raster position of each coefficient in coded order: along diagonals, turning at the edges."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: The inverse DCT of eight coefficients as a matrix.
IDCT = np.cos((2 * _K[:, None] + 1) * _K * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)


def segments(data: bytes | Window):
    """(marker, offset of the payload, payload length) up to and with the first scan; a length below 2 or a cut gives length -1."""
    at, n = 2, len(data)
    while at + 1 < n:
        start = at
        while at < n and data[at] != 0xFF:
            at += 1
            if at - start > STRAY:
                return
        while at < n and data[at] == 0xFF:
            at += 1
        if at >= n:
            return
        marker = data[at]
        at += 1
        if marker == 0xD9:
            yield marker, at, 0
            return
        if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > n:
            yield marker, at, -1
            return
        length = data[at] << 8 | data[at + 1]
        if length < 2 or at + length > n:
            yield marker, at, -1 if length >= 2 else -2
            return
        yield marker, at + 2, length - 2
        at += length
        if marker == 0xDA:
            return


def _orientation(exif: bytes) -> int | None:
    little = exif[:2] == b"II"
    if not little and exif[:2] != b"MM":
        return None
    c = Cursor(exif, little, 4)
    c.seek(c.u32())
    for _ in range(c.u16()):
        tag, kind, _count = c.u16(), c.u16(), c.u32()
        value = c.take(4)
        if tag == 0x0112 and kind == 3:
            return struct.unpack(("<" if little else ">") + "H", value[:2])[0] if len(value) == 4 else None
    return None


def _sampling(factors: list[tuple[int, int]]) -> str:
    if len(factors) == 3 and factors[1] == factors[2] == (1, 1):
        known = {(2, 2): "4:2:0", (2, 1): "4:2:2", (1, 1): "4:4:4"}.get(factors[0])
        if known:
            return known
    return ", ".join(f"{h}x{v}" for h, v in factors)


def parse(reader: Reader, record: Record) -> None:
    data = Window(reader)
    if data[:2] != b"\xff\xd8":
        return record.problem("JPEG_SOI", "CORRUPTED", "no SOI")
    frame = None
    scan, tables, huffman, quantum, restart = False, 0, 0, None, 0
    names: list[str] = []
    for marker, at, length in segments(data):
        names.append(f"{marker:02X}")
        if length == -2:
            record.problem("JPEG_SEGMENT", "WARNING", f"segment {marker:02X} of no length")
            break
        if length < 0:
            record.problem("JPEG_SEGMENT_CUT", "CORRUPTED", f"segment {marker:02X} is cut off")
            break
        body = data[at : at + length] if marker in READ else b""
        if marker == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            unit, x, y = struct.unpack(">BHH", body[7:12])
            if unit in (1, 2) and x and y:
                factor = 2.54 if unit == 2 else 1.0
                record.dpi(x * factor, y * factor, "dots per inch" if unit == 1 else "dots per centimetre")
            else:
                record.resolution_unit = "aspect ratio only"
            record.detail("Resolution", "JFIF density", f"{x} x {y}, unit {unit}")
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            o = _orientation(body[6:])
            record.detail("Extra", "EXIF orientation", L.ORIENTATIONS.get(o, "unknown") if o else "not given")
        elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            record.detail("Colour", "ICC profile bytes", length - 14)
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            record.detail("Colour", "Adobe transform", body[11])
        elif marker == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                if p + 1 + 64 * (1 + wide) <= len(body) and quantum is None:
                    values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1)
                    quantum = np.empty(64, int)
                    quantum[ZIGZAG] = values
                tables += 1
                p += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            p = 0
            while p + 17 <= len(body):
                huffman += 1
                p += 17 + sum(body[p + 1 : p + 17])
        elif marker == 0xDD and length >= 2:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            record.detail("Extra", "comment", body[:120].decode("latin-1"))
        elif marker == 0xDA:
            scan = True
            record.detail("Compression", "components in scan", body[0] if body else 0)
        elif marker in FRAMES and frame is None and length >= 6:
            frame = (marker, *struct.unpack(">BHHB", body[:6]), [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(min(body[5], (len(body) - 6) // 3))])
    if frame is None:
        record.problem("JPEG_NO_FRAME", "CORRUPTED", "no frame header")
    else:
        marker, precision, height, width, count, factors = frame
        record.width, record.height, record.sample_depth, record.channels, record.bits_per_pixel = width, height, precision, count, precision * count
        record.color_model = {1: "grayscale", 3: "YCbCr", 4: "CMYK / YCCK"}.get(count, "")
        record.compression, record.compression_code = L.SOF_NAMES.get(marker, "unknown"), f"SOF{marker - 0xC0:X}"
        if not width or not height:
            record.problem("JPEG_GEOMETRY", "CORRUPTED", f"geometry {width} x {height}")
        if count > 4:
            record.problem("JPEG_COMPONENTS", "WARNING", f"{count} components")
        if precision not in (8, 12, 16):
            record.problem("JPEG_PRECISION", "WARNING", f"{precision} bits a sample")
        record.detail("Geometry", "width x height", f"{width} x {height}")
        record.detail("Depth", "precision", precision)
        record.detail("Colour", "subsampling", _sampling(factors))
    if not scan:
        record.problem("JPEG_NO_SCAN", "CORRUPTED", "no scan")
    if b"\xff\xd9" not in reader.tail(32):
        record.problem("JPEG_NO_EOI", "CORRUPTED", "no EOI at the end")
    if reader.size < 100:
        record.problem("JPEG_SHORT", "WARNING", "file is under 100 bytes")
    record.measures |= {"segments": len(names), "quantisation_tables": tables, "huffman_tables": huffman}
    record.detail("Format", "segments", " ".join(names[:40]))
    record.detail("Compression", "quantisation tables", tables)
    record.detail("Compression", "Huffman tables", huffman)
    if quantum is not None:
        record.detail("Compression", "first quantisation table", " ".join(map(str, quantum)))
    if restart:
        record.detail("Compression", "restart interval", restart)


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code times 256 plus its symbol, 0 if there is none."""
    table = np.zeros(65536, np.int32)
    code = k = 0
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            start = code << 16 - length
            if 16 + k >= len(body) or start >= 65536:
                raise Broken("Huffman table")
            table[start : start + (1 << 16 - length)] = length << 8 | body[16 + k]
            code += 1
            k += 1
        code <<= 1
    return table


class _Bits:
    """Bits of a scan between two restart markers, byte stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def peek16(self) -> int:
        while self.n < 16:
            part = self.data[self.at : self.at + 6]
            if part:
                self.acc = self.acc << 8 * len(part) | int.from_bytes(part, "big")
                self.n += 8 * len(part)
                self.at += len(part)
            else:
                if self.at > len(self.data) + 8:
                    raise EOFError
                self.acc <<= 16
                self.n += 16
                self.at += 2
        return self.acc >> self.n - 16 & 0xFFFF

    def drop(self, k: int) -> None:
        self.n -= k
        self.acc &= (1 << self.n) - 1

    def symbol(self, table: list[int]) -> int:
        v = table[self.peek16()]
        if not v:
            raise Broken("Huffman code")
        self.drop(v >> 8)
        return v & 255

    def signed(self, k: int) -> int:
        if not k:
            return 0
        v = self.peek16() >> 16 - k
        self.drop(k)
        return v if v >> k - 1 else v - (1 << k) + 1


def _upsample(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples, each three parts its nearest and one part the next."""
    x = np.moveaxis(plane, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.empty((2 * len(x), *x.shape[1:]))
    out[0::2], out[1::2] = (3 * x + before) / 4, (3 * x + after) / 4
    return np.moveaxis(out, 0, axis)


def decode(reader: Reader, record: Record, limits: Limits) -> np.ndarray:
    limits.compressed(reader.size)
    data = reader.all(reader.size)
    quanta, dc, ac, restart, frame, scan = {}, {}, {}, 0, None, None
    for marker, at, length in segments(data):
        if length < 0:
            raise Broken("a segment is cut off")
        body = data[at : at + length]
        if marker == 0xDB:
            p = 0
            while p < len(body):
                wide, slot = body[p] >> 4, body[p] & 15
                if p + 1 + 64 * (1 + wide) > len(body):
                    raise Broken("quantisation table")
                quanta[slot] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(np.float64)
                p += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            p = 0
            while p + 17 <= len(body):
                n = sum(body[p + 1 : p + 17])
                (ac if body[p] >> 4 else dc)[body[p] & 15] = _lookup(body[p + 1 : p + 17 + n]).tolist()
                p += 17 + n
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker in FRAMES:
            frame = (marker, *struct.unpack(">BHHB", body[:6]), [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])])
        elif marker == 0xDA:
            scan = (at + length, [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])])
    if frame is None or scan is None:
        raise Broken("no frame or scan")
    marker, precision, height, width, count, components = frame
    if marker not in (0xC0, 0xC1) or precision != 8 or count not in (1, 3) or len(scan[1]) != count:
        raise Limited(f"SOF{marker - 0xC0}, {precision} bits, {count} components")
    limits.check(width, height, 3)
    if count == 1:
        components = [(components[0][0], 0x11, components[0][2])]
    sampling = [(c[1] >> 4, c[1] & 15) for c in components]
    if any(s not in ((1, 1), (1, 2), (2, 1), (2, 2)) for s in sampling):
        raise Limited("sampling factors")
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    blocks = [np.zeros((down * v, across * h, 64)) for h, v in sampling]
    tables = {c: (d, a) for c, d, a in scan[1]}
    units = []
    for i, c in enumerate(components):
        d, a = tables.get(c[0], (None, None))
        if d not in dc or a not in ac or c[2] not in quanta:
            raise Broken("a table is missing")
        units.append((i, *sampling[i], dc[d], ac[a]))
    parts = _scan_parts(data, scan[0])
    total, cut = across * down, False
    step = restart or total
    for k in range(0, total, step):
        if k // step >= len(parts):
            cut = True
            break
        bits, last = _Bits(parts[k // step]), [0] * count
        try:
            for mcu in range(k, min(k + step, total)):
                my, mx = divmod(mcu, across)
                for i, h, v, dct, act in units:
                    for by in range(v):
                        for bx in range(h):
                            block = blocks[i][my * v + by, mx * h + bx]
                            last[i] += bits.signed(bits.symbol(dct))
                            block[0] = last[i]
                            at = 1
                            while at < 64:
                                s = bits.symbol(act)
                                run, size = s >> 4, s & 15
                                if not size:
                                    if run != 15:
                                        break
                                    at += 16
                                    continue
                                at += run
                                if at > 63:
                                    raise Broken("coefficient beyond the block")
                                block[at] = bits.signed(size)
                                at += 1
        except EOFError:
            cut = True
            break
    planes = []
    for i, c in enumerate(components):
        raster = np.zeros_like(blocks[i])
        raster[:, :, ZIGZAG] = blocks[i] * quanta[c[2]]
        square = raster.reshape(*raster.shape[:2], 8, 8)
        pixels = np.einsum("xu,abuv,yv->abxy", IDCT, square, IDCT, optimize=True) + 128
        plane = pixels.transpose(0, 2, 1, 3).reshape(pixels.shape[0] * 8, pixels.shape[1] * 8)
        h, v = sampling[i]
        plane = plane[: -(-height * v // vmax), : -(-width * h // hmax)]
        if v < vmax:
            plane = _upsample(plane, 0)
        if h < hmax:
            plane = _upsample(plane, 1)
        planes.append(np.clip(plane[:height, :width], 0, 255))
    if cut:
        record.detail("Check", "decoding", "entropy data end early; the rest is gray")
    if count == 1:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _scan_parts(data: bytes, start: int) -> list[bytes]:
    """The scan's bytes between restart markers, without stuffed zeros."""
    parts, begin, at = [], start, start
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            parts.append(data[begin:])
            break
        following = data[at + 1]
        if following == 0 or following == 0xFF:
            at += 2 if following == 0 else 1
        elif 0xD0 <= following <= 0xD7:
            parts.append(data[begin:at])
            begin = at = at + 2
        else:
            parts.append(data[begin:at])
            break
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]

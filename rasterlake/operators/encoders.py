"""Encoders of small pictures, for tests and for the queries that bring tables into picture form. pixels: (height, width, 3) uint8."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rasterlake.operators.formats.jpeg import IDCT, ZIGZAG


def bmp24(pixels: np.ndarray, ppm: int = 0) -> bytes:
    h, w, _ = pixels.shape
    stride = (w * 24 + 31) // 32 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    size = 54 + stride * h
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", size, 0, 54, 40, w, h, 1, 24, 0, stride * h, ppm, ppm, 0, 0) + rows.tobytes()


def bmp_rle8(index: np.ndarray, palette: np.ndarray) -> bytes:
    """index: (height, width); palette: up to 256 x 3."""
    h, w = index.shape
    body = bytearray()
    for row in index[::-1]:
        x = 0
        while x < w:
            n = 1
            while x + n < w and n < 255 and row[x + n] == row[x]:
                n += 1
            body += bytes([n, row[x]])
            x += n
        body += b"\0\0"
    body += b"\0\1"
    table = np.zeros((256, 4), np.uint8)
    table[: len(palette), 2::-1] = palette
    offset = 54 + 1024
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", offset + len(body), 0, offset, 40, w, h, 1, 8, 1, len(body), 0, 0, 256, 0) + table.tobytes() + bytes(body)


def bmp_rle4(index: np.ndarray, palette: np.ndarray) -> bytes:
    """index: (height, width) below 16; palette: 16 x 3. Runs of three or more are runs, of index 0 within a row jumps, the rest literals."""
    h, w = index.shape
    body = bytearray()

    def literal(values: list[int]) -> None:
        if len(values) < 3:  # a literal has three values at least
            for v in values:
                body.extend((1, v << 4))
            return
        body.extend((0, len(values)))
        packed = bytes(a << 4 | b for a, b in zip(values[::2], [*values[1::2], 0], strict=False))
        body.extend(packed + b"\0" * (len(packed) % 2))

    for row in index[::-1].tolist():
        x, waiting = 0, []
        while x < w:
            n = 1
            while x + n < w and n < 255 and row[x + n] == row[x]:
                n += 1
            if n < 3 and len(waiting) + n <= 255:
                waiting += row[x : x + n]
            else:
                literal(waiting)
                waiting = []
                body.extend((0, 2, n, 0) if row[x] == 0 and x + n < w else (n, row[x] * 17))
            x += n
        literal(waiting)
        body.extend(b"\0\0")
    body += b"\0\1"
    table = np.zeros((16, 4), np.uint8)
    table[: len(palette), 2::-1] = palette
    offset = 54 + 64
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", offset + len(body), 0, offset, 40, w, h, 1, 4, 2, len(body), 0, 0, 16, 0) + table.tobytes() + bytes(body)


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples: np.ndarray, colour: int, depth: int = 8, filters: int = 0, adam7: bool = False, extra: list[tuple[bytes, bytes]] | None = None) -> bytes:
    """samples: (height, width, channels) at full depth. filters: the filter type of all rows."""
    from rasterlake.operators.formats.png import ADAM7, SIGNATURE

    h, w, c = samples.shape
    raw = bytearray()
    step = max(1, c * depth // 8)
    for x, y, dx, dy in ADAM7 if adam7 else ((0, 0, 1, 1),):
        part = samples[y::dy, x::dx]
        if not part.size:
            continue
        if depth == 16:
            rows = part.astype(">u2").reshape(len(part), -1).view(np.uint8)
        elif depth == 8:
            rows = part.astype(np.uint8).reshape(len(part), -1)
        else:
            bits = (part.reshape(len(part), -1)[:, :, None] >> np.arange(depth - 1, -1, -1) & 1).astype(np.uint8)
            rows = np.packbits(bits.reshape(len(part), -1), axis=1)
        above = np.zeros(rows.shape[1], np.int16)
        for row in rows.astype(np.int16):
            left = np.concatenate([np.zeros(step, np.int16), row])[: len(row)]
            corner = np.concatenate([np.zeros(step, np.int16), above])[: len(row)]
            p = left + above - corner
            pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
            guess = (0, left, above, (left + above) // 2, paeth)[filters]
            raw.append(filters)
            raw += ((row - guess) & 255).astype(np.uint8).tobytes()
            above = row
    body = png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(adam7)))
    for kind, data in extra or []:
        body += png_chunk(kind, data)
    return SIGNATURE + body + png_chunk(b"IDAT", zlib.compress(bytes(raw), 6)) + png_chunk(b"IEND", b"")


def pcx24(pixels: np.ndarray, dpi: int = 72) -> bytes:
    h, w, _ = pixels.shape
    line = w + w % 2
    head = struct.pack("<BBBBHHHHHH48sBBHHHH54s", 10, 5, 1, 8, 0, 0, w - 1, h - 1, dpi, dpi, b"", 0, 3, line, 1, 0, 0, b"")
    rows = np.zeros((h, 3, line), np.uint8)
    rows[:, :, :w] = pixels.transpose(0, 2, 1)
    out = bytearray()
    for row in rows.reshape(-1, line):
        x = 0
        while x < line:
            n = 1
            while x + n < line and n < 63 and row[x + n] == row[x]:
                n += 1
            if n > 1 or row[x] >= 0xC0:
                out += bytes([0xC0 | n, row[x]])
            else:
                out.append(row[x])
            x += n
    return head + bytes(out)


def _bits(codes: list[tuple[int, int]], msb: bool) -> bytes:
    acc = n = 0
    out = bytearray()
    for code, width in codes:
        if msb:
            acc, n = acc << width | code, n + width
            while n >= 8:
                out.append(acc >> n - 8 & 255)
                n -= 8
                acc &= (1 << n) - 1
        else:
            acc, n = acc | code << n, n + width
            while n >= 8:
                out.append(acc & 255)
                acc, n = acc >> 8, n - 8
    if n:
        out.append(acc << 8 - n & 255 if msb else acc & 255)
    return bytes(out)


def lzw(data: bytes, min_code: int, early: bool) -> bytes:
    """GIF's LZW, or TIFF's with early: high bits first and codes that grow one entry sooner."""
    clear, end = 1 << min_code, (1 << min_code) + 1
    table, width = {bytes([i]): i for i in range(clear)}, min_code + 1
    codes, prefix, following = [(clear, width)], b"", end + 1
    for b in data:
        longer = prefix + bytes([b])
        if longer in table:
            prefix = longer
            continue
        codes.append((table[prefix], width))
        if following < (4094 if early else 4096):
            table[longer] = following
            following += 1
            if following > (1 << width) - early and width < 12:
                width += 1
        else:
            codes.append((clear, width))
            table, width, following = {bytes([i]): i for i in range(clear)}, min_code + 1, end + 1
        prefix = bytes([b])
    if prefix:
        codes.append((table[prefix], width))
        if following < 4096 and following + 1 > (1 << width) - early and width < 12:
            width += 1
    codes.append((end, width))
    return _bits(codes, early)


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def gif(frames: list[np.ndarray], palette: np.ndarray, delays: list[int] | None = None, interlaced: bool = False, loop: int | None = None) -> bytes:
    """frames: (height, width) indexes below 256; all of one size."""
    h, w = frames[0].shape
    table = np.zeros((256, 3), np.uint8)
    table[: len(palette)] = palette
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + table.tobytes()
    if loop is not None:
        out += b"\x21\xff\x0bNETSCAPE2.0" + _sub_blocks(b"\x01" + struct.pack("<H", loop))
    for i, frame in enumerate(frames):
        if delays:
            out += b"\x21\xf9\x04" + struct.pack("<BHB", 0, delays[i], 0) + b"\0"
        if interlaced:
            frame = frame[[y for s, t in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(s, h, t)]]
        out += b"," + struct.pack("<HHHHB", 0, 0, w, h, 0x40 if interlaced else 0) + b"\x08" + _sub_blocks(lzw(frame.astype(np.uint8).tobytes(), 8, False))
    return out + b";"


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            while at + n < len(data) and n < 128 and data[at + n] != data[at + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out)


def tiff(samples: np.ndarray, photometric: int = 2, compression: int = 1, bits: int = 8, little: bool = True, big: bool = False, predictor: bool = False, dpi: int | None = None, extra: int | None = None, colour_map: np.ndarray | None = None) -> bytes:
    """One strip; samples: (height, width, channels)."""
    order = "<" if little else ">"
    h, w, c = samples.shape
    values = samples.astype(np.uint16 if bits == 16 else np.uint8)
    if predictor:
        values = np.concatenate([values[:, :1], values[:, 1:] - values[:, :-1]], axis=1)
    raw = values.astype(order + "u2").tobytes() if bits == 16 else values.tobytes()
    data = {1: lambda: raw, 5: lambda: lzw(raw, 8, True), 8: lambda: zlib.compress(raw), 32946: lambda: zlib.compress(raw), 32773: lambda: pack_bits(raw)}[compression]()
    tags: dict[int, tuple[int, list]] = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * c), 259: (3, [compression]), 262: (3, [photometric]), 273: (4, [0]), 277: (3, [c]), 278: (4, [h]), 279: (4, [len(data)])}
    if predictor:
        tags[317] = (3, [2])
    if extra is not None:
        tags[338] = (3, [extra])
    if dpi:
        tags |= {282: (5, [dpi, 1]), 283: (5, [dpi, 1]), 296: (3, [2])}
    if colour_map is not None:
        tags[320] = (3, [int(v) * 257 for v in colour_map.T.ravel()])
    size, inline, counter, entry = (16, 8, "Q", 20) if big else (8, 4, "H", 12)
    start = size
    after = start + struct.calcsize(order + counter) + entry * len(tags) + inline
    packed = {t: struct.pack(f"{order}{len(v)}{'H' if k == 3 else 'I'}", *v) for t, (k, v) in tags.items()}
    over = b""
    where = {}
    for t in sorted(tags):
        if len(packed[t]) > inline:
            where[t] = after + len(over)
            over += packed[t]
    packed[273] = struct.pack(order + "I", after + len(over))
    body = struct.pack(order + counter, len(tags))
    wide = "Q" if big else "I"
    for t in sorted(tags):
        kind, v = tags[t]
        n = len(v) // 2 if kind == 5 else len(v)
        value = struct.pack(order + wide, where[t]) if t in where else packed[t].ljust(inline, b"\0")
        body += struct.pack(order + "HH" + wide, t, kind, n) + value
    head = (b"II" if little else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    return head + body + b"\0" * inline + over + data


# The Huffman tables of the JPEG standard's annex K for luminance, as code counts and symbols.
_DC_COUNTS, _DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))


def _flat_ac() -> tuple[bytes, bytes]:
    """A table of all run and size symbols with codes of eight and nine bits: larger files, but nothing to look up."""
    symbols = [0x00, 0xF0] + [r << 4 | s for s in range(1, 11) for r in range(16)]
    counts = [0] * 16
    counts[7], counts[8] = len(symbols[:200]), len(symbols[200:])
    return bytes(counts), bytes(symbols)


def jpeg(pixels: np.ndarray, quality_step: int = 1, restart: int = 0, dpi: int = 72) -> bytes:
    """Baseline, 4:4:4 or gray (pixels of one channel); every quantisation step is quality_step."""
    h, w, c = pixels.shape
    x = pixels.astype(np.float64)
    if c == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        x = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b, 128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b], axis=2)
    x = np.pad(x, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    counts, symbols = _flat_ac()

    def codes(n: bytes, s: bytes) -> dict[int, tuple[int, int]]:
        out, code, k = {}, 0, 0
        for length in range(1, 17):
            for _ in range(n[length - 1]):
                out[s[k]] = (code, length)
                code, k = code + 1, k + 1
            code <<= 1
        return out

    dc, ac = codes(_DC_COUNTS, _DC_SYMBOLS), codes(counts, symbols)
    parts: list[list[tuple[int, int]]] = [[]]
    last, unit = [0] * c, 0

    def value(v: int, size: int) -> tuple[int, int]:
        return (v if v >= 0 else v + (1 << size) - 1, size)

    for y in range(0, x.shape[0], 8):
        for z in range(0, x.shape[1], 8):
            if restart and unit and unit % restart == 0:
                parts.append([])
                last = [0] * c
            unit += 1
            for i in range(c):
                block = np.rint(IDCT.T @ x[y : y + 8, z : z + 8, i] @ IDCT / quality_step).astype(int).ravel()[ZIGZAG]
                out = parts[-1]
                d = int(block[0]) - last[i]
                last[i] = int(block[0])
                out.append(dc[abs(d).bit_length()])
                if d:
                    out.append(value(d, abs(d).bit_length()))
                run = 0
                top = int(np.flatnonzero(block)[-1]) if block.any() else 0
                for v in block[1 : top + 1].tolist():
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        out.append(ac[0xF0])
                        run -= 16
                    size = abs(v).bit_length()
                    out += [ac[run << 4 | size], value(v, size)]
                    run = 0
                if top < 63:
                    out.append(ac[0])

    def padded(bits: list[tuple[int, int]]) -> bytes:
        bits = [*bits, (127, 7)]
        raw = _bits(bits, True)
        total = sum(n for _, n in bits) - 7
        return raw[: -(-total // 8)].replace(b"\xff", b"\xff\x00")

    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    scan = b"".join(padded(p) + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 1, dpi, dpi, 0, 0)) + segment(0xDB, b"\0" + bytes([quality_step] * 64))
        + segment(0xC0, struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(c)))
        + segment(0xC4, b"\0" + _DC_COUNTS + _DC_SYMBOLS) + segment(0xC4, b"\x10" + counts + symbols) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
        + segment(0xDA, bytes([c]) + b"".join(bytes([i + 1, 0]) for i in range(c)) + b"\0\x3f\0") + scan + b"\xff\xd9"
    )

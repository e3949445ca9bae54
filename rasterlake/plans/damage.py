"""A damaged file for each rule that a file can break, so that verdicts can be told from a rule's name."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from rasterlake.operators import encoders as E

_RGB = (np.arange(60).reshape(4, 5, 3) * 4).astype(np.uint8)
_INDEX = (np.arange(20).reshape(4, 5) % 7).astype(np.uint8)
_GRAYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
_HEADER = struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0)
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Where a GIF of these encoders has its first frame: behind the header and 256 colours.
_FRAME = 13 + 768


def put(data: bytes, at: int, form: str, *values: int) -> bytes:
    new = struct.pack(form, *values)
    return data[:at] + new + data[at + len(new) :]


def _png(header: bytes = _HEADER, *chunks: bytes) -> bytes:
    return _SIGNATURE + E.png_chunk(b"IHDR", header) + b"".join(chunks)


def _whole_png(**changes: int) -> bytes:
    at = {"width": 0, "interlace": 12}
    header = _HEADER
    for name, value in changes.items():
        header = put(header, at[name], ">I" if name == "width" else "B", value)
    return _png(header, *_png_body())


def _png_body() -> tuple[bytes, bytes]:
    whole = E.png(_RGB, 2)
    at = whole.index(b"IDAT") - 4
    return whole[at:-12], whole[-12:]


def _jpeg_without(marker: int) -> bytes:
    data = E.jpeg(_RGB)
    at = data.index(bytes([0xFF, marker]))
    return data[:at] + data[at + 2 + struct.unpack(">H", data[at + 2 : at + 4])[0] :]


def _jpeg_frame(offset: int, form: str, value: int) -> bytes:
    """A value of the frame header: precision 4, height 5, width 7, components 9."""
    data = E.jpeg(_RGB)
    return put(data, data.index(b"\xff\xc0") + offset, form, value)


def _progressive() -> bytes:
    data = E.jpeg(_RGB)
    return put(data, data.index(b"\xff\xc0") + 1, "B", 0xC2)


_TAGS = {256: (3, 1, 2), 257: (3, 1, 2), 258: (3, 1, 8), 259: (3, 1, 1), 262: (3, 1, 1), 273: (4, 1, 0), 277: (3, 1, 1), 278: (4, 1, 2), 279: (4, 1, 4)}


def tiff(without: tuple[int, ...] = (), count: int | None = None, first: int = 8, after: bytes = b"\0\0\0\0", **more: tuple[int, int, int]) -> bytes:
    """A gray picture of 2 x 2, its four bytes taken from the header."""
    tags = sorted((_TAGS | {int(k[1:]): v for k, v in more.items()}).items())
    tags = [(t, v) for t, v in tags if t not in without]
    body = b"".join(struct.pack("<HHII", t, *v) for t, v in tags)
    return b"II*\0" + struct.pack("<IH", first, len(tags) if count is None else count) + body + after


def _bmp(at: int, form: str, value: int) -> bytes:
    """A value of the header: DIB size 14, width 18, planes 26, bits 28, file size 2, pixel offset 10, picture size 34."""
    return put(E.bmp24(_RGB), at, form, value)


def _cut_literal() -> bytes:
    """An RLE picture whose only run promises twenty values and brings three."""
    body = b"\0\x14abc"
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 1024 + len(body), 0, 54 + 1024, 40, 40, 30, 1, 8, 1, len(body), 0, 0, 256, 0)
    return head + bytes(1024) + body


_SHORT_JPEG = b"\xff\xd8\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\x55\xff\xd9"

#: By rule: a file that breaks it, and the extension that it bears.
CASES: dict[str, tuple[str, Callable[[], bytes]]] = {
    "EMPTY": ("png", lambda: b""),
    "NO_SIGNATURE": ("tif", lambda: b"plain text"),
    "EXTENSION": ("png", lambda: E.bmp24(_RGB)),
    "DEEP_LIMITED": ("jpg", _progressive),
    "DEEP": ("bmp", _cut_literal),
    "BMP_SHORT": ("bmp", lambda: b"BM" + bytes(8)),
    "BMP_DIB_SIZE": ("bmp", lambda: _bmp(14, "<I", 200)),
    "BMP_NO_DIB": ("bmp", lambda: E.bmp24(_RGB)[:30]),
    "BMP_GEOMETRY": ("bmp", lambda: _bmp(18, "<i", 0)),
    "BMP_PLANES": ("bmp", lambda: _bmp(26, "<H", 3)),
    "BMP_DEPTH": ("bmp", lambda: _bmp(28, "<H", 20)),
    "BMP_PALETTE": ("bmp", lambda: E.bmp_rle8(_INDEX, _GRAYS)[:154]),
    "BMP_FILE_SIZE": ("bmp", lambda: _bmp(2, "<I", 5000)),
    "BMP_EXTRA": ("bmp", lambda: put(E.bmp24(_RGB), 34, "<I", 0) + bytes(2000)),
    "BMP_OFFSET": ("bmp", lambda: _bmp(10, "<I", 5000)),
    "BMP_TRUNCATED": ("bmp", lambda: _bmp(18, "<i", 500)),
    "BMP_IMAGE_SIZE": ("bmp", lambda: put(E.bmp24(_RGB) + bytes(600), 2, "<I", 718)),
    "PNG_CHUNK": ("png", lambda: _png(_HEADER, struct.pack(">I4s", 10**6, b"tEXt"), bytes(8))),
    "PNG_CRC": ("png", lambda: put(E.png(_RGB, 2), 29, "B", E.png(_RGB, 2)[29] ^ 1)),
    "PNG_IHDR": ("png", lambda: _png(_HEADER[:12], *_png_body())),
    "PNG_NO_IHDR": ("png", lambda: _SIGNATURE + b"".join(_png_body())),
    "PNG_GEOMETRY": ("png", lambda: _whole_png(width=0)),
    "PNG_INTERLACE": ("png", lambda: _whole_png(interlace=5)),
    "PNG_NO_IDAT": ("png", lambda: _png(_HEADER, _png_body()[1])),
    "PNG_NO_IEND": ("png", lambda: E.png(_RGB, 2)[:-12]),
    "JPEG_SEGMENT": ("jpg", lambda: b"\xff\xd8\xff\xed\0\x01" + E.jpeg(_RGB)[2:]),
    "JPEG_SEGMENT_CUT": ("jpg", lambda: b"\xff\xd8\xff\xed\xff\x00" + E.jpeg(_RGB)[2:]),
    "JPEG_NO_FRAME": ("jpg", lambda: _jpeg_without(0xC0)),
    "JPEG_GEOMETRY": ("jpg", lambda: _jpeg_frame(7, ">H", 0)),
    "JPEG_COMPONENTS": ("jpg", lambda: _jpeg_frame(9, "B", 5)),
    "JPEG_PRECISION": ("jpg", lambda: _jpeg_frame(4, "B", 9)),
    "JPEG_NO_SCAN": ("jpg", lambda: E.jpeg(_RGB)[: E.jpeg(_RGB).index(b"\xff\xda")] + b"\xff\xd9"),
    "JPEG_NO_EOI": ("jpg", lambda: E.jpeg(_RGB)[:-2] + bytes(40)),
    "JPEG_SHORT": ("jpg", lambda: _SHORT_JPEG),
    "GIF_SHORT": ("gif", lambda: E.gif([_INDEX], _GRAYS)[:10]),
    "GIF_PALETTE": ("gif", lambda: E.gif([_INDEX], _GRAYS)[:200]),
    "GIF_GEOMETRY": ("gif", lambda: put(E.gif([_INDEX], _GRAYS), _FRAME + 5, "<H", 0)),
    "GIF_TRAILER": ("gif", lambda: E.gif([_INDEX], _GRAYS)[:-1]),
    "GIF_STRUCTURE": ("gif", lambda: E.gif([_INDEX], _GRAYS)[:-1] + b"\x55;"),
    "GIF_NO_FRAME": ("gif", lambda: E.gif([_INDEX], _GRAYS)[:_FRAME] + b";"),
    "GIF_LZW": ("gif", lambda: put(E.gif([_INDEX], _GRAYS), _FRAME + 10, "B", 13)),
    "GIF_FRAME": ("gif", lambda: put(E.gif([_INDEX], _GRAYS), _FRAME + 1, "<H", 100)),
    "TIFF_SHORT": ("tif", lambda: b"II*\0\x08\0"),
    "TIFF_MAGIC": ("tif", lambda: b"II+\0" + bytes(8)),
    "TIFF_CYCLE": ("tif", lambda: tiff(after=struct.pack("<I", 8))),
    "TIFF_IFD": ("tif", lambda: tiff(first=9999)),
    "TIFF_NEXT_IFD": ("tif", lambda: tiff(after=struct.pack("<I", 9999))),
    "TIFF_TAGS": ("tif", lambda: tiff(count=5000)),
    "TIFF_IFD_CUT": ("tif", lambda: tiff(count=20)),
    "TIFF_TAG_DATA": ("tif", lambda: tiff(t270=(2, 100, 99_999))),
    "TIFF_CHAIN": ("tif", lambda: tiff(after=b"")),
    "TIFF_EMPTY": ("tif", lambda: tiff(without=tuple(_TAGS))),
    "TIFF_GEOMETRY": ("tif", lambda: tiff(without=(256,))),
    "TIFF_COMPRESSION": ("tif", lambda: tiff(without=(259,))),
    "TIFF_STRIPS": ("tif", lambda: tiff(without=(273,))),
    "TIFF_STRIP": ("tif", lambda: tiff(t273=(4, 1, 99_999))),
    "PCX_SHORT": ("pcx", lambda: E.pcx24(_RGB)[:100]),
    "PCX_BOUNDS": ("pcx", lambda: put(E.pcx24(_RGB), 4, "<H", 50)),
    "PCX_PLANES": ("pcx", lambda: put(E.pcx24(_RGB), 65, "B", 7)),
    "PCX_LINE": ("pcx", lambda: put(E.pcx24(_RGB), 66, "<H", 1)),
    "PCX_TRUNCATED": ("pcx", lambda: E.pcx24(np.tile(_RGB, (16, 16, 1)))[:200]),
}

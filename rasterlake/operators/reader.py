"""Ranged reads with an account of what was read, and the record that parsers fill."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


class Reader:
    """Random access to a file's bytes; counts the union of the ranges that were read. Reads clamp at the end of the file."""

    def __init__(self, data: bytes | None = None, path: str | None = None):
        self._data, self._file = data, None
        if data is None:
            self._file = open(path, "rb")  # noqa: SIM115
            self.size = self._file.seek(0, 2)
        else:
            self.size = len(data)
        self._ranges: list[tuple[int, int]] = []

    def read(self, offset: int, n: int) -> bytes:
        if n <= 0 or offset < 0 or offset >= self.size:
            return b""
        n = min(n, self.size - offset)
        self._ranges.append((offset, offset + n))
        if len(self._ranges) > 256:
            self._ranges = _union(self._ranges)
        if self._file is None:
            return bytes(self._data[offset : offset + n])
        self._file.seek(offset)
        return self._file.read(n)

    def tail(self, n: int) -> bytes:
        return self.read(max(0, self.size - n), n)

    def all(self, most: int) -> bytes:
        return self.read(0, min(self.size, most))

    @property
    def bytes_read(self) -> int:
        return sum(b - a for a, b in _union(self._ranges))

    def close(self) -> None:
        if self._file:
            self._file.close()


class Window:
    """A file's bytes by place, as a bytes object gives them, read in blocks; only the block at hand is kept."""

    def __init__(self, reader: Reader, block: int = 32 * 1024):
        self.reader, self.block, self.start, self.held = reader, block, 0, b""

    def __len__(self) -> int:
        return self.reader.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, slice):
            a, b, _ = at.indices(len(self))
            if b - a > self.block:
                return self.reader.read(a, b - a)
            return self._at(a, b)[a - self.start : b - self.start] if b > a else b""
        return self._at(at, at + 1)[at - self.start]

    def _at(self, a: int, b: int) -> bytes:
        if a < self.start or b > self.start + len(self.held):
            self.start, self.held = a, self.reader.read(a, max(self.block, b - a))
        return self.held


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Cursor:
    """Sequential reads of numbers; beyond the end they give 0 and `ok` turns false."""

    def __init__(self, data: bytes, little: bool = True, at: int = 0):
        self.data, self.at, self.ok, self.order = data, at, True, "<" if little else ">"

    def _number(self, kind: str, size: int) -> int:
        if self.at < 0 or self.at + size > len(self.data):
            self.at, self.ok = len(self.data), False
            return 0
        value = struct.unpack_from(self.order + kind, self.data, self.at)[0]
        self.at += size
        return value

    def u8(self) -> int:
        return self._number("B", 1)

    def u16(self) -> int:
        return self._number("H", 2)

    def u32(self) -> int:
        return self._number("I", 4)

    def u64(self) -> int:
        return self._number("Q", 8)

    def i32(self) -> int:
        return self._number("i", 4)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            self.ok = False
        out = self.data[self.at : self.at + n]
        self.at = min(len(self.data), self.at + max(n, 0))
        return out

    def seek(self, at: int) -> None:
        self.ok = 0 <= at <= len(self.data)
        self.at = min(max(at, 0), len(self.data))

    def skip(self, n: int) -> None:
        self.seek(self.at + n)

    def fixed_text(self, n: int) -> str:
        return self.take(n).replace(b"\0", b" ").decode("latin-1")


SEVERITIES = ("OK", "WARNING", "CORRUPTED")


class Limited(Exception):
    """A picture that can't be decoded for its kind or its size; the file is not to blame."""


class Broken(Exception):
    """A picture that can't be decoded because its data are wrong."""


@dataclass
class Limits:
    max_pixels: int = 64 * 1024 * 1024
    max_decoded_bytes: int = 512 * 1024 * 1024
    max_compressed_bytes: int = 512 * 1024 * 1024

    def check(self, width: int, height: int, channels: int = 4) -> None:
        if width <= 0 or height <= 0:
            raise Broken("no picture area")
        if width * height > self.max_pixels:
            raise Limited(f"{width * height} pixels are over the limit of {self.max_pixels}")
        if width * height * channels > self.max_decoded_bytes:
            raise Limited("decoded picture is over the limit")

    def compressed(self, n: int) -> None:
        if n > self.max_compressed_bytes:
            raise Limited("compressed data are over the limit")


@dataclass
class Record:
    """What one file's header tells."""

    width: int = 0
    height: int = 0
    bits_per_pixel: int = 0
    sample_depth: int = 0
    channels: int = 0
    color_model: str = ""
    dpi_x: float | None = None
    dpi_y: float | None = None
    resolution_unit: str = ""
    compression: str = ""
    compression_code: str = ""
    check: str = "OK"
    problems: list[tuple[str, str, str]] = field(default_factory=list)
    details: list[tuple[str, str, str]] = field(default_factory=list)
    #: What a format has in numbers: frames, chunks, tags.
    frames: list[dict] = field(default_factory=list)
    chunks: dict[str, int] = field(default_factory=dict)
    tags: list[dict] = field(default_factory=list)
    #: Numbers that the details show as text: chunks and bytes of a PNG's IDAT, a TIFF's strips, frames of a GIF, bytes without compression.
    measures: dict[str, int] = field(default_factory=dict)

    def problem(self, code: str, severity: str, message: str) -> None:
        """The worst severity wins."""
        self.problems.append((code, severity, message))
        self.check = max(self.check, severity, key=SEVERITIES.index)

    def detail(self, group: str, name: str, value: object) -> None:
        self.details.append((group, name, value if isinstance(value, str) else str(value)))

    def dpi(self, x: float, y: float, unit: str) -> None:
        self.dpi_x, self.dpi_y, self.resolution_unit = float(x), float(y), unit

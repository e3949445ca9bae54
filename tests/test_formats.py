"""Lossless codecs give back the pixels that were encoded; damaged files give a verdict and never raise."""

import numpy as np
import pytest

from rasterlake.operators import encoders as E
from rasterlake.operators.engine import analyse_bytes

RNG = np.random.default_rng(7)
RGB = RNG.integers(0, 256, (23, 37, 3), dtype=np.uint8)
FLAT = np.repeat(np.repeat(RNG.integers(0, 256, (4, 5, 3), dtype=np.uint8), 6, axis=0), 7, axis=1)
PALETTE = RNG.integers(0, 256, (256, 3), dtype=np.uint8)
INDEX = RNG.integers(0, 256, (20, 31), dtype=np.uint8)


def pixels(data: bytes) -> np.ndarray:
    from rasterlake.operators.engine import decode_bytes

    return decode_bytes(data)


@pytest.mark.parametrize("picture", [RGB, FLAT], ids=["noise", "flat"])
@pytest.mark.parametrize("encode", [E.bmp24, E.pcx24, lambda p: E.png(p, 2), *(lambda p, f=f: E.png(p, 2, filters=f) for f in range(1, 5)), lambda p: E.png(p, 2, adam7=True), *(lambda p, c=c: E.tiff(p, compression=c) for c in (1, 5, 8, 32773, 32946)), lambda p: E.tiff(p, little=False, compression=5, predictor=True), lambda p: E.tiff(p, big=True)])
def test_rgb_round_trip(encode, picture):
    data = encode(picture)
    assert (pixels(data) == picture).all()
    record = analyse_bytes("a", data, deep=True)
    assert (record["check"], record["width"], record["height"]) == ("OK", picture.shape[1], picture.shape[0])


@pytest.mark.parametrize("encode", [lambda: E.bmp_rle8(INDEX, PALETTE), lambda: E.gif([INDEX], PALETTE), lambda: E.gif([INDEX], PALETTE, interlaced=True), lambda: E.png(INDEX[:, :, None], 3, extra=[(b"PLTE", PALETTE.tobytes())]), lambda: E.tiff(INDEX[:, :, None], 3, colour_map=PALETTE)])
def test_palette_round_trip(encode):
    assert (pixels(encode()) == PALETTE[INDEX]).all()


def test_lzw_repeats_its_newest_entry():
    index = np.array([[0, 1, 0, 1, 0, 1, 0]], np.uint8)
    assert (pixels(E.gif([index], PALETTE)) == PALETTE[index]).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_gray_depths(depth):
    full = RNG.integers(0, 1 << depth, (9, 13, 1))
    want = full >> 8 if depth == 16 else full * 255 // ((1 << depth) - 1)
    assert (pixels(E.png(full, 0, depth)) == want).all()
    assert (pixels(E.png(full, 0, depth, adam7=True)) == want).all()


def test_sixteen_bits_in_both_orders():
    full = RNG.integers(0, 65536, (5, 6, 3), dtype=np.uint16)
    for little in (True, False):
        assert (pixels(E.tiff(full, bits=16, little=little)) == full >> 8).all()


def test_alpha_and_key():
    rgba = RNG.integers(0, 256, (5, 6, 4), dtype=np.uint8)
    assert (pixels(E.png(rgba, 6)) == rgba).all()
    assert (pixels(E.tiff(rgba, extra=2)) == rgba).all()
    keyed = pixels(E.png(RGB, 2, extra=[(b"tRNS", b"".join(int(v).to_bytes(2, "big") for v in RGB[0, 0]))]))
    assert (keyed[..., 3] == np.where((RGB == RGB[0, 0]).all(axis=2), 0, 255)).all()


def test_jpeg_is_close():
    smooth = np.stack(np.meshgrid(np.arange(40) * 3, np.arange(24) * 5), axis=2).astype(np.uint8)
    picture = np.dstack([smooth, smooth[..., 0]])
    for restart in (0, 3):
        assert np.abs(pixels(E.jpeg(picture, restart=restart)).astype(int) - picture).max() <= 4
    gray = picture[..., :1]
    assert np.abs(pixels(E.jpeg(gray)).astype(int) - gray).max() <= 2


def test_jpeg_header():
    record = analyse_bytes("a.jpg", E.jpeg(RGB, dpi=300))
    assert (record["dpi_x"], record["channels"], record["check"], record["extension_mismatch"]) == (300.0, 3, "OK", False)


ALL = {"bmp": E.bmp24(RGB), "rle.bmp": E.bmp_rle8(INDEX, PALETTE), "png": E.png(RGB, 2), "pcx": E.pcx24(RGB), "gif": E.gif([INDEX, INDEX], PALETTE, [5, 7]), "tif": E.tiff(RGB, compression=5), "big.tif": E.tiff(RGB, big=True), "jpg": E.jpeg(RGB)}


@pytest.mark.parametrize("name", ALL)
def test_two_thirds_of_a_file_are_corrupted(name):
    data = ALL[name]
    assert analyse_bytes(f"x.{name}", data[: len(data) * 2 // 3], deep=True)["check"] == "CORRUPTED"


@pytest.mark.parametrize("name", ALL)
def test_damage_never_raises(name):
    rng = np.random.default_rng(3)
    for _ in range(150):
        data = bytearray(ALL[name])
        for _ in range(int(rng.integers(1, 6))):
            data[int(rng.integers(0, min(len(data), 400)))] = int(rng.integers(0, 256))
        record = analyse_bytes(f"x.{name}", bytes(data[: int(rng.integers(0, len(data) + 1))]), deep=True)
        assert record["check"] in ("OK", "WARNING", "CORRUPTED", "NOT_IMAGE")


def test_not_an_image_and_mismatch():
    assert analyse_bytes("a.png", b"")["check"] == "NOT_IMAGE"
    record = analyse_bytes("a.png", b"plain text")
    assert (record["check"], record["extension_mismatch"], record["format"]) == ("NOT_IMAGE", True, "NOT_IMAGE")
    record = analyse_bytes("a.png", ALL["bmp"])
    assert (record["check"], record["extension_mismatch"]) == ("WARNING", True)


def test_limits_warn():
    assert analyse_bytes("a.png", ALL["png"], deep=True, limits={"max_pixels": 10})["check"] == "WARNING"


def test_top_down_bmp_and_bit_fields():
    import struct

    h, w = RGB.shape[:2]
    body = np.zeros((h, w, 4), np.uint8)
    body[..., :3] = RGB
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 12 + body.size, 0, 66, 40, w, -h, 1, 32, 3, 0, 2835, 2835, 0, 0) + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)
    assert (pixels(head + body.tobytes()) == RGB).all()
    record = analyse_bytes("a.bmp", head + body.tobytes())
    assert (record["height"], round(record["dpi_x"], 3), record["check"]) == (h, 72.009, "OK")


def test_animations_of_any_length():
    """Frames aren't capped, and a header scan holds one block of the file."""
    frame = np.zeros((2, 2), np.uint8)
    for n in (20_000, 20_005):
        record = analyse_bytes("a.gif", E.gif([frame] * n, PALETTE, [1] * n))
        assert (record["check"], len(record["frames"])) == ("OK", n)


def test_long_jpeg_headers():
    """Segments before the frame may be longer than any window; their payload isn't read."""
    import struct

    data = E.jpeg(RGB)
    for k in (1, 40):
        padded = data[:2] + (b"\xff\xed" + struct.pack(">H", 65_000) + b"\0" * 64_998) * k + data[2:]
        record = analyse_bytes("a.jpg", padded)
        assert (record["check"], record["width"], record["height"]) == ("OK", 37, 23) and record["bytes_read"] < 40_000 + k * 33_000
        assert (pixels(padded) == pixels(data)).all()


def test_rules_and_damaged_files():
    """Each rule that a file can break has a file that breaks it; the verdict is the rule's."""
    import pathlib
    import re

    from rasterlake.functions import labels as L
    from rasterlake.operators import formats
    from rasterlake.plans import damage

    assert set(damage.CASES) == set(L.RULES) - set(L.ALONE) - {"ROOT", "OPEN", "PARSE"}
    for rule, (extension, make) in damage.CASES.items():
        record = analyse_bytes(f"x.{extension}", make(), deep=rule.startswith("DEEP"))
        found = {p["code"]: p["severity"] for p in record["problems"]}
        assert found.get(rule) == L.RULES[rule][0] and record["check"] == L.FOLLOWED.get(rule, L.RULES[rule][0]), (rule, found)
        assert all(found[c] == L.RULES[c][0] for c in found)
    source = "".join(p.read_text() for p in pathlib.Path(formats.__file__).parent.glob("*.py"))
    assert set(re.findall(r'problem\("([A-Z_]+)"', source)) <= set(L.RULES)


def test_rules_of_parsers_alone():
    from rasterlake.functions import labels as L
    from rasterlake.operators.formats import REGISTRY
    from rasterlake.operators.reader import Reader, Record

    for rule, data in {"PNG_SHORT": b"\x89PNG", "PNG_SIGNATURE": b"x" * 40, "JPEG_SOI": b"x" * 200, "GIF_HEADER": b"x" * 40, "TIFF_ORDER": b"x" * 40}.items():
        record = Record()
        REGISTRY[rule.partition("_")[0]].parse(Reader(data), record)
        assert record.problems[0][:2] == (rule, "CORRUPTED") and rule in L.ALONE


def test_rle4_round_trip():
    """Runs, literals of odd and even length, jumps over index 0, rows of one value."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        h, w = rng.integers(1, 40, 2)
        index = np.repeat(rng.integers(0, 16, (h, w)), rng.integers(1, 9), axis=1)[:, :w].astype(np.uint8)
        index[rng.random((h, w)) < 0.3] = 0
        assert (pixels(E.bmp_rle4(index, PALETTE[:16])) == PALETTE[:16][index]).all()


def test_early_end_of_rle_leaves_index_zero():
    import struct

    body = b"\x05\x03\0\1"
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 1024 + len(body), 0, 54 + 1024, 40, 40, 30, 1, 8, 1, len(body), 0, 0, 256, 0)
    table = np.zeros((256, 4), np.uint8)
    table[:, 2::-1] = PALETTE
    got = pixels(head + table.tobytes() + body)
    want = np.zeros((30, 40), np.uint8)
    want[-1, :5] = 3
    assert (got == PALETTE[want]).all()


class Java:
    """The JDK's own encoders and decoders, as an independent hand."""

    def __init__(self, spark):
        self.jvm = spark._jvm
        self.io = self.jvm.javax.imageio.ImageIO

    def image(self, rgb, kind=1):
        h, w = rgb.shape[:2]
        out = self.jvm.java.awt.image.BufferedImage(w, h, kind)
        for y in range(h):
            for x in range(w):
                out.setRGB(x, y, int.from_bytes(bytes([255, *rgb[y, x]]), "big", signed=True))
        return out

    def written(self, rgb, name, compression=None, kind=1):
        out = self.jvm.java.io.ByteArrayOutputStream()
        writer = self.io.getImageWritersByFormatName(name).next()
        param = writer.getDefaultWriteParam()
        if compression:
            param.setCompressionMode(2)
            param.setCompressionType(compression)
        stream = self.io.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, self.jvm.javax.imageio.IIOImage(self.image(rgb, kind), None, None), param)
        stream.flush()
        return bytes(out.toByteArray())

    def read(self, data):
        image = self.io.read(self.jvm.java.io.ByteArrayInputStream(data))
        h, w = image.getHeight(), image.getWidth()
        flat = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64) & 0xFFFFFF
        return np.stack([flat >> 16, flat >> 8 & 255, flat & 255], axis=1).astype(np.uint8).reshape(h, w, 3)


SMALL = RGB[:9, :14]


@pytest.mark.parametrize("name,compression", [("png", None), ("bmp", None), ("tiff", "LZW"), ("tiff", "PackBits"), ("tiff", "Deflate"), ("tiff", "ZLib"), ("tiff", None)])
def test_files_of_another_encoder(spark, name, compression):
    java = Java(spark)
    data = java.written(SMALL, name, compression)
    assert (pixels(data)[..., :3] == SMALL).all() and (java.read(data) == SMALL).all()
    assert analyse_bytes(f"x.{name}", data, deep=True)["check"] == "OK"


def test_gif_and_jpeg_of_another_encoder(spark):
    java = Java(spark)
    grays = np.repeat((np.arange(126).reshape(9, 14, 1) * 2).astype(np.uint8), 3, axis=2)
    data = java.written(grays, "gif", kind=10)
    assert (pixels(data) == java.read(data)).all()
    data = java.written(np.repeat(np.repeat(grays, 3, axis=0), 3, axis=1), "jpeg")
    assert np.abs(pixels(data)[..., :3].astype(int) - java.read(data)).max() <= 16 and np.abs(pixels(data)[..., :3].astype(int) - java.read(data)).mean() < 0.4


@pytest.mark.parametrize("encode", [lambda: E.png(SMALL, 2, filters=4), lambda: E.png(SMALL, 2, adam7=True), lambda: E.bmp24(SMALL), lambda: E.tiff(SMALL, compression=5), lambda: E.tiff(SMALL, compression=32773), lambda: E.tiff(SMALL, compression=8, predictor=True)])
def test_our_files_under_another_decoder(spark, encode):
    assert (Java(spark).read(encode()) == SMALL).all()

"""Scalar operators as Column expressions: detection by signature, names, sizes, report numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlake.functions import labels as L


def lookup(code: Column, names: Mapping, default: str | None = None) -> Column:
    """A label by code, as one map literal."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), code)
    return found if default is None else F.coalesce(found, F.lit(default))


def byte_at(data: Column, offset: int) -> Column:
    """The byte at offset (from 0) as an int; null beyond the end."""
    return F.when(F.length(data) > offset, F.conv(F.hex(F.substring(data, offset + 1, 1)), 16, 10).cast("int"))


def _starts(head: Column, signature: bytes) -> Column:
    return F.substring(head, 1, len(signature)) == F.lit(signature)


def detect_format(head: Column) -> Column:
    """The format's short name by the first bytes of a file, NOT_IMAGE if there is none."""
    pcx = (byte_at(head, 0) == 0x0A) & (byte_at(head, 2) <= 1) & byte_at(head, 1).isin(0, 2, 3, 4, 5) & byte_at(head, 3).isin(1, 2, 4, 8)
    tiff = [_starts(head, s) for s in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")]
    return (
        F.when(_starts(head, b"\x89PNG\r\n\x1a\n"), "PNG")
        .when(_starts(head, b"\xff\xd8\xff"), "JPEG")
        .when(_starts(head, b"GIF87a") | _starts(head, b"GIF89a"), "GIF")
        .when(tiff[0] | tiff[1] | tiff[2] | tiff[3], "TIFF")
        .when(_starts(head, b"BM"), "BMP")
        .when(pcx, "PCX")
        .otherwise("NOT_IMAGE")
    )


#: How many bytes of a file's head are its signature.
SIGNATURE_BYTES = {"PNG": 8, "JPEG": 3, "GIF": 6, "TIFF": 4, "BMP": 2, "PCX": 4}


def signature_text(head: Column, fmt: Column) -> Column:
    """The signature's bytes in hex, "89 50 ..."; empty if there is none."""
    n = lookup(fmt, SIGNATURE_BYTES)
    return F.coalesce(F.regexp_replace(F.hex(F.substring(head, F.lit(1), n)), "(..)(?!$)", "$1 "), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def format_from_extension(path: Column) -> Column:
    return lookup(extension(path), L.EXTENSIONS, "")


def short_name(fmt: Column) -> Column:
    return lookup(fmt, L.SHORT_LABELS, "?")


def full_name(fmt: Column) -> Column:
    return lookup(fmt, L.FULL_NAMES, L.FULL_NAMES["UNKNOWN"])


def is_supported(fmt: Column) -> Column:
    return fmt.isin(*L.FORMATS)


def check_name(check: Column) -> Column:
    return lookup(check, L.CHECK_LABELS, L.CHECK_LABELS["NOT_IMAGE"])


def has_error(check: Column) -> Column:
    return check.isin("CORRUPTED", "NOT_IMAGE")


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {"OK": 0, "WARNING": 1, "CORRUPTED": 2})


def fold_severity(problems: Column) -> Column:
    """The worst severity in an array of problems, OK if it is empty."""
    worst = F.array_max(F.transform(problems, lambda p: severity_rank(p["severity"])))
    return F.element_at(F.array(F.lit("OK"), F.lit("WARNING"), F.lit("CORRUPTED")), F.coalesce(worst, F.lit(0)) + 1)


# Numbers and sizes


def fixed(value: Column, digits: int) -> Column:
    """The value in fixed notation, rounded as C's printf does: by its exact binary value, ties to even. (Java's formatter rounds the
    shortest decimal, ties up.) The product with the power of ten is taken as a rounded part and its error, which is exact here."""
    x, scale = F.abs(value.cast("double")), float(10**digits)
    product = x * scale
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    text = n.cast("string") if not digits else F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))
    small = F.concat(F.when(value < 0, "-").otherwise(""), text)
    return F.when(x < 2.0**46, small).when(x.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def number(value: Column, digits: int = 2) -> Column:
    """Fixed notation without trailing zeros or dot."""
    text = fixed(value, digits)
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _scaled(size: Column, units: int) -> tuple[Column, Column]:
    """The size over the largest power of 1024 it reaches, and that power."""
    power = F.lit(0)
    for k in range(1, units):
        power = F.when(size >= 1024**k, k).otherwise(power)
    return size.cast("double") / F.pow(F.lit(1024.0), power), power


def human_size(size: Column) -> Column:
    value, power = _scaled(size, 5)
    digits = F.when(power == 0, fixed(value, 0)).when(value < 10, fixed(value, 2)).when(value < 100, fixed(value, 1)).otherwise(fixed(value, 0))
    return F.concat(digits, F.lit(" "), F.element_at(F.lit(["Б", "КБ", "МБ", "ГБ", "ТБ"]), power + 1))


def human_size_console(size: Column) -> Column:
    value, power = _scaled(size, 4)
    return F.concat(fixed(value, 1), F.lit(" "), F.element_at(F.lit(["Б", "КБ", "МБ", "ГБ"]), power + 1))


def human_size_details(size: Column) -> Column:
    value, power = _scaled(size, 4)
    return F.concat(F.when(power == 0, fixed(value, 0)).otherwise(fixed(value, 2)), F.lit(" "), F.element_at(F.lit(["Б", "КБ", "МБ", "ГБ"]), power + 1))


def trim_number(value: Column, digits: int = 2) -> Column:
    """No decimals if within 0.005 of an integer."""
    return F.when(F.abs(value - F.round(value)) < 0.005, fixed(F.round(value), 0)).otherwise(fixed(value, digits))


def human_speed(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.concat(human_size((size / seconds).cast("long")), F.lit("/с"))).otherwise(F.lit(L.NOT_SET))


def resolution_text(dpi: Column) -> Column:
    return F.format_string("%.0f x %.0f dpi", dpi, dpi)


def dpi_text(dpi_x: Column, dpi_y: Column, unit: Column) -> Column:
    return F.when(dpi_x.isNotNull() & dpi_y.isNotNull(), F.format_string("%.0f x %.0f dpi", dpi_x, dpi_y)).otherwise(unit)


def mean_text(value: Column) -> Column:
    return fixed(value, 1)


def seconds_text(value: Column) -> Column:
    return F.concat(fixed(value, 2), F.lit(" с"))


def plural_files(n: Column) -> Column:
    two, one = n % 100, n % 10
    return F.when(two.between(11, 19), "файлов").when(one == 1, "файл").when(one.between(2, 4), "файла").otherwise("файлов")


def shorten_path(path: Column, most: int) -> Column:
    """The end of a path behind dots, `most` characters in all."""
    return F.when((F.length(path) <= most) | F.lit(most < 4), path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(most - 3))))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "да").otherwise("нет")


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(F.least(F.lit(1.0), done / total) * 100)).otherwise(0).cast("int")


# Pixels and resolutions


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def bits_used(value: Column) -> Column:
    return F.when(value > 0, F.length(F.bin(value))).otherwise(0)


def dpi_from_metres(per_metre: Column) -> Column:
    return per_metre * F.lit(0.0254)


def dpi_from_centimetres(per_cm: Column) -> Column:
    return per_cm * F.lit(2.54)


def rational(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0)))


def bytes_for_samples(samples: Column, bits: Column) -> Column:
    return F.floor((samples * bits + 7) / 8).cast("long")


def bmp_row_stride(width: Column, bits: Column) -> Column:
    return (F.floor((width.cast("long") * bits + 31) / 32) * 4).cast("long")


def matches_text(record_text: Column, query: str, unicode: bool = False) -> Column:
    """Case-insensitive substring; only ASCII letters fold unless unicode."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    if unicode:
        return F.contains(F.lower(record_text), F.lower(F.lit(query)))
    return F.contains(F.translate(record_text, upper, lower), F.translate(F.lit(query), upper, lower))


def csv_quoted(value: Column, separator: str = ";") -> Column:
    special = F.contains(value, F.lit(separator)) | F.contains(value, F.lit('"')) | F.contains(value, F.lit("\n"))
    return F.when(special, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

"""From file bytes to records: detection, header, structure, pixels on request; and the queries over records.

Files are independent, so a scan is one map stage without a shuffle; a deep scan decodes in the same stage, as the bytes are at hand, and
only statistics leave it. Rules that need no bytes (state folding, names, views) are Column expressions over the records.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import asdict, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterlake.functions import exprs as X
from rasterlake.functions import labels as L
from rasterlake.functions.schema import struct
from rasterlake.operators import pixels as P
from rasterlake.operators.formats import REGISTRY
from rasterlake.operators.reader import Broken, Limited, Limits, Reader, Record

_PIXELS = struct(
    "decoded boolean, error string, width int, height int, pixel_count bigint, distinct_colors bigint, distinct_colors_capped boolean, used_channel_bits int, grayscale boolean, has_alpha boolean, alpha_used boolean, "
    "min_channel array<double>, max_channel array<double>, mean_channel array<double>, entropy double, entropy_full double, compression_ratio double, top_colors array<struct<rgb: int, percent: double>>"
)
RECORD_SCHEMA = struct(
    "path string, name string, folder string, root_ordinal int, file_size bigint, bytes_read bigint, format string, extension_name string, extension_mismatch boolean, signature binary, width int, height int, geometry_valid boolean, "
    "bits_per_pixel int, sample_depth int, channels int, color_model string, dpi_x double, dpi_y double, dpi_known boolean, resolution_unit string, compression string, compression_code string, check string, "
    "problems array<struct<code: string, severity: string, message: string>>, details array<struct<group: string, name: string, value: string>>, frames array<struct<left: int, top: int, width: int, height: int, interlaced: boolean, local: int, delay: int, disposal: int, bytes: bigint>>, "
    "chunks map<string, int>, tags array<struct<tag: int, type: int, count: bigint, ints: array<bigint>, reals: array<double>, ascii: string, offset_valid: boolean>>, measures map<string,bigint>, red_histogram array<bigint>, pixels_analyzed boolean"
).add("pixels", _PIXELS)

_HEADS = ((b"\x89PNG\r\n\x1a\n", "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"GIF87a", "GIF"), (b"GIF89a", "GIF"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"II+\0", "TIFF"), (b"MM\0+", "TIFF"), (b"BM", "BMP"))


def detect(head: bytes) -> str:
    """The twin of functions.exprs.detect_format for bytes at hand."""
    for signature, name in _HEADS:
        if head.startswith(signature):
            return name
    if len(head) >= 4 and head[0] == 0x0A and head[1] in (0, 2, 3, 4, 5) and head[2] <= 1 and head[3] in (1, 2, 4, 8):
        return "PCX"
    return "NOT_IMAGE"


def _int(v: int) -> int:
    return max(-(2**31), min(2**31 - 1, int(v)))


def analyse(path: str, reader: Reader | None, deep: bool = False, limits: Limits | None = None, error: str = "", code: str = "OPEN") -> dict:
    """One record of RECORD_SCHEMA. reader: None if the file can't be opened, for the reason in error; code ROOT: path is a root that can't be listed."""
    folder, name = os.path.split(path)
    ext = os.path.splitext(name)[1]
    known = L.EXTENSIONS.get(ext[1:].lower(), "")
    head = reader.read(0, 64) if reader else b""
    fmt, record, pixels = detect(head), Record(), None
    if reader is None:
        record.problem(code, "CORRUPTED", f"root can't be listed: {error}" if code == "ROOT" else f"file can't be opened: {error}")
    elif not reader.size or fmt == "NOT_IMAGE":
        record.check = "NOT_IMAGE"
        why = "file is empty" if not reader.size else f"no signature of a known format, though the extension names {known}" if known else "no signature of a known format"
        record.problems.append(("EMPTY" if not reader.size else "NO_SIGNATURE", "NOT_IMAGE", why))
    else:
        try:
            REGISTRY[fmt].parse(reader, record)
        except Exception as e:  # a file must not end the scan
            record.problem("PARSE", "CORRUPTED", f"header can't be read: {type(e).__name__}")
        if known and known != fmt and record.check == "OK":
            record.problem("EXTENSION", "WARNING", f"extension names {known}, file is {fmt}")
        if deep and record.check in ("OK", "WARNING"):
            try:
                pixels = P.analyse(REGISTRY[fmt].decode(reader, record, limits or Limits()), reader.size)
            except Limited as e:
                record.problem("DEEP_LIMITED", "WARNING", f"not decoded: {e}")
            except Exception as e:
                record.problem("DEEP", "CORRUPTED", f"pixels can't be decoded: {e if isinstance(e, Broken) else type(e).__name__}")
    return {
        "path": path, "name": name, "folder": folder, "root_ordinal": None, "file_size": reader.size if reader else 0, "bytes_read": reader.bytes_read if reader else 0, "format": fmt, "extension_name": known if reader else ext, "extension_mismatch": bool(known) and bool(reader) and known != fmt,
        "signature": head[:8].ljust(8, b"\0"), "width": _int(record.width), "height": _int(record.height), "geometry_valid": record.width > 0 and record.height > 0, "bits_per_pixel": _int(record.bits_per_pixel), "sample_depth": _int(record.sample_depth), "channels": _int(record.channels),
        "color_model": record.color_model, "dpi_x": record.dpi_x, "dpi_y": record.dpi_y, "dpi_known": record.dpi_x is not None, "resolution_unit": record.resolution_unit, "compression": record.compression, "compression_code": record.compression_code, "check": record.check,
        "problems": [dict(zip(("code", "severity", "message"), p, strict=True)) for p in record.problems], "details": [dict(zip(("group", "name", "value"), d, strict=True)) for d in record.details], "frames": record.frames, "chunks": record.chunks,
        "tags": record.tags, "measures": record.measures, "red_histogram": pixels.pop("red_histogram") if pixels else None, "pixels_analyzed": pixels is not None, "pixels": pixels,
    }


def analyse_bytes(path: str, content: bytes, deep: bool = False, limits: dict | None = None) -> dict:
    return analyse(path, Reader(content), deep, Limits(**limits) if limits else None)


def decode_bytes(content: bytes, limits: dict | None = None):
    """Pixels (height, width, channels) of one picture; raises Limited or Broken."""
    fmt = detect(content[:64])
    if fmt == "NOT_IMAGE":
        raise Broken("not an image")
    return REGISTRY[fmt].decode(Reader(content), Record(), Limits(**limits) if limits else Limits())


def limits_from(options: dict) -> Limits:
    return Limits(**{f.name: int(options[f.name]) for f in fields(Limits) if f.name in options})


def schema_of(names: Iterable[str] | None = None) -> T.StructType:
    """RECORD_SCHEMA, or the fields of it that are named, in its order."""
    if names is None:
        return RECORD_SCHEMA
    unknown = set(names) - set(RECORD_SCHEMA.names)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return T.StructType([f for f in RECORD_SCHEMA if f.name in set(names)])


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """A column for each field of the schema; what else the rows hold stays behind."""
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def analyse_contents(files: DataFrame, deep: bool = False, limits: Limits | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """files: path, content. One record for each row, of all fields or those named. Few pictures at a time are in a worker's hands."""
    bounds, wanted = asdict(limits or Limits()), schema_of(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, own = to_arrow_schema(wanted), Limits(**bounds)
        for batch in batches:
            paths, contents = batch.column("path"), batch.column("content")
            for a in range(0, len(batch), 256):
                yield batch_of([analyse(p.as_py() or "", Reader(c.as_py() or b""), deep, own) for p, c in zip(paths[a : a + 256], contents[a : a + 256], strict=True)], schema)

    return files.select("path", "content").mapInArrow(run, wanted)


def scan(spark: SparkSession, roots: str | list[str], recursive: bool = True, deep: bool = False, extensions: tuple[str, ...] | None = L.DEFAULT_EXTENSIONS, dedupe: bool = False, follow_links: bool = False, listing: str = "driver", names: Iterable[str] | None = None, **limits: int) -> DataFrame:
    """Records (of all fields, or those named) of all files under the roots, and one for each root that can't be listed. listing: driver, or executors for large collections."""
    from rasterlake.sources.images import register

    register(spark)
    roots = [roots] if isinstance(roots, str) else list(roots)
    options = {"recursive": str(recursive).lower(), "deep": str(deep).lower(), "extensions": ",".join(extensions or ()), "dedupe": str(dedupe).lower(), "followSymlinks": str(follow_links).lower(), "listing": listing, "roots": "\n".join(roots)} | {k: str(v) for k, v in limits.items()}
    return spark.read.format("raster_files").schema(schema_of(names)).options(**options).load()


def decode_one(path: str, **limits: int):
    """(width, height, channels, bytes) of one picture, for a preview."""
    with open(path, "rb") as f:
        pixels = decode_bytes(f.read(), limits or None)
    return pixels.shape[1], pixels.shape[0], pixels.shape[2], pixels.tobytes()


# Queries over records


def summarize(records: DataFrame, *keys: str) -> DataFrame:
    """Counters of a scan, in all or by keys."""
    check = F.col("check")
    return records.groupBy(*keys).agg(
        F.count("*").alias("done"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_bytes"), F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read"), F.count_if(check == "CORRUPTED").alias("corrupted"),
        F.count_if(check == "WARNING").alias("warnings"), F.count_if(check == "NOT_IMAGE").alias("not_image"), F.count_if(X.has_error(check)).alias("errors"),
    )


def search_text() -> Column:
    return F.concat_ws(" ", "name", "folder", X.full_name(F.col("format")), "compression")


def search(records: DataFrame, query: str, unicode: bool = False) -> DataFrame:
    return records if not query else records.where(X.matches_text(search_text(), query, unicode))


def errors(records: DataFrame) -> DataFrame:
    return records.where(X.has_error(F.col("check")))


def by_name(records: DataFrame) -> DataFrame:
    return records.orderBy("name", "path")


def by_root(records: DataFrame) -> DataFrame:
    """In the order of the roots, then by path, as a listing has it."""
    return records.orderBy("root_ordinal", "path")


def compat(records: DataFrame) -> DataFrame:
    """Records as lenient readers tell them, where that costs nothing: a top-down BMP has no valid geometry; a BMP's compression without run lengths has its
    label for a code; an animation has the size of its last frame; PCX run lengths never halve a picture."""
    c, last = F.col, F.element_at("frames", -1)
    flipped = (c("format") == "BMP") & F.exists("details", lambda d: (d["name"] == "rows") & (d["value"] == "top-down"))
    packed = (c("format") == "PCX") & (c("compression") == "RLE") & (c("file_size") < 128 + F.floor(c("measures")["raw_bytes"] / 2)) & ~F.exists("problems", lambda p: p["code"] == "PCX_TRUNCATED")
    problem = lambda when, code, text: F.when(when, F.array(F.struct(F.lit(code).alias("code"), F.lit("CORRUPTED").alias("severity"), F.lit(text).alias("message")))).otherwise(F.array())
    animated = (c("format") == "GIF") & (F.size("frames") > 0)
    return records.withColumns({
        "problems": F.concat("problems", problem(flipped, "BMP_GEOMETRY", "height is negative"), problem(packed, "PCX_TRUNCATED", "file is too short for its picture")),
        "check": F.when(flipped | packed, "CORRUPTED").otherwise(c("check")),
        "compression_code": F.when((c("format") == "BMP") & ~c("compression_code").isin("BI_1", "BI_2"), c("compression")).otherwise(c("compression_code")),
        "width": F.when(animated, last["width"]).otherwise(c("width")),
        "height": F.when(animated, last["height"]).otherwise(c("height")),
    })


def record_at(records: DataFrame, k: int) -> DataFrame:
    """The k-th row (from 0) by name."""
    return by_name(records).offset(k).limit(1)


def details(records: DataFrame) -> DataFrame:
    """path, position, group, name, value: the common rows first, then what the format adds, then the problems."""
    d = lambda group, name, value: F.struct(F.lit(group).alias("group"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    common = F.array(
        d("Format", "detected format", F.col("format")), d("Format", "full name", X.full_name(F.col("format"))), d("Format", "signature bytes", X.signature_text(F.col("signature"), F.col("format"))), d("Format", "extension", F.col("extension_name")),
        d("Format", "extension mismatch", F.col("extension_mismatch")), d("Format", "path", F.col("path")), d("Format", "file size", F.col("file_size")), d("Format", "bytes read", F.col("bytes_read")), d("Check", "state", F.col("check")),
    )
    found = F.transform("problems", lambda p, i: F.struct(F.lit("Check").alias("group"), F.concat(F.lit("problem "), (i + 1).cast("string")).alias("name"), p["message"].alias("value")))
    rows = F.concat(common, F.col("details"), F.when(F.size(found) > 0, found).otherwise(F.array(d("Check", "problems", F.lit("none")))))
    return records.select("path", F.posexplode(rows).alias("position", "x")).select("path", "position", "x.*")


def problems(records: DataFrame) -> DataFrame:
    return records.select("path", F.posexplode("problems").alias("position", "x")).select("path", "position", "x.*")


def frame_rollup(records: DataFrame) -> DataFrame:
    """Totals over the frames of each animation."""
    delays = F.filter(F.transform("frames", lambda f: f["delay"]), lambda d: d.isNotNull())
    return records.select(
        "path", F.size("frames").alias("frames"), F.array_min(delays).alias("delay_min"), F.array_max(delays).alias("delay_max"), F.aggregate(delays, F.lit(0).cast("long"), lambda a, d: a + d).alias("delay_sum"),
        F.coalesce(F.array_max(F.transform("frames", lambda f: f["local"])), F.lit(0)).alias("largest_local_palette"), F.exists("frames", lambda f: f["interlaced"]).alias("any_interlaced"),
    )


def add_rollups(rollups: DataFrame, *keys: str) -> DataFrame:
    """One row for each key of roll-ups of parts of it."""
    return rollups.groupBy(*keys).agg(
        F.sum("frames").cast("int").alias("frames"), F.min("delay_min").alias("delay_min"), F.max("delay_max").alias("delay_max"), F.sum("delay_sum").alias("delay_sum"), F.max("largest_local_palette").alias("largest_local_palette"), F.bool_or("any_interlaced").alias("any_interlaced"),
    )


def chunk_census(records: DataFrame) -> DataFrame:
    return records.select("path", F.explode(F.map_entries("chunks")).alias("c")).select("path", F.col("c.key").alias("chunk"), F.col("c.value").alias("n"))


def tag_table(spark: SparkSession) -> DataFrame:
    """tag, tag_name: the dictionary as a dimension; its size is fixed."""
    return spark.createDataFrame(list(L.TIFF_TAGS.items()), "tag int, tag_name string")


def tags(records: DataFrame) -> DataFrame:
    """path, tag, tag_name, type_name, count and values of the first page's tags."""
    rows = records.select("path", F.explode("tags").alias("t")).select("path", "t.*")
    types = F.coalesce(X.lookup(F.col("type"), {k: v[0] for k, v in L.TIFF_TYPES.items()}), F.lit("unknown"))
    return rows.join(F.broadcast(tag_table(records.sparkSession)), "tag", "left").withColumn("type_name", types)


#: Ranges of one key that one task sorts; a key with more is split by place.
SPLIT = 200_000


def interval_union(ranges: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Length of the union of half-open ranges [start, end) for each key: the relational form of a reader's account.

    Keys with more than SPLIT ranges are split into slices of their span; a range is cut where it runs over a slice's end, so slices add up."""
    from pyspark.sql import Window

    rows = ranges.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"))
    kind = rows.schema["_a"].dataType
    large = rows.groupBy(*keys).agg(F.min("_a").alias("_lo"), F.max("_b").alias("_hi"), F.ceil(F.count("*") / SPLIT).alias("_parts")).where("_parts > 1")
    large = large.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_lo", "_parts", F.ceil((F.col("_hi") - F.col("_lo")) / F.col("_parts")).cast(kind).alias("_width"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(large[f"_k{i}"])
    slice_of = lambda at: F.floor((at - F.col("_lo")) / F.col("_width"))
    cut = rows.join(large, same, "left").withColumn("_slice", F.explode(F.when(F.col("_parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(slice_of(F.col("_a")), F.least(slice_of(F.col("_b")), F.col("_parts"))))))
    low = F.col("_lo") + (F.col("_slice") * F.col("_width")).cast(kind)
    cut = cut.select(*keys, "_slice", F.greatest("_a", low).alias("_a"), F.least("_b", low + F.col("_width")).alias("_b")).where("_b > _a")
    before = F.max("_b").over(Window.partitionBy(*keys, "_slice").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("_b") - F.greatest(F.col("_a"), F.coalesce(before, F.col("_a"))))
    return cut.withColumn("_new", new).groupBy(*keys).agg(F.sum("_new").alias("covered"))


def register_views(records: DataFrame, prefix: str = "images") -> None:
    """SQL views: images, images_details, images_problems, images_pixels."""
    records.createOrReplaceTempView(prefix)
    details(records).createOrReplaceTempView(f"{prefix}_details")
    problems(records).createOrReplaceTempView(f"{prefix}_problems")
    records.where("pixels_analyzed").select("path", "pixels.*").createOrReplaceTempView(f"{prefix}_pixels")


def register_functions(spark: SparkSession) -> None:
    """SQL functions: image_format(binary), image_check(path, binary), image_parse(path, binary) (a record's header), image_pixels(binary) (statistics of
    the decoded pixels) and the table function image_chunks(binary) (kind, position, offset, length of a PNG's chunks or a JPEG's segments)."""
    header = schema_of([n for n in RECORD_SCHEMA.names if n not in ("frames", "chunks", "tags", "pixels", "root_ordinal")])

    @F.pandas_udf("string")
    def image_format(content: pd.Series) -> pd.Series:
        return pd.Series([detect(bytes(b[:64]) if b is not None else b"") for b in content], dtype=object)

    @F.pandas_udf("string")
    def image_check(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([analyse_bytes(p or "", bytes(b or b""))["check"] for p, b in zip(path, content, strict=True)], dtype=object)

    @F.udf(header, useArrow=True)
    def image_parse(path, content):
        record = analyse_bytes(path or "", bytes(content or b""))
        return {n: record[n] for n in header.names}

    @F.udf(_PIXELS, useArrow=True)
    def image_pixels(content):
        return analyse_bytes("", bytes(content or b""), deep=True)["pixels"]

    @F.udtf(returnType="kind string, position int, offset bigint, length bigint")
    class ImageChunks:
        def eval(self, content):
            data = bytes(content or b"")
            fmt = detect(data[:64])
            if fmt == "PNG":
                from rasterlake.operators.formats.png import chunks

                for i, (kind, at, length) in enumerate(chunks(Reader(data))):
                    yield kind, i, at, length
            elif fmt == "JPEG":
                from rasterlake.operators.formats.jpeg import segments

                for i, (marker, at, length) in enumerate(segments(data)):
                    yield f"{marker:02X}", i, at, max(length, 0)

    for f in (image_format, image_check, image_parse, image_pixels):
        spark.udf.register(f.__name__ if hasattr(f, "__name__") else f.func.__name__, f)
    spark.udtf.register("image_chunks", ImageChunks)

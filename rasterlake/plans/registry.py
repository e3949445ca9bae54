"""Every query of the engine, by name, and its SQL for an oracle."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import engine
from rasterlake.operators import pixels as P
from rasterlake.plans import bridge as B
from rasterlake.plans import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# Pixel statistics through every lossless codec


def _rgb_stats(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = B.records(B.order_pictures(spark, sf_dir), kind, names=("check", "pixels"))
        channel = [f(F.col(f"pixels.{n}_channel")[i]).alias(f"{n}_{c}") for i, c in enumerate("rgb") for n, f in (("min", lambda x: x.cast("int")), ("max", lambda x: x.cast("int")), ("mean", lambda x: F.round(x, 6)))]
        return r.select("key", "check", F.col("pixels.pixel_count").alias("pixel_count"), F.col("pixels.distinct_colors").alias("distinct_colors"), F.col("pixels.grayscale").alias("grayscale"), *channel, F.round("pixels.entropy", 6).alias("entropy"))

    return query


_PX = "px AS (SELECT l_orderkey AS key, CAST(l_quantity AS INT) AS r, CAST(round(l_discount * 100) AS INT) AS g, CAST(round(l_tax * 100) AS INT) AS b FROM lineitem)"
_RGB_SQL = f"""
WITH {_PX}, n AS (SELECT key, count(*) AS n FROM px GROUP BY key),
h AS (SELECT key, r, count(*) AS c FROM px GROUP BY key, r),
e AS (SELECT h.key, sum(CASE WHEN r > 0 THEN -(c / CAST(n AS DOUBLE)) * log2(c / CAST(n AS DOUBLE)) ELSE 0 END) AS entropy FROM h JOIN n ON h.key = n.key GROUP BY h.key)
SELECT px.key, 'OK' AS "check", count(*) AS pixel_count, count(DISTINCT r * 65536 + g * 256 + b) AS distinct_colors, bool_and(r = g AND g = b) AS grayscale,
  min(r) AS min_r, max(r) AS max_r, round(avg(r), 6) AS mean_r, min(g) AS min_g, max(g) AS max_g, round(avg(g), 6) AS mean_g, min(b) AS min_b, max(b) AS max_b, round(avg(b), 6) AS mean_b,
  round(max(e.entropy), 6) AS entropy
FROM px JOIN e ON px.key = e.key GROUP BY px.key"""
for _name, _kind in {"bmp24_stats": "bmp", "png_rgb_stats": "png", "pcx_rgb_stats": "pcx", "tiff_none_stats": "tif", "tiff_packbits_stats": "packbits.tif", "tiff_lzw_stats": "lzw.tif", "tiff_deflate_stats": "deflate.tif"}.items():
    _add(_name, _rgb_stats(_kind), _RGB_SQL)


def _gray_stats(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r, p = B.records(B.vector_pictures(spark, sf_dir), kind, names=("check", "width", "height", "pixels")), F.col("pixels")
        return r.select(
            "key", "check", "width", "height", p["min_channel"][0].cast("int").alias("min_v"), p["max_channel"][0].cast("int").alias("max_v"), F.round(p["mean_channel"][0], 6).alias("mean_v"), p["distinct_colors"].alias("distinct_colors"),
            p["used_channel_bits"].alias("used_channel_bits"), F.round(p["entropy"], 6).alias("entropy"), F.round(p["entropy_full"], 6).alias("entropy_full"),
        )

    return query


_V = "v AS (SELECT vec_id AS key, CAST(least(255, greatest(0, floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5))) AS INT) AS v FROM embeddings)"
_GRAY_SQL = f"""
WITH {_V}, h AS (SELECT key, v, count(*) AS c FROM v GROUP BY key, v),
e AS (SELECT key, round(sum(CASE WHEN v > 0 THEN -(c / 64.0::DOUBLE) * log2(c / 64.0::DOUBLE) ELSE 0 END), 6) AS entropy, round(sum(-(c / 64.0::DOUBLE) * log2(c / 64.0::DOUBLE)), 6) AS entropy_full FROM h GROUP BY key)
SELECT v.key, 'OK' AS "check", CAST(8 AS INT) AS width, CAST(8 AS INT) AS height, min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS mean_v, count(DISTINCT v) AS distinct_colors,
  CAST(CASE WHEN max(v) = 0 THEN 0 ELSE floor(log2(max(v))) + 1 END AS INT) AS used_channel_bits, max(entropy) AS entropy, max(entropy_full) AS entropy_full
FROM v JOIN e ON v.key = e.key GROUP BY v.key"""
for _name, _kind in {"bmp_rle8_stats": "bmp", "gif_lzw_stats": "gif", "png_gray_stats": "png", "png_adam7_stats": "adam7.png"}.items():
    _add(_name, _gray_stats(_kind), _GRAY_SQL)


def relational_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.relational(B.lineitem_pixels(spark, sf_dir).withColumnRenamed("l_orderkey", "key"), "key")
    return out.select("key", "pixel_count", "distinct_colors", "grayscale", *(F.col(f"{n}_{c}") if n != "mean" else F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in "rgb" for n in ("min", "max", "mean")), "used_channel_bits")


_add("relational_stats", relational_stats, f"""
WITH {_PX} SELECT key, count(*) AS pixel_count, least(count(DISTINCT r * 65536 + g * 256 + b), 65536) AS distinct_colors, bool_and(r = g AND g = b) AS grayscale,
  min(r) AS min_r, max(r) AS max_r, round(avg(r), 6) AS mean_r, min(g) AS min_g, max(g) AS max_g, round(avg(g), 6) AS mean_g, min(b) AS min_b, max(b) AS max_b, round(avg(b), 6) AS mean_b,
  CAST(max(CASE WHEN greatest(r, g, b) > 0 THEN length(bin(greatest(r, g, b))) ELSE 0 END) AS INT) AS used_channel_bits FROM px GROUP BY key""")


def top_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.records(B.order_pictures(spark, sf_dir), "bmp", names=("pixels",))
    return r.select("key", F.posexplode("pixels.top_colors").alias("position", "c")).select("key", (F.col("position") + 1).alias("place"), F.col("c.rgb").alias("rgb"), F.round("c.percent", 6).alias("percent"))


_add("top_colors", top_colors, f"""
WITH {_PX}, c AS (SELECT key, r * 65536 + g * 256 + b AS rgb, count(*) AS n FROM px GROUP BY 1, 2),
t AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY n DESC, rgb) AS INT) AS place, rgb, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY key), 6) AS percent FROM c)
SELECT key, place, rgb, percent FROM t WHERE place <= 8""")


# Detection and structure


def _detect(name: str, key: str, text: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        head = F.substring(F.encode(F.col(text), "UTF-8"), 1, 64)
        fmt = X.detect_format(head)
        return B.table(spark, sf_dir, name).select(key, fmt.alias("format"), X.is_supported(fmt).alias("supported"), X.signature_text(head, fmt).alias("signature"))

    _add(f"detect_{name}", query, f"""
SELECT {key}, f AS format, f <> 'NOT_IMAGE' AS supported, CASE f WHEN 'GIF' THEN CASE WHEN {text} LIKE 'GIF87a%' THEN '47 49 46 38 37 61' ELSE '47 49 46 38 39 61' END WHEN 'BMP' THEN '42 4D' ELSE '' END AS signature
FROM (SELECT *, CASE WHEN {text} LIKE 'GIF87a%' OR {text} LIKE 'GIF89a%' THEN 'GIF' WHEN {text} LIKE 'BM%' THEN 'BMP' ELSE 'NOT_IMAGE' END AS f FROM {name})""")


_detect("documents", "doc_id", "text")
_detect("pages", "page_id", "html")

#: Encoder, extension and format by key modulo 7, for collections of mixed files.
_MIX = (("bmp", "BMP"), ("png", "PNG"), ("pcx", "PCX"), ("tif", "TIFF"), ("lzw.tif", "TIFF"), ("gif", "GIF"), ("jpg", "JPEG"))


def _mixed(spark: SparkSession, sf_dir: str, *names: str, deep: bool = False) -> DataFrame:
    """One picture for each part in one of seven encodings; every third part's file is cut to two thirds."""
    size = F.col("p_size")
    parts = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array_repeat(F.array(size, size + 1, size + 2), 40).alias("x")).select("key", F.flatten("x").alias("rgb"))
    kind = F.element_at(F.lit([k for k, _ in _MIX]), (F.col("key") % 7 + 1).cast("int"))
    return B.records(B.spread(parts), kind, deep, F.col("key") % 3 == 0, names)


_MIX_FORMAT = "CASE p_partkey % 7 WHEN 0 THEN 'BMP' WHEN 1 THEN 'PNG' WHEN 2 THEN 'PCX' WHEN 3 THEN 'TIFF' WHEN 4 THEN 'TIFF' WHEN 5 THEN 'GIF' ELSE 'JPEG' END"


def detect_bridge_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, "path", "format", "extension_mismatch").select("key", "format", X.full_name(F.col("format")).alias("full_name"), X.format_from_extension(F.col("path")).alias("named"), "extension_mismatch")


_FULL = "CASE f WHEN 'BMP' THEN 'Windows Bitmap' WHEN 'PNG' THEN 'Portable Network Graphics' WHEN 'JPEG' THEN 'JPEG / JFIF' WHEN 'GIF' THEN 'CompuServe GIF' WHEN 'TIFF' THEN 'Tagged Image File Format' ELSE 'ZSoft PC Paintbrush' END"
_add("detect_bridge_mix", detect_bridge_mix, f"SELECT key, f AS format, {_FULL} AS full_name, f AS named, false AS extension_mismatch FROM (SELECT p_partkey AS key, {_MIX_FORMAT} AS f FROM part)")


def ext_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same BMP under a right or a wrong name."""
    files = B.encoded(B.order_pictures(spark, sf_dir), F.lit("bmp"))
    key = F.regexp_extract("path", r"^([0-9]+)\.", 1).cast("long")
    named = F.concat(key.cast("string"), F.element_at(F.lit([".bmp", ".DIB", ".png", ".dat"]), (key % 4 + 1).cast("int")))
    r = engine.analyse_contents(files.select(named.alias("path"), "content"), names=("name", "format", "extension_name", "extension_mismatch", "check"))
    return r.select(F.regexp_extract("name", r"^([0-9]+)\.", 1).cast("long").alias("key"), "format", "extension_name", "extension_mismatch", "check")


_add("ext_mismatch", ext_mismatch, """
SELECT l_orderkey AS key, 'BMP' AS format, CASE l_orderkey % 4 WHEN 0 THEN 'BMP' WHEN 1 THEN 'BMP' WHEN 2 THEN 'PNG' ELSE '' END AS extension_name, l_orderkey % 4 = 2 AS extension_mismatch,
  CASE WHEN l_orderkey % 4 = 2 THEN 'WARNING' ELSE 'OK' END AS "check" FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")


def truncation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _mixed(spark, sf_dir, "format", "check", "problems", "pixels_analyzed", deep=True)
    return r.select("key", "format", (F.col("check") == "CORRUPTED").alias("corrupted"), X.has_error(F.col("check")).alias("has_error"), "pixels_analyzed", (X.fold_severity(F.col("problems")) == F.col("check")).alias("folded"))


_add("truncation_status", truncation_status, f"SELECT p_partkey AS key, {_MIX_FORMAT} AS format, p_partkey % 3 = 0 AS corrupted, p_partkey % 3 = 0 AS has_error, p_partkey % 3 <> 0 AS pixels_analyzed, true AS folded FROM part")


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.summarize(_mixed(spark, sf_dir, "format", "check", "file_size", "bytes_read"), "format").select("format", "done", "corrupted", "warnings", "not_image", "errors")


_add("status_summary", status_summary, f"""
SELECT f AS format, count(*) AS done, count(*) FILTER (WHERE k % 3 = 0) AS corrupted, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS not_image, count(*) FILTER (WHERE k % 3 = 0) AS errors
FROM (SELECT p_partkey AS k, {_MIX_FORMAT} AS f FROM part) GROUP BY f""")


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of uncompressed pictures: 54 bytes and rows of three bytes a pixel, filled up to four."""
    r = B.records(B.order_pictures(spark, sf_dir), "bmp", deep=False, names=("check", "file_size", "bytes_read"))
    return engine.summarize(r).select("done", "file_bytes", "corrupted", "errors")


_add("corpus_totals", corpus_totals, """
SELECT count(*) AS done, CAST(sum(54 + (n * 24 + 31) // 32 * 4) AS BIGINT) AS file_bytes, CAST(0 AS BIGINT) AS corrupted, CAST(0 AS BIGINT) AS errors FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")


def dpi_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return B.table(spark, sf_dir, "part").select("p_partkey", F.round(X.dpi_from_metres(size * 100), 6).alias("from_metres"), F.round(X.dpi_from_centimetres(size), 6).alias("from_cm"), F.round(X.rational(size, F.col("p_partkey") % 5), 6).alias("ratio"))


_add("dpi_conversion", dpi_conversion, "SELECT p_partkey, round(p_size * 100.0::DOUBLE * 0.0254::DOUBLE, 6) AS from_metres, round(p_size * 2.54::DOUBLE, 6) AS from_cm, round(CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE / (p_partkey % 5) END, 6) AS ratio FROM part")


#: Frames of one animation.
FRAMES = 5000


def frame_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event, in one animation for each user or, of users with many events, in several."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from rasterlake.operators import encoders as E

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = np.zeros((2, 2), np.uint8)
        for batch in batches:
            out = [E.gif([frame] * len(d), B.PALETTE, d) for d in batch.column("delays").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    delay = F.least(F.lit(60000), F.greatest(F.lit(0), F.floor("value"))).cast("int")
    events = B.table(spark, sf_dir, "events").where("user_id is not null and value is not null").select("user_id", "event_id", delay.alias("delay"))
    # a user's events make as many animations as keep each of them small
    parts = events.groupBy("user_id").agg(F.ceil(F.count("*") / FRAMES).alias("parts")).where("parts > 1")
    dealt = events.join(parts, "user_id", "left").withColumn("part", F.pmod(F.xxhash64("event_id"), F.coalesce("parts", F.lit(1))))
    files = dealt.groupBy("user_id", "part").agg(F.collect_list("delay").alias("delays")).select(F.concat_ws(".", F.col("user_id").cast("string"), F.col("part").cast("string"), F.lit("gif")).alias("path"), "delays")
    r = engine.frame_rollup(engine.analyse_contents(files.mapInArrow(run, "path string, content binary"), names=("path", "frames")))
    r = engine.add_rollups(r.withColumn("user_id", F.regexp_extract("path", "^([0-9]+)", 1).cast("long")), "user_id")
    return r.select("user_id", "frames", "delay_min", "delay_max", "delay_sum", "any_interlaced")


_add("frame_rollup", frame_rollup, """
SELECT user_id, CAST(count(*) AS INT) AS frames, min(d) AS delay_min, max(d) AS delay_max, CAST(sum(d) AS BIGINT) AS delay_sum, false AS any_interlaced
FROM (SELECT user_id, CAST(least(60000, greatest(0, floor(value))) AS INT) AS d FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL) GROUP BY user_id""")


def chunk_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.chunk_census(B.records(B.vector_pictures(spark, sf_dir), "png", deep=False, names=("path", "chunks"))).groupBy("chunk").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


_add("chunk_census", chunk_census, "SELECT chunk, (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM embeddings) AS files FROM (VALUES ('IHDR'), ('IDAT'), ('IEND')) t(chunk)")


def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine.tags(B.records(B.order_pictures(spark, sf_dir), "lzw.tif", deep=False, names=("path", "tags")))
    return t.groupBy("tag", "tag_name", "type_name").agg(F.count("*").alias("n"))


_add("tag_lookup", tag_lookup, """
SELECT tag, tag_name, type_name, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n FROM (VALUES (CAST(256 AS INT), 'ImageWidth', 'LONG'), (257, 'ImageLength', 'LONG'), (258, 'BitsPerSample', 'SHORT'), (259, 'Compression', 'SHORT'),
  (262, 'PhotometricInterpretation', 'SHORT'), (273, 'StripOffsets', 'LONG'), (277, 'SamplesPerPixel', 'SHORT'), (278, 'RowsPerStrip', 'LONG'), (279, 'StripByteCounts', 'LONG')) t(tag, tag_name, type_name)""")


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.col("value") * 10).cast("long")
    ranges = B.table(spark, sf_dir, "events").where("user_id is not null and value is not null").select("user_id", start.alias("a"), (start + F.col("event_id") % 50).alias("b"))
    return engine.interval_union(ranges, "a", "b", "user_id").select("user_id", F.col("covered").cast("long").alias("covered"))


_add("interval_union", interval_union, """
WITH r AS (SELECT user_id, CAST(floor(value * 10) AS BIGINT) AS a, CAST(floor(value * 10) AS BIGINT) + event_id % 50 AS b FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r WHERE b > a)
SELECT user_id, CAST(sum(greatest(0, b - greatest(a, coalesce(p, a)))) AS BIGINT) AS covered FROM m GROUP BY user_id""")

# Queries and views over records


def _part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the place of records: a name, a folder, a format, a compression."""
    p = B.table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("folder"), F.lit("PNG").alias("format"), F.col("p_type").alias("compression"), F.concat_ws("/", "p_brand", "p_name").alias("path"), "p_partkey")


def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.search(_part_records(spark, sf_dir), "BRAND#1").select("p_partkey", "name")


_add("search_substring", search_substring, "SELECT p_partkey, p_name AS name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, 'Portable Network Graphics', p_type)), 'brand#1')")


def sort_topk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_records(spark, sf_dir).orderBy("name", "path", "p_partkey").limit(25).select("p_partkey", "name")


_add("sort_topk_names", sort_topk_names, "SELECT p_partkey, p_name AS name FROM part ORDER BY p_name, concat_ws('/', p_brand, p_name), p_partkey LIMIT 25")


def grid_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reports.grid(B.records(B.order_pictures(spark, sf_dir), "pcx", deep=False, names=("format", "width", "height", "geometry_valid", "dpi_x", "dpi_y", "resolution_unit", "bits_per_pixel", "compression", "check", "pixels_analyzed", "pixels")))
    return g.toDF("name", "format", "size", "resolution", "depth", "compression", "state", "colours")


_add("grid_projection", grid_projection, """
SELECT l_orderkey || '.pcx' AS name, 'PCX' AS format, count(*) || ' x 1' AS size, '72 x 72 dpi' AS resolution, '24' AS depth, 'RLE' AS compression, 'OK' AS state, '' AS colours FROM lineitem GROUP BY l_orderkey""")


def csv_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.csv_lines(B.records(B.order_pictures(spark, sf_dir), "bmp", deep=True).withColumn("bytes_read", F.col("file_size"))).select("path", "line")


_add("csv_report_rows", csv_report_rows, f"""
WITH {_PX}, n AS (SELECT key, count(*) AS n, count(DISTINCT r * 65536 + g * 256 + b) AS d FROM px GROUP BY key), h AS (SELECT key, r, count(*) AS c FROM px GROUP BY key, r),
e AS (SELECT h.key, sum(CASE WHEN r > 0 THEN -(c / CAST(n AS DOUBLE)) * log2(c / CAST(n AS DOUBLE)) ELSE 0 END) AS e FROM h JOIN n ON h.key = n.key GROUP BY h.key),
t AS (SELECT n.key, n, d, e, 54 + (n * 24 + 31) // 32 * 4 AS size FROM n JOIN e ON n.key = e.key)
SELECT key || '.bmp' AS path, concat_ws(';', key || '.bmp', 'Windows Bitmap', 'BMP', n, 1, 'не задано', 'не задано', '', 24, 8, 3, 'RGB 8-8-8', 'BI_RGB', 'BI_0', size, size, 'OK', '', d,
  rtrim(rtrim(printf('%.3f', abs(e)), '0'), '.'), rtrim(rtrim(printf('%.2f', size / (4.0::DOUBLE * n)), '0'), '.'), key || '.bmp') AS line FROM t""")


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * F.col("o_orderkey") * 37).cast("long")
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", X.human_size(n).alias("size"), X.human_size_console(n).alias("console"), X.human_size_details(n).alias("details"), X.plural_files(F.col("o_orderkey")).alias("files"), X.trim_number(F.col("o_totalprice")).alias("trimmed"),
        X.number(F.col("o_totalprice")).alias("number"), X.shorten_path(F.col("o_orderpriority"), 6).alias("short"), X.progress_percent(F.col("o_custkey"), F.col("o_orderkey")).alias("percent"),
    )


_V10 = "v / CASE WHEN v >= 1099511627776 AND {top} THEN 1099511627776.0::DOUBLE WHEN v >= 1073741824 THEN 1073741824.0::DOUBLE WHEN v >= 1048576 THEN 1048576.0::DOUBLE WHEN v >= 1024 THEN 1024.0::DOUBLE ELSE 1.0::DOUBLE END"
_U10 = "CASE WHEN v >= 1099511627776 AND {top} THEN ' ТБ' WHEN v >= 1073741824 THEN ' ГБ' WHEN v >= 1048576 THEN ' МБ' WHEN v >= 1024 THEN ' КБ' ELSE ' Б' END"
_add("human_sizes", human_sizes, f"""
WITH o AS (SELECT *, o_orderkey * o_orderkey * 37 AS v FROM orders), s AS (SELECT *, {_V10.format(top='true')} AS x, {_U10.format(top='true')} AS u, {_V10.format(top='false')} AS y, {_U10.format(top='false')} AS w FROM o)
SELECT o_orderkey, printf(CASE WHEN v < 1024 THEN '%.0f' WHEN x < 10 THEN '%.2f' WHEN x < 100 THEN '%.1f' ELSE '%.0f' END, x) || u AS size, printf('%.1f', y) || w AS console, printf(CASE WHEN v < 1024 THEN '%.0f' ELSE '%.2f' END, y) || w AS details,
  CASE WHEN o_orderkey % 100 BETWEEN 11 AND 19 THEN 'файлов' WHEN o_orderkey % 10 = 1 THEN 'файл' WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 'файла' ELSE 'файлов' END AS files,
  CASE WHEN abs(o_totalprice - round(o_totalprice)) < 0.005 THEN printf('%.0f', round(o_totalprice)) ELSE printf('%.2f', o_totalprice) END AS trimmed, rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.') AS number,
  CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority ELSE '...' || right(o_orderpriority, 3) END AS short, CASE WHEN o_orderkey > 0 THEN CAST(floor(least(1.0::DOUBLE, o_custkey / CAST(o_orderkey AS DOUBLE)) * 100) AS INT) ELSE 0 END AS percent FROM s""")


def packrgb_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = B.lineitem_pixels(spark, sf_dir)
    return px.select("l_orderkey", "l_linenumber", X.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"), X.bits_used(F.greatest("r", "g", "b")).cast("int").alias("bits"), X.bmp_row_stride(F.col("r"), F.lit(24)).alias("stride"), X.bytes_for_samples(F.col("r"), F.lit(3)).alias("bytes"))


_add("packrgb_bits", packrgb_bits, """
SELECT l_orderkey, l_linenumber, r * 65536 + g * 256 + b AS rgb, CAST(CASE WHEN greatest(r, g, b) > 0 THEN length(bin(greatest(r, g, b))) ELSE 0 END AS INT) AS bits, CAST((r * 24 + 31) // 32 * 4 AS BIGINT) AS stride, CAST((r * 3 + 7) // 8 AS BIGINT) AS bytes
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS r, CAST(round(l_discount * 100) AS INT) AS g, CAST(round(l_tax * 100) AS INT) AS b FROM lineitem)""")


def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = engine.details(B.records(B.order_pictures(spark, sf_dir), "bmp", deep=False))
    return d.where("name in ('full name', 'state', 'problems', 'bits per pixel')").groupBy("name", "value").agg(F.count("*").alias("n"))


_add("detail_rows", detail_rows, "SELECT name, value, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n FROM (VALUES ('full name', 'Windows Bitmap'), ('state', 'OK'), ('problems', 'none'), ('bits per pixel', '24')) t(name, value)")


def jpeg_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray pictures through JPEG with steps of one: means stay within one of the truth."""
    truth = B.vector_pictures(spark, sf_dir).select("key", (F.aggregate("gray", F.lit(0).cast("long"), lambda a, x: a + x) / 64.0).alias("mean"))
    r = B.records(B.vector_pictures(spark, sf_dir), "jpg", names=("check", "bits_per_pixel", "pixels")).select("key", "check", "bits_per_pixel", F.col("pixels.mean_channel")[0].alias("m"))
    return r.join(truth, "key").select("key", "check", "bits_per_pixel", (F.abs(F.col("m") - F.col("mean")) <= 1.0).alias("close"))


_add("jpeg_closeness", jpeg_closeness, "SELECT vec_id AS key, 'OK' AS \"check\", CAST(8 AS INT) AS bits_per_pixel, true AS close FROM embeddings")


def crc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's checksum of the PNG pictures, as the parser reports it."""
    d = engine.details(B.records(B.vector_pictures(spark, sf_dir), "png", deep=False))
    return d.where("name = 'checksums'").groupBy("value").agg(F.count("*").alias("n"))


_add("crc_check", crc_check, "SELECT '1 verified, 0 wrong' AS value, count(*) AS n FROM embeddings")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parquet table as a stream of pictures, counted as it goes; all that is there, then the counters."""
    import uuid

    source = spark.readStream.schema(B.table(spark, sf_dir, "embeddings").schema).parquet(f"{os.path.dirname(f'{sf_dir}/')}/embeddings.parquet*")
    pictures = source.select(F.col("vec_id").alias("key"), F.transform("embedding", B.gray_value).alias("gray"))
    name = f"progress_{uuid.uuid4().hex}"
    q = engine.summarize(B.records(pictures, "gif", deep=False, names=("check", "file_size", "bytes_read"))).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("done", "corrupted", "warnings", "not_image", "errors")


_add("stream_progress", stream_progress, "SELECT count(*) AS done, CAST(0 AS BIGINT) AS corrupted, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS not_image, CAST(0 AS BIGINT) AS errors FROM embeddings")


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part a file that breaks one rule, by turns: whether the rule is found broken, and the verdict."""
    from collections.abc import Iterator

    import pyarrow as pa

    from rasterlake.plans import damage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(damage.CASES)
        files = {n: (ext, make()) for n, (ext, make) in damage.CASES.items()}
        for batch in batches:
            rows = [(f"{k}.{names[k % len(names)]}.{files[names[k % len(names)]][0]}", files[names[k % len(names)]][1]) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])

    files = B.spread(B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))).mapInArrow(run, "path string, content binary")
    deep = F.col("path").contains("DEEP")
    names = ("path", "problems", "check")
    records = engine.analyse_contents(files.where(~deep), names=names).unionAll(engine.analyse_contents(files.where(deep), deep=True, names=names))
    rule = F.regexp_extract("path", r"^[0-9]+[.]([A-Z_]+)[.]", 1)
    return records.select(F.regexp_extract("path", "^([0-9]+)", 1).cast("long").alias("key"), rule.alias("rule"), F.exists("problems", lambda p: p["code"] == rule).alias("found"), "check")


def _rule_values() -> str:
    from rasterlake.functions import labels as L
    from rasterlake.plans import damage

    return ", ".join(f"({i}, '{n}', '{L.FOLLOWED.get(n, L.RULES[n][0])}')" for i, n in enumerate(damage.CASES))


_add("rule_verdicts", rule_verdicts, f"""SELECT p_partkey AS key, rule, true AS found, verdict AS "check" FROM part, (VALUES {_rule_values()}) t(i, rule, verdict) WHERE p_partkey % {_rule_values().count("(")} = i""")


def bmp_rle4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of sixteen grays through RLE4 with runs, literals and deltas."""
    pictures = B.vector_pictures(spark, sf_dir).withColumn("gray", F.transform("gray", lambda v: F.floor(v / 16).cast("int")))
    r, p = B.records(pictures, "rle4.bmp", names=("check", "bits_per_pixel", "pixels")), F.col("pixels")
    return r.select("key", "check", "bits_per_pixel", p["min_channel"][0].cast("int").alias("min_v"), p["max_channel"][0].cast("int").alias("max_v"), F.round(p["mean_channel"][0], 6).alias("mean_v"), p["distinct_colors"].alias("distinct_colors"))


_add("bmp_rle4_stats", bmp_rle4_stats, f"""
WITH {_V}, s AS (SELECT key, CAST(floor(v / 16.0) AS INT) * 17 AS v FROM v)
SELECT key, 'OK' AS "check", CAST(4 AS INT) AS bits_per_pixel, min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS mean_v, count(DISTINCT v) AS distinct_colors FROM s GROUP BY key""")


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail panel's rows of PCX pictures, counted by group, name and value where values are shared."""
    rows = reports.panel(B.records(B.order_pictures(spark, sf_dir), "pcx", deep=False))
    shared = rows.where("`group` in ('Глубина', 'Сжатие', 'Проверка') or name in ('Определён как', 'Расширение', 'Высота', 'Разрешение', 'Единицы')").where("note <> ''")
    return shared.groupBy("group", "name", "value").agg(F.count("*").alias("n"))


_add("panel_rows", panel_rows, """
SELECT g AS "group", name, value, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n FROM (VALUES ('Формат', 'Определён как', 'ZSoft PC Paintbrush'), ('Формат', 'Расширение', 'PCX'), ('Размер', 'Высота', '1 px'), ('Размер', 'Разрешение', '72.00 x 72.00'),
  ('Размер', 'Единицы', 'dots per inch'), ('Глубина', 'Бит на пиксель', '24'), ('Глубина', 'Бит на канал', '8'), ('Глубина', 'Каналы', '3'), ('Глубина', 'Модель цвета', 'RGB'), ('Сжатие', 'Метод', 'RLE'), ('Сжатие', 'Код', 'PCX encoding = 1'), ('Проверка', 'Статус', 'OK')) t(g, name, value)""")


def strip_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, m = B.records(B.order_pictures(spark, sf_dir), "tif", deep=False, names=("measures",)), F.col("measures")
    return r.agg(F.count("*").alias("files"), F.sum(m["strips"]).alias("strips"), F.sum(m["strip_bytes"]).alias("strip_bytes"), F.sum(m["tags"]).alias("tags"))


_add("strip_sums", strip_sums, "SELECT count(DISTINCT l_orderkey) AS files, count(DISTINCT l_orderkey) AS strips, CAST(count(*) * 3 AS BIGINT) AS strip_bytes, CAST(count(DISTINCT l_orderkey) * 9 AS BIGINT) AS tags FROM lineitem")


def red_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.records(B.order_pictures(spark, sf_dir), "tif", names=("red_histogram",))
    return r.select(F.posexplode("red_histogram").alias("red", "n")).where("n > 0").groupBy("red").agg(F.sum("n").alias("pixels"), F.count("*").alias("pictures"))


_add("red_histogram", red_histogram, f"WITH {_PX} SELECT r AS red, count(*) AS pixels, count(DISTINCT key) AS pictures FROM px GROUP BY r")


def compat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and sizes as lenient readers tell them."""
    bmp = engine.compat(B.records(B.vector_pictures(spark, sf_dir).withColumn("gray", F.transform("gray", lambda v: F.floor(v / 16).cast("int"))), "rle4.bmp", deep=False))
    plain = engine.compat(B.records(B.order_pictures(spark, sf_dir), "bmp", deep=False))
    both = bmp.select("compression_code", "check", F.lit(0).alias("width")).unionAll(plain.select("compression_code", "check", "width"))
    return both.groupBy("compression_code", "check").agg(F.count("*").alias("n"), F.sum("width").alias("width"))


_add("compat_records", compat_records, """
SELECT 'BI_2' AS compression_code, 'OK' AS "check", count(*) AS n, CAST(0 AS BIGINT) AS width FROM embeddings UNION ALL SELECT 'BI_RGB', 'OK', count(DISTINCT l_orderkey), count(*) FROM lineitem""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep scan of mixed files, summed up by format and state: files, pixels, and colours and red of what is without loss."""
    r = _mixed(spark, sf_dir, "format", "check", "pixels", deep=True)
    exact = F.col("format") != "JPEG"
    return r.groupBy("format", "check").agg(F.count("*").alias("files"), F.sum(F.coalesce("pixels.pixel_count", F.lit(0))).alias("pixels"), F.sum(F.when(exact, F.coalesce("pixels.distinct_colors", F.lit(0))).otherwise(0)).alias("colours"), F.sum(F.when(exact, F.coalesce(F.col("pixels.max_channel")[0], F.lit(0.0))).otherwise(0.0)).alias("red")).orderBy("format", "check")


_add("mixed_deep_scan", flagship, f"""
SELECT f AS format, CASE WHEN cut THEN 'CORRUPTED' ELSE 'OK' END AS "check", count(*) AS files, CAST(CASE WHEN NOT cut THEN 40 * count(*) ELSE 0 END AS BIGINT) AS pixels, CAST(CASE WHEN NOT cut AND f <> 'JPEG' THEN count(*) ELSE 0 END AS BIGINT) AS colours,
  CASE WHEN NOT cut AND f <> 'JPEG' THEN CAST(sum(p_size) AS DOUBLE) ELSE 0.0::DOUBLE END AS red FROM (SELECT {_MIX_FORMAT} AS f, p_partkey % 3 = 0 AS cut, p_size FROM part) GROUP BY f, cut""")

"""Tables as pictures: rows become pixels, so that the engine's operators run on data whose results SQL can tell."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators import encoders as E
from rasterlake.operators import engine

PALETTE = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
SIXTEEN = PALETTE[::17]

#: Encoders of RGB pictures and of 8-bit gray ones (as an array of shape height, width), by name.
RGB_ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "bmp": E.bmp24, "png": lambda p: E.png(p, 2, filters=1), "pcx": E.pcx24, "jpg": lambda p: E.jpeg(p),
    "tif": E.tiff, "packbits.tif": lambda p: E.tiff(p, compression=32773), "lzw.tif": lambda p: E.tiff(p, compression=5), "deflate.tif": lambda p: E.tiff(p, compression=8), "gif": lambda p: E.gif([p[..., 0]], PALETTE),
}
GRAY_ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "bmp": lambda g: E.bmp_rle8(g, PALETTE), "rle4.bmp": lambda g: E.bmp_rle4(g, SIXTEEN), "gif": lambda g: E.gif([g], PALETTE), "png": lambda g: E.png(g[:, :, None], 0, filters=4), "adam7.png": lambda g: E.png(g[:, :, None], 0, adam7=True), "jpg": lambda g: E.jpeg(g[:, :, None]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows that lie in fewer partitions than there are cores are dealt out before work that is heavy for their size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, r, g, b."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("r"), F.round(F.col("l_discount") * 100).cast("int").alias("g"), F.round(F.col("l_tax") * 100).cast("int").alias("b"))


def order_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, rgb: one picture of one row of pixels for each order; an order has few lines."""
    px = F.sort_array(F.collect_list(F.struct("l_linenumber", "r", "g", "b")))
    flat = F.flatten(F.transform(px, lambda p: F.array(p["r"], p["g"], p["b"])))
    # a number of partitions that adaptive execution keeps: these rows are few bytes but much work
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return lineitem_pixels(spark, sf_dir).repartition(n, "l_orderkey").groupBy("l_orderkey").agg(flat.alias("rgb")).withColumnRenamed("l_orderkey", "key")


def gray_value(e: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5))).cast("int")


def vector_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, gray: an 8 x 8 picture for each vector."""
    return spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", gray_value).alias("gray")))


def encoded(pictures: DataFrame, kind: Column, cut: Column | None = None) -> DataFrame:
    """path (`key.kind`), content. pictures: key and rgb or gray; kind: an encoder's name; cut: where true, two thirds of the bytes."""
    values = "rgb" if "rgb" in pictures.columns else "gray"
    encoders = RGB_ENCODERS if values == "rgb" else GRAY_ENCODERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = [], []
            for key, v, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                pixels = np.array(v, np.uint8).reshape((1, -1, 3) if values == "rgb" else (8, 8))
                data = encoders[k](pixels)
                paths.append(f"{key}.{k}")
                contents.append(data[: len(data) * 2 // 3] if c else data)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    rows = pictures.select("key", values, kind.alias("kind"), (cut if cut is not None else F.lit(False)).alias("cut"))
    return rows.mapInArrow(run, "path string, content binary")


def records(pictures: DataFrame, kind: Column | str, deep: bool = True, cut: Column | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """Records of encoded pictures (all fields, or the name and those named), with their key."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    found = engine.analyse_contents(encoded(pictures, kind, cut), deep, names=None if names is None else {"name", *names})
    return found.withColumn("key", F.regexp_extract("name", r"^([0-9]+)\.", 1).cast("long"))

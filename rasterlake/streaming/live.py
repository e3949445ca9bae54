"""Scans as streams: records as they come, live counters, batches handed on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterlake.operators import engine
from rasterlake.sources.images import register


def stream(spark: SparkSession, roots: list[str], recursive: bool = True, deep: bool = False, **options: str) -> DataFrame:
    """A streaming DataFrame of records; files that appear later come in later batches."""
    register(spark)
    return spark.readStream.format("raster_files").options(roots="\n".join(roots), recursive=str(recursive).lower(), deep=str(deep).lower(), **options).load()


def deliver(records: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Hands each batch to `handle` once, by its number; without an interval, takes what is there and ends."""
    writer = records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def progress(records: DataFrame, table: str, interval: str = "1 second") -> StreamingQuery:
    """Counters in a table in memory, readable while the scan runs; stop() cancels."""
    return engine.summarize(records).writeStream.outputMode("complete").format("memory").queryName(table).trigger(processingTime=interval).start()

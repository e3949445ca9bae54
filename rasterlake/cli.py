"""Console scan: python -m rasterlake.cli [options] PATH..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterlake.functions import exprs as X
from rasterlake.operators import engine
from rasterlake.plans import reports


def main(arguments: list[str] | None = None) -> int:
    """0; 1 if the report can't be saved; 2 for wrong usage, or with --strict if a file has errors."""
    parser = argparse.ArgumentParser(prog="rasterlake")
    parser.add_argument("paths", nargs="+")
    for flag in ("--deep", "--csv", "--quiet", "--strict", "--no-recursive"):
        parser.add_argument(flag, action="store_true")
    parser.add_argument("--save")
    parser.add_argument("--workers", type=int, default=0)
    try:
        a = parser.parse_args(arguments)
    except SystemExit as e:
        return int(e.code or 0)
    builder = SparkSession.builder.appName("rasterlake")
    if a.workers:
        builder = builder.master(f"local[{min(64, max(1, a.workers))}]")
    spark = SparkSession.getActiveSession() or builder.getOrCreate()
    began = time.monotonic()
    try:
        records = engine.scan(spark, a.paths, recursive=not a.no_recursive, deep=a.deep).cache()
        total = engine.summarize(records).select("*", X.human_size_console(F.col("bytes_read")).alias("r"), X.human_size_console(F.col("file_bytes")).alias("f"), X.plural_files(F.col("done")).alias("files")).first()
    except Exception as e:
        print(f"scan failed: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    if not a.quiet:
        print(reports.to_csv(records) if a.csv else reports.to_text_table(records), end="")
    if a.save:
        try:
            reports.save_csv(a.save, records)
        except OSError as e:
            print(f"report can't be saved: {e}", file=sys.stderr)
            return 1
    print(f"\nФайлов: {total['done']}, прочитано {total['r']} из {total['f']}, время {time.monotonic() - began:.3f} с")
    print(f"Повреждённых: {total['corrupted']}, не изображений: {total['not_image']}, с предупреждениями: {total['warnings']}")
    if total["errors"]:
        print(f"Файлов с ошибками: {total['errors']}")
    return 2 if a.strict and total["errors"] else 0


if __name__ == "__main__":
    sys.exit(main())

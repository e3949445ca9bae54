"""The data source `raster_files`: lists files under roots, reads ranges of them on the executors and gives records. Batch and stream.

Files are dealt to partitions by bytes. The driver lists the roots' files in several threads; with `listing=executors` it looks only for as many
folders as there is work for, and executors list what is below them, so a collection of any size costs the driver a few folders. A root
that can't be listed becomes a record of its own (problem ROOT) and the others are scanned. Roots have to be paths that every executor sees (a
shared file system); for stores that only Spark reads, `binary_files` takes contents through Spark's own reader.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from rasterlake.functions.labels import DEFAULT_EXTENSIONS
from rasterlake.operators import engine
from rasterlake.operators.reader import Reader


def matches(path: str, extensions: tuple[str, ...]) -> bool:
    """ASCII case-insensitive; no extensions: all."""
    return not extensions or os.path.splitext(path)[1].lower() in extensions


def _folder(folder: str, extensions: tuple[str, ...], links: bool) -> tuple[list[os.DirEntry], list[str]]:
    """Files and folders of a folder; what can't be read is left out."""
    files, folders = [], []
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=links):
                        folders.append(e.path)
                    elif matches(e.name, extensions) and e.is_file():
                        files.append(e)
                except OSError:
                    continue
    except OSError:
        pass
    return files, folders


def _walk(root: str, recursive: bool, extensions: tuple[str, ...], links: bool) -> Iterator[tuple[str, os.stat_result]]:
    """Files under a folder, several folders at a time. With links followed, a folder is entered once."""
    entered = {os.path.realpath(root)}
    with ThreadPoolExecutor(8) as pool:
        waiting = [root]
        while waiting:
            below: list[str] = []
            for files, folders in pool.map(lambda f: _folder(f, extensions, links), waiting):
                for e in files:
                    try:
                        yield e.path, e.stat()
                    except OSError:
                        continue
                below += folders if recursive else ()
            if links:
                real = {f: os.path.realpath(f) for f in below}
                below = [f for f in below if real[f] not in entered and not entered.add(real[f])]
            waiting = below


def _stats(root: str, recursive: bool = True, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, links: bool = False) -> list[tuple[str, os.stat_result]]:
    root = root.removeprefix("file://")
    if os.path.isfile(root):
        return [(root, os.stat(root))]
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such root: {root}")
    os.listdir(root)  # a root that can't be read is an error, unlike a folder below it
    return sorted(_walk(root, recursive, extensions, links), key=lambda f: f[0])


def listing(root: str, recursive: bool = True, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, links: bool = False) -> list[tuple[str, int]]:
    """(path, size) under root, sorted by path. A root that is a file is taken whatever its extension; folders that can't be read are skipped."""
    return [(path, s.st_size) for path, s in _stats(root, recursive, extensions, links)]


def folders_of(root: str, extensions: tuple[str, ...], links: bool, enough: int) -> tuple[list[str], list[str]]:
    """Folders to walk (all below them too) and folders to list alone, level by level until there are enough of the first."""
    whole, alone = [root], []
    while whole and len(whole) < enough:
        below = [f for folder in whole for f in _folder(folder, extensions, links)[1]]
        alone, whole = alone + whole, sorted(below)
    return whole, alone


class Files(InputPartition):
    """Files, each with the number of its root; folders to list (the flag: with all below them); roots that failed, with the reason."""

    def __init__(self, files: list[tuple[str, int]], folders: list[tuple[str, bool, int]] | None = None, failed: list[tuple[str, str, int]] | None = None):
        super().__init__(0)
        self.files, self.folders, self.failed = files, folders or [], failed or []


def deal(files: list[tuple[str, int, int]], bytes_each: int, most: int) -> list[Files]:
    """Files (path, size, root) in partitions of about bytes_each bytes and at most `most` files."""
    out: list[list[tuple[str, int]]] = []
    size = 0
    for path, n, root in files:
        n += 65_536  # opening a file costs as much as reading some
        if not out or size + n > bytes_each or len(out[-1]) >= most:
            out.append([])
            size = 0
        out[-1].append((path, root))
        size += n
    return [Files(x) for x in out]


class _Options:
    def __init__(self, options: dict, schema=None):
        self.wanted = schema or engine.RECORD_SCHEMA
        self.roots = [r for r in (options.get("roots") or options.get("path") or "").split("\n") if r]
        self.recursive = options.get("recursive", "true") == "true"
        self.deep = options.get("deep", "false") == "true"
        self.links = (options.get("followSymlinks") or options.get("followsymlinks") or "false") == "true"
        self.extensions = tuple(e.lower() for e in options.get("extensions", ",".join(DEFAULT_EXTENSIONS)).split(",") if e)
        self.dedupe = options.get("dedupe", "false") == "true"
        self.limits = engine.limits_from(options)
        self.bytes_each = int(options.get("partition_bytes", 64 << 20))
        self.remote = options.get("listing", "driver") == "executors"
        self.settle = float(options.get("settle_seconds", 0.05))

    def stats(self) -> tuple[list[tuple[str, os.stat_result, int]], list[tuple[str, str, int]]]:
        """(path, stat, root's number) in the order of the roots, and (root, reason, number) of those that failed."""
        files, failed, seen = [], [], set()
        for k, root in enumerate(self.roots):
            try:
                found = _stats(root, self.recursive, self.extensions, self.links)
            except OSError as e:
                failed.append((root, e.strerror or str(e), k))
                continue
            files += [(path, s, k) for path, s in found if not (self.dedupe and path in seen)]
            if self.dedupe:
                seen.update(path for path, _ in found)
        return files, failed

    def partitions(self) -> list[Files]:
        if self.remote and self.recursive and not self.dedupe:
            return self.remote_partitions()
        files, failed = self.stats()
        return deal([(p, s.st_size, k) for p, s, k in files], self.bytes_each, 1000) + ([Files([], failed=failed)] if failed else []) or [Files([])]

    def remote_partitions(self, enough: int = 256) -> list[Files]:
        out: list[Files] = []
        for k, root in enumerate(self.roots):
            root = root.removeprefix("file://")
            try:
                if os.path.isfile(root):
                    out.append(Files([(root, k)]))
                    continue
                os.listdir(root)
            except OSError as e:
                out.append(Files([], failed=[(root, e.strerror or str(e), k)]))
                continue
            whole, alone = folders_of(root, self.extensions, self.links, enough)
            out += [Files([], [(f, True, k)]) for f in whole] + [Files([], [(f, False, k) for f in alone[a : a + 64]]) for a in range(0, len(alone), 64)]
        return out or [Files([])]

    def records(self, part: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.wanted)
        if part.failed:
            yield engine.batch_of([engine.analyse(root, None, error=why, code="ROOT") | {"root_ordinal": k} for root, why, k in part.failed], schema)
        below = ((path, k) for folder, deep, k in part.folders for path, _ in sorted(_walk(folder, deep, self.extensions, self.links), key=lambda f: f[0]))
        rows: list[dict] = []
        for path, k in chain(part.files, below):
            rows.append(self.record(path) | {"root_ordinal": k})
            if len(rows) == 64:
                yield engine.batch_of(rows, schema)
                rows = []
        if rows:
            yield engine.batch_of(rows, schema)

    def record(self, path: str) -> dict:
        try:
            reader = Reader(path=path)
        except OSError as e:
            return engine.analyse(path, None, error=e.strerror or "unreadable")
        try:
            return engine.analyse(path, reader, self.deep, self.limits)
        finally:
            reader.close()


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Files]:
        return self.options.partitions()

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.options.records(partition)


class _Stream(DataSourceStreamReader):
    """An offset is the time of the last change of a file's entry that was seen (which no one can set back): its size is fixed, however many files
    there are. A file that is written again is a new file. Files of the last settle_seconds wait for the next batch, as others of the same
    moment may not be listed yet. A root that can't be listed gives no files until it can."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(self.options.settle * 1e9)
        return {"until": max((s.st_ctime_ns for _, s, _ in self.options.stats()[0] if s.st_ctime_ns <= settled), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [(p, s.st_size, k) for p, s, k in self.options.stats()[0] if start["until"] < s.st_ctime_ns <= end["until"]]
        return deal(new, self.options.bytes_each, 1000)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.options.records(partition)


class RasterFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self):
        return engine.RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Options(dict(self.options), schema))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Options(dict(self.options), schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterFiles)


def binary_files(spark: SparkSession, roots: list[str], recursive: bool = True, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS) -> DataFrame:
    """path, content through Spark's reader, for stores that executors can't open. It leaves out empty files."""
    glob = "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(roots).select("path", "content")

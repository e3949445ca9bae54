"""Near-duplicate documents: 64-bit SimHash of word shingles, linked by anchor-point covering.

The anchors are the code words of a covering code of length 64: nine Hamming codes [7, 4] side by side, each of covering radius 1,
and one free bit. The nearest anchor of a point is found block by block. Two fingerprints that differ in at most DISTANCE = 2 bits
have a point half-way, within one bit of either; the nearest anchor of that point lies within the covering radius and one bit of
both. So each fingerprint is replicated to the nearest anchors of all points within one bit (26 on average, of 2^37; a full ball would
be larger and finds no more), and any two that link meet at one anchor at least. Members of an anchor are compared bit by bit.

Only distinct fingerprints are compared, so exact copies cost nothing. Fingerprints of an anchor with more than CROWD members are
linked exactly in another way: each goes to all points within one bit of it, and whoever shares a point is within two bits. That takes one
minimum for each point, combined before the shuffle, and no pairs. Components are found over fingerprints and handed to documents.

Null or empty texts, or those without a word, have fingerprint 0 and link like others; texts of fewer words than SHINGLE have one
shingle, the whole; repeated rows are linked; a null doc_id is a document that is never a component's smallest id unless all are
null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import bucket, checkpointed, shuffle_partitions, slices, text_bytes
from rasterlake.llm.graph import connected_components
from rasterlake.llm.jaccard import majority, similar

DISTANCE, SHINGLE, SEED = 2, 3, 42
#: An anchor's members beyond which they are linked by shared points.
CROWD = 64


def _hamming74() -> tuple[np.ndarray, list[list[int]]]:
    """For each 7-bit value its nearest code word, and the nearest code words of all values within one bit."""

    def syndrome(v: int) -> int:
        s = 0
        for i in range(7):
            if v >> i & 1:
                s ^= i + 1
        return s

    nearest = np.array([v ^ (1 << syndrome(v) - 1) if syndrome(v) else v for v in range(128)])
    reach = [sorted({int(nearest[v])} | {int(nearest[v ^ 1 << i]) for i in range(7)}) for v in range(128)]
    return nearest, reach


NEAREST, REACH = _hamming74()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else iter([b" ".join(words)])
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and, for each, the row that it is reached from."""
    u = fp.view(np.uint64)
    block = [((u >> np.uint64(7 * i)) & np.uint64(127)).astype(np.int64) for i in range(9)]
    home = u & np.uint64(1 << 63)
    for i in range(9):
        home = home | (NEAREST[block[i]].astype(np.uint64) << np.uint64(7 * i))
    rows = np.arange(len(fp))
    anchors, owners = [home, home ^ np.uint64(1 << 63)], [rows, rows]
    most = max(map(len, REACH))
    table = np.array([x + [-1] * (most - len(x)) for x in REACH])
    for i in range(9):
        clear = home & ~np.uint64(127 << 7 * i)
        for j in range(most):
            to = table[block[i], j]
            use = ((to >= 0) & (to != NEAREST[block[i]])).nonzero()[0]
            anchors.append(clear[use] | (to[use].astype(np.uint64) << np.uint64(7 * i)))
            owners.append(use)
    return np.concatenate(anchors).view(np.int64), np.concatenate(owners)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        anchor, owner = _replicas(fp)
        for a in range(0, len(anchor), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(anchor[a : a + 100_000]), pa.array(fp[owner[a : a + 100_000]])], ["anchor", "fp"])


def _links(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an anchor's members (rows sorted by anchor, at most CROWD of each) within DISTANCE."""
    a, b = [], []
    at = np.arange(len(anchor) - 1)
    for step in range(1, CROWD):
        at = at[at + step < len(anchor)]
        at = at[anchor[at] == anchor[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= DISTANCE]
        a.append(fp[near])
        b.append(fp[near + step])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs: as many connections, in fewer rows."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor. An anchor's rows may go on in the next batch; they wait for it."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    crowd: int | None = None  # an anchor whose members are all passed on

    def done(anchor: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(start, append=len(anchor))
        over = np.repeat(size > CROWD, size)
        if over.any():
            yield from passed(fp[over])
        two = np.repeat((size > 1) & (size <= CROWD), size)
        a, b = _forest(*_links(anchor[two], fp[two]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def passed(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp)), pa.nulls(len(np.unique(fp)), pa.int64())], ["a", "b"])

    for batch in batches:
        anchor = np.concatenate([held[0], batch.column("anchor").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([held[1], batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(anchor):
            continue
        if crowd is not None:
            n = int(np.searchsorted(anchor, crowd, side="right"))
            yield from passed(fp[:n])
            anchor, fp = anchor[n:], fp[n:]
            if not len(anchor):
                held = (anchor, fp)
                continue
            crowd = None
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last:
            yield from done(anchor[:last], fp[:last])
        held = (anchor[last:], fp[last:])
        if len(held[0]) > CROWD:
            crowd = int(anchor[-1])
            yield from passed(held[1])
            held = (held[0][:0], held[1][:0])
    if len(held[0]):
        yield from done(*held)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for a in range(0, len(fp), 2000):
            f = fp[a : a + 2000]
            yield pa.RecordBatch.from_arrays([pa.array((f.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(f, 65))], ["point", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """a, b: pairs of fingerprints within DISTANCE that connect all that link. distinct: fp, each once."""
    n = shuffle_partitions(distinct.sparkSession)
    near = distinct.mapInArrow(_replicate, "anchor long, fp long").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long")
    near = checkpointed(near)
    crowded = near.where("b is null").select(F.col("a").alias("fp")).distinct()
    points = crowded.mapInArrow(_points, "point long, fp long")
    # whoever shares a point is linked to the least that shares it
    shared = points.groupBy("point").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m != x").select("point", "m")
    linked = points.join(shared, "point").where("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return near.where("b is not null").unionAll(linked)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id, the smallest doc_id that links reach."""
    prints = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = connected_components(links(nodes.select("fp")))
    # components are named by a fingerprint; each gets its smallest doc_id
    member = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("node").alias("component_id"))
    named = checkpointed(member.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each group of texts that pairs with a Jaccard similarity of 0.8 or more over their shingles of five words connect: the one with the
    smallest doc_id (null counts as the largest), of equal ids the one whose text has the smallest hash. Rows with the same id and text are one
    document twice; rows with the same id and unlike texts are two documents. Texts without a word are alike. Columns stay.

    Links within DISTANCE bits are taken first, confirmed by the sets of shingles; as most such pairs lie further apart, `jaccard` finds the others.
    Only rows of groups are shuffled, told from the others by a table of buckets."""
    k0, k1 = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = similar(docs.select(k0.alias("k0"), k1.alias("k1"), F.col("text").cast("string").alias("text")), shingle, links)
    groups = checkpointed(found.where("rows > 1").select("k0", "k1", (F.struct("k0", "k1") == F.col("first")).alias("stays")).distinct())
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), k0.alias("k0"), k1.alias("k1"))
    buckets = F.broadcast(groups.select(bucket("k0", "k1").alias("_b")).distinct())
    alone = rows.join(buckets, bucket(rows["k0"], rows["k1"]) == F.col("_b"), "left_anti")
    asked = rows.join(buckets, bucket(rows["k0"], rows["k1"]) == F.col("_b"), "left_semi").join(groups, ["k0", "k1"], "left")
    # of rows with equal id and text, the one whose other columns have the smallest hash
    others = F.xxhash64(F.to_json(F.struct(*(F.col(f"_row.`{c}`") for c in docs.columns if c != "text"))))
    one = asked.where("stays").groupBy("k0", "k1").agg(F.min_by("_row", others).alias("_row"))
    return alone.select("_row.*").unionAll(asked.where("stays is null").select("_row.*")).unionAll(one.select("_row.*"))

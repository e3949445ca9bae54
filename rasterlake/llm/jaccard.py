"""Documents whose sets of word shingles have a Jaccard similarity of SHARE or more, found exactly.

First come the links that another operator offers (fingerprints that lie close). They join copies that hardly differ, but no distance of short
fingerprints reaches every pair, so the rest is found by a prefix filter that misses none: two similar sets have a common shingle among the first n - ceil(SHARE n) + 1 of each, in any order that both follow. The order puts the HEAVY shingles
that many texts bear last and goes by hash otherwise, so few texts meet at a shingle that says little; which ones are heavy is counted on
an eighth of the texts, which changes what is compared but never what is found.

Equal sets are compared once. With those links each text of a shingle is confirmed against the first of them, which joins most of a large group;
then the pairs that aren't in one component yet are compared. A pair is dropped by two bounds that no similar pair can miss: the ratio
of sizes, and the sum by which the counts of 128 hash buckets differ (modulo 16), at most the size of the symmetric difference. What
passes is confirmed by the whole sets. Sets are the same up to 64-bit hash collisions, confirmed by 48 bits of each shingle's hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import bucket, checkpointed, release, shuffle_partitions, slices, text_bytes
from rasterlake.llm.graph import connected_components
from rasterlake.llm.substring_dedup import window_hashes, word_hashes

#: SHARE as a fraction: 4/5.
NUMERATOR, DENOMINATOR = 4, 5
HEAVY, SAMPLE, SEEN = 100_000, 8, 8
FLUSH = 200_000

#: The counts, modulo 16, of 128 buckets, sixteen to a long.
_SKETCH = [f"s{k}" for k in range(8)]


def hashes(text: bytes, size: int) -> np.ndarray:
    """The hashes of a text's shingles, with repeats; a text with fewer words has one, the whole."""
    words = word_hashes(text.lower().split())
    return window_hashes(words, min(size, len(words))) if len(words) else words


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        ones += np.unpackbits(h[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def shingles(text: bytes, size: int) -> np.ndarray:
    return np.unique(hashes(text, size))


def _key(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - 2**63


def _longs(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


def _sketch(s: np.ndarray) -> np.ndarray:
    counts = (np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 15).astype(np.uint8)
    return (counts[:64] | counts[64:] << 4).view(np.int64)


def _fine(s: np.ndarray) -> bytes:
    """The counts, modulo 16, of about as many buckets as there are shingles (128 to 8192), two to a byte."""
    buckets = max(128, min(8192, 1 << max(len(s) - 1, 0).bit_length()))
    counts = (np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 15).astype(np.uint8)
    return (counts[: buckets // 2] | counts[buckets // 2 :] << 4).tobytes()


def _counts(fine: bytes, buckets: int) -> np.ndarray:
    both = np.frombuffer(fine, np.uint8)
    return np.concatenate([both & 15, both >> 4]).reshape(-1, buckets).sum(axis=0, dtype=np.int64)


def _profiles(size: int):
    """k0, k1, and of the text's set: key, n, fp, sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, n, fp, fine, sketch = [], [], [], [], []
            for t in text_bytes(batch.column("text")):
                h = hashes(t, size)
                s = np.unique(h)
                key.append(_key(s))
                n.append(len(s))
                fp.append(majority(h))
                fine.append(_fine(s))
                sketch.append(_sketch(s))
            sketches = np.array(sketch, np.int64).reshape(-1, len(_SKETCH))
            columns = [_longs(key), _longs(n), _longs(np.array(fp, np.uint64).view(np.int64)), pa.array(fine, pa.binary()), *(_longs(sketches[:, k].copy()) for k in range(len(_SKETCH)))]
            yield pa.RecordBatch.from_arrays([batch.column("k0"), batch.column("k1"), *columns], ["k0", "k1", "key", "n", "fp", "fine", *_SKETCH])

    return run


def _sets(size: int):
    """key, set: 48 bits of each hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            key, body = [], []
            for t in text_bytes(batch.column("text")):
                s = shingles(t, size)
                key.append(_key(s))
                body.append(np.ascontiguousarray((s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            yield pa.RecordBatch.from_arrays([_longs(key), pa.array(body, pa.binary())], ["key", "set"])

    return run


def _set(body: bytes) -> np.ndarray:
    six = np.frombuffer(body, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _tokens(size: int):
    """token, key: all shingles of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for t in text_bytes(batch.column("text")):
                s = shingles(t, size)
                for a in range(0, len(s), FLUSH):
                    yield pa.RecordBatch.from_arrays([_longs(s[a : a + FLUSH].view(np.int64)), _longs(np.full(len(s[a : a + FLUSH]), _key(s)))], ["token", "key"])

    return run


def heavy(docs: DataFrame, size: int) -> np.ndarray:
    """At most HEAVY shingles that many texts bear, sorted; counted on the texts of an eighth of all hashes, copies once."""
    some = docs.where(F.pmod("k1", F.lit(SAMPLE)) == 0).select("text")
    counts = checkpointed(some.mapInArrow(_tokens(size), "token long, key long").distinct().groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= SEEN))
    step = F.floor(F.log2("c") * 64).cast("int")
    bound, held = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        held += r["count"]
        if held > HEAVY:
            break
        bound = r["s"]
    if bound is None:
        return np.empty(0, np.uint64)
    return np.sort(np.array([r["token"] for r in counts.where(step >= bound).select("token").collect()], np.int64).view(np.uint64))


def _prefixes(size: int, last: np.ndarray):
    """token, key: for each text the shingles at which a similar one must meet it. Equal texts of a task are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in slices(batches):
            tokens, keys = [], []
            for t in text_bytes(batch.column("text")):
                s = shingles(t, size)
                n, key = len(s), _key(s)
                if not n or key in sent:
                    continue
                if len(sent) < FLUSH:
                    sent.add(key)
                at = np.minimum(np.searchsorted(last, s), max(0, len(last) - 1))
                common = last[at] == s if len(last) else np.zeros(n, bool)
                first = np.concatenate([s[~common], s[common]])[: n - -(-NUMERATOR * n // DENOMINATOR) + 1]
                tokens.append(first.view(np.int64))
                keys.append(np.full(len(first), key))
            if tokens:
                token, key = np.concatenate(tokens), np.concatenate(keys)
                for a in range(0, len(token), FLUSH):
                    yield pa.RecordBatch.from_arrays([_longs(token[a : a + FLUSH]), _longs(key[a : a + FLUSH])], ["token", "key"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows, sorted by token, as matrices in which no token is cut."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else None
        if rows is None:
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if held and held[-1][-1, 0] != rows[0, 0]:
            yield np.concatenate(held)
            held = []
        if cut:
            yield np.concatenate([*held, rows[:cut]])
            held = []
        held.append(rows[cut:])
    if held:
        yield np.concatenate(held)
    release()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, key of tokens that more than one key bears, each once. Rows come sorted by both."""
    for rows in _whole_groups(batches):
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        same = rows[1:, 0] == rows[:-1, 0]
        use = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        for a in range(0, len(use), FLUSH):
            yield pa.RecordBatch.from_arrays([_longs(use[a : a + FLUSH, k].copy()) for k in range(2)], ["token", "key"])


def _possible(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs a, b of rows (token, key, root, n, sketch) may be similar."""
    m, n = rows[a, 3], rows[b, 3]
    near = (DENOMINATOR * np.minimum(m, n) >= NUMERATOR * np.maximum(m, n)) & (rows[a, 2] != rows[b, 2])
    left = np.flatnonzero(near)
    for x in range(0, len(left), 20_000):
        i = left[x : x + 20_000]
        near[i] = _close(rows[a[i], 4:], rows[b[i], 4:], m[i] + n[i])
    return near


def _close(p: np.ndarray, q: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether the sketches p and q leave room for similar sets of `total` shingles together."""
    x, y = (np.ascontiguousarray(v).view(np.uint8) for v in (p, q))
    differ = np.zeros(len(x), np.int64)
    for u, v in ((x & 15, y & 15), (x >> 4, y >> 4)):
        d = (u - v) & 15
        differ += np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
    return (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * total


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        yield pa.RecordBatch.from_arrays([_longs(np.ascontiguousarray(both[:, 0])), _longs(np.ascontiguousarray(both[:, 1]))], ["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of each token with the others. Rows: token, key."""
    for rows in _whole_groups(batches):
        start = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        first = np.flatnonzero(start)[np.cumsum(start) - 1]
        yield from _pairs(rows[first[~start], 1], rows[~start, 1])


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a token that may be similar and whose components differ. Rows: token, key, root, n, sketch, sorted by token and n."""
    for rows in _whole_groups(batches):
        found, held = [], 0
        at = np.arange(len(rows))
        step = 0
        while True:
            step += 1
            at = at[at + step < len(rows)]
            # rows come by size, so beyond the first that is too large all are
            at = at[(rows[at, 0] == rows[at + step, 0]) & (DENOMINATOR * rows[at, 3] >= NUMERATOR * rows[at + step, 3])]
            if not len(at):
                break
            use = at[_possible(rows, at, at + step)]
            found.append((rows[use, 1], rows[use + step, 1]))
            held += len(use)
            if held > FLUSH:
                yield from _pairs(*map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
        if found:
            yield from _pairs(*map(np.concatenate, zip(*found, strict=True)))


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of tokens at which more than one component meets. Rows: token, key, root."""
    for rows in _whole_groups(batches):
        start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        many = np.minimum.reduceat(rows[:, 2], start) != np.maximum.reduceat(rows[:, 2], start)
        use = rows[np.repeat(many, np.diff(start, append=len(rows)))]
        for a in range(0, len(use), FLUSH):
            yield pa.RecordBatch.from_arrays([_longs(use[a : a + FLUSH, k].copy()) for k in range(3)], ["token", "key", "root"])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and fine sketches allow that they are similar."""
    for batch in batches:
        near = []
        for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "fine_a", "fine_b")), strict=True):
            fits = DENOMINATOR * min(m, n) >= NUMERATOR * max(m, n)
            if fits:
                buckets = 2 * min(len(x), len(y))
                d = (_counts(x, buckets) - _counts(y, buckets)) & 15
                fits = (DENOMINATOR + NUMERATOR) * int(np.minimum(d, 16 - d).sum()) <= (DENOMINATOR - NUMERATOR) * (m + n)
            near.append(fits)
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        a, b = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
        good = []
        for x, y in zip(a, b, strict=True):
            both = len(np.intersect1d(_set(x), _set(y), assume_unique=True))
            good.append(DENOMINATOR * both >= NUMERATOR * ((len(x) + len(y)) // 6 - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def similar(docs: DataFrame, size: int, near_fingerprints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs: k0, k1 (a row's identity) and text. One row for each row of docs: k0, k1, component (of its set), and the component's `first`,
    the smallest (k0, k1), and `rows`. near_fingerprints gives pairs a, b of close fingerprints from a column fp that holds each once."""
    n = shuffle_partitions(docs.sparkSession)
    by_token = lambda x, *order: x.repartition(n, "token").sortWithinPartitions("token", *order)
    columns = "k0 long, k1 long, key long, n long, fp long, fine binary, " + ", ".join(f"{c} long" for c in _SKETCH)
    own = checkpointed(docs.mapInArrow(_profiles(size), columns))
    nodes = checkpointed(own.groupBy("key").agg(F.min(F.struct("k0", "k1")).alias("node"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ["n", "fp", "fine", *_SKETCH])))
    met = by_token(docs.mapInArrow(_prefixes(size, heavy(docs, size)), "token long, key long"), "key")
    shared = checkpointed(met.mapInArrow(_shared, "token long, key long"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs a, b that are similar: fine sketches first, then the sets of those that are left."""
        a, b = (nodes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}")) for c in ("a", "b"))
        left = checkpointed(pairs.distinct().join(a, "a").join(b, "b").mapInArrow(_fitting, "a long, b long"))
        keys = left.select(F.col("a").alias("key")).unionAll(left.select("b")).distinct()
        wanted = checkpointed(nodes.select("key", "node").join(keys, "key", "left_semi").select("node.*"))
        likely = docs.join(F.broadcast(wanted.select(bucket("k0", "k1").alias("_b")).distinct()), bucket(docs["k0"], docs["k1"]) == F.col("_b"), "left_semi")
        sets = checkpointed(likely.join(wanted, ["k0", "k1"], "left_semi").dropDuplicates(["k0", "k1"]).mapInArrow(_sets(size), "key long, set binary"))
        a, b = (sets.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
        return checkpointed(left.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long"))

    def placed(rows: DataFrame, edges: DataFrame) -> DataFrame:
        """rows with the root of their key."""
        roots = connected_components(edges).withColumnRenamed("node", "key")
        return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    prints = nodes.groupBy("fp").agg(F.min("key").alias("leader"))
    alike = nodes.select("fp", "key").join(prints, "fp").where("key != leader").select(F.col("leader").alias("a"), F.col("key").alias("b"))
    close = near_fingerprints(prints.select("fp"))
    close = close.join(prints.select(F.col("fp").alias("a"), F.col("leader").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("leader").alias("y")), "b")
    stars = by_token(shared, "key").mapInArrow(_stars, "a long, b long")
    edges = confirmed(alike.unionAll(close.select("x", "y")).unionAll(stars))

    rest = by_token(placed(shared, edges).select("token", "key", "root"), "key").mapInArrow(_open, "token long, key long, root long")
    rest = rest.join(nodes.select("key", "n", *_SKETCH), "key").select("token", "key", "root", "n", *_SKETCH)
    edges = edges.unionAll(confirmed(by_token(rest, "n", "key").mapInArrow(_others, "a long, b long")))

    member = placed(nodes.select("key", "node", "rows"), edges)
    whole = member.groupBy("root").agg(F.min("node").alias("first"), F.sum("rows").alias("rows"))
    named = checkpointed(member.select("key", "root").join(whole, "root"))
    return own.select("k0", "k1", "key").join(named, "key").select("k0", "k1", F.col("root").alias("component"), "first", "rows")

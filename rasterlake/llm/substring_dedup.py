"""Repeated passages, found by difference-cover anchors.

A window is WINDOW consecutive words. It repeats if its word sequence also starts somewhere else, in the same document or
another. COVER is a difference cover modulo PERIOD: for any two positions i and j there is a shift d below PERIOD that puts both
i + d and j + d on cover positions. So two equal windows share an anchor (ANCHOR words, ANCHOR + PERIOD - 1 = WINDOW) at an
aligned cover position of each, and only the anchors at cover positions, 5 in 21, are hashed and shuffled. Documents with an
anchor that occurs twice then extend it: every window that holds such an anchor is a candidate, and candidates are compared by
their whole word sequence (96-bit hash). Texts that occur twice as a whole need no extension: all their windows repeat, and one of
the copies stands in for the others.

Every map task first looks for repeats among its own rows and sends each hash once, so a passage in a third of all documents
costs one row for each task. The result is exact up to hash collisions: no bucket is capped, no text is cut.

Null or empty texts have no words and lose none; a repeated row is another document, so it repeats all windows of its twin; null
doc_ids are kept; other columns are ignored by `repeated_words` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import checkpointed, release, shuffle_partitions, slices, text_bytes, text_key

WINDOW, PERIOD = 35, 21
#: A perfect difference set modulo 21: each difference 1 to 20 occurs once.
COVER = (3, 6, 7, 12, 14)
#: What a map task holds of hashes before it sends them on; 33 bytes each, some three times that while they are sorted.
FLUSH = 500_000

_B = np.uint64(0x9E3779B97F4A7C15)
_B2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Positions that stand for a whole text: an extra copy, and the copy that speaks for the others.
COPY, SPEAKER = -1, -2


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_pow: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        have = _pow[int(base)] = _powers(base, max(n, 4096) * 2)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int, base: np.uint64 = _B) -> np.ndarray:
    """For each start, a hash of the size words from there: Horner's rule in log2(size) doublings, no inverse needed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, out, power = 0, np.zeros(len(h), np.uint64), h
    width, factor = 1, int(base)
    while True:
        if size & width:
            # out covers `done` words before; append the next `width` words
            m = len(h) - done - width + 1
            out = out[:m] * np.uint64(factor) + power[done : done + m]
            done += width
        if done == size:
            return _mix(out[:n])
        m = len(power) - width
        power = power[:m] * np.uint64(factor) + power[width : width + m]
        factor = factor * factor % 2**64
        width *= 2


def is_cover(n: int) -> np.ndarray:
    table = np.zeros(PERIOD, bool)
    table[list(COVER)] = True
    return table[np.arange(n) % PERIOD]


def _squeezed(x: np.ndarray) -> bytes:
    """Row keys and positions come in runs, so they are sent at a fraction of their size."""
    return zstandard.compress(x.tobytes(), 1)


def _unsqueezed(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


class _Sender:
    """Collects (hash, row, position), finds repeats among its own and sends each hash once."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, h: np.ndarray, hi: np.ndarray, k0: int, k1: int, pos: np.ndarray, wants: bool = True) -> Iterator[dict]:
        if len(h):
            self.parts.append((h, hi, np.full(len(h), k0, np.int64), np.full(len(h), k1, np.int64), pos.astype(np.int32), np.full(len(h), wants)))
            self.size += len(h)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if not self.parts:
            return
        h, hi, k0, k1, pos, wants = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order, start, count = _groups(h, hi)
        twice = count >= 2
        # what repeats here is known already; only the receiver can choose the copy that speaks for the others
        known = np.zeros(len(h), bool)
        known[order] = np.repeat(twice, count)
        first = np.zeros(len(h), bool)
        first[order[start]] = True
        whole = pos == COPY
        answer = known & wants & ~(whole & first)
        sent = first.nonzero()[0]
        bucket = (h[sent] % np.uint64(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        sent, bucket = sent[by], bucket[by]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(sent)], strict=True):
            i = sent[a:b]
            yield {"p": int(bucket[a]), "h": h[i].tobytes(), "hi": hi[i].tobytes() if hi.any() else b"", "k0": _squeezed(k0[i]), "k1": _squeezed(k1[i]), "pos": _squeezed(pos[i]), "flag": _squeezed((known[i] | (~wants[i] << 1)).astype(np.uint8))}
        if answer.any():
            i = answer.nonzero()[0]
            each = max(1, FLUSH // 16)
            for a in range(0, len(i), each):
                j = i[a : a + each]
                yield {"p": int((k0[j[0]] ^ k1[j[0]]) % self.buckets), "h": b"", "hi": b"", "k0": _squeezed(k0[j]), "k1": _squeezed(k1[j]), "pos": _squeezed(pos[j]), "flag": b""}


def _groups(h: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((hi, h)) if hi.any() else np.argsort(h, kind="stable")
    a, b = h[order], hi[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = new.nonzero()[0]
    return order, start, np.diff(start, append=len(h))


_SENT = "p int, h binary, hi binary, k0 binary, k1 binary, pos binary, flag binary"
_FOUND = "k0 long, k1 long, pos binary"


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ANSWER_ARROW = pa.schema([("p", pa.int32()), *((x, pa.binary()) for x in ("k0", "k1", "pos"))])
_SENT_ARROW = pa.schema([("p", pa.int32()), *((x, pa.binary()) for x in ("h", "hi", "k0", "k1", "pos", "flag"))])


def _by_row(k0: np.ndarray, k1: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(k0):
        return
    order = np.lexsort((pos, k1, k0))
    k0, k1, pos = k0[order], k1[order], pos[order]
    cut = np.flatnonzero(np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]))
    ends = np.append(cut[1:], len(k0))
    for a in range(0, len(cut), 5000):
        s, e = cut[a : a + 5000], ends[a : a + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(k0[s]), pa.array(k1[s]), pa.array([pos[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary())], ["k0", "k1", "pos"])


def _find(buckets: int):
    """All that was sent of a hash is here: answers those whose hash has another occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        done: list[tuple] = []
        for batch in batches:
            for h, hi, k0, k1, pos, flag in zip(*(batch.column(x).to_pylist() for x in ("h", "hi", "k0", "k1", "pos", "flag")), strict=True):
                row = (_unsqueezed(k0, np.int64), _unsqueezed(k1, np.int64), _unsqueezed(pos, np.int32))
                if h:
                    got.append((np.frombuffer(h, np.uint64), np.frombuffer(hi, np.uint32) if hi else np.zeros(len(h) // 8, np.uint32), *row, _unsqueezed(flag, np.uint8)))
                else:
                    done.append(row)
        if got:
            h, hi, k0, k1, pos, flag = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            order, start, count = _groups(h, hi)
            known = np.maximum.reduceat(flag[order] & 1, start) > 0
            repeats = np.zeros(len(h), bool)
            repeats[order] = np.repeat(known | (count >= 2), count)
            answer = repeats & (flag < 2) & ((flag == 0) | (pos == COPY))
            pos = pos.copy()
            first = order[start]
            speaks = first[(pos[first] == COPY) & answer[first]]
            pos[speaks] = SPEAKER
            done.append((k0[answer], k1[answer], pos[answer]))
        if sum(len(x[0]) for x in done):
            # each document's answers go to one place; many documents' in one row, so that rows don't grow with partitions times documents
            k0, k1, pos = (np.concatenate(x) for x in zip(*done, strict=True))
            to = (_mix((k0 ^ k1).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((pos, k1, k0, to))
            cut = np.flatnonzero(np.diff(to[order], prepend=-1))
            rows = [{"p": int(to[order[a]]), **{c: _squeezed(x[order[a:b]]) for c, x in (("k0", k0), ("k1", k1), ("pos", pos))}} for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]
            yield _table(rows, _ANSWER_ARROW)
        release()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [tuple(_unsqueezed(x, t) for x, t in zip(row, (np.int64, np.int64, np.int32), strict=True)) for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "pos")), strict=True)]
    if got:
        yield from _by_row(*(np.concatenate(x) for x in zip(*got, strict=True)))
    release()


def _repeats(sent: DataFrame, buckets: int) -> DataFrame:
    """(k0, k1, positions) of what repeats, one row for each document."""
    n = buckets // 4
    answers = sent.repartition(n, "p").mapInArrow(_find(n), "p int, k0 binary, k1 binary, pos binary")
    return answers.repartition(n, "p").mapInArrow(_gather, _FOUND)


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets)
        for batch in slices(batches):
            rows: list[dict] = []
            for text, k0, k1 in zip(text_bytes(batch.column("text")), batch.column("k0").to_pylist(), batch.column("k1").to_pylist(), strict=True):
                words = text.split()
                if len(words) < WINDOW:
                    continue
                h = window_hashes(word_hashes(words), WINDOW - PERIOD + 1)
                at = is_cover(len(h)).nonzero()[0]
                whole = xxhash.xxh3_64_intdigest(b" ".join(words), 1)
                h = np.append(h[at], np.uint64(whole))
                rows += out.add(h, np.zeros(len(h), np.uint32), k0, k1, np.append(at, COPY))
            if rows:
                yield _table(rows, _SENT_ARROW)
        if rows := list(out.flush()):
            yield _table(rows, _SENT_ARROW)

    return run


def _candidates(n: int, anchors: np.ndarray) -> np.ndarray:
    """Starts of windows that hold one of the anchors."""
    mark = np.zeros(n - WINDOW + 2, np.int32)
    np.add.at(mark, np.maximum(anchors - (PERIOD - 1), 0), 1)
    np.add.at(mark, np.minimum(anchors, n - WINDOW) + 1, -1)
    return (np.cumsum(mark[:-1]) > 0).nonzero()[0]


def _positions(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x, np.int32) if x else np.empty(0, np.int32)


_STEP_SQL = "k0 long, k1 long, doc_id long, text binary, n_words long, n_removed long, kept_sha256 string, p int, h binary, hi binary, sk0 binary, sk1 binary, pos binary, flag binary"
_STEP_ARROW = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("p", pa.int32()), ("h", pa.binary()), ("hi", pa.binary()), ("sk0", pa.binary()), ("sk1", pa.binary()), ("pos", pa.binary()), ("flag", pa.binary())])


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _extend(buckets: int):
    """Ends documents without a repeated anchor and copies of whole texts; sends the others' candidate windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets)

        def sent(rows) -> list[dict]:
            return [{"p": x["p"], "h": x["h"], "hi": x["hi"], "sk0": x["k0"], "sk1": x["k1"], "pos": x["pos"], "flag": x["flag"]} for x in rows]

        for batch in slices(batches):
            rows: list[dict] = []
            for text, k0, k1, doc_id, found in zip(text_bytes(batch.column("text")), *(batch.column(x).to_pylist() for x in ("k0", "k1", "doc_id", "pos")), strict=True):
                words, anchors = text.split(), _positions(found)
                row = {"k0": k0, "k1": k1, "doc_id": doc_id, "n_words": len(words)}
                if not len(anchors):
                    rows.append(row | {"n_removed": 0, "kept_sha256": _sha(words)})
                    continue
                whole = anchors[anchors < 0]
                if len(whole):
                    rows.append(row | {"n_removed": len(words), "kept_sha256": _sha([])})
                    if SPEAKER not in whole:
                        continue
                else:
                    rows.append(row | {"text": zstandard.compress(text, 1)})
                h = word_hashes(words)
                at = _candidates(len(words), anchors[anchors >= 0])
                rows += sent(out.add(window_hashes(h, WINDOW)[at], (window_hashes(h, WINDOW, _B2)[at] >> np.uint64(32)).astype(np.uint32), k0, k1, at, wants=not len(whole)))
                if len(whole):  # what a copy speaks for occurs twice
                    rows += sent(out.add(window_hashes(h, WINDOW)[at], (window_hashes(h, WINDOW, _B2)[at] >> np.uint64(32)).astype(np.uint32), k0, k1, at, wants=False))
            yield _table(rows, _STEP_ARROW)
        if rows := sent(out.flush()):
            yield _table(rows, _STEP_ARROW)

    return run


def _kept(n: int, starts: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + WINDOW, -1)
    return np.cumsum(mark[:-1]) == 0


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4 << 20):  # texts are compressed
        rows = []
        for text, k0, k1, doc_id, found in zip(map(zstandard.decompress, batch.column("text").to_pylist()), *(batch.column(x).to_pylist() for x in ("k0", "k1", "doc_id", "pos")), strict=True):
            words = text.split()
            keep = _kept(len(words), _positions(found))
            left = [w for w, k in zip(words, keep, strict=True) if k]
            rows.append({"k0": k0, "k1": k1, "doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": _sha(left), "keep": np.packbits(keep).tobytes() if len(left) < len(words) else None})
        yield pa.RecordBatch.from_pylist(rows, _OUT_ARROW)


_OUT_ARROW = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("keep", pa.binary())])
_OUT_SQL = "k0 long, k1 long, doc_id long, n_words long, n_removed long, kept_sha256 string, keep binary"


def _extended(docs: DataFrame, buckets: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(*text_key(), "doc_id", "text")
    anchors = _repeats(rows.drop("doc_id").mapInArrow(_anchors(buckets), _SENT), buckets)
    return rows.join(anchors, ["k0", "k1"], "left").mapInArrow(_extend(buckets), _STEP_SQL)


def repeated_words(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: k0, k1 (its identity, see `text_key`), doc_id, n_words, n_removed, kept_sha256 and keep, a bit
    for each word (null: all words stay, or none does, by n_removed)."""
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    step = checkpointed(_extended(docs, buckets))
    windows = step.where("p is not null").select("p", "h", "hi", F.col("sk0").alias("k0"), F.col("sk1").alias("k1"), "pos", "flag")
    ended = step.where("kept_sha256 is not null").select("k0", "k1", "doc_id", "n_words", "n_removed", "kept_sha256", F.lit(None).cast("binary").alias("keep"))
    open_ = step.where("text is not null").select("k0", "k1", "doc_id", "text")
    return ended.unionAll(open_.join(_repeats(windows, buckets), ["k0", "k1"], "left").mapInArrow(_finish, _OUT_SQL))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, removed, keep in zip(batch.column("text").to_pylist(), *(batch.column(x).to_pylist() for x in ("n_removed", "keep")), strict=True):
            if removed:
                words = text.encode().split()
                bits = np.unpackbits(np.frombuffer(keep, np.uint8), count=len(words))
                text = b" ".join(w for w, k in zip(words, bits, strict=True) if k).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without its repeated words: the kept ones joined by single spaces. Texts that lose nothing stay as they are; documents that
    lose every word go. Columns stay, n_chars counts the new text if there is such a column."""
    marks = repeated_words(docs).where("n_removed > 0").select("k0", "k1", "n_words", "n_removed", "keep").dropDuplicates(["k0", "k1"])
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    body = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), *text_key(), "text")
    left = body.join(marks, ["k0", "k1"], "left").where("n_removed is null or n_removed < n_words").select("row", "text", "n_removed", "keep")
    out = left.mapInArrow(_rewrite, left.select("row", "text").schema)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))

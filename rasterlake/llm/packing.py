"""Best-fit packing of tokenised documents with a Martello-Toth dominance reduction.

How documents pack depends on their lengths alone, and a length is 1 to CAPACITY tokens. So the plan is made from a histogram of at
most CAPACITY rows, whatever the number of documents: first the reduction fixes sets that provably dominate every other way to fill a
sequence around a document (alone, with one partner, with two), then best-fit in order of decreasing length packs what is left. Both work on
whole classes of equal documents at once. Documents get their places by their rank among those of equal length; ranks are counted
within salted buckets of a length, so that a length that many documents share is no one's group.

A null or empty text is a document of the single id 0; texts, words and white space of any length are encoded whole; repeated rows are packed
twice; null doc_ids are kept; other columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import checkpointed, slices, texts

CAPACITY = 2048
#: Ids that a worker remembers for words, in entries.
REMEMBERED = 200_000


#: White space or a word of such a length goes to the tokenizer itself: the fast encoder recurses on the one and is quadratic on the other.
_LONG = re.compile(r"\s{128}|\S{1024}")
_LOOSE = re.compile(r" \s")


class Words(dict):
    """The ids, as little-endian bytes, of a word with the space before it; always those that the tokenizer gives for the whole text.

    The vocabulary's pattern never joins what stands on both sides of a single space, but for the space itself, so texts without a space
    before other white space can be encoded word by word, and most words are met again. Other texts are encoded as a whole; those with the string of
    an added token, or with very long words or white space, by the tokenizer itself.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        import tiktoken

        self.vocabulary, self.tokenizer = vocabulary, None
        with open(vocabulary, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        ranks, pattern = read_vocabulary(vocabulary)
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else self.whole

    def whole(self, text: str) -> list[int]:
        """By the tokenizer itself, which takes as much memory again and is loaded when a text needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.vocabulary)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(word) < 64:
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if self.special and self.special.search(text) or _LONG.search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        if not text or text[-1] == " " or _LOOSE.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, _, rest = text.partition(" ")
        start = np.array(self.encode(first), "<u4").tobytes() if first else b""
        return start + b"".join(map(self.__getitem__, rest.split(" "))) if _ else start


@lru_cache(maxsize=1)
def words_of(vocabulary: str) -> Words:
    """A worker's vocabulary, with what it remembers, serves one task after the other."""
    return Words(vocabulary)


def read_vocabulary(path: str) -> tuple[dict[bytes, int], str]:
    """The same byte-level vocabulary as ranks, which encodes faster, if it lies beside the tokenizer's file."""
    import os

    import public_tokenizers

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return {}, ""
    with open(ranks, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(vocabulary: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary or vocabulary_path())
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                ids = words.ids(text) + b"\0\0\0\0"
                n = len(ids) // 4
                start, length = 0, (n - 1) % capacity + 1
                for piece in range(math.ceil(n / capacity)):
                    for x, v in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        x.append(v)
                    start, length = start + length, capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def reduce_instance(count: list[int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Takes sets that dominate all alternatives out of count (documents of each length); returns (lengths and their numbers, sequences)."""
    fixed: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(sizes: list[int]) -> None:
        need = {s: sizes.count(s) for s in sizes}
        times = min(count[s] // k for s, k in need.items())
        for s, k in need.items():
            count[s] -= times * k
        fixed.append((tuple(need.items()), times))

    for big in range(capacity, 0, -1):
        while count[big]:
            room = capacity - big
            count[big] -= 1  # the one that the others are set beside
            partner = next((s for s in range(min(room, big), 0, -1) if count[s]), 0)
            small: list[int] = []
            for s in range(1, big + 1):
                small += [s] * min(count[s], 3 - len(small))
                if len(small) == 3:
                    break
            chosen: list[int] | None = None
            if not partner:
                chosen = [big]
            elif big + partner == capacity or len(small) < 2 or small[0] + small[1] > room:
                chosen = [big, partner]
            elif len(small) < 3 or sum(small) > room:
                # no more than two fit beside it
                if _best_pair(count, room, big) <= partner:
                    chosen = [big, partner]
                else:
                    count[partner] -= 1
                    third = next((s for s in range(min(room - partner, big), 0, -1) if count[s]), 0)
                    count[partner] += 1
                    if third:
                        over: list[int] = []
                        for s in range(third + 1, big + 1):
                            over += [s] * min(count[s], 2 - len(over))
                            if len(over) == 2:
                                break
                        if len(over) < 2 or sum(over) > room:
                            chosen = [big, partner, third]
            count[big] += 1
            if not chosen:
                break
            take(chosen)
    return fixed


def _best_pair(count: list[int], room: int, big: int) -> int:
    sizes = [s for s in range(1, min(room, big) + 1) if count[s]]
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total <= room:
            if i != j or count[sizes[i]] > 1:
                best = max(best, total)
            i += 1
        else:
            j -= 1
    return best


def best_fit(count: list[int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit in order of decreasing length. Sequences filled alike are one group."""
    groups: dict[int, list[tuple[tuple, int]]] = {}  # by room left: (what is in, sequences)

    def put(room: int, inside: tuple, times: int) -> None:
        if times:
            groups.setdefault(room, []).append((inside, times))

    for size in range(capacity, 0, -1):
        left = count[size]
        while left:
            room = next((r for r in range(size, capacity + 1) if groups.get(r)), 0)
            if room:
                inside, times = groups[room].pop()
            else:
                room, inside, times = capacity, (), math.ceil(left / (capacity // size))
            each = room // size
            full = min(times, left // each)
            put(room - each * size, (inside, size, each), full)
            left -= full * each
            times -= full
            if left and times:
                put(room - left * size, (inside, size, left), 1)
                left, times = 0, times - 1
            if inside or room < capacity:
                put(room, inside, times)
    out = []
    for inside, times in itertools.chain.from_iterable(groups.values()):
        flat = []
        while inside:
            inside, size, k = inside
            flat.append((size, k))
        out.append((tuple(reversed(flat)), times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of equal documents: from rank `start` of length `size` on, `each` to a sequence, from sequence `first` and place `offset` on."""
    count = [histogram.get(s, 0) for s in range(capacity + 1)]
    groups = reduce_instance(count, capacity)
    groups += best_fit(count, capacity)
    used = [0] * (capacity + 1)
    rows, sequence = [], 0
    for sizes, times in groups:
        offset = 0
        for size, each in sizes:
            rows.append((size, used[size], sequence, each, offset))
            used[size] += times * each
            offset += size * each
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("size", "start", "first", "each", "offset"), table.T, strict=True))


def _place(runs: dict[str, np.ndarray]):
    key = runs["size"]
    first_of = {int(s): int(i) for s, i in zip(*np.unique(key, return_index=True), strict=True)}
    last_of = {int(s): int(np.searchsorted(key, s, side="right")) for s in first_of}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for s in np.unique(length):
                mine = length == s
                a, b = first_of[int(s)], last_of[int(s)]
                at[mine] = a + np.searchsorted(runs["start"][a:b], rank[mine], side="right") - 1
            within = rank - runs["start"][at]
            each = runs["each"][at]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(runs["first"][at] + within // each), pa.array(runs["offset"][at] + within % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: see the module. vocabulary: a tokenizer's file, byte_bpe_50k.json if none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = checkpointed(rows.mapInArrow(_pieces(vocabulary, capacity), schema))
    sizes = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in sizes.collect()}  # capacity rows at most
    spark = docs.sparkSession
    # a bucket has about the square root of a length's documents, so neither buckets nor their list are large
    buckets = spark.createDataFrame([(s, math.ceil(n / max(500, math.isqrt(n)))) for s, n in histogram.items()], "length long, buckets long")
    salted = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), "buckets")).drop("buckets")
    salted = checkpointed(salted)
    within = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = salted.groupBy("length", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = within.join(before.drop("count"), ["length", "bucket"]).withColumn("rank", (F.col("r") + F.col("before")).cast("long"))
    return ranked.mapInArrow(_place(plan(histogram, capacity)), schema + ", sequence_id long, offset long")

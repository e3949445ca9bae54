"""The pipeline's stages in a row, each against brute force on its own input, with the odd rows: nulls, empty texts, repeated ids, clashing names."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_lines

from rasterlake.llm import secret_scan
from rasterlake.llm.common import documents


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    docs = documents(spark, sf_dir)
    some = docs.where("text is not null").orderBy("doc_id").first()
    odd = [
        (None, some["text"], "en", "src0", 1), (None, None, None, None, None), (some["doc_id"], "A document of its own under an id that another one bears, with words enough to stay in.", "en", None, 86), (900_001, "", "en", "src0", 0),
        (900_002, "x " * 3000 + "and a long tail of <|endoftext|> words", "en", "src1", 6039), (900_003, "y" * 30_000 + " one two three four five six seven eight nine ten", "en", "src1", 30_049), (900_004, "one two three four five six seven eight nine ten DB_PASSWORD=Tr0ub4dor&3xyz end", "en", "src2", 80),
    ]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"row": F.lit("r"), "k0": F.lit(1), "component_id": F.lit(2), "_b": F.lit(3), "stays": F.lit(False), "gone": F.lit("g")})


@pytest.fixture(scope="module")
def stages(spark, sf_dir, source, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), source, [source]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def listed(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


def test_columns_stay(source, stages):
    for docs in stages[:-1]:
        assert docs.columns == source.columns


def base_failed(text):
    w = (text or "").encode().split()
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_stage(stages):
    rows = listed(stages[0])
    want = [(i, t) for (i, whole, *_), (_, _, depleted, t) in zip(rows, brute_lines(rows), strict=True) if not base_failed(whole) and not depleted]
    assert sorted(((r[0], r[1]) for r in listed(stages[1])), key=str) == sorted(want, key=str)


def test_near_duplicate_stage(stages):
    """One row of each group that pairs of a Jaccard similarity of 0.8 or more over five words connect: the smallest id, null last."""
    rows = listed(stages[1])

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    got = listed(stages[2])
    assert len(got) == len(groups) and len(groups) < len(rows)
    least = lambda g: min((r[0] is None, r[0] or 0) for r in g)
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(map(least, groups.values()))
    assert all(any(r in g for g in groups.values()) for r in got)


def test_substring_stage(stages):
    rows = listed(stages[2])
    words = [(t or "").encode().split() for _, t, *_ in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (i, t, *_), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        if all(keep):
            want.append((i, t))
        elif any(keep):
            want.append((i, b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()))
    assert sorted(((r[0], r[1]) for r in listed(stages[3])), key=str) == sorted(want, key=str)


def test_secret_stage(stages):
    """Every candidate that the forest takes for a secret, and nothing else, becomes the mark."""
    forest, want = secret_scan.train(), []
    for i, t, *_ in listed(stages[3]):
        spans = [(s, e) for s, e in secret_scan.candidates(t or "") if forest.probability(np.array([secret_scan.features(t, s, e)]))[0] >= secret_scan.THRESHOLD]
        for s, e in reversed(spans):
            t = t[:s] + "[SECRET]" + t[e:]
        want.append((i, t))
    got = [(r[0], r[1]) for r in listed(stages[4])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(i == 900_004 and "Tr0ub4dor" not in t for i, t in got)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    from rasterlake.llm import packing

    tok, want = Tokenizer.from_file(packing.vocabulary_path()), collections.Counter()
    for i, t, *_ in listed(stages[4]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i if i is not None else -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = stages[5].toPandas()
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    assert collections.Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty_table(spark, sf_dir, source, tmp_path):
    docs = source.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0

"""Scores by a log-bilinear language model, trained in numpy with noise-contrastive estimation.

Tokens are words (ASCII capitals lower-cased) and one end for each text. Counts cover every training text: those of single tokens, and those
of pairs of the model's symbols one and two places apart. The symbols are the end, the most frequent words, and CLASSES for all other
words, by a hash of their last two bytes, so an unseen word has one too. How many words have a symbol of their own grows with the training tokens
(their number to the power 0.4, VOCABULARY at least), and so do the pairs counted and the updates made.

For each of the two places before, a log-bilinear part scores a symbol: s(w | c) = q[w] . (C r[c]) + b[w]. It is fitted by noise-contrastive
estimation: observed pairs, drawn by their counts in the whole corpus, PASSES times as many as there are distinct pairs, against NOISE
times as many whose second symbol comes from the symbols' own frequencies. Pairs come to the driver in blocks of about BLOCK. Normalisers of all
contexts come from batched matrix products, so probabilities are exactly normalised; the two parts are mixed half and half. A word of a class has its
share of the class by smoothed counts, unseen words included, which makes probabilities of all words sum to one.

Counts of all words stay a table. Only the most frequent words (KNOWN, or twice the symbols) go to the workers; the others are counted by text and meet
their counts in a join. Base score: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), with the end among the tokens.

A null or empty text is one end token; with nothing to train on, counts are zero and the model is uniform over its symbols; repeated rows
count twice; words of equal counts go by their bytes; texts of any length are counted and scored whole; a null doc_id belongs to the training texts; other
columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import checkpointed, slices, text_bytes

VOCABULARY, CLASSES, KNOWN = 1024, 256, 50_000
#: Places before a token that it is predicted from.
LAGS = (1, 2)
DIMENSION, NOISE, PASSES, STEPS, BATCH, RATE, SEED = 24, 8, 3, 800, 2048, 0.15, 3
#: Pairs that the driver, and places of texts that a worker, has in hand at once.
BLOCK, PLACES = 2_000_000, 50_000
#: Words that a worker counts before it hands the counts on.
FLUSH = 300_000
ALPHA = 0.1


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


class Symbols(dict):
    """The symbol of a word: 0 is the end, then the vocabulary, then the classes. Those of known words are looked up."""

    def __init__(self, vocabulary: list[bytes], known: Iterable[bytes] = ()):
        super().__init__({w: i + 1 for i, w in enumerate(vocabulary)})
        self.first_class = len(vocabulary) + 1
        self.size = self.first_class + CLASSES
        for w in known:
            if w and w not in self:
                self[w] = self.first_class + word_class(w)

    def __missing__(self, word: bytes) -> int:
        return self.first_class + zlib.crc32(word[-2:]) % CLASSES

    def ids(self, text: bytes) -> np.ndarray:
        """The symbols of a text, with the end before and behind it."""
        return np.array([0, *map(self.__getitem__, tokens(text)), 0], np.int64)


class Model:
    """One place's part: s(w | c) = r[c] . q[w] + b[w], and its normaliser for each c."""

    def __init__(self, r: np.ndarray, q: np.ndarray, b: np.ndarray):
        z = np.empty(len(r))
        for a in range(0, len(r), 512):
            s = r[a : a + 512] @ q.T + b
            top = s.max(axis=1)
            z[a : a + 512] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        self.r, self.q, self.b, self.z = (x.astype(np.float32) for x in (r, q, b, z))

    def logs(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """ln P(w | c), each from its own row alone."""
        return np.einsum("ij,ij->i", self.r[c], self.q[w]) + self.b[w] - self.z[c]

    @property
    def log10(self) -> np.ndarray:
        return (self.r.astype(np.float64) @ self.q.T + self.b - self.z[:, None]) / math.log(10)


def mixed(models: list[Model], ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """ln P of each symbol of ids but those at begins (the ends before texts, which have 0): of a text's first symbol from the end before it, of others from
    the two places before."""
    out = np.zeros(len(ids))
    at = np.ones(len(ids), bool)
    at[begins] = False
    one = at.nonzero()[0]
    first, second = models
    out[one] = first.logs(ids[one - 1], ids[one])
    at[begins + 1] = False
    two = at.nonzero()[0]
    out[two] = np.logaddexp(out[two], second.logs(ids[two - 2], ids[two])) - math.log(2)
    return out


class Trainer:
    """Noise-contrastive estimation with adaptive rates, a block of pairs after the other."""

    def __init__(self, follows: np.ndarray, seed: int = SEED):
        """follows: how often each symbol is a second one."""
        self.rng, self.n = np.random.default_rng(seed), len(follows)
        self.noise = (follows + 0.5) / (follows + 0.5).sum()
        self.log_noise, self.cdf = np.log(NOISE * self.noise), np.cumsum(self.noise)
        self.r, self.q = (self.rng.normal(0, 0.1, (self.n, DIMENSION)) for _ in range(2))
        self.b = np.log(self.noise)
        self.grads = [np.full_like(x, 1e-6) for x in (self.r, self.q, self.b)]

    def train(self, pairs: np.ndarray, counts: np.ndarray, steps: int, rates: np.ndarray) -> None:
        """pairs: first symbol times n plus second; rates: one for each step."""
        n, rng, r, q, b = self.n, self.rng, self.r, self.q, self.b
        share = np.cumsum(counts, dtype=np.float64)
        for step in range(steps):
            c, w = np.divmod(pairs[np.minimum(np.searchsorted(share, rng.random(BATCH) * share[-1], side="right"), len(pairs) - 1)], n)
            # the noise words of a batch are shared by its pairs in a matrix product
            k = np.minimum(np.searchsorted(self.cdf, rng.random(BATCH // 16)), n - 1)
            rc, qw, qk = r[c], q[w], q[k]
            true = np.einsum("ij,ij->i", rc, qw) + b[w] - self.log_noise[w]
            false = rc @ qk.T + b[k] - self.log_noise[k]
            g_true = 1 - _sigmoid(true)
            g_false = -_sigmoid(false) * (NOISE / len(k))
            self._move(0, [(c, g_true[:, None] * qw + g_false @ qk)], rates[step])
            self._move(1, [(w, g_true[:, None] * rc), (k, g_false.T @ rc)], rates[step])
            self._move(2, [(w, g_true), (k, g_false.sum(axis=0))], rates[step])

    def _move(self, which: int, parts: list[tuple[np.ndarray, np.ndarray]], rate: float) -> None:
        """Only the rows that a step touches."""
        rows, values = np.concatenate([x for x, _ in parts]), np.concatenate([v for _, v in parts])
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        at, g = rows[start], np.add.reduceat(values[order], start)
        h = self.grads[which]
        h[at] += g * g
        (self.r, self.q, self.b)[which][at] += rate * g / np.sqrt(h[at])

    def model(self) -> Model:
        return Model(self.r, self.q, self.b)


def fit(pairs: np.ndarray, seed: int = SEED, steps: int = STEPS) -> Model:
    """pairs: symbols x symbols, how often the second follows the first (the end stands before a text too)."""
    at = np.flatnonzero(pairs)
    trainer = Trainer(pairs.sum(axis=0), seed)
    if not len(at):
        return Model(np.zeros_like(trainer.r), trainer.q, trainer.b)
    trainer.train(at, pairs.ravel()[at], steps, RATE * (1 - np.arange(steps) / steps))
    return trainer.model()


def fit_blocks(pairs: DataFrame, follows: np.ndarray, distinct: int, seed: int = SEED) -> Model:
    """pairs: pair, n. As many blocks as there are BLOCKs of distinct pairs, each a part by hash."""
    trainer = Trainer(follows, seed)
    if not distinct:
        return Model(np.zeros_like(trainer.r), trainer.q, trainer.b)
    blocks = -(-distinct // BLOCK)
    steps = max(STEPS, PASSES * distinct // BATCH)
    rates, done = RATE * (1 - np.arange(steps) / steps), 0
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("pair"), blocks) == k).toArrow()
        pair, n = (part.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(pair)
        own = steps - done if k == blocks - 1 else min(steps - done, round(steps * len(pair) / distinct))
        if len(pair):
            trainer.train(pair[order], n[order], own, rates[done : done + own])
        done += own
    return trainer.model()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: of the texts; a text's end is the empty word."""
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in slices(batches):
        for text in text_bytes(batch.column("text")):
            counts.update(tokens(text))
            counts[b""] += 1
            if len(counts) > FLUSH:
                yield flush()
    if counts:
        yield flush()


def _count_pairs(vocabulary: list[bytes], known: list[bytes]):
    """lag, pair, n: of the texts, added up for a task's part of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(vocabulary, known)
        n = symbols.size
        waiting: list[list[np.ndarray]] = [[] for _ in LAGS]
        held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in LAGS]
        size = 0

        def add() -> None:
            for k in range(len(LAGS)):
                if waiting[k]:
                    new, count = np.unique(np.concatenate(waiting[k]), return_counts=True)
                    codes, at = np.unique(np.concatenate([held[k][0], new]), return_inverse=True)
                    held[k] = (codes, np.bincount(at, np.concatenate([held[k][1], count])).astype(np.int64))
                    waiting[k].clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for k, lag in enumerate(LAGS):
                codes, count = held[k]
                held[k] = (codes[:0], count[:0])
                for a in range(0, len(codes), 200_000):
                    part = codes[a : a + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), lag), pa.int32()), pa.array(part), pa.array(count[a : a + 200_000])], ["lag", "pair", "n"])

        for batch in slices(batches):
            for text in text_bytes(batch.column("text")):
                ids = symbols.ids(text)
                for k, lag in enumerate(LAGS):
                    waiting[k].append(ids[:-lag] * n + ids[lag:])
                size += len(ids)
                if size > FLUSH:
                    add()
                    size = 0
                    if max(len(c) for c, _ in held) > BLOCK:
                        yield from flush()
        add()
        yield from flush()

    return run


_PARTS = pa.schema([("k", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(vocabulary: list[bytes], known: dict[bytes, int], models: list[Model], rest: np.ndarray, total: int, distinct: int):
    """For each text one row of what its known words and its symbols give, and one for each other word. The first kind bears a word that
    cannot be, a space and the row's number, and the text's tokens as tf, so that both go through one join. rest: for each class log10 of the smoothed
    count of its members, unseen ones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(vocabulary, known)
        first, bottom = symbols.first_class, math.log10(total + ALPHA * (distinct + 1))
        base = {w: math.log10(c + ALPHA) - bottom for w, c in known.items()}
        share = {w: math.log10(c + ALPHA) - rest[symbols[w] - first] for w, c in known.items() if w and symbols[w] >= first}
        end, end_known = base.get(b"", math.log10(ALPHA) - bottom), int(b"" in base)

        def scores(ids: list[np.ndarray]) -> np.ndarray:
            begins = np.cumsum([0, *map(len, ids[:-1])])
            return np.add.reduceat(mixed(models, np.concatenate(ids), begins), begins) / math.log(10)

        for batch in slices(batches, 4 << 20):
            texts: tuple[list, ...] = tuple([] for _ in _PARTS)
            words_k, words_w, words_n = [], [], []
            waiting, found, size = [], [], 0
            for text, k, doc_id, held in zip(text_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("k", "doc_id", "held_out")), strict=True):
                words = tokens(text)
                waiting.append(np.array([0, *map(symbols.__getitem__, words), 0], np.int64))
                size += len(words)
                if size > PLACES:
                    found.append(scores(waiting))
                    waiting, size = [], 0
                score, base_score, n_known = 0.0, end, end_known
                for w, n in Counter(words).items():
                    v = base.get(w)
                    if v is None:
                        words_k.append(k)
                        words_w.append(w)
                        words_n.append(n)
                    else:
                        base_score += n * v
                        n_known += n
                        if w in share:
                            score += n * share[w]
                for x, y in zip(texts, (k, b" %d" % k, len(words) + 1, doc_id, held, n_known, base_score, score), strict=True):
                    x.append(y)
            if waiting:
                found.append(scores(waiting))
            columns = [pa.array(x, f.type) for x, f in zip(texts, _PARTS, strict=True)]
            if found:
                columns[-1] = pa.array(np.array(texts[-1]) + np.concatenate(found))
            yield pa.RecordBatch.from_arrays(columns, schema=_PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(words_k, pa.int64()), pa.array(words_w, pa.binary()), pa.array(words_n, pa.int64()), *(pa.nulls(len(words_k), f.type) for f in list(_PARTS)[3:])], schema=_PARTS)

    return run


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, count) of at most `most` words, the most frequent first. An ordered limit would send as many from each partition to the
    driver; so the bound is looked for among some 3000 steps of the counts' logarithms, and only words above it are sent."""
    step = F.floor(F.log2("c") * 64).cast("int")
    sizes = counts.groupBy(step.alias("s")).count().collect()
    bound, held = None, 0
    for r in sorted(sizes, reverse=True):
        held += r["count"]
        if held > most:
            break
        bound = r["s"]
    if bound is None:
        return []
    found = [(bytes(r["word"]), r["c"]) for r in counts.where(step >= bound).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


@dataclass
class Learned:
    """What training gives: counts (word, c) of all words, those of the most frequent, the models of both places, class shares."""

    counts: DataFrame
    known: dict[bytes, int]
    vocabulary: list[bytes]
    models: list[Model]
    rest: np.ndarray
    total: int
    distinct: int


def learn(train: DataFrame, vocabulary_size: int | None = None) -> Learned:
    """train: text."""
    counts = checkpointed(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    size = vocabulary_size or max(VOCABULARY, int(total**0.4))
    top = most_frequent(counts, max(KNOWN, 2 * size))
    vocabulary = [w for w, _ in top if w][:size]
    known = dict(top)
    symbols = Symbols(vocabulary)
    found = checkpointed(train.mapInArrow(_count_pairs(vocabulary, list(known)), "lag int, pair long, n long").groupBy("lag", "pair").agg(F.sum("n").alias("n")))
    models = []
    for lag in LAGS:
        own = found.where(F.col("lag") == lag).select("pair", "n")
        follows = np.zeros(symbols.size)
        seen = own.groupBy((F.col("pair") % symbols.size).cast("int").alias("w")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()  # as many as there are symbols
        for r in seen:
            follows[r["w"]] = r["n"]
        models.append(fit_blocks(own, follows, sum(r["d"] for r in seen), SEED + lag))
    # tokens and distinct words of each class: of all counted words but the vocabulary
    grouped = counts.where("length(word) > 0").groupBy(_class("word").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    tokens_of, words_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in grouped.collect():
        tokens_of[r["k"]], words_of[r["k"]] = r["c"], r["v"]
    known |= {b"": r["c"] for r in counts.where("length(word) = 0").collect()}  # the end, should it be a rare token
    for w in vocabulary:
        tokens_of[word_class(w)] -= known[w]
        words_of[word_class(w)] -= 1
    rest = np.log10(tokens_of + ALPHA * (words_of + 1))
    return Learned(counts, known, vocabulary, models, rest, total, distinct)


def score(docs: DataFrame, held_out: Column, vocabulary_size: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs. Learns from rows that aren't held out."""
    own = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("held_out"), F.col("text").cast("string").alias("text"))
    m = learn(rows.where(~F.col("held_out")).select("text"), vocabulary_size)
    total, distinct = m.total, m.distinct
    keyed = rows.select(F.monotonically_increasing_id().alias("k"), "doc_id", "held_out", "text")
    parts = keyed.mapInArrow(_score(m.vocabulary, m.known, m.models, m.rest, total, distinct), "k long, word binary, tf long, doc_id long, held_out boolean, n_known long, base_score double, score double")
    c, own = F.coalesce("c", F.lit(0)), F.col("held_out").isNotNull()
    bottom = F.lit(math.log10(total + ALPHA * (distinct + 1)))
    share = F.element_at(F.lit([float(x) for x in m.rest]), _class("word") + 1)
    met = parts.join(m.counts, "word", "left").select(
        "k", "doc_id", "held_out", F.when(own, F.col("tf")).otherwise(0).alias("n"), F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.coalesce("base_score", F.col("tf") * (F.log10(c + ALPHA) - bottom)).alias("b"), F.coalesce("score", F.col("tf") * (F.log10(c + ALPHA) - share)).alias("s"),
    )
    out = met.groupBy("k").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("known").alias("n_known"), F.sum("n").alias("n_tokens"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _class(word: str) -> Column:
    return F.pmod(F.crc32(F.substring(word, -2, 2)), CLASSES).cast("int")

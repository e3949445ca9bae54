"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's features are the byte n-grams (2 to 4) of its words, hashed into BUCKETS rows of an embedding; ASCII capitals are lower-cased,
other ASCII but letters separates words, and a word's ends count as a mark. A text is the mean of its features' embeddings; a linear layer and
softmax give the language. Training takes at most SAMPLE rows, those of smallest hash among the rows allowed to it, so the sample is the
same wherever rows lie; a fifth of it is held back to calibrate the temperature of the scores and the score under which a text is
rejected as no known language. Prediction reads whole texts. As embedding and layer are linear, they are one table in prediction.

A null text or one without a letter (Unicode category L: digits and fractions of any script are none) is `und` with score 0; if nothing can be learned
(no labelled row), all texts are `und`; of equally likely languages the first by name is taken; a script that training never saw gets the languages'
own shares, a low score, and is flagged as rejected; repeated rows are treated alike; null doc_ids are kept; other columns are ignored; an empty
table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIMENSION, GRAMS = 1 << 15, 16, (2, 3, 4)
#: Labelled rows to fit on at most, the longest part of a row's text that comes to the driver (from a place that hangs on its hash), and the
#: longest piece of it that one step sees.
SAMPLE, PART, PIECE = 2500, 4000, 240
EPOCHS, RATE, SEED = 5, 0.5, 7
#: Bytes that are hashed at once.
BLOCK = 1 << 18

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, bytes of other characters as they are, the rest a space.
_BYTES = bytes(i if i >= 128 else i | 32 if chr(i).isalpha() else 32 for i in range(256))


def features(plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of plain (bytes as uint8, words between spaces) and their places; n-grams that run over a word's end don't count."""
    x = plain.astype(np.uint32)
    space = plain == 32
    found, places = [], []
    h, inner = x + np.uint32(1), np.zeros(len(x), bool)
    for n in range(2, max(GRAMS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) ^ x[n - 1 :]
        inner = inner[:m] | space[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        if n in GRAMS:
            at = (~(inner if n > 2 else space[:m] & space[1:])).nonzero()[0]
            g = h[at] * np.uint32(2654435761)
            found.append((g >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64))
            places.append(at)
    return (np.concatenate(found), np.concatenate(places)) if found else (np.empty(0, np.int64),) * 2


def plain_bytes(text: str) -> bytes:
    return b" " + text.encode("utf-8", "replace").translate(_BYTES) + b" "


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: the embedding times the linear layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, plain: list[bytes]) -> np.ndarray:
        """One row for each text. Short texts are hashed together, a long one in blocks that overlap."""
        total, count = np.zeros((len(plain), len(self.languages))), np.zeros(len(plain))
        overlap = max(GRAMS) - 1
        group: list[int] = []

        def add(joined: bytes, starts: np.ndarray, rows: np.ndarray, upto: int) -> None:
            g, at = features(np.frombuffer(joined, np.uint8))
            # the last block of a text has all n-grams; others leave those that start in the overlap to the next
            use = at < upto
            owner = rows[np.searchsorted(starts, at[use], side="right") - 1]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, self.table[g[use], k], len(plain))
            count[:] += np.bincount(owner, minlength=len(plain))

        def flush() -> None:
            if group:
                sizes = np.cumsum([0, *(len(plain[i]) for i in group)])
                add(b"".join(plain[i] for i in group), sizes[:-1], np.array(group), int(sizes[-1]))
                group.clear()

        held = 0
        for i, p in enumerate(plain):
            if len(p) > BLOCK:
                for a in range(0, len(p), BLOCK):
                    last = a + BLOCK >= len(p)
                    add(p[a : a + BLOCK + (0 if last else overlap)], np.array([0]), np.array([i]), BLOCK if not last else len(p))
                continue
            if held + len(p) > BLOCK:
                flush()
                held = 0
            group.append(i)
            held += len(p)
        flush()
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        z = self.logits([plain_bytes(t or "") for t in texts]) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [(self.languages[i], float(p[k, i])) if t and _LETTER.search(t) else ("und", 0.0) for k, (t, i) in enumerate(zip(texts, best, strict=True))]


def train(rows: list[tuple[str, str]], seed: int = SEED) -> Model | None:
    """rows: text, language."""
    rng = np.random.default_rng(seed)
    data = [(np.frombuffer(plain_bytes(t), np.uint8), lang) for t, lang in rows if _LETTER.search(t)]
    if not data:
        return None
    languages = sorted({lang for _, lang in data})
    held, fit = data[::5], [x for i, x in enumerate(data) if i % 5] or data
    embedding = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION))
    layer, bias = rng.normal(0, 0.1, (DIMENSION, len(languages))), np.zeros(len(languages))
    y = np.array([languages.index(lang) for _, lang in fit])
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(fit), 16):
            buckets = []
            for plain, _ in fit[a : a + 16]:
                size = int(rng.integers(16, PIECE + 1))
                start = int(rng.integers(0, max(1, len(plain) - size + 1)))
                buckets.append(features(plain[start : start + size])[0])
            k = len(buckets)
            sizes = np.array([len(b) for b in buckets])
            used, c = np.unique(np.concatenate(buckets), return_inverse=True)
            share = np.zeros((k, len(used)))
            np.add.at(share, (np.repeat(np.arange(k), sizes), c), np.repeat(1 / np.maximum(sizes, 1), sizes))
            hidden = share @ embedding[used]
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(k), y[a : a + 16]] -= 1
            back = p @ layer.T
            layer -= rate * hidden.T @ p
            bias -= rate * p.sum(axis=0) / k
            embedding[used] -= 8 * rate * share.T @ back
    model = Model(languages, (embedding @ layer).astype(np.float32), bias, 1.0, 0.0)
    return calibrate(model, held)


def calibrate(model: Model, held: list[tuple[np.ndarray, str]]) -> Model:
    """The temperature of least log loss on the rows held back, one label in 50 taken for wrong; rejection below the score of their lowest hundredth, 0.5 at most."""
    z = model.logits([plain.tobytes() for plain, _ in held])
    y = np.array([model.languages.index(lang) if lang in model.languages else 0 for _, lang in held])

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        log_p = q - np.log(np.exp(q).sum(axis=1, keepdims=True))
        return float(-(0.98 * log_p[np.arange(len(y)), y] + 0.02 * log_p.mean(axis=1)).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss)
    q = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    model.reject_below = min(0.5, float(np.quantile((q / q.sum(axis=1, keepdims=True)).max(axis=1), 0.01)))
    return model


def sample(docs: DataFrame, allowed: Column, rows: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `rows` labelled rows: smallest hash of doc_id and text first. Only ids travel until the rows are chosen."""
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - (PART - 1), F.lit(1))).cast("int") + 1
    last = labelled.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return []
    # many rows may share a doc_id, so the number is held to here too
    chosen = labelled.where(F.col("h") <= last).select("h", F.xxhash64("text").alias("t"), F.substring("text", place, F.lit(PART)).alias("text"), "lang").orderBy("h", "t").limit(rows).collect()
    return [(r["text"], r["lang"]) for r in chosen]


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (calibrated probability), rejected (score under the calibrated bound). Learns from rows that aren't held out."""
    model = train(sample(docs, ~F.coalesce(held_out, F.lit(False))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("text").to_pylist()
            found = model.predict(body) if model and body else [("und", 0.0)] * len(body)
            low = [lang == "und" or score < model.reject_below for lang, score in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()), pa.array(low, pa.bool_())], schema=_OUT)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")

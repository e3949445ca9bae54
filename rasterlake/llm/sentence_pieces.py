"""SentencePiece encoding and decoding by streaming Viterbi.

A text is a lattice: boundaries between characters, and an arc for each piece of the vocabulary that stands between two of them. From left to
right each boundary gets the best path that ends there, as one backpointer. Only a window as long as the longest piece can still be continued
from; whenever all paths that survive in it come through one boundary, the ids before that boundary are committed and forgotten, so memory
does not grow with the text. Characters without a piece become byte pieces.

What the best path is depends on the model. With unigram scores (`merged=False`) it is the path of the highest total score. The scores of a
merging vocabulary are ranks, whose sum means nothing; there (`merged=True`) an arc may follow another only if merging the text of both gives
just these two. At most one path of such pairs leads to a boundary, since merging splits a text's start the same way whatever comes
after the last piece, and the path through the whole text is what merging the whole text gives: the library's ids.

Where no piece of the vocabulary runs over a word's start (a space mark after another character), all paths come through it, so ids are committed at
each word's start at the latest, and the ids of a word hang on nothing around it: those of recent words are remembered.

A null or empty text has no ids; texts and words of any length are encoded whole; repeated rows are treated alike; null doc_ids are kept; other
columns are ignored. The vocabulary file's path is a parameter; the file has to be where the workers are.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import slices

SPACE = "▁"
#: Entries of a worker's memory of words, and of pairs of pieces; the older half goes when a new one is full.
REMEMBERED = 250_000
#: Words longer than this aren't remembered.
LONG = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Recent(dict):
    """What was used lately: a full generation becomes the old one."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most, self.old = most, {}

    def known(self, key):
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Pieces:
    """A vocabulary: normal pieces with scores, byte pieces, the id of unknown characters."""

    def __init__(self, path: str, merged: bool = True):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.merged = merged
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.unknown = sp.unk_id()
        self.score = {self.text[i]: (sp.get_score(i), i) for i in range(n) if not (i in self.byte_of or i in self.skip or sp.is_unused(i))}
        self.longest = max(map(len, self.score), default=1)
        self.unknown_score = min((s for s, _ in self.score.values()), default=0.0) - 10.0
        #: whether a word's start is always a boundary
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.known: Recent = Recent()
        #: whether a piece may follow another, by their codes: 0 nothing, then the pieces, then single characters
        self.pairs: Recent = Recent(2 * REMEMBERED)
        self.code = {p: i + 1 for i, p in enumerate(self.score)}
        self.id_of = [-1, *(i for _, i in self.score.values())]
        #: the code of what is a piece, 0 for what only begins one
        self.begins = {p[:k]: 0 for p in self.score for k in range(2, len(p))} | self.code

    def merge(self, text: str) -> list[str]:
        """What merging gives: the neighbours whose joint piece has the highest score first, the leftmost of equal ones."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                joint = parts[i] + parts[after[i]]  # type: ignore[operator]
                got = self.score.get(joint)
                if got:
                    heapq.heappush(queue, (-got[0], i, joint))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, joint = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joint:  # type: ignore[operator]
                continue
            parts[i], parts[j], after[i] = joint, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _code(self, piece: str) -> int:
        return self.code.get(piece) or (len(self.code) + 1 + ord(piece) if piece else 0)

    def _follows(self, a: str, b: str) -> bool:
        """Whether b may stand after a (nothing: at the start)."""
        key = self._code(a) << 32 | self._code(b)
        got = self.pairs.get(key)
        if got is None and (got := self.pairs.known(key)) is None:
            got = self.merge(a + b) == ([a, b] if a else [b])
            self.pairs.put(key, got)
        return got

    def _arc(self, text: str, end: int, back: dict[int, tuple[int, int]], best: dict[int, float], reach: int) -> tuple[int, int] | None:
        """The best arc to the boundary `end`: its start and id (-1: a character without a piece). Sets best."""
        score, low = self.score, max(reach, end - self.longest)
        if self.merged:
            for start in range(low, end):
                if start in back:
                    piece = text[start:end]
                    got = score.get(piece)
                    if (got is not None or end - start == 1) and self._follows(text[back[start][0] : start], piece):
                        return start, got[1] if got else -1
            return None
        found, most = None, -np.inf
        for start in range(low, end):
            if start in back:
                got = score.get(text[start:end])
                if got is not None or end - start == 1:
                    s = best[start] + (got[0] if got else self.unknown_score)
                    if s > most:
                        found, most = (start, got[1] if got else -1), s
        if found:
            best[end] = most
        return found

    def viterbi(self, text: str) -> Iterator[int]:
        """Ids of text (space marks in place of spaces), committed whenever all surviving paths converge."""
        n, longest = len(text), self.longest
        back: dict[int, tuple[int, int]] = {0: (0, -2)}
        best: dict[int, float] = {0: 0.0}
        via: dict[int, int] = {0: 0}  # the first boundary after the committed one on the path to each boundary
        committed = 0
        for end in range(1, n + 1):
            arc = self._arc(text, end, back, best, committed)
            if arc is None:
                continue
            back[end] = arc
            via[end] = end if arc[0] == committed else via[arc[0]]
            while end - longest >= committed and end < n:
                # the committed boundary has left the window: what all survivors share can go out
                alive = [p for p in range(end - longest + 1, end + 1) if p in via]
                through = {via[p] for p in alive}
                if len(through) > 1:
                    break
                at = through.pop()
                yield from self._ids(text, back[at], at)
                keep = {at}
                for p in alive:
                    while p not in keep:
                        keep.add(p)
                        p = back[p][0]
                for p in [p for p in back if p not in keep]:
                    back.pop(p)
                    best.pop(p, None)
                    via.pop(p)
                for p in sorted(keep):
                    via[p] = p if p == at or back[p][0] == at else via[back[p][0]]
                committed = at
        path, end = [], n
        while end > committed:
            path.append((back[end], end))
            end = back[end][0]
        for arc, at in reversed(path):
            yield from self._ids(text, arc, at)

    def _ids(self, text: str, arc: tuple[int, int], end: int) -> list[int]:
        start, piece = arc
        if piece >= 0:
            return [piece]
        return [self.bytes[b] for b in text[start:end].encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def _short(self, word: str) -> tuple[int, ...]:
        """As viterbi, for a merging vocabulary and a word so short that the window need not move: arcs go forward from each boundary, as
        long as some piece begins so."""
        begins, pairs, single = self.begins, self.pairs, len(self.code) + 1
        n = len(word)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        last[0] = 0
        for start in range(n):
            a = last[start]
            if a < 0:
                continue
            for end in range(start + 1, n + 1):
                b = begins.get(word[start:end])
                if b is None:
                    if end > start + 1:
                        break
                    b = single + ord(word[start])
                if b and last[end] < 0:
                    fits = pairs.get(a << 32 | b)
                    if fits is None:
                        fits = self._follows(word[begin[start] : start], word[start:end])
                    if fits:
                        last[end], begin[end] = b, start
        out: list[int] = []
        while n:
            start, b = begin[n], last[n]
            out += [self.id_of[b]] if b < single else self._ids(word, (start, -1), n)[::-1]
            n = start
        return tuple(reversed(out))

    def _word(self, word: str) -> tuple[int, ...]:
        got = self.known.known(word)
        if got is None:
            if len(word) > LONG:
                return tuple(self.viterbi(word))
            got = self._short(word) if self.merged else tuple(self.viterbi(word))
            self.known.put(word, got)
        return got

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.words_apart:
            return list(self.viterbi(text))
        known, word = self.known, self._word
        # the marks before a word belong to it
        return list(chain.from_iterable([known.get(w) or word(w) for w in _WORD.findall(text)]))

    def decode(self, ids: list[int]) -> str:
        out: list[bytes] = []
        for i in ids:
            b = self.byte_of.get(i)
            out.append(bytes([b]) if b is not None else b"" if i in self.skip else self.text[i].encode())
        return b"".join(out).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

_OUT = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """A worker's vocabulary, with what it remembers, serves one task after the other."""
    return Pieces(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary or vocabulary_path())
        for batch in slices(batches):
            ids = [pieces.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text: from doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary or vocabulary_path())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pieces.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (whether decoding the ids gives the text itself: not so
    where it holds a space mark, which decodes to a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary or vocabulary_path())
        as_bytes = [bytes([pieces.byte_of[i]]) if i in pieces.byte_of else b"" if i in pieces.skip else t.replace(SPACE, " ").encode() for i, t in enumerate(pieces.text)]
        for batch in slices(batches):
            n, crc, same = [], [], []
            for t in batch.column("text").to_pylist():
                ids = pieces.encode(t or "")
                n.append(len(ids))
                crc.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
                same.append(b"".join(map(as_bytes.__getitem__, ids)).removeprefix(b" ") == (t or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)

"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, `://`, `+` before a digit, a dot between digits, two digits with at most one space
or hyphen between, and `IBAN`. From each anchor a deterministic parser expands to both sides, as far as the characters of its kind go,
and validates what it got. Positions are code points, ends exclusive.

Base kinds, as leftmost non-overlapping matches: email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`; ip
`[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` with parts at most 255; card `[0-9]([\\x20-]?[0-9])+` of 14 to 19 digits that pass Luhn;
phone `\\+[0-9][\\x20().0-9-]+[0-9]` of 10 to 15 digits. Beyond them: url (scheme and host) and iban (ISO 13616 check digits).

A null or empty text has no spans; repeated rows are treated alike; null doc_ids are kept; other columns are ignored by `find` and
kept by `redact`. A text of any length is read once: no parser goes beyond the next anchor of its kind unless it has a match, whose end the
scan then starts from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import slices, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban")
DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = ALNUM | frozenset("+.-")
#: What may not end a URL, and what ends it besides white space.
URL_TAIL = frozenset(".,;:!?)")
URL_ENDS = frozenset(" \t\n\x0b\x0c\r<>\"'`{}|\\^[]")

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    """Anchors and the parser that each calls for."""
    a = ahocorasick.Automaton()
    digits = sorted(DIGITS)
    a.add_word("@", ("email", 1))
    a.add_word("://", ("url", 3))
    a.add_word("IBAN", ("iban", 4))
    for x in digits:
        a.add_word("+" + x, ("phone", 2))
        for y in digits:
            a.add_word(f"{x}.{y}", ("ip", 3))
            for between in ("", " ", "-"):
                a.add_word(x + between + y, ("card", 2 + len(between)))
    a.make_automaton()
    return a


def _email(t: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: the at-sign; floor: the end of the last match. Returns start, end, valid; or None."""
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels = len(t), at + 1, 0
    while True:
        e = end
        while e < n and t[e] in LABEL:
            e += 1
        if e == end:
            break
        labels, stop = labels + 1, e
        if e == n or t[e] != ".":
            break
        end = e + 1
    return (start, stop, True) if labels >= 2 else None


def _ips(t: str, dot: int) -> tuple[list[tuple[int, int, bool]], int]:
    """All groups of four numbers in the chain of numbers and single dots around dot, and the chain's end."""
    start, n = dot, len(t)
    while start and (t[start - 1] in DIGITS or (t[start - 1] == "." and start > 1 and t[start - 2] in DIGITS and t[start] in DIGITS)):
        start -= 1
    parts, p = [], start
    while p < n and t[p] in DIGITS:
        e = p
        while e < n and t[e] in DIGITS:
            e += 1
        parts.append((p, e))
        if e + 1 < n and t[e] == "." and t[e + 1] in DIGITS:
            p = e + 1
        else:
            p = e
            break
    found = []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        ok = all(e - s <= 3 and int(t[s:e]) <= 255 or (e - s > 3 and t[s:e].lstrip("0")[:4].isdigit() and len(t[s:e].lstrip("0")) <= 3 and int(t[s:e].lstrip("0")) <= 255) or not t[s:e].strip("0") for s, e in four)
        found.append((four[0][0], four[3][1], ok))
    return found, parts[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _card(t: str, at: int) -> tuple[int, int, bool]:
    start, end, n = at, at + 1, len(t)
    while True:
        if start and t[start - 1] in DIGITS:
            start -= 1
        elif start > 1 and t[start - 1] in " -" and t[start - 2] in DIGITS:
            start -= 2
        else:
            break
    while True:
        if end < n and t[end] in DIGITS:
            end += 1
        elif end + 1 < n and t[end] in " -" and t[end + 1] in DIGITS:
            end += 2
        else:
            break
    digits = t[start:end].replace(" ", "").replace("-", "")
    return start, end, 14 <= len(digits) <= 19 and luhn(digits)


def _phone(t: str, plus: int) -> tuple[int, int, bool] | None:
    end, n = plus + 2, len(t)
    while end < n and t[end] in PHONE:
        end += 1
    while end > plus + 2 and t[end - 1] not in DIGITS:
        end -= 1
    if end - plus < 4:
        return None
    return plus, end, 10 <= sum(c in DIGITS for c in t[plus:end]) <= 15


def _url(t: str, colon: int) -> tuple[int, int, bool] | None:
    """The host is judged first; it ends at the next slash at the latest, so a text of many schemes and no host is still read once."""
    start, stop, n = colon, colon + 3, len(t)
    while start and colon - start < 2 and t[start - 1] in SCHEME:
        start -= 1
    while stop < n and t[stop] != "/" and t[stop] not in URL_ENDS:
        stop += 1
    last = stop
    if stop == n or t[stop] != "/":
        while last > colon + 3 and t[last - 1] in URL_TAIL:
            last -= 1
    host = t[colon + 3 : last].rpartition("@")[2].partition(":")[0]
    if colon - start < 2 or "." not in host.strip(".") or not all(c in LABEL or c == "." for c in host):
        return None
    while start and t[start - 1] in SCHEME:
        start -= 1
    end = stop
    while end < n and t[end] not in URL_ENDS:
        end += 1
    while end > colon + 3 and t[end - 1] in URL_TAIL:
        end -= 1
    return start, end, True


def _iban(t: str, at: int) -> tuple[int, int, bool] | None:
    p, n = at + 4, len(t)
    while p < n and t[p] in " :#":
        p += 1
    start, got = p, ""
    while p < n and len(got) < 34 and (t[p] in ALNUM or (t[p] == " " and p + 1 < n and t[p + 1] in ALNUM)):
        got += t[p].strip()
        p += 1
        if len(got) == 4 and not (got[:2].isupper() and got[2:].isdigit()):
            return None
        if len(got) >= 15 and got[:2].isalpha() and got[:2].isupper() and got[2:4].isdigit() and (p == n or t[p] not in ALNUM):
            number = "".join(str(int(c, 36)) for c in got[4:] + got[:4])
            if int(number) % 97 == 1:
                return start, p, True
    return None


def scan(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All valid spans, by start, then kind as listed."""
    out: list[Span] = []
    floor = dict.fromkeys(KINDS, 0)  # where each kind's last match, valid or not, has ended
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if at < floor[kind] and kind != "email":
            continue
        match: tuple[int, int, bool] | None
        if kind == "ip":
            found, floor["ip"] = _ips(text, at + 1)
            out += [("ip", s, e) for s, e, ok in found if ok]
            continue
        if kind == "email":
            match = _email(text, at, floor["email"]) if at >= floor["email"] else None
        elif kind == "card":
            match = _card(text, at)
        elif kind == "phone":
            match = _phone(text, at)
        elif kind == "url":
            match = _url(text, at)
        else:
            match = _iban(text, at)
        if match:
            floor[kind] = match[1]
            if match[2]:
                out.append((kind, match[0], match[1]))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            spans = scan(text, anchors)
            kinds = [k for k, _, _ in spans]
            base = joined([s for s in spans if s[0] in BASE_KINDS])
            rows.append({"doc_id": doc_id, **{f"n_{k}": kinds.count(k) for k in KINDS}, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": joined(spans)})
        yield pa.RecordBatch.from_pylist(rows, _FOUND)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind, base_sha256 (of the base spans, joined) and spans (all), one row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover becomes the name of the kind that starts it."""
    out, p = [], 0
    for kind, s, e in spans:
        if s >= p:
            out += [text[p:s], f"<{kind}>"]
        p = max(p, e)
    return "".join(out) + text[p:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced by their kinds; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            new = [t and mask(t, scan(t, anchors)) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)

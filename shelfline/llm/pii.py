"""Personal data, found also where it is disguised, at its place in the source text.

Base detectors search the text as it is.  Texts that show signs of a disguise also pass a chain of
transducers (coded, look-alike and hidden characters, spelled digits, at/dot disguises).  Each keeps, for
every character it writes, where that came from, so what the detectors find in the normalised text maps
back to the characters of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfline.llm.common import cut, free_names, text_of

KINDS = ("email", "ip", "card", "phone")
BATCH = 8 << 20

Span = tuple[int, int]

# -- base detectors: leftmost matches that do not overlap, in linear time -----------------

_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TWO_PARTS = re.compile(r"\.[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[Span]:
    """The name is the longest run before an ``@``: no other start can match earlier."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[Span]:
    """Four parts at a time of each dotted run of numbers; parts above 255 drop the four."""
    out = []
    if "." not in text or not _TWO_PARTS.search(text):
        return out
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for run in _DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", run.group())
        if len(digits) <= 19 and luhn(digits):
            out.append(run.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


DETECTORS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    """All kinds but the first need a digit."""
    if not _ANY_DIGIT.search(text):
        return {kind: emails(text) if kind == "email" else [] for kind in KINDS}
    return {kind: find(text) for kind, find in DETECTORS.items()}


# -- transducers --------------------------------------------------------------------------

# Letters of other scripts that look like ASCII ones, in the order of the ASCII letters.
_CYRILLIC = dict(zip("аЬсԁеһіјӏорԛѕԝхуАВСЕНІЈКМОРЅТХУ", "abcdehijlopqswxyABCEHIJKMOPSTXY"))
_GREEK = dict(zip("αικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aiknopuxABEZHIKMNOPTYX"))
_SIGNS = dict(zip("﹫․‐‑‒–−﹢⁺", "@.-----++"))
_HIDDEN = "­​‌‍⁠﻿"


def _alike() -> dict[str, str]:
    """Look-alikes: the tables above, full-width forms, and decimal digits of all scripts."""
    out = {**_CYRILLIC, **_GREEK, **_SIGNS}
    out |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    for c in range(0x80, 0x20000):
        digit = unicodedata.decimal(chr(c), None)
        if digit is not None:
            out[chr(c)] = str(digit)
    return out


_ALIKE = _alike()
_TO_PLAIN = str.maketrans(_ALIKE)
_STRANGE = frozenset([*_ALIKE, *_HIDDEN])
_HIDDEN_RUN = re.compile(f"[{_HIDDEN}]+")

# Names of signs in web pages; printable ASCII characters may stand there by number as well, signs of addresses by percent code.
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-"}
_CODED = re.compile(rf"&#(?:(?P<number>[0-9]{{2,3}})|[xX](?P<hex>[0-9A-Fa-f]{{2}}));|&(?P<name>{'|'.join(_NAMED)});|%(?P<code>40|2[BbDdEe])")

# The English names of the digits.
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?i)(?<![A-Za-z])(?:{_DIGIT})(?:[\s,-]{{1,3}}(?:{_DIGIT}|dot|[0-9]+))+(?![A-Za-z])")
_WORDS = re.compile("[A-Za-z]+|[0-9]+")
_BRACKET = re.compile(r"(?i)[\[({<]\s{0,2}(?:at|dot|@|\.)\s{0,2}[\])}>]")
_BRACKET_AT = re.compile(r"(?i)\s{0,2}[\[({<]\s{0,2}(?:at|@)\s{0,2}[\])}>]\s{0,2}")
_BRACKET_DOT = re.compile(r"(?i)\s{0,2}[\[({<]\s{0,2}(?:dot|\.)\s{0,2}[\])}>]\s{0,2}")
# Top-level domains, the common general ones and those of all countries; a spoken address ends in one of them.
_TOP = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|app|dev|xyz|online|site|store|shop|tech|cloud|blog|email|live|news|agency|"
    "design|digital|studio|solutions|services|systems|network|software|company|group|team|world|global|space|website|academy|club|"
    "[a-z]{2}"
)
_AT = r"(?:\s{0,2}[\[({<]\s{0,2}(?:at|@)\s{0,2}[\])}>]\s{0,2}|\sat\s)"
_DOT = r"(?:\s{0,2}[\[({<]\s{0,2}(?:dot|\.)\s{0,2}[\])}>]\s{0,2}|\sdot\s)"
_PART = "[A-Za-z0-9-]+"
# Each place may be disguised in its own way, one dot at least: "at" before a plain domain is common prose.
_SPOKEN_MAIL = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{_AT}|@)(?={_PART}(?:\.{_PART})*{_DOT}){_PART}(?:(?:{_DOT}|\.){_PART})*(?:{_DOT}|\.)(?:{_TOP})(?![A-Za-z0-9-])"
)
_SPOKEN_NUMBERS = re.compile(r"(?i)[0-9]{1,3}(?:(?:\sdot\s|\.)[0-9]{1,3}){3}")
_SPOKEN = re.compile(rf"(?i)(?P<at>{_AT})|(?P<dot>{_DOT})")
_DOT_WORD = re.compile(r"(?i)\sdot\s")
_PLUS_WORD = re.compile(r"(?i)(?<![A-Za-z])plus\s(?=[0-9])")


class Trace:
    """A text under change, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def decode(self) -> None:
        """Characters that are written by number, name or percent code."""
        edits = []
        for m in _CODED.finditer(self.text):
            new = _NAMED[m["name"]] if m["name"] else chr(int(m["number"]) if m["number"] else int(m["hex"] or m["code"], 16))
            if "!" <= new <= "~":
                edits.append((*m.span(), new))
        self.replace(edits)

    def plain(self) -> None:
        """Look-alikes are single characters: places stay."""
        self.text = self.text.translate(_TO_PLAIN)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put a string for each span ``(start, end, string)``; spans are in order and do not overlap."""
        if not edits:
            return
        parts, starts, ends, at = [], [], [], 0
        for i, j, new in edits:
            parts += [self.text[at:i], new]
            starts += [self.start[at:i], np.full(len(new), self.start[i])]
            ends += [self.end[at:i], np.full(len(new), self.end[j - 1])]
            at = j
        self.text = "".join([*parts, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])

    def sub(self, pattern: re.Pattern, new: str) -> None:
        self.replace([(*m.span(), new) for m in pattern.finditer(self.text)])

    def inside(self, outer: re.Pattern) -> None:
        """Signs that are spoken or in brackets become plain within matches of ``outer``."""
        edits = [
            (*x.span(), "@" if x.lastgroup == "at" else ".")
            for m in outer.finditer(self.text)
            for x in _SPOKEN.finditer(self.text, m.start(), m.end())
        ]
        self.replace(edits)

    def digits(self) -> None:
        """Runs of spelled digits become digits without gaps; a spoken dot among them stays for later."""
        edits = []
        for run in _SPELLED.finditer(self.text):
            last = None
            for word in _WORDS.finditer(self.text, run.start(), run.end()):
                name = word.group().lower()
                if last is not None and name != "dot" != last.group().lower():
                    edits.append((last.end(), word.start(), ""))
                if name in DIGIT_WORDS:
                    edits.append((*word.span(), str(DIGIT_WORDS.index(name))))
                last = word
        self.replace(edits)


def disguised(text: str) -> bool:
    """Cheap signs that a transducer could change something that matters."""
    if not text.isascii() and not _STRANGE.isdisjoint(set(text)):
        return True
    if ("&" in text or "%" in text) and _CODED.search(text):
        return True
    low = text.casefold()  # as the patterns ignore case
    if "dot" in low and _DOT_WORD.search(text) or _BRACKET.search(text) or "plus" in low and _PLUS_WORD.search(text):
        return True
    return any(w in low for w in DIGIT_WORDS) and _SPELLED.search(text) is not None


def normalise(text: str) -> Trace:
    trace = Trace(text)
    trace.decode()
    trace.sub(_HIDDEN_RUN, "")
    trace.plain()
    trace.digits()
    trace.inside(_SPOKEN_MAIL)
    trace.sub(_BRACKET_AT, "@")
    trace.sub(_BRACKET_DOT, ".")
    trace.inside(_SPOKEN_NUMBERS)
    trace.sub(_PLUS_WORD, "+")
    return trace


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans with those of the method, by kind.

    A normalised match counts if its source is written otherwise and it holds all of the base spans of its
    kind that it meets.
    """
    base = base_spans(text)
    if not disguised(text):
        return base, base
    trace = normalise(text)
    found = {}
    for kind, detect in DETECTORS.items():
        more = []
        for a, b in detect(trace.text):
            start, end = int(trace.start[a]), int(trace.end[b - 1])
            meets = [(s, e) for s, e in base[kind] if s < end and start < e]
            if text[start:end] != trace.text[a:b] and (start, end) not in meets and all(start <= s and e <= end for s, e in meets):
                more.append((start, end))
        found[kind] = sorted(base[kind] + more)
    return base, found


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """Put ``<kind>`` for each span; spans that overlap are one, with the kind that starts first."""
    out, at, covered = [], 0, 0
    for a, b, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if a >= covered:
            out += [text[at:a], f"<{kind}>"]
        covered = at = max(covered, b)
    return "".join([*out, text[at:]])


# -- Spark --------------------------------------------------------------------------------


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every document.

    The counts and ``spans`` hold base and disguised finds; ``base_sha256`` covers the base ones alone.
    Places are code points of the whole text, end exclusive.  A null text is empty and has no spans;
    repeated rows are scanned each; null ids stay null; an empty table gives no rows; other columns are
    ignored.  Work is linear in the text, also for very long runs without blanks.
    """
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_of(documents).alias("text"))
    counts = [f"n_{kind}" for kind in KINDS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                found = [find(t) for t in batch.column("text").to_pylist()]
                number = [pa.array([len(spans[kind]) for _, spans in found], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
                spans = pa.array([listed(spans) for _, spans in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *number, digest, spans], ["doc_id", *counts, "base_sha256", "spans"])

    return rows.mapInArrow(work, f"doc_id long, {', '.join(c + ' long' for c in counts)}, base_sha256 string, spans string")


def redact(documents: DataFrame) -> DataFrame:
    """The documents with ``<kind>`` in place of personal data in ``text``; ``n_chars`` follows where it is there.

    Null texts stay null; no row goes, repeated ones stay as often as they are, and an empty table stays empty.
    """
    text, size = free_names(documents, "redacted", "redacted_chars")
    names, at = documents.columns, [c.lower() for c in documents.columns].index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, BATCH):
                out = [None if t is None else redacted(t, find(t)[1]) for t in batch.column(at).to_pylist()]
                length = [None if t is None else len(t) for t in out]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(length, pa.int64())], [*names, text, size])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    rows = documents.mapInArrow(work, f"{fields}, `{text}` string, `{size}` long")
    new = {names[at].lower(): rows[text], "n_chars": rows[size]}
    return rows.select(*[new.get(c.lower(), rows[c]).cast(documents.schema[c].dataType).alias(c) for c in names])

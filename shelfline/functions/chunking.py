"""Chunks of bounded size: the small per-document helper.

Spark splits the documents and spreads them over tasks; this code sees one document at a time.  A document
is a row of tokens with places where it may be cut: before sections, paragraphs and sentences.  A chunk is
a slice of the original text between two tokens, so no text is lost and none is rewritten.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

#: One to six marks, white space and a text; only a line feed ends a line.
_HEADING = re.compile(r"^(#{1,6})[^\S\n]+([^\n]+)", re.M)
_WORD = re.compile(r"\S+")
_LINE_FEED = re.compile("\n")
_STOP = re.compile("[.!?]")


class Words:
    """Tokens are runs without white space; any object with ``spans`` will do."""

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in _WORD.finditer(text)]


@dataclass(frozen=True)
class ChunkRules:
    """``size``: most tokens of a chunk, of which the first ``overlap`` repeat the end of the chunk before.

    A cut at a border gives at least ``least`` new tokens.
    """

    size: int = 512
    overlap: int = 50
    least: int = 100

    def __post_init__(self):
        if not 0 <= self.overlap < self.size or not 1 <= self.least <= self.size - self.overlap:
            raise ValueError("need 0 <= overlap < size and 1 <= least <= size - overlap")


@dataclass(frozen=True)
class Section:
    path: tuple[str, ...]
    heading: str | None
    level: int
    start: int
    end: int


def outline(text: str) -> list[Section]:
    """Sections of a markdown text, the one before the first heading included; blank ones are left out.

    A heading cuts the path to the entries above its level and appends itself, so a skipped level leaves
    no hole.  A heading of blanks opens a section but names nothing.
    """
    found = list(_HEADING.finditer(text))
    edges = [0, *(m.start() for m in found), len(text)]
    out, path = [], ()
    for m, start, end in zip([None, *found], edges, edges[1:]):
        heading = m.group(2).strip() if m else ""
        level = len(m.group(1)) if m else 0
        if heading:
            path = (*path[: level - 1], heading)
        if text[start:end].strip():
            out.append(Section(path, heading or None, level, start, end))
    return out


def chunks(text: str, rules: ChunkRules, tokens) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(heading path where the new text starts, slice of the text, number of tokens) of each chunk.

    The new text of a chunk ends at the last section start that its size allows, else at the last start
    of a paragraph, else of a sentence, else where it is full.
    """
    spans = tokens.spans(text)
    n = len(spans)
    starts = [a for a, _ in spans]
    sections = outline(text)
    first = [bisect_right(starts, s.start - 1) for s in sections]
    # a text of one chunk needs no borders
    paragraphs, sentences = _borders(text, spans, starts) if n > rules.size else ([], [])
    at = 0
    while at < n:
        back = min(rules.overlap, at)
        most = at + rules.size - back
        end = n if n <= most else _last((first, paragraphs, sentences), at + rules.least, most)
        section = bisect_right(first, at) - 1
        yield sections[section].path if section >= 0 else (), text[starts[at - back] : spans[end - 1][1]], end - at + back
        at = end


def _borders(text: str, spans: list[tuple[int, int]], starts: list[int]) -> tuple[list[int], list[int]]:
    """Tokens with a blank line before them, and tokens after the end of a sentence."""
    paragraphs, sentences, n = [], [], len(spans)
    before = 0  # the token that the last line feed between tokens stands before
    for m in _LINE_FEED.finditer(text):
        i = bisect_left(starts, m.end())
        if 0 < i < n and spans[i - 1][1] <= m.start():
            if i == before and paragraphs[-1:] != [i]:
                paragraphs.append(i)
            before = i
    for m in _STOP.finditer(text):
        i = bisect_left(starts, m.end())
        if 0 < i < n and spans[i - 1][1] == m.end() < starts[i]:
            sentences.append(i)
    return paragraphs, sentences


def _last(borders: tuple[list[int], ...], low: int, high: int) -> int:
    """The last border between ``low`` and ``high`` of the first kind that has one, else ``high``."""
    for kind in borders:
        i = bisect_right(kind, high) - 1
        if i >= 0 and kind[i] >= low:
            return kind[i]
    return high

"""Places of markers in a text, and what they bound: the helper behind the section and chapter operators.

Every marker's places are found once a text and kept as a sorted list; a section is then the
first start that has a stop within its bounds, looked up by bisection.  Nothing is matched
lazily across a text, so the cost grows in proportion to its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from scholia.functions.text import SPACE

FLAGS = re.IGNORECASE | re.MULTILINE
_BODY = re.compile(r"\((?P<head>.*)\[\\s\\S\](?:\{(?P<least>\d+),(?P<most>\d+)\}\?|\*\?)\)\(\?=(?P<stop>.*)\)", re.DOTALL)
_LINE_HEAD, _LINE_TAIL = r"(?:^|\n)\s*", r"\s*[^\n\r]*"


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, its outermost group opened."""
    out, depth, kind, begun, k = [], 0, 0, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            kind = 1
        elif c == "]":
            kind = 0
        elif not kind:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                out.append(pattern[begun:k])
                begun = k + 1
        k += 1
    out.append(pattern[begun:])
    if len(out) == 1 and pattern.startswith("(?:") and pattern.endswith(")") and len(inner := alternatives(pattern[3:-1])) > 1:
        return inner
    return out


class Head(NamedTuple):
    """One way a section begins: its pattern, whether it begins a line after white space, the parts that follow on the same line
    (`.*?`), and whether the rest of the line belongs to it."""

    pattern: str
    line: bool
    parts: tuple[str, ...]
    tail: bool


class Bounded(NamedTuple):
    """A section: its heads in order, the least and greatest number of characters up to a stop, and the stops."""

    heads: tuple[Head, ...]
    least: int
    most: int | None
    stops: tuple[str, ...]


def bounded(pattern: str) -> Bounded | None:
    """The parts of `(head[\\s\\S]{least,most}?)(?=stops)`; None for a pattern of another form, which is matched as it is."""
    m = _BODY.fullmatch(pattern)
    if m is None:
        return None
    heads = []
    for p in alternatives(m["head"]):
        line, tail = p.startswith(_LINE_HEAD), p.endswith(_LINE_TAIL)
        core = p.removeprefix(_LINE_HEAD).removesuffix(_LINE_TAIL)
        first, *parts = core.split(".*?")
        if not first or not all(re.fullmatch("[一-鿿]+", x) for x in parts):
            return None
        heads.append(Head(first, line, tuple(parts), tail))
    return Bounded(tuple(heads), int(m["least"] or 0), int(m["most"]) if m["most"] else None, tuple(alternatives(m["stop"])))


class Places:
    """The places of patterns in one text, each found once."""

    def __init__(self, text: str):
        self.text, self._found, self._spans = text, {}, {}
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def line_end(self, at: int) -> int:
        k = bisect_left(self.lines, at)
        return self.lines[k] if k < len(self.lines) else len(self.text)

    def line_start(self, at: int) -> int:
        k = bisect_left(self.lines, at)
        return self.lines[k - 1] + 1 if k else 0

    def lines_before(self, at: int) -> int:
        return bisect_left(self.lines, at)

    def spans(self, pattern: str) -> list[tuple[int, int]]:
        """(start, end) of the matches that begin at every place."""
        if pattern not in self._spans:
            rx, at, out = compiled(pattern), 0, []
            if absent(pattern, self.text):
                rx = None
            while rx and (m := rx.search(self.text, at)):
                out.append(m.span())
                at = m.start() + 1
            self._spans[pattern] = out
        return self._spans[pattern]

    def of(self, patterns: tuple[str, ...]) -> list[int]:
        """The places of any of the patterns, in order; `$` is the end of each line."""
        if patterns not in self._found:
            told = set()
            for p in patterns:
                if p == "$":
                    told.update(self.lines)
                    told.add(len(self.text))
                else:
                    told.update(a for a, _ in self.spans(p))
            self._found[patterns] = sorted(told)
        return self._found[patterns]

    def white_before(self, at: int) -> int:
        """Where the white space that ends at `at` begins."""
        while at and self.text[at - 1].isspace():
            at -= 1
        return at

    def starts(self, head: Head):
        """(start, ends) of a head, in order: ends are tried in turn, or a range that is tried from its end on."""
        if head.pattern == "^":
            yield from ((a, (a,)) for a in [0, *(k + 1 for k in self.lines)])
            return
        seen = -1
        for begun, end in self.spans(head.pattern):
            start = begun
            if head.line:  # from the first line break of the white space before it, or from the text's beginning
                white = self.white_before(begun)
                start = 0 if not white else self.text.find("\n", white, begun)
                if start < 0:
                    continue
            ends: tuple[int, ...] | range = (end,)
            if head.parts:
                if begun < seen:  # an earlier start on this line has all its ends
                    continue
                seen = self.line_end(end)
                ends = self._chain(end, seen, head.parts)
            if head.tail:
                ends = range(end, self._tail_end(end) + 1)
            yield start, ends

    def _chain(self, at: int, line_end: int, parts: tuple[str, ...]) -> tuple[int, ...]:
        *before, last = parts
        for p in before:
            at = self.text.find(p, at, line_end)
            if at < 0:
                return ()
            at += len(p)
        out = []
        while (at := self.text.find(last, at, line_end)) >= 0:
            at += len(last)
            out.append(at)
        return tuple(out)

    def _tail_end(self, at: int) -> int:
        """The end of the first line with a character other than white space, from a head on."""
        n = len(self.text)
        while at < n and self.text[at].isspace():
            at += 1
        k = self.line_end(at)
        cr = self.text.find("\r", at, k)
        return cr if cr >= 0 else k

    def first(self, section: Bounded) -> tuple[int, int] | None:
        """(start, end) of a section: the first start with a stop in bounds."""
        heads = [(start, k, ends) for k, head in enumerate(section.heads) for start, ends in self.starts(head)]
        stops = self.of(section.stops) if heads else []
        for start, _, ends in sorted(heads, key=lambda x: x[:2]):
            if isinstance(ends, range):
                end = self._from_end_on(stops, ends, section)
            else:
                end = next((s for e in ends if (s := _next(stops, e, section)) is not None), None)
            if end is not None:
                return start, end
        return None

    def _from_end_on(self, stops: list[int], ends: range, section: Bounded) -> int | None:
        if (s := _next(stops, ends[-1], section)) is not None:
            return s
        k = bisect_left(stops, ends[-1] + section.least)  # else the last stop that a shorter line leaves room for
        return stops[k - 1] if k and stops[k - 1] >= ends[0] + section.least else None


def _next(stops: list[int], end: int, section: Bounded) -> int | None:
    k = bisect_left(stops, end + section.least)
    return stops[k] if k < len(stops) and (section.most is None or stops[k] <= end + section.most) else None


_patterns: dict[str, re.Pattern] = {}


def compiled(pattern: str) -> re.Pattern:
    if pattern not in _patterns:
        # white space after a line break is looked through once, from its beginning
        _patterns[pattern] = re.compile(pattern.replace(r"\n+\s*", r"\n\s*?"), FLAGS)
    return _patterns[pattern]


def absent(pattern: str, text: str) -> bool:
    """Whether a text lacks the letter without case that a pattern begins with."""
    c = pattern[0]
    return "一" <= c <= "鿿" and len(pattern) > 1 and pattern[1] not in "?*{" and c not in text


def first_sections(text: str, library: dict[str, str]) -> list[tuple[str, int, int, int, int]]:
    """(name, start, end, line of the start, line of the end) of the first match of each pattern; lines count from 1."""
    places, out = Places(text), []
    for name, pattern in library.items():
        parts = _parts(pattern)
        if parts is None:
            m = compiled(pattern).search(text)
            span = m.span() if m and m.end() > m.start() else None
        else:
            span = places.first(parts)
        if span:
            out.append((name, *span, *(places.lines_before(x) + 1 for x in span)))
    return out


_CHAPTER = re.compile("第[一二三四五六七八九十1-9]章")


@lru_cache(maxsize=None)
def _words(pattern: str) -> tuple[str, ...]:
    """Words of a pattern, one of which a text holds where it matches; none if it has no such words."""
    return tuple({w.casefold() for w in re.findall(r"[一-鿿]+|[A-Za-z]{4,}?(?=[A-Za-z]\?|[^A-Za-z]|$)", pattern)})


class Lines:
    """First matches of line patterns in one text."""

    def __init__(self, text: str):
        self.text, self._folded = text, None
        self.places = Places(text)

    def holds(self, word: str) -> bool:
        if not word.isascii():
            return word in self.text
        if self._folded is None:
            self._folded = self.text.casefold()
        return word in self._folded

    def first(self, pattern: str) -> tuple[int, int, str] | None:
        """(start, end, the first group) of the first match.  What follows `^\\s*` is looked for first, then the line's beginning before it."""
        words = _words(pattern)
        if words and not any(map(self.holds, words)):
            return None
        core = pattern.removeprefix(r"^\s*")
        at, rx = 0, compiled(core)
        while (m := rx.search(self.text, at)) and m.end() > m.start():
            start = m.start()
            if core != pattern:
                white = self.places.white_before(start)
                start = self.text.find("\n", white, start) + 1 if white else 0
            if start or core == pattern or not white:
                return start, m.end(), (m[1] or "") if rx.groups else ""
            at = m.start() + 1
        return None


def located_sections(text: str, asked: dict[str, tuple[tuple[str, float], ...]], nexts: tuple[str, ...]) -> Iterator[tuple]:
    """(name, title, score, start, end, line of the start, line of the end, next section, content) of each section that one of its patterns
    finds; lines count from 1."""
    lines, after = Lines(text), compiled(rf"\n\s*+({'|'.join(nexts)})?")  # a run of white space is gone through once
    for name, patterns in asked.items():
        best = None
        for k, (pattern, boost) in enumerate(patterns):
            if m := lines.first(pattern):
                start, end, group = m
                lead = not start or text[start - 1] == "\n"
                line_end = text[end : end + 1] == "\n"
                # the title stands between the white space (blank lines too) that a pattern takes in
                whole = text[start:end].lstrip(SPACE)
                start, whole = end - len(whole), whole.rstrip(SPACE)
                quality = 0.5 + 0.2 * lead + 0.2 * line_end + 0.3 * bool(_CHAPTER.search(whole)) + 0.1 * (2 <= len(whole) <= 50)
                best = max(best or (0, 0), (round(min(1.0, quality) + boost, 6), -k, start, start + len(whole), group))
        if best is None:
            continue
        score, _, start, end, group = best
        follows = next((m for m in after.finditer(text, end) if m[1]), None)
        stop = follows.start() if follows else len(text)
        clean, group = re.sub(r"\s+", " ", text[start:end]), group.strip(SPACE)
        title = group if len(group) > len(clean.rpartition(" ")[2]) else clean
        yield (name, title, score, start, stop, lines.places.lines_before(start) + 1, lines.places.lines_before(stop) + 1,
               follows[0].strip(SPACE) if follows else "", text[start:stop].strip(SPACE))


_split: dict[str, Bounded | None] = {}


def _parts(pattern: str) -> Bounded | None:
    if pattern not in _split:
        _split[pattern] = bounded(pattern)
    return _split[pattern]

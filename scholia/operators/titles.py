"""Where the titles of a document's chapters stand in its text: one pass over the text for all titles.

An automaton of the titles gives every place of every title; what stands around a place decides
which of the title patterns hold there, and the number before it is looked up, so that neither
a pattern is compiled for a title nor a text searched once a chapter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import ahocorasick

from scholia.operators.offsets import Places, compiled

#: patterns of a title, in this order: 第n章 t, Chapter n: t, ^n t, ^n. t, ^n[space . 、] t, ^t$, ###t, ^ t :$, t
ORDER = ("zh", "en", "plain", "dot", "mark", "line", "hash", "colon", "any")
FUZZY = 5


def fold(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word(c: str) -> bool:
    return c.isalnum() or c == "_"


def fuzzy_key(title: str) -> str:
    """The first word characters of a title that has over three."""
    bare = "".join(c for c in title if word(c))
    return fold(bare[:FUZZY]) if len(bare) > 3 else ""


class Titles:
    """First places of titles in a text, by pattern and number."""

    def __init__(self, places: Places, titles: Iterable[str], numbers: Iterable[str]):
        self.places, self.text = places, fold(places.text)
        self.numbers = {fold(n) for n in numbers}
        self.longest = max(map(len, self.numbers), default=0)
        self.found: dict[tuple, int] = {}
        keys = ahocorasick.Automaton()
        for t in titles:
            for key in (fold(t), fuzzy_key(t)):
                if key:
                    keys.add_word(key, key)
        if len(keys):
            keys.make_automaton()
            for last, key in keys.iter(self.text):
                self._note(key, last + 1 - len(key), last + 1)

    def _first(self, kind: str, key: str, more, at: int) -> None:
        self.found.setdefault((kind, key, more), at)

    def _number_before(self, at: int) -> Iterable[tuple[str, int]]:
        """Numbers that end at a place, with where they begin."""
        for n in range(1, min(self.longest, at) + 1):
            if self.text[at - n : at] in self.numbers:
                yield self.text[at - n : at], at - n

    def _begins_line(self, at: int) -> bool:
        return at == 0 or self.text[at - 1] == "\n"

    def _white_to_line_end(self, at: int) -> bool:
        end = self.places.line_end(at)
        while at < end and self.text[at].isspace():
            at += 1
        return at == end

    def _note(self, key: str, begun: int, end: int) -> None:
        text, white = self.text, self.places.white_before(begun)
        self._first("any", key, None, begun)
        for n, at in self._number_before(white):
            if self._begins_line(at):
                self._first("plain", key, n, at)
                if white < begun:
                    self._first("mark", key, n, at)
        if white and text[white - 1] in ".、":
            for n, at in self._number_before(white - 1):
                if self._begins_line(at):
                    self._first("mark", key, n, at)
                    if text[white - 1] == ".":
                        self._first("dot", key, n, at)
        if white and text[white - 1] == "章":
            for n, at in self._number_before(white - 1):
                if at and text[at - 1] == "第":
                    self._first("zh", key, n, at - 1)
        if white and text[white - 1] in "：:":
            for n, at in self._number_before(self.places.white_before(white - 1)):
                gap = self.places.white_before(at)
                if gap < at and text.endswith("chapter", 0, gap):
                    self._first("en", key, n, gap - len("chapter"))
        hashes = 0
        while hashes < 3 and hashes < white and text[white - hashes - 1] == "#":
            hashes += 1
        for level in range(hashes + 1):
            self._first("hash", key, level, white - hashes)
        if self._begins_line(begun) and self._white_to_line_end(end):
            self._first("line", key, None, begun)
        start = 0 if not white else text.find("\n", white, begun) + 1
        if not white or start:
            colon = end
            while colon < len(text) and text[colon].isspace():
                colon += 1
            if self._white_to_line_end(end) or (colon < len(text) and text[colon] in "：:" and self._white_to_line_end(colon + 1)):
                self._first("colon", key, None, start)

    def place(self, title: str, number: str | None, level: int | None) -> int | None:
        """Where the first pattern that holds anywhere has its first match; else where the title's first word characters stand,
        with what comes before them that is none."""
        key, n = fold(title), fold(number or "") or None
        more = {"line": None, "colon": None, "any": None, "hash": level}
        for kind in ORDER:
            by = more.get(kind, n)
            if (kind in more or n) and not (kind == "hash" and (level is None or level > 3)):
                at = self.found.get((kind, key, by))
                if at is not None:
                    return at
        at = self.found.get(("any", fuzzy_key(title), None))
        while at and not word(self.text[at - 1]):
            at -= 1
        return at


class Nexts:
    """Where what may follow a chapter begins: by patterns in order, each from a place on that counts as a line's beginning."""

    def __init__(self, places: Places, patterns: tuple[str, ...]):
        self.places, self.patterns = places, patterns

    def after(self, at: int) -> int | None:
        for p in self.patterns:
            if p.startswith("^") and compiled(p[1:]).match(self.places.text, at):
                return at
            told = self.places.of((p,))
            k = bisect_left(told, at)
            if k < len(told):
                return told[k]
        return None


def contents_by_title(text: str, chapters: list[dict], patterns: tuple[str, ...], past: int) -> list[tuple[int, int, int]]:
    """(number in the list, start, end) of the chapters (title, number, level) that are found."""
    places = Places(text)
    titles = Titles(places, {c["title"] for c in chapters}, {c["number"] for c in chapters if c["number"]})
    nexts, out = Nexts(places, patterns), []
    for k, c in enumerate(chapters):
        at = titles.place(c["title"], c["number"], c["level"])
        if at is not None:
            begun = min(at + len(c["title"]) + past, len(text))
            end = nexts.after(begun)
            out.append((k, at, len(text) if end is None else end))
    return out

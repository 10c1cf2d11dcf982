"""Many names in a text in one pass, and positions against spans without testing all of both.

An automaton over the names of a batch reads each text once. Texts are folded first, so that a name is found under any
separators and letter case, with the places of the folded signs kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import ahocorasick
import numpy as np

_SEPARATORS = re.compile(r"[-_.]+")
#: Letters that match another one where letter case is ignored, beside those with one lower form.
_SAME = str.maketrans({"İ": "i", "ı": "i"})


def fold(text: str) -> str:
    """text in one letter case, of the same length."""
    if text.isascii():
        return text.lower()
    out = []
    for c in text.translate(_SAME):
        low = c.casefold()
        out.append(low if len(low) == 1 else c.lower() if len(c.lower()) == 1 else c)
    return "".join(out)


def squeezed(text: str) -> tuple[str, list[int]]:
    """text folded, with one hyphen for each run of separators, and where each of its signs begins (one more for the end)."""
    runs = [m.span() for m in _SEPARATORS.finditer(text)]
    parts, at, starts = [], 0, []
    folded = fold(text)
    for s, e in runs:
        parts += [folded[at:s], "-"]
        starts += range(at, s + 1)
        at = e
    return "".join([*parts, folded[at:]]), [*starts, *range(at, len(text) + 1)]


class NameFinder:
    """Finds any of the names of a batch of rows."""

    def __init__(self, names: set[str]):
        self.keys: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for n in names:
            key = "-".join(p for p in fold(n).split("-") if p)
            self.keys[n] = key
            if key:
                self.automaton.add_word(key, key)
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def spans(self, text: str, names: list[str]) -> list[tuple[int, int]]:
        """Whole words of the text that are one of the names: longer names first take what is free, equal ones by name.

        The matches of one name do not overlap, the earlier one stays; what a longer name took is not free.
        """
        if not self.some or not text:
            return []
        order: dict[str, int] = {}
        for n in sorted(set(names), key=lambda k: (-len(k), k)):
            if self.keys[n]:
                order.setdefault(self.keys[n], len(order))
        if not order:
            return []
        flat, starts = squeezed(text)
        word = [c.isalnum() or c == "_" for c in text]
        places: list[list[tuple[int, int]]] = [[] for _ in order]
        for last, key in self.automaton.iter(flat):
            rank = order.get(key)
            if rank is None:
                continue
            s, e = starts[last + 1 - len(key)], starts[last] + 1
            # a border is where a word's sign and another, or an end of the text, meet
            if (s > 0 and word[s - 1]) == word[s] or (e < len(text) and word[e]) == word[e - 1]:
                continue
            if not places[rank] or places[rank][-1][1] <= s:
                places[rank].append((s, e))
        taken, out = bytearray(len(text)), []
        for own in places:
            for s, e in own:
                if taken.find(1, s, e) < 0:
                    taken[s:e] = b"\x01" * (e - s)
                    out.append((s, e))
        return out


def overlapping(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Whether each position with width meets any of the spans, which do not overlap each other: both sorted, then met once."""
    if not len(span_starts) or not len(starts):
        return np.zeros(len(starts), bool)
    order = np.argsort(span_starts, kind="stable")
    s, e = span_starts[order], span_ends[order]
    before = np.searchsorted(s, ends, "left") - 1  # the last span that begins before the position's end reaches furthest
    return (before >= 0) & (e[np.maximum(before, 0)] > starts) & (ends > starts)


class Positions:
    """Positions of tokens, sorted once, for many spans."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        order = np.argsort(starts, kind="stable")
        self.order, self.starts, self.ends = order, starts[order], ends[order]
        self.rising = bool((np.diff(self.ends) >= 0).all())

    def within(self, s: int, e: int) -> list[int]:
        """Numbers of the positions that a span meets, in order."""
        if self.rising:
            found = self.order[np.searchsorted(self.ends, s, "right") : np.searchsorted(self.starts, e, "left")]
        else:  # positions that contain others: only those that begin before the span's end are looked at
            upto = np.searchsorted(self.starts, e, "left")
            found = self.order[:upto][self.ends[:upto] > s]
        return sorted(found.tolist())

    def nearest(self, at: int) -> int | None:
        """The number of the position that begins nearest, the first of equals."""
        if not len(self.starts):
            return None
        i = int(np.searchsorted(self.starts, at, "left"))
        near = []
        if i < len(self.starts):
            near.append((int(self.starts[i]) - at, int(self.order[i])))
        if i:
            first = int(np.searchsorted(self.starts, self.starts[i - 1], "left"))
            near.append((at - int(self.starts[first]), int(self.order[first])))
        return min(near)[1]


_NUMBER = re.compile(r"\d+[.)]")
_ITEM = re.compile(r"(\d+[.)])\s*[`']?([a-zA-Z0-9\-_.]+)[`']?")
_SKIPPED = re.compile(r"\s*[`']?")


def _joined(text: str) -> tuple[str, list[int]]:
    """text without what may stand between an item's number and its name: a sign \\x01 for it, \\x00 where nothing stands; and where each sign begins."""
    parts, starts, at = [], [], 0
    for m in _NUMBER.finditer(text):
        gap = _SKIPPED.match(text, m.end())
        parts += [text[at : m.end()], "\x01" if gap.end() > m.end() else "\x00"]
        starts += range(at, m.end() + 1)
        at = gap.end()
    return "".join([*parts, text[at:]]), [*starts, *range(at, len(text) + 1)]


def listed(text: str, described: re.Pattern[str]) -> list[str] | None:
    """Names of a numbered list without those whose line has a match of `described`; null where fewer than two are left.

    An item's line is that of the first place in the text that reads like it: a number ending like its own and a name
    beginning like its own. All items' first places are found in one pass.
    """
    items = [m.group(1, 2) for m in _ITEM.finditer(text)]
    wanted = {x for x in items if len(x[1]) > 2}
    if len(items) < 2 or not wanted:
        return None
    flat, starts = _joined(text.replace("\x00", "\x02").replace("\x01", "\x02"))
    automaton = ahocorasick.Automaton()
    for number, name in wanted:
        inner = _NUMBER.sub(lambda m, n=len(name): m.group() + ("\x00" if m.end() < n else ""), name)
        for sign in "\x00\x01":
            automaton.add_word(f"{number}{sign}{inner}", (number, name, len(number) + 1 + len(inner)))
    automaton.make_automaton()
    first: dict[tuple[str, str], tuple[int, int]] = {}
    for last, (number, name, size) in automaton.iter(flat):
        s = starts[last + 1 - size]
        if (number, name) not in first or s < first[number, name][0]:
            first[number, name] = (s, starts[last] + 1)
    cues = [m.start() for m in described.finditer(text)]
    kept = []
    for number, name in items:
        if (number, name) not in wanted:
            continue
        s, e = first[number, name]
        line = text.find("\n", e)
        cue = bisect_left(cues, s)
        if cue == len(cues) or (line >= 0 and cues[cue] >= line):
            kept.append(name)
    return kept if len(kept) >= 2 else None


def lengths_before(lengths: list[int], gap: int) -> list[int]:
    """Where each of some parts begins when they are joined with a gap."""
    return [0, *accumulate(n + gap for n in lengths)][: len(lengths)]

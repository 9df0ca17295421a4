"""Multi-pattern matching over text, built on an Aho-Corasick automaton."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import ahocorasick


class PhraseMatcher:
    """Finds known phrases in a text.

    Phrases and texts must come in the same normalised form. With ``bounded`` a hit counts only where no
    alphanumeric character touches it from outside. A script written without spaces needs no bound: ``free`` tells
    of a phrase whether it is of that kind.
    """

    def __init__(self, phrases: Iterable[tuple[str, object]], bounded: bool = True, free=lambda phrase: False):
        self._automaton = ahocorasick.Automaton()
        self._empty = True
        for phrase, payload in phrases:
            if phrase:
                self._automaton.add_word(phrase, (len(phrase), not bounded or free(phrase), payload))
                self._empty = False
        if not self._empty:
            self._automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, object]]:
        """All hits as (start, end, payload)."""
        if self._empty or not text:
            return []
        found, last = [], len(text)
        for stop, (length, free, payload) in self._automaton.iter(text):
            start, end = stop - length + 1, stop + 1
            if free or ((start == 0 or not text[start - 1].isalnum()) and (end == last or not text[end].isalnum())):
                found.append((start, end, payload))
        return found

    def longest(self, text: str) -> list[tuple[int, int, object]]:
        """Longest hits that don't overlap, in text order; of equal length the earlier one wins."""
        taken: list[tuple[int, int, object]] = []
        for hit in sorted(self.hits(text), key=lambda h: (h[0] - h[1], h[0])):
            k = bisect_left(taken, hit[0], key=lambda h: h[0])
            if (k == 0 or taken[k - 1][1] <= hit[0]) and (k == len(taken) or hit[1] <= taken[k][0]):
                taken.insert(k, hit)
        return taken

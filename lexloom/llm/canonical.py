"""Mapping free-entered values to a canonical list.

A multi-pattern automaton over canonical names and their aliases finds embedded mentions; of those that overlap the
longest wins, and the longest of all is what the value stands for. Values in which no mention explains everything go to
token-set similarity: an inverted index from words (and from names written as one word), under all spellings with a few
letters left out, gives the entries that share a word with the value up to small slips, so the cost of a value
doesn't depend on how many names there are. A value that reaches the threshold for no entry, or for two entries alike,
is reported as unmatched (-1).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.automaton import PhraseMatcher

UNMATCHED = -1
# Words of remarks on usage or grammar that may stand around a name.
REMARKS = frozenset(
    "a an the as used only also usually often sometimes mainly chiefly esp especially usu or formal informal rare old "
    "dated archaic slang literary spoken written technical bre ame british american c u t i pl sing plural singular "
    "countable uncountable transitive intransitive attributive predicative form use type".split()
)
BRACKETED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")
#: Edits allowed between a word and one of the list, by the letters of the latter.
EDITS = ((4, 0), (8, 1), (1 << 62, 2))
#: Token-set similarity from which a value stands for a name.
LEAST_SIMILAR = 0.7
MEMO = 65_536


def allowed(letters: int) -> int:
    return next(e for size, e in EDITS if letters < size)


def normal(text: str) -> str:
    """Lower-case words with single spaces."""
    text = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(re.findall(r"[^\W_]+", text))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance in which a swap of neighbours is one edit, also with an edit between them.

    ``most + 1`` if larger than ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, same = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), same
            swap = table[k][m] + (i - k - 1) + 1 + (j - m - 1)
            row.append(min(table[i][j] + (x != y), row[j] + 1, table[i][j + 1] + 1, swap))
            if x == y:
                same = j
        table.append(row)
        seen[x] = i
    return min(table[-1][-1], most + 1)


def shortened(word: str, most: int) -> set[str]:
    """``word`` with up to ``most`` letters left out; two words within so many edits have one of these in common."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class NearIndex:
    """Words by their shortened spellings: finds those within the allowed edits of another word."""

    def __init__(self) -> None:
        self._by_short: dict[str, list[str]] = {}
        self._words: set[str] = set()
        self._longest = 0

    def add(self, word: str) -> None:
        if word not in self._words:
            self._words.add(word)
            self._longest = max(self._longest, len(word))
            for short in shortened(word, allowed(len(word))):
                self._by_short.setdefault(short, []).append(word)

    def near(self, word: str) -> dict[str, int]:
        """The indexed words within the edits they allow, with their number of edits."""
        most = allowed(len(word) + EDITS[-1][1])
        if len(word) > self._longest + most:
            return {}
        found: dict[str, int] = {}
        for short in shortened(word, most):
            for other in self._by_short.get(short, ()):
                if other not in found:
                    found[other] = edits(word, other, allowed(len(other)))
        return {other: n for other, n in found.items() if n <= allowed(len(other))}


class CanonicalList:
    """``names`` are (id, canonical name, aliases)."""

    def __init__(self, names: Iterable[tuple[int, str, tuple[str, ...]]]):
        phrases: dict[str, int] = {}
        self._names: list[tuple[int, frozenset[str]]] = []  # id and words of each canonical name
        self._with_word: dict[str, list[int]] = {}  # inverted index: numbers of the names that hold a word
        self._as_one: dict[str, list[int]] = {}  # numbers of the names by their words written as one
        self._near_words, self._near_names = NearIndex(), NearIndex()
        for ident, name, aliases in names:
            for phrase in (name, *aliases):
                words = normal(phrase)
                if not words:
                    continue
                plural = words + ("es" if words.endswith(("s", "x", "ch", "sh")) else "s")
                for form in (words, plural) if len(words) > 3 else (words,):
                    phrases.setdefault(form, ident)
                    phrases.setdefault(form.replace(" ", ""), ident)
            canonical = normal(name)
            if not canonical:
                continue
            number = len(self._names)
            self._names.append((ident, frozenset(canonical.split())))
            for word in self._names[-1][1]:
                self._with_word.setdefault(word, []).append(number)
                self._near_words.add(word)
            self._as_one.setdefault(canonical.replace(" ", ""), []).append(number)
            self._near_names.add(canonical.replace(" ", ""))
        self._exact = phrases
        self._matcher = PhraseMatcher(phrases.items())

    def find(self, value: str) -> int:
        """Id of the entry that ``value`` stands for, -1 if none."""
        whole = normal(value)
        if not whole:
            return UNMATCHED
        if whole in self._exact:
            return self._exact[whole]
        core = normal(BRACKETED.sub(" ", value)) or whole
        if core in self._exact:
            return self._exact[core]
        joined = core.replace(" ", "")
        if joined in self._exact:
            return self._exact[joined]
        hits = self._matcher.longest(core)
        mention = max(hits, key=lambda h: h[1] - h[0])[2] if hits else UNMATCHED  # the first of equal length
        spare = [w for w in self._outside(core, hits) if w not in REMARKS and not w.isdigit()]
        if hits and not spare:
            return mention
        similar = self._similar([w for w in core.split() if w not in REMARKS])
        return similar if similar != UNMATCHED else mention

    @staticmethod
    def _outside(text: str, hits: list[tuple[int, int, int]]) -> list[str]:
        parts, at = [], 0
        for start, end, _ in hits:
            parts.append(text[at:start])
            at = end
        return " ".join([*parts, text[at:]]).split()

    def _similar(self, words: list[str]) -> int:
        """The entry of the largest token-set similarity.

        Words of the value and of a name that agree up to the allowed edits are common, each for the share of its
        letters that agree; the similarity is the common letters over all letters of both sets. A value whose words as
        one agree with a name as one is as similar as their letters agree.
        """
        scores: dict[int, float] = {}
        distinct = set(words)
        near = {word: self._near_words.near(word) for word in distinct}
        reached = {n for found in near.values() for other in found for n in self._with_word[other]}
        for number in reached:
            own = self._names[number][1]
            pairs = sorted(
                (count / len(other), word, other)
                for word, found in near.items()
                for other, count in found.items()
                if other in own
            )
            used: set[str] = set()
            common, both = 0.0, sum(map(len, own)) + sum(map(len, distinct))
            for share, word, other in pairs:
                if ("value", word) not in used and ("name", other) not in used:
                    used |= {("value", word), ("name", other)}
                    common += len(other) * (1 - share)
                    both -= len(word)
            scores[number] = common / both
        for other, count in self._near_names.near("".join(words)).items():
            for number in self._as_one[other]:
                scores[number] = max(scores.get(number, 0.0), 1 - count / len(other))
        best = sorted(((-score, self._names[n][0]) for n, score in scores.items() if score >= LEAST_SIMILAR))
        if not best or len(best) > 1 and best[0][0] == best[1][0] and best[0][1] != best[1][1]:
            return UNMATCHED
        return best[0][1]


def map_to_canonical(df: DataFrame, column: str, names: list[tuple[int, str, tuple[str, ...]]], single) -> DataFrame:
    """``df`` with ``label_id`` for each value of ``column`` that holds one value; other rows are left out.

    ``single`` is a function of a text: whether it holds one value. Null and blank values are left out, values that
    match nothing get -1. Equal values are worked out once a task (a bounded memo), so skew costs nothing and there
    is no shuffle. ``names`` is a list of bounded size held by every task.
    """
    entries = [tuple(n) for n in names]

    @F.pandas_udf("int")
    def label_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool, memo = CanonicalList(entries), {}
        for batch in batches:
            out = []
            for value in batch:
                if value not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[value] = tool.find(value) if single(value) else None
                out.append(memo[value])
            yield pd.Series(out, dtype="Int32")

    return (
        df.where(F.col(column).isNotNull() & F.col(column).rlike(r"(?U)\S"))
        .withColumn("label_id", label_of(F.col(column)))
        .where(F.col("label_id").isNotNull())
    )

"""One consistent form for text that looks the same but differs in its characters.

A transducer over grapheme clusters, compiled once in each worker, rewrites a text in one pass. A token is the longest
key at its place: a cluster together with the invisible characters and accents after it that join it once the
invisible ones are gone, or a run of plain letters. Each key has a precomputed arc: its form in ordinary width,
unjoined, with accents composed and invisible characters gone, and that form once more for each script that its
letters imitate. The tables of widths, spaces, invisible characters, accents and imitations are joined when the
transducer is compiled; tables in which a key has two values, or a value that would change again, are refused. Clusters
beyond the precomputed ones (rare combinations of accents) get their arc by the same rule when first met.

Which script a word is written in is known at its end, so the arcs of a word wait until then; a word whose letters
all exist in both scripts waits for the end of the text. A word of one script is changed only if each of its letters
imitates a Latin one and the nearest other words that are sure are Latin; a word that mixes scripts is brought to the
script of its sure letters, or is left alone if one of its letters has no form there. So no word of two scripts comes
out unless it came in, and words truly of another script stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that imitate a Latin letter, "imitation latin" (a subset of Unicode's confusables).
CYRILLIC = (
    "а a|е e|о o|р p|с c|у y|х x|ѕ s|і i|ј j|һ h|ӏ l|ԁ d|ԛ q|ԝ w|ү y|ѵ v|А A|В B|Е E|К K|М M|Н H|О O|Р P|С C|Т T"
    "|У Y|Х X|Ѕ S|І I|Ј J|Һ h|Ӏ I|Ԛ Q|Ԝ W|Ү Y|Ѵ V"
)
GREEK = "ο o|ν v|ρ p|ϳ j|ϲ c|Α A|Β B|Ε E|Ζ Z|Η H|Ι I|Κ K|Μ M|Ν N|Ο O|Ρ P|Τ T|Υ Y|Χ X|Ϲ C|Ϳ J"
ARMENIAN = "օ o|Օ O|ո n|ս u|Ս U|հ h|ց g|զ q|յ j|Լ L"
LATIN = "ɑ a|ɡ g|ɩ i|ᴄ c|ᴏ o|ᴠ v|ᴡ w|ᴢ z"
#: Further imitations, believed only in a word that holds sure Latin letters or mixes scripts among Latin words.
WITHIN_LATIN = "α a|γ y|ι i|κ k|τ t|υ u|ω w|к k|т t|п n|г r"
# The letters that a Latin letter imitates in a word of another script.
TO_CYRILLIC = "a а|e е|o о|p р|c с|y у|x х|A А|B В|E Е|K К|M М|H Н|O О|P Р|C С|T Т|X Х|Y У"
TO_GREEK = "o ο|v ν|p ρ|A Α|B Β|E Ε|Z Ζ|H Η|I Ι|K Κ|M Μ|N Ν|O Ο|P Ρ|T Τ|Y Υ|X Χ"

#: Formatting characters, joiners, marks of direction, the soft hyphen, fillers, variation selectors.
INVISIBLE = regex.compile(r"[\p{Cf}\u115F\u1160\u17B4\u17B5\u180B-\u180F\u3164\uFFA0\u034F]")
VARIATION = regex.compile(r"[\uFE00-\uFE0F\U000E0100-\U000E01EF]")
JOINERS = "\u200C\u200D"
#: Clusters in which joiners, selectors and tags shape what is seen.
SHAPED = regex.compile(
    r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Tamil}\p{Telugu}\p{Kannada}"
    r"\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Mongolian}\p{Extended_Pictographic}]"
)
#: The longest key: plain letters that no accent follows, or a cluster with all that joins it.
TOKEN = regex.compile(
    r"[A-Za-z]+(?![\p{M}\p{Cf}])|\X(?:[\p{Cf}\u115F\u1160\u17B4\u17B5\u3164\uFFA0\u034F]+\p{M}+)*"
)
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "other")
#: Planes with assigned characters but private use.
_ASSIGNED = (*range(0x323B0), *range(0xE0000, 0xE0200))
MOST_ARCS = 65_536  # arcs kept; those of clusters met on the way are dropped beyond it and worked out again
MEMO = 65_536


def _pairs(*texts: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for text in texts:
        for pair in text.split("|"):
            key, value = pair.split()
            if out.setdefault(key, value) != value:
                raise ValueError(f"two values for {key!r}")
    return out


def _checked(mapping: dict[str, str]) -> dict[str, str]:
    """``mapping`` if no result is a key again, so that applying it twice changes nothing more."""
    for key, value in mapping.items():
        if any(c in mapping for c in value):
            raise ValueError(f"{key!r} leads to {value!r}, which is mapped again")
    return mapping


def _through_latin(mapping: dict[str, str], latin: dict[str, str], script: str) -> dict[str, str]:
    """``mapping`` with the letters of third scripts that imitate one of its keys."""
    more = {k: mapping[v] for k, v in latin.items() if v in mapping and script_of(k) != script}
    return _checked(more | mapping)


_SCRIPT = regex.compile("|".join(rf"(?P<{name}>\p{{Script={name}}})" for name in SCRIPTS[:-1]))


@lru_cache(maxsize=65_536)
def script_of(c: str) -> str:
    found = _SCRIPT.match(c)
    return found.lastgroup if found else "other"


_LATIN = _checked(_pairs(CYRILLIC, GREEK, ARMENIAN, LATIN))
IMITATIONS = {
    "Latin": _LATIN,
    "Latin-sure": _checked(_LATIN | _pairs(WITHIN_LATIN)),
    "Cyrillic": _through_latin(_pairs(TO_CYRILLIC), _LATIN, "Cyrillic"),
    "Greek": _through_latin(_pairs(TO_GREEK), _LATIN, "Greek"),
}
_WEAK = frozenset(_pairs(WITHIN_LATIN))
_SHARED = frozenset(_LATIN) | frozenset(_pairs(TO_CYRILLIC)) | frozenset(_pairs(TO_GREEK))


class Arc(NamedTuple):
    """What a key becomes; scripts are bits of ``SCRIPTS``."""

    letter: bool
    scripts: int
    sure: int  # scripts of letters that imitate none
    weak: int  # scripts of letters that imitate one only within sure words
    forms: tuple[str | None, ...]  # as it is, Latin, Cyrillic, Greek; None where a letter has no form there
    basic: bool  # Latin letters of the alphabet, accents aside


def _bit(script: str) -> int:
    return 1 << SCRIPTS.index(script)


LATIN_BIT, CYRILLIC_BIT, GREEK_BIT, ARMENIAN_BIT, OTHER_BIT = map(_bit, SCRIPTS)
_FORM = {LATIN_BIT: 1, CYRILLIC_BIT: 2, GREEK_BIT: 3}


def _ordinary(c: str) -> str:
    """A character in ordinary width, joined letters taken apart, spaces plain."""
    category = unicodedata.category(c)
    if category == "Zs":
        return " "
    kind = unicodedata.decomposition(c).partition(" ")[0]
    joined = (
        0xFB00 <= ord(c) <= 0xFB17
        or ord(c) in (0x132, 0x133)
        or 0x1C4 <= ord(c) <= 0x1CC
        or 0x1F1 <= ord(c) <= 0x1F3
    )
    if category[0] in "LN" and (kind in ("<wide>", "<narrow>", "<font>") or kind == "<compat>" and joined):
        return unicodedata.normalize("NFKC", c)
    return c


def _visible(cluster: str) -> str:
    if SHAPED.search(cluster):  # what shapes a cluster from inside stays, what trails a picture shapes nothing
        kept = INVISIBLE.sub(lambda m: m[0] if m[0] in JOINERS or "\U000E0020" <= m[0] <= "\U000E007F" else "", cluster)
        return kept if SHAPED.match(kept) and unicodedata.category(kept[0])[0] == "L" else kept.rstrip(JOINERS)
    seen = INVISIBLE.sub("", cluster)
    return VARIATION.sub("", seen) if seen and script_of(seen[0]) != "other" else seen


def arc_of(key: str) -> Arc:
    """The arc of a key, by the tables."""
    plain = unicodedata.normalize("NFC", "".join(map(_ordinary, _visible(key))))
    letter = plain[:1].isalpha()
    if not letter:
        return Arc(False, 0, 0, 0, (plain, plain, plain, plain), False)
    taken_apart = unicodedata.normalize("NFD", plain)
    scripts = sure = weak = 0
    basic = True
    for c in taken_apart:
        if c.isalpha():
            bit = _bit(script_of(c))
            scripts |= bit
            basic &= c.isascii() or c in _LATIN
            if c in _WEAK:
                weak |= bit
            elif c not in _SHARED:
                sure |= bit
    forms: list[str | None] = [plain]
    for script in ("Latin-sure", "Cyrillic", "Greek"):
        own = script.partition("-")[0]
        mapped = "".join(IMITATIONS[script].get(c, c) for c in taken_apart)
        fits = all(script_of(c) == own for c in mapped if c.isalpha())
        forms.append(unicodedata.normalize("NFC", mapped) if fits else None)
    return Arc(True, scripts, sure, weak, tuple(forms), basic)


class Transducer:
    """The compiled table of arcs, and the pass over a text."""

    def __init__(self) -> None:
        self._arcs: dict[str, Arc] = {}
        letters = sorted({*_LATIN, *_WEAK, *IMITATIONS["Cyrillic"], *IMITATIONS["Greek"]})
        accents: dict[str, list[str]] = {}
        for c in map(chr, _ASSIGNED):
            split = unicodedata.decomposition(c)
            if split and not split.startswith("<"):
                full = unicodedata.normalize("NFD", c)
                if unicodedata.normalize("NFC", full) == c:
                    self._put(full)
                    if len(full) == 2:
                        accents.setdefault(full[0], []).append(full[1])
                self._put(c)
            elif split or unicodedata.category(c) in ("Zs", "Cf"):
                self._put(c)
        for c in letters:
            self._put(c)
            for mark in accents.get(IMITATIONS["Latin-sure"].get(c, c), ()):
                self._put(c + mark)
        self._compiled = len(self._arcs)

    def _put(self, key: str) -> None:
        arc = arc_of(key)
        if self._arcs.setdefault(key, arc) != arc:
            raise ValueError(f"two values for {key!r}")

    def conflicts(self) -> list[tuple[str, str]]:
        """Compiled keys with a form that would change again; the tests hold that there are none."""
        arcs = list(self._arcs.items())[: self._compiled]
        return [(key, f) for key, arc in arcs for f in arc.forms if f is not None and arc_of(f).forms[0] != f]

    def _arc(self, key: str) -> Arc:
        arc = self._arcs.get(key)
        if arc is None:
            if len(self._arcs) >= self._compiled + MOST_ARCS:
                for met in list(self._arcs)[self._compiled :]:
                    del self._arcs[met]
            arc = self._arcs[key] = arc_of(key)
        return arc

    def run(self, text: str) -> str:
        """``text`` in its consistent form, without spaces at its ends."""
        out: list[str] = []
        word: list[Arc] = []
        sure: list[tuple[int, int]] = []  # place and script of the words that are settled
        waiting: list[tuple[int, list[Arc]]] = []
        for token in [*TOKEN.findall(text), ""]:
            arc = self._arc(token)
            if arc.letter:
                word.append(arc)
                continue
            if not arc.forms[0] and token:
                continue  # an invisible character doesn't end a word
            if word:
                script, form = settled(word)
                if script is None:
                    waiting.append((len(out), word))
                elif script:
                    sure.append((len(out), script))
                out.append("" if script is None else "".join(a.forms[form] for a in word))
                word = []
            out.append(arc.forms[0])
        if waiting:
            _resolve(waiting, sure, out)
        return unicodedata.normalize("NFC", "".join(out)).strip(" ")


def _bits(word: list[Arc]) -> tuple[int, int, int]:
    scripts = sure = weak = 0
    for arc in word:
        scripts |= arc.scripts
        sure |= arc.sure
        weak |= arc.weak
    return scripts, sure, weak


def _able(word: list[Arc], form: int) -> bool:
    return all(arc.forms[form] is not None for arc in word)


def settled(word: list[Arc]) -> tuple[int | None, int]:
    """(script, form) of a word; script None if its neighbours decide, 0 if it tells its neighbours nothing."""
    scripts, sure, weak = _bits(word)
    if scripts & OTHER_BIT:
        return 0, 0
    if scripts == LATIN_BIT:  # look-alikes of its own script count only beside nothing but letters of the alphabet
        return LATIN_BIT, 1 if all(arc.basic for arc in word) else 0
    if scripts & (scripts - 1) == 0:
        if scripts == GREEK_BIT and len(word) == 1:
            return 0, 0  # a Greek letter by itself is a symbol
        return (scripts, 0) if sure or weak else (None, 0)
    if not sure:
        return None, 0
    form = _FORM.get(sure)
    if form is None or not _able(word, form):
        return 0, 0
    return sure, form


def _nearest(places: list[int], sure: list[tuple[int, int]]) -> list[int]:
    """For each place the scripts of the settled words next to it on either side."""
    out, k = [], 0
    for place in places:
        while k < len(sure) and sure[k][0] < place:
            k += 1
        out.append((sure[k - 1][1] if k else 0) | (sure[k][1] if k < len(sure) else 0))
    return out


def _resolve(waiting: list[tuple[int, list[Arc]]], sure: list[tuple[int, int]], out: list[str]) -> None:
    """Writes the words that waited: first those that mix scripts, which then count as settled, then the others."""
    mixed = [(place, word) for place, word in waiting if (s := _bits(word)[0]) & (s - 1)]
    single = [(place, word) for place, word in waiting if not (s := _bits(word)[0]) & (s - 1)]
    fresh = []
    for (place, word), near in zip(mixed, _nearest([p for p, _ in mixed], sure)):
        weak = _bits(word)[2]
        foreign = [b for b in (CYRILLIC_BIT, GREEK_BIT) if near & b]
        wanted = foreign if foreign else [LATIN_BIT] if near or not weak else [b for b in _FORM if weak & b]
        script = next((b for b in wanted if _able(word, _FORM[b])), None)
        if script is None and _able(word, 1):
            script = LATIN_BIT
        out[place] = "".join(arc.forms[_FORM[script] if script else 0] for arc in word)
        if script:
            fresh.append((place, script))
    sure = sorted(sure + fresh)
    for (place, word), near in zip(single, _nearest([p for p, _ in single], sure)):
        latin = near == LATIN_BIT and _able(word, 1)
        out[place] = "".join(arc.forms[1 if latin else 0] for arc in word)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def consistent(text: str) -> str:
    """``text`` in its consistent form, without spaces at its ends."""
    return text.strip(" ") if text.isascii() else transducer().run(text)


@F.pandas_udf(T.StringType())
def consistent_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of :func:`consistent`; null stays null, blank text becomes empty."""
    memo: dict[str, str] = {}
    for batch in batches:
        out = []
        for text in batch:
            if text is None:
                out.append(None)
                continue
            if text not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[text] = consistent(text)
            out.append(memo[text])
        yield pd.Series(out, dtype=object)


def inconsistent_texts(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """(id, field, clean_text) for each text of ``fields`` that isn't in its consistent form.

    Nulls and texts of ASCII characters alone are left out on the JVM side. A text that differs only by ordinary
    spaces at its ends is none. A text of nothing but invisible characters gets an empty ``clean_text``. Rows are
    independent, so there is no shuffle.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return (
        df.select(F.col(id_column), F.explode(texts).alias("f"))
        .select(id_column, "f.field", "f.text")
        .where(F.col("text").rlike(r"[^\x00-\x7F]"))
        .withColumn("clean_text", consistent_form("text"))
        .where(F.col("clean_text") != F.btrim("text", F.lit(" ")))
        .select(id_column, "field", "clean_text")
    )

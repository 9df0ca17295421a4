"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton finds known whole values and fixed expressions; quotes, brackets, ratios and units are
spans that no cut may enter; dynamic programming then picks the cheapest cover of the field by values. A comma,
slash, bar or line break cuts unless the value around it is known as a whole; a word such as ``and`` cuts only
where known values stand on both sides.

The dictionary of a field is a list of bounded size that every task holds (parts of speech), or the field's own
column: the values that stand alone in other rows. That one grows with the data, so it never comes together: the
pieces of each packed text that could be values are joined with it, and a text gets those of its pieces that are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.automaton import PhraseMatcher

# English expressions written with a slash.
FIXED_EXPRESSIONS = (
    "and/or", "either/or", "he/she", "she/he", "his/her", "her/his", "him/her", "himself/herself", "s/he",
    "w/o", "w/", "n/a", "c/o", "a/c", "i/o", "r/c", "b/w", "24/7", "50/50", "read/write", "on/off", "yes/no",
)
# Units over units, and ratios.
UNITS = "km|m|cm|mm|mi|ft|kg|g|mg|l|ml|kb|mb|gb|kwh|j|n|mol|rad|rev|beats|words"
PER_UNITS = "h|hr|s|sec|min|ms|l|ml|m|m2|m3|kg|km|day|wk|mo|yr|mol"
RATIO = re.compile(rf"(?<![\w/])(?:\d+(?:[.,]\d+)?/\d+(?:[.,]\d+)?|(?:{UNITS})/(?:{PER_UNITS}))(?![\w/])", re.I)

STRONG = ",;/|、，；／｜\t\n\r\v\f"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】"}
WEAK = re.compile(r"\s+(?:and|or)\s+|\s*[&+]\s*", re.I)
NUMBER = re.compile(r"(?:(?<=\s)|^)\(?(\d{1,2})[.)]\s+")
AFTER_QUOTE = re.compile(rf" *(?:\Z|[{STRONG}(\[])")
WHITE = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Costs of a cut at a word and of a value that isn't known; only a known value may hold a delimiter.
CUT_WEAK, UNKNOWN = 0.01, 1.0
#: Rows from which a text of words such as ``and`` alone counts as a value of the column's own dictionary.
LEAST_WHOLE = 2
SALTS = 8  # parts into which the rows of one text are spread where its known pieces are joined to them


def may_be_packed(column: Column) -> Column:
    """Whether a field can hold several values, on the JVM side: any delimiter, delimiting word or numbering."""
    lower = F.lower(column)  # white space other than a space is a delimiter itself
    return (
        column.rlike(r"[,;/|、，；／｜\t\n\r\x0b\x0c&+]")
        | lower.contains(" and ")
        | lower.contains(" or ")
        | column.rlike(r"\d[.)] ")
    )


def folded(text: str) -> tuple[str, list[int] | None]:
    """``text`` case-folded, and the place in ``text`` of each of its characters (None where places agree)."""
    whole = text.casefold()
    if len(whole) == len(text):
        return whole, None
    return whole, [i for i, c in enumerate(text) for _ in c.casefold()]


class Segmenter:
    """Splits a field into its values; ``values`` are the known whole values, in any case."""

    def __init__(self, values: Iterable[str] = (), expressions: Iterable[str] = FIXED_EXPRESSIONS):
        self._values = frozenset(v.casefold().strip() for v in values)
        self._longest_known = max(map(len, self._values), default=0)
        self._matcher = PhraseMatcher(
            [(e.casefold(), "expression") for e in expressions] + [(v, "value") for v in self._values]
        )

    def _protected(self, text: str, own: PhraseMatcher | None) -> list[tuple[int, int]]:
        """Spans that no cut may enter; ``own`` finds the values known of this text."""
        spans, i, fresh = [], 0, True  # fresh: a value may begin here
        unclosed: set[str] = set()  # marks that nothing further on closes
        while i < len(text):
            c = text[i]
            end = 0
            if c not in unclosed and (fresh and c in QUOTES or c in BRACKETS):
                end = self._closing(text, i) if c in QUOTES else text.find(BRACKETS[c], i + 1) + 1
                if not end:
                    unclosed.add(c)
            if end:
                spans.append((i, end))
                i, fresh = end, False
            else:
                weak = WEAK.match(text, i)
                if c in STRONG:
                    fresh = True
                elif weak:
                    fresh = True
                    i = weak.end()
                    continue
                elif not c.isspace():
                    fresh = False
                i += 1
        lower, places = folded(text)
        hits = self._matcher.hits(lower) + (own.hits(lower) if own else [])
        for start, end, kind in hits:
            if places:
                start, end = places[start], places[end - 1] + 1
            if kind == "expression" and (end == len(text) or text[end] != "/") and (not start or text[start - 1] != "/"):
                spans.append((start, end))
            elif kind == "value" and any(c in STRONG for c in text[start:end]):
                spans.append((start, end))  # a legitimate value that holds delimiters
        spans += [m.span() for m in RATIO.finditer(text)]
        merged: list[tuple[int, int]] = []
        for start, end in sorted(spans):
            if merged and start < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged

    @staticmethod
    def _closing(text: str, start: int) -> int:
        """End of the quotation that begins at ``start``, 0 if it isn't closed before a delimiter or the end."""
        close, end = QUOTES[text[start]], start + 1
        while (end := text.find(close, end)) >= 0:
            end += 1
            if end - start > 2 and (AFTER_QUOTE.match(text, end) or WEAK.match(text, end)):
                return end
        return 0

    def _cuts(self, text: str, own: PhraseMatcher | None = None) -> list[tuple[int, int, bool]]:
        """Possible cuts as (start, end, weak)."""
        spans = self._protected(text, own)
        starts = [a for a, _ in spans]

        def inside(start: int, end: int) -> bool:
            k = bisect_left(starts, end) - 1
            return k >= 0 and spans[k][1] > start

        cuts = [(m.start(), m.end(), False) for m in re.finditer(rf"[{STRONG}]+", text)]
        cuts += [(m.start(), m.end(), True) for m in WEAK.finditer(text)]
        marks = list(NUMBER.finditer(text))
        if len(marks) > 1 and [int(m[1]) for m in marks] == list(range(1, len(marks) + 1)) and not text[: marks[0].start()].strip():
            cuts += [(m.start(), m.end(), False) for m in marks]
        return [c for c in sorted(set(cuts)) if not inside(c[0], c[1])]

    def split(self, text: str | None, own: Iterable[str] = ()) -> list[str]:
        """The values of ``text`` in order; none for a null, empty or blank text.

        ``own`` are values known besides the dictionary, those of a column's own dictionary that this text holds.
        """
        if text is None or not text.strip():
            return []
        known = frozenset(v.casefold().strip() for v in own)
        cuts = self._cuts(text, PhraseMatcher([(v, "value") for v in known]) if known else None)
        if not cuts:
            return [self._bare(text)] if self._bare(text) else []
        longest = max(self._longest_known, max(map(len, known), default=0))
        # best[i] is the cheapest cover up to border i; cuts at delimiters are free.
        borders = [(0, 0, False), *cuts, (len(text), len(text), False)]
        starts, ends = _cores(text, borders)
        best, back = [0.0], [0]
        run = 0  # of the borders since the last delimiter, the one with the cheapest cover
        for i in range(1, len(borders)):
            # a value that isn't known reaches back to the cheapest border that no delimiter parts it from
            options = [(best[run] + UNKNOWN, run)]
            for j in range(i - 1, -1, -1):
                core = text[starts[j] : ends[i]]
                if len(core) > longest and j < i - 1:
                    break  # no longer one is known
                lower = core.casefold()
                blank = not core and not text[borders[j][1] : borders[i][0]].strip()
                if blank or lower in self._values or lower in known or j == i - 1 and self._bare(core) != core:
                    options.append((best[j], j))
            cost, j = min(options)
            best.append(cost + (CUT_WEAK if borders[i][2] else 0))
            back.append(j)
            if not borders[i][2] or best[i] < best[run]:
                run = i
        pieces, i = [], len(borders) - 1
        while i:
            j = back[i]
            pieces.append(text[borders[j][1] : borders[i][0]])
            i = j
        return [v for v in map(self._bare, reversed(pieces)) if v]

    def whole(self, text: str) -> tuple[str | None, int, bool]:
        """(value, parts, needs several rows) of a text that stands for one value though it holds delimiters.

        That is a text in quotes, or one with no other delimiters than words such as ``and``; the value is None for any
        other. ``parts`` counts the pieces between all its possible cuts.
        """
        outer = text.strip()
        value = self._bare(outer)
        cuts = self._cuts(value)
        if value != outer or all(weak for _, _, weak in cuts):
            starts, ends = _cores(value, [(0, 0, False), (len(value), len(value), False)])
            return value[starts[0] : ends[1]] or None, len(cuts) + 1, value == outer
        return None, 0, False

    def windows(self, text: str, longest: dict[int, int]) -> list[str]:
        """Pieces of ``text`` that may be known values: runs of n parts, for each n of ``longest`` up to that length.

        Single parts only matter where a word such as ``and`` may cut.
        """
        cuts = self._cuts(text)
        borders = [(0, 0, False), *cuts, (len(text), len(text), False)]
        starts, ends = _cores(text, borders)
        weak = any(w for _, _, w in cuts)
        found = {}
        for n, most in longest.items():
            for i in range(n, len(borders)) if n > 1 or weak else ():
                core = text[starts[i - n] : ends[i]]
                if core and len(core) <= most:
                    found[core] = None
        return list(found)

    def _bare(self, piece: str) -> str:
        """``piece`` as written, without outer white space and enclosing quotes."""
        piece = piece.strip()
        if piece and piece[0] in QUOTES and self._closing(piece, 0) == len(piece):
            return piece[1:-1].strip()
        return piece


def _cores(text: str, borders: list[tuple[int, int, bool]]) -> tuple[list[int], list[int]]:
    """Where a value that starts or ends at each border does so: white space, a remark in brackets and dots aside."""
    opened: dict[int, int] = {}  # closing bracket -> opening one, without any bracket between
    last = -1
    if ")" in text or "]" in text:
        for i, c in enumerate(text):
            if c in "([":
                last = i
            elif c in ")]":
                if last >= 0:
                    opened[i] = last
                last = -1
    starts, ends = [], []
    for before, after, _ in borders:
        start, end = after, before
        while start < len(text) and text[start].isspace():
            start += 1
        end = _outer(text, end)
        if end - 1 in opened:
            end = _outer(text, opened[end - 1])
        while end and text[end - 1] == ".":
            end -= 1
        starts.append(start)
        ends.append(_outer(text, end))
    return starts, ends


def _outer(text: str, end: int) -> int:
    while end and text[end - 1].isspace():
        end -= 1
    return end


@lru_cache(maxsize=16)
def segmenter(values: tuple[str, ...], expressions: tuple[str, ...]) -> Segmenter:
    return Segmenter(values, expressions)


def _packed_texts(df: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """The texts of a column that may be packed, and the others."""
    texts = df.select(F.col(f"`{field}`").alias("text")).where(F.col("text").isNotNull())
    may = may_be_packed(F.col("text"))
    return texts.where(may), texts.where(~may)


def own_dictionary(
    df: DataFrame, field: str, expressions: tuple[str, ...], least_whole: int
) -> tuple[DataFrame, DataFrame]:
    """(value in lower case, parts) of the values that stand alone in a column: those of one part, and the others.

    A value stands alone in a row whose field has no delimiter, whose whole field is quoted, or, where words such as
    ``and`` are the only delimiters, in at least ``least_whole`` rows.
    """
    packed, plain = _packed_texts(df, field)

    def wholes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = segmenter((), tuple(expressions))
        for batch in batches:  # equal texts of a batch are worked out once
            rows = [(*tool.whole(text), n) for text, n in batch["text"].value_counts().items()]
            found = pd.DataFrame(rows, columns=["value", "parts", "several", "n"])
            yield found[found["value"].notna()]

    several = (
        packed.mapInPandas(wholes, "value string, parts int, several boolean, n long")
        .groupBy(F.lower("value").alias("value"), "parts")
        .agg(F.sum("n").alias("n"), F.bool_and("several").alias("several"))
        .where(~F.col("several") | (F.col("n") >= least_whole))
    )
    bare = F.btrim(F.rtrim(F.btrim("text", F.lit(WHITE)), F.lit(".")), F.lit(WHITE))
    alone = plain.select(F.lower(bare).alias("value"), F.lit(1).alias("parts")).where("value <> ''")
    return alone, several.select("value", "parts")


def known_pieces(
    df: DataFrame, field: str, expressions: tuple[str, ...] = FIXED_EXPRESSIONS, least_whole: int = LEAST_WHOLE
) -> DataFrame:
    """(text, known) for each distinct packed text of a column that holds values of the column's own dictionary.

    The join is by value: a value is one row of the dictionary, a piece one row of a distinct text. Of the dictionary
    the driver only gets the length of the longest value for each number of parts but one.
    """
    alone, several = own_dictionary(df, field, expressions, least_whole)
    sizes = several.groupBy("parts").agg(F.max(F.length("value")).alias("most")).collect()
    longest = {r["parts"]: r["most"] for r in sizes} | {1: 1 << 62}  # single parts are as many as cuts
    values = alone.unionByName(several)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = segmenter((), tuple(expressions))
        for batch in batches:
            rows = [(text, piece) for text in batch["text"].unique() for piece in tool.windows(text, longest)]
            yield pd.DataFrame(rows, columns=["text", "piece"])

    pieces = _packed_texts(df, field)[0].mapInPandas(windows, "text string, piece string")
    held = pieces.withColumn("value", F.lower("piece")).join(values.select("value").distinct(), "value", "left_semi")
    return held.groupBy("text").agg(F.collect_set("piece").alias("known"))


def split_packed(
    df: DataFrame,
    id_column: str,
    dictionaries: dict[str, tuple[str, ...] | None],
    expressions: tuple[str, ...] = FIXED_EXPRESSIONS,
    least: int = 2,
) -> DataFrame:
    """One row (id, field, position, value) for each value of a packed field.

    ``dictionaries`` names the fields and their known whole values; None stands for the values that stand alone in the
    column itself. Fields with fewer than ``least`` values yield nothing; so do null, empty and blank ones. Rows are
    independent but for that dictionary, and extra columns don't matter. Repeated rows give repeated output.
    """
    known = dict(dictionaries)

    @F.pandas_udf("array<string>")
    def values_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tools = {field: segmenter(tuple(values or ()), tuple(expressions)) for field, values in known.items()}
        for fields, texts, owns in batches:
            seen: dict[tuple[str, str], list[str]] = {}
            out = []
            for field, text, own in zip(fields, texts, owns):
                if (field, text) not in seen:
                    seen[field, text] = tools[field].split(text, () if own is None else own)
                out.append(seen[field, text])
            yield pd.Series(out, dtype=object)

    packed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in known])
    may = may_be_packed(F.col("text")) if least > 1 else F.col("text").isNotNull()
    rows = (
        df.select(F.col(f"`{id_column}`").alias(id_column), F.explode(packed).alias("f"))
        .select(id_column, "f.field", "f.text")
        .where(may)
    )
    own = None
    for field in (f for f, values in known.items() if values is None):
        # a text that very many rows have is one row of ``own``; salts spread its rows
        part = known_pieces(df, field, expressions).select(
            F.lit(field).alias("field"), "text", "known", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        )
        own = part if own is None else own.unionByName(part)
    if own is None:
        rows = rows.withColumn("known", F.lit(None).cast("array<string>"))
    else:
        salt = F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(own, ["field", "text", "salt"], "left")
    return (
        rows.select(id_column, "field", values_of("field", "text", "known").alias("values"))
        .where(F.size("values") >= least)
        .select(id_column, "field", F.posexplode("values").alias("position", "value"))
        .select(id_column, "field", (F.col("position") + 1).cast("int").alias("position"), "value")
    )

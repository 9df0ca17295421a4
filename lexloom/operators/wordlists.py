"""Word-list parsers: running text lines to entries.

Lines are rows of (document keys, line number, text). Each parser marks lines by patterns, carries headings forward
and numbers the runs of lines that make one entry, so a document is never held whole by one row; only the text of
one entry is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.gates import GateError
from lexloom.operators.ordered import blocked

#: Lines of one document that share a window task.
LINE_BLOCK = 10_000


def lines_of(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, line_no, line) of every line of a text; no rows for a null text, one empty line for an empty one."""
    return df.where(F.col(text).isNotNull()).select(
        id_column, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line")
    )


def entries_by_head(lines: DataFrame, keys: list[str], head: str, group: int = 1) -> DataFrame:
    """(keys, entry, head, first_line, n_lines, rest) of entries that begin with a line matching ``head``.

    ``group`` of the pattern is the head itself. Lines before the first head belong to entry 0 with a null head;
    the lines after a head are its notes, in order.
    """
    starts = F.col("line").rlike(head)
    marked = blocked(
        lines,
        keys,
        ["line_no"],
        F.floor(F.col("line_no") / LINE_BLOCK),
        {"entry": ("sum", F.when(starts, 1).otherwise(0))},
    )
    is_head = F.col("line").rlike(head)
    notes = F.array_compact(F.collect_list(F.when(~is_head & (F.btrim("line") != ""), F.struct("line_no", "line"))))
    return marked.groupBy(*keys, "entry").agg(
        F.min(F.when(is_head, F.regexp_extract("line", head, group))).alias("head"),
        F.min("line_no").alias("first_line"),
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(notes), lambda n: F.btrim(n["line"])), " ").alias("rest"),
    )


def entries_until(lines: DataFrame, keys: list[str], terminator: str) -> DataFrame:
    """(keys, entry, first_line, text, complete): lines joined up to and including one that matches ``terminator``.

    Text after the last terminator comes out as an entry that isn't complete; nothing is dropped.
    """
    ends = F.when(F.col("line").rlike(terminator), 1).otherwise(0)
    marked = blocked(lines, keys, ["line_no"], F.floor(F.col("line_no") / LINE_BLOCK), {"ended": ("sum", ends)})
    entry = (F.col("ended") - F.when(F.col("line").rlike(terminator), 1).otherwise(0)).alias("entry")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda n: F.btrim(n["line"]))
    return marked.select(*keys, "line_no", "line", entry).groupBy(*keys, "entry").agg(
        F.min("line_no").alias("first_line"),
        F.btrim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")).alias("text"),
        F.bool_or(F.col("line").rlike(terminator)).alias("complete"),
    )


def with_sections(lines: DataFrame, keys: list[str], heading: str, group: int = 1) -> DataFrame:
    """Lines that are no headings, with the heading above them (null before the first)."""
    title = F.when(F.col("line").rlike(heading), F.regexp_extract("line", heading, group))
    marked = blocked(lines, keys, ["line_no"], F.floor(F.col("line_no") / LINE_BLOCK), {"section": ("last", title)})
    return marked.where(~F.col("line").rlike(heading))


def comma_stream(blocks: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, n, term) of a comma-separated stream that runs on over blocks; a term cut by a block's end is whole again.

    For streams of bounded length, such as one section of a book.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda b: b[text]), " ")
    terms = F.filter(
        F.transform(F.split(joined, ","), lambda t: F.btrim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != ""
    )
    return blocks.groupBy(*keys).agg(terms.alias("terms")).select(*keys, F.posexplode("terms").alias("n", "term"))


def coded_lines(lines: DataFrame, codes: dict[str, str]) -> DataFrame:
    """``CODE|term`` lines as (…, code, term, problem); lines without a problem are entries, blank lines are left out."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    code, term = F.btrim(F.substring_index("line", "|", 1)), F.btrim(F.regexp_replace("line", r"^[^|]*\|", ""))
    problem = (
        F.when(~F.col("line").contains("|"), "no_delimiter")
        .when(F.try_element_at(known, code).isNull(), "unknown_code")
        .when(term == "", "empty_term")
        .when(term.rlike("[㐀-鿿]"), "wrong_script")
    )
    return lines.where(F.btrim("line") != "").select(
        "*", F.try_element_at(known, code).alias("label"), term.alias("term"), problem.alias("problem")
    )


def ordered_unique(text: str) -> list[str]:
    """Terms of a bar-separated literal in order; a repeated one (case aside) aborts."""
    terms = [" ".join(t.split()) for t in text.split("|")]
    terms = [t for t in terms if t]
    if len({t.casefold() for t in terms}) != len(terms):
        raise GateError("a term stands twice")
    return terms


def missing_from_pages(plan: DataFrame, pages: DataFrame, seen: Column) -> DataFrame:
    """Planned (page, term) rows that their page doesn't show; ``seen`` compares the two sides' columns.

    Each planned term meets its own page only, so the work is one equi-join.
    """
    shown = plan.join(pages, "page").where(seen).select("page", "term").distinct()
    return plan.join(shown, ["page", "term"], "left_anti")


def apply_fixes(rows: DataFrame, fixes: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with reviewed replacements of ``target`` by ``key``, and the fixes that no row used."""
    fixed = rows.join(fixes.select(key, F.col("fixed").alias("_fixed")), key, "left")
    unused = fixes.join(rows.select(key).distinct(), key, "left_anti")
    return fixed.withColumn(target, F.coalesce("_fixed", target)).drop("_fixed"), unused

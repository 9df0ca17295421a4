"""Queries of the general training-data operators (problems 1 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.packed import split_packed
from lexloom.operators.rowparse import accepted, parse_lines, rejected
from lexloom.sources.tables import load, small_rows

#: The dictionary of parts of speech is a configuration table; a larger one is refused.
MOST_LABELS = 10_000
# The column names of the two file layouts.
TSV_COLUMNS = [
    "source", "raw_term", "headword", "pos", "cefr", "topic_or_section", "pdf_page", "source_ref", "definition",
    "notes", "registry_source_id", "source_role", "corpus_policy", "source_format", "locator",
]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the packed ``pos`` and ``headword`` fields, with its place."""
    labels = small_rows(load(spark, d, "pos_labels", "label", "short_form"), MOST_LABELS)
    names = tuple(sorted({x for row in labels for x in row if x}))
    return split_packed(
        load(spark, d, "source_rows", "row_id", "pos", "headword"), "row_id", {"pos": names, "headword": None}
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every raw line that fails, with the first reason."""
    return rejected(_parsed(spark, d, None))


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every valid raw line as a row of typed-by-name columns, whatever the order of columns in its file."""
    return accepted(_parsed(spark, d, ()), TSV_COLUMNS)


def _parsed(spark: SparkSession, d: str, keep: tuple[str, ...] | None) -> DataFrame:
    return parse_lines(
        load(spark, d, "raw_lines"), load(spark, d, "raw_files"), load(spark, d, "source_registry"), keep
    )


QUERIES = {"p1_found": p1_found, "p6_found": p6_found, "p6_rows": p6_rows}
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fields are matched from tab to tab; where quoting is broken, what is matched isn't the whole line.
_P6_PARSED = (
    r"""
WITH reg AS (SELECT DISTINCT lower(regexp_replace(display_name, '^SPACE+|SPACE+$', '', 'g')) AS name FROM source_registry),
l AS (SELECT line_id, file_id, line_no, chr(9) || regexp_replace(regexp_replace(coalesce(raw_line, ''), '^\x{feff}', ''), '\r\z', '') AS x FROM raw_lines),
f AS (SELECT line_id, file_id, line_no, x, regexp_extract_all(x, '\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)') AS fs, string_split(header, chr(9)) AS h
  FROM l LEFT JOIN raw_files USING (file_id)),
v AS (SELECT line_id, file_id, line_no, array_to_string(fs, '') = x AS closed, len(fs) = len(h) AS fits,
    [CASE WHEN y[2:2] = '"' THEN replace(y[3:-2], '""', '"') ELSE y[2:] END FOR y IN fs] AS vs, h FROM f),
w AS (SELECT line_id, file_id, line_no, vs, h, closed, coalesce(fits, false) AS fits, vs[list_position(h, 'source')] AS source, vs[list_position(h, 'headword')] AS head,
    vs[list_position(h, 'raw_term')] AS raw FROM v),
c AS (SELECT *, regexp_replace(head, 'SPACE+', '', 'g') = '' AS no_head, regexp_replace(raw, 'SPACE+', '', 'g') = '' AS no_raw,
    NOT regexp_matches(head, '\p{L}') OR length(head) > 120 OR regexp_matches(head, 'BAD') AS bad_head,
    NOT regexp_matches(raw, '\p{L}') OR length(raw) > 120 OR regexp_matches(raw, 'BAD') AS bad_raw FROM w),
r AS (SELECT line_id, file_id, line_no, vs, h, CASE WHEN NOT closed THEN 'quoting' WHEN NOT fits THEN 'column_count'
    WHEN lower(regexp_replace(source, '^SPACE+|SPACE+$', '', 'g')) NOT IN (SELECT name FROM reg) OR no_head OR bad_head OR (NOT no_raw AND bad_raw)
    THEN 'invalid_value' END AS reason FROM c)
""".replace("SPACE", _SPACE).replace(
        "BAD", r"[\x00-\x08\x0a-\x1f\x7f-\x{9f}\x{fffd}]|\p{Co}"
    )
)
_COLUMNS = ", ".join(f"vs[list_position(h, '{c}')] AS {c}" for c in TSV_COLUMNS)
ORACLES: dict[str, str] = {
    "p6_found": _P6_PARSED + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p6_rows": _P6_PARSED + f"SELECT line_id, file_id, line_no, {_COLUMNS} FROM r WHERE reason IS NULL",
}

"""Rows that fail to parse: bulk parsing of record blocks, bisection of failing blocks, strict diagnosis.

A block, all lines of one file layout in an Arrow batch, is tested with Arrow kernels and parsed as a whole with Arrow's
columnar reader, which sets lines with another number of columns apart. A block whose rows don't come out one a line
is halved until they do. Lines that a kernel or the reader sets apart are read by a strict character-level reader that
names the first reason; all others never pass through Python one by one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import strip

MOST_CHARACTERS = 120
REASONS = ("quoting", "column_count", "invalid_value")
#: As patterns of Arrow's kernels: control characters but tab, private-use characters, the replacement character;
#: what is found in every line whose quoting is broken (and in a few others, which the strict reader clears).
BAD_CHARACTER = r"[\x00-\x08\x0a-\x1f\x7f-\x{9f}\x{fffd}]|\p{Co}"
DOUBTFUL_LINE = r'(?s)(?:^|\t)"(?:[^"]|"")*(?:"[^"\t]|$)|[\r\n]|^$'
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def bare(line: str) -> str:
    """``line`` without a byte order mark before and a carriage return after it."""
    line = line[1:] if line.startswith("﻿") else line
    return line[:-1] if line.endswith("\r") else line


def read_strict(line: str) -> list[tuple[str, bool]] | None:
    """The fields of a line as (value, quoted); None where quoting is broken."""
    fields: list[tuple[str, bool]] = []
    at, n = 0, len(line)
    while True:
        if at < n and line[at] == '"':
            stop = at + 1
            while True:
                stop = line.find('"', stop)
                if stop < 0:
                    return None
                if line[stop + 1 : stop + 2] != '"':
                    break
                stop += 2
            if stop + 1 < n and line[stop + 1] != "\t":
                return None
            fields.append((line[at + 1 : stop].replace('""', '"'), True))
            at = stop + 1
        else:
            stop = line.find("\t", at)
            stop = n if stop < 0 else stop
            fields.append((line[at:stop], False))
            at = stop
        if at >= n:
            return fields
        at += 1


def sound(value: str, quoted: bool) -> bool:
    """Whether a non-blank term is possible."""
    if len(value) > MOST_CHARACTERS or not any(map(str.isalpha, value)):
        return False
    return not any(
        (c == "�" or unicodedata.category(c) in ("Cc", "Co")) and not (c == "\t" and quoted) for c in value
    )


def diagnose(line: str, header: tuple[str, ...]) -> tuple[str | None, dict[str, str]]:
    """The first reason why ``line`` fails (None if it doesn't), and its fields by name."""
    fields = read_strict(bare(line))
    if fields is None:
        return "quoting", {}
    if len(fields) != len(header):
        return "column_count", {}
    row = dict(zip(header, fields))
    head, head_quoted = row.get("headword", ("", False))
    raw, raw_quoted = row.get("raw_term", ("", False))
    values = {k: v for k, (v, _) in row.items()}
    if not head.strip() or not sound(head, head_quoted) or raw.strip() and not sound(raw, raw_quoted):
        return "invalid_value", values
    return None, values


def _read(lines: pa.Array, header: tuple[str, ...]) -> tuple[pa.Table, list[int]] | None:
    """The lines as a table, and the places of those with another number of columns; None if lines ran together."""
    apart: list[int] = []

    def other_columns(row) -> str:
        apart.append(row.number - 1)
        return "skip"

    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0]
    block = joined.as_buffer()
    try:
        table = pacsv.read_csv(
            pa.BufferReader(block),
            read_options=pacsv.ReadOptions(column_names=list(header), use_threads=False, block_size=len(block) + 64),
            parse_options=pacsv.ParseOptions(
                delimiter="\t", newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=other_columns
            ),
            convert_options=pacsv.ConvertOptions(
                column_types={h: pa.string() for h in header}, strings_can_be_null=False, quoted_strings_can_be_null=False
            ),
        )
    except pa.ArrowInvalid:
        return None
    return (table, apart) if table.num_rows + len(apart) == len(lines) else None


def _impossible(values: pa.ChunkedArray, blank_is_bad: bool) -> pa.ChunkedArray:
    blank = pc.equal(pc.utf8_trim(values, WHITE), "")
    bad = pc.or_(
        pc.greater(pc.utf8_length(values), MOST_CHARACTERS),
        pc.or_(pc.match_substring_regex(values, BAD_CHARACTER), pc.invert(pc.match_substring_regex(values, r"\p{L}"))),
    )
    return pc.or_(bad, blank) if blank_is_bad else pc.and_not(bad, blank)


def _bulk(lines: pa.Array, at: np.ndarray, header: tuple[str, ...], good: list, strict: list) -> None:
    """Parses the lines at the places ``at``: (places, table) of valid rows to ``good``, places of all others to ``strict``."""
    if not len(at):
        return
    found = _read(lines.take(pa.array(at)), header)
    if found is None:
        if len(at) == 1:
            strict.extend(at.tolist())
            return
        half = len(at) // 2
        _bulk(lines, at[:half], header, good, strict)
        _bulk(lines, at[half:], header, good, strict)
        return
    table, apart = found
    strict.extend(at[apart].tolist())
    at = np.delete(at, apart)
    bad = pc.or_(_impossible(table["headword"], True), _impossible(table["raw_term"], False))
    if pc.any(bad).as_py():
        strict.extend(at[bad.to_numpy()].tolist())
        kept = pc.invert(bad)
        at, table = at[kept.to_numpy()], table.filter(kept)
    good.append((at, table))


def parse_block(
    lines: pa.Array, header: tuple[str, ...], keep: tuple[str, ...] | None
) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, pa.Array]]:
    """(places, reasons, sources, fields) of the lines of one layout, in parts and in no order of lines.

    ``fields`` are maps of the columns ``keep``, all of them if it is empty, null if it is None.
    """
    lines = pc.replace_substring_regex(pc.fill_null(lines, ""), "^\ufeff", "")
    lines = pc.replace_substring_regex(lines, r"\r\z", "")
    places = np.arange(len(lines))
    good: list[tuple[np.ndarray, pa.Table]] = []
    strict: list[int] = []
    if len(set(header)) == len(header) and "headword" in header and "raw_term" in header:
        doubtful = pc.match_substring_regex(lines, DOUBTFUL_LINE).to_numpy(zero_copy_only=False)
        strict += places[doubtful].tolist()
        _bulk(lines, places[~doubtful], header, good, strict)
    else:
        strict += places.tolist()
    wanted = [h for h in header if keep is not None and (not keep or h in keep)]
    for at, table in good:
        source = table["source"] if "source" in header else pa.nulls(len(at), pa.string())
        key = pc.utf8_lower(pc.utf8_trim(pc.fill_null(source, ""), WHITE))
        yield at, pa.nulls(len(at), pa.string()), _one(key), _maps([_one(table[h]) for h in wanted], wanted, len(at), keep)
    if strict:
        found = [diagnose(line, header) for line in lines.take(pa.array(strict)).to_pylist()]
        rows = [[(h, row.get(h)) for h in wanted] if row and keep is not None else None for _, row in found]
        keys = [row.get("source", "").strip().lower() if row else None for _, row in found]
        yield (
            np.array(strict),
            pa.array([reason for reason, _ in found], pa.string()),
            pa.array(keys, pa.string()),
            pa.array(rows, pa.map_(pa.string(), pa.string())),
        )


def _one(values: pa.ChunkedArray | pa.Array) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _maps(columns: list[pa.Array], names: list[str], rows: int, keep: tuple[str, ...] | None) -> pa.Array:
    """One map a row from whole columns."""
    if keep is None or not columns:
        return pa.nulls(rows, pa.map_(pa.string(), pa.string()))
    by_row = pa.array(np.arange(rows * len(names)).reshape(len(names), rows).T.ravel())
    keys = pa.array(names).take(pa.array(np.tile(np.arange(len(names)), rows)))
    offsets = pa.array(np.arange(0, rows * len(names) + 1, len(names)), pa.int32())
    return pa.MapArray.from_arrays(offsets, keys, pa.concat_arrays(columns).take(by_row))


def parse_lines(
    lines: DataFrame, files: DataFrame, registry: DataFrame, keep: tuple[str, ...] | None = ()
) -> DataFrame:
    """One row (line_id, file_id, line_no, reason, fields) for every line; reason is null for a valid row.

    ``fields`` maps column names to values and is null where the line has no readable columns. Only the values
    named by ``keep`` are carried, all if it is empty. A null line counts as an empty one. A line of an unknown
    file or a file with a null header has no columns to agree with: ``column_count`` unless its quoting is broken.
    Repeated lines give repeated rows; of a file listed twice the smaller header counts. The join with ``files`` is left to Catalyst (broadcast while small, else a
    skew-adapted shuffle), the check of ``source`` is a join with the distinct registry names.
    """
    names_out = ["line_id", "file_id", "line_no", "broken", "source_key", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column("header").dictionary_encode()
            texts, codes = batch.column("raw_line"), heads.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                header = tuple(heads.dictionary[int(code)].as_py().split("\t")) if code >= 0 else ()
                for at, reasons, sources, fields in parse_block(texts.take(pa.array(own)), header, keep):
                    ids = [batch.column(c).take(pa.array(own[at])) for c in names_out[:3]]
                    yield pa.RecordBatch.from_arrays([*ids, reasons, sources, fields], names_out)

    with_header = (
        lines.select("line_id", "file_id", "line_no", "raw_line")
        .join(files.groupBy("file_id").agg(F.min("header").alias("header")), "file_id", "left")
        .select("line_id", "file_id", "line_no", "raw_line", "header")
    )
    parsed = with_header.mapInArrow(
        run, "line_id long, file_id long, line_no int, broken string, source_key string, fields map<string,string>"
    )
    names = (
        registry.where(F.col("display_name").isNotNull())
        .select(F.lower(strip("display_name")).alias("source_key"))
        .distinct()
        .withColumn("registered", F.lit(True))
    )
    reason = F.when(F.col("broken").isNotNull(), F.col("broken")).when(
        F.col("registered").isNull(), F.lit("invalid_value")
    )
    return parsed.join(names, "source_key", "left").select(
        "line_id", "file_id", "line_no", reason.alias("reason"), "fields"
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that fail, with their reason."""
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason")


def accepted(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """The valid rows as columns; a column that the file doesn't have is null."""
    return parsed.where(F.col("reason").isNull()).select(
        "line_id", "file_id", "line_no", *[F.col("fields")[c].alias(c) for c in columns]
    )

"""File sources and sinks: TSV evidence, registries, documents of Office and XML kinds, manifests."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import clean_text, source_title
from lexloom.operators.gates import GateError

REQUIRED = ["source", "raw_term", "headword"]
POLICY = ["source_role", "corpus_policy", "source_format", "registry_source_id"]
LEGACY = [
    "source", "raw_term", "headword", "pos", "cefr", "topic_or_section", "pdf_page", "source_ref", "definition", "notes"
]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# The first bytes of a PNG file, and the pattern of a term in a word box.
PNG = "89504E470D0A1A0A"
BOXED = r"^[A-Za-z][A-Za-z' -]*$"


def _tsv_groups(spark: SparkSession, path: str, multi_line: bool) -> list[tuple[list[str], DataFrame]]:
    """(column names, rows as texts) of the TSV files under ``path``, those of one header together.

    Only the headers come to the driver, which lists the files anyway; large files are read in splits.
    """
    found = {"recursiveFileLookup": True, "pathGlobFilter": "*.[tT][sS][vV]"}
    first = (
        spark.read.options(**found)
        .text(path)
        .select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
        .where("file_block_start = 0")
    )
    headers = first.groupBy("file_path").agg(F.min_by("value", "at").alias("header")).collect()
    paths: dict[str, list[str]] = {}
    for row in headers:
        paths.setdefault(row["header"].removeprefix("\ufeff"), []).append(row["file_path"])
    groups = []
    for header, own in sorted(paths.items()):
        names = header.split("\t")
        # of a repeated name the last column counts
        unique = [n if n not in names[i + 1 :] else f"_{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in unique])
        options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "nullValue": "\u0000"}
        groups.append((names, spark.read.schema(schema).options(**options).csv(own)))
    return groups


def tsv_evidence(spark: SparkSession, path: str, legacy: bool = False, multi_line: bool = False) -> DataFrame:
    """Rows of all TSV files under ``path``: read by column name, with file, record number and defaults.

    Cells may be quoted, a doubled quote inside standing for one, and then hold tabs; they may hold line ends with
    ``multi_line``, which reads each file in one task. A byte order mark before a header is no part of its first name.
    Files that lack required columns, or policy columns unless they are legacy ones, abort; so do legacy files with a
    row of another role or policy than a target's. Cells are cleaned. Rows without a headword are dropped; an empty raw
    term takes the headword, an empty source the file's name; all other nulls become empty texts. Empty files add no
    rows. ``line_no`` counts the header and the records before.
    """
    wanted = REQUIRED + ([] if legacy else POLICY)
    names_out = [*LEGACY, *POLICY, "locator"]
    groups = _tsv_groups(spark, path, multi_line)
    bad = [(names, [w for w in wanted if w not in names]) for names, _ in groups]
    if lacking := [f"a file with {', '.join(n)} lacks {', '.join(w)}" for n, w in bad if w]:
        raise GateError("; ".join(lacking[:20]))
    out: DataFrame | None = None
    for names, rows in groups:
        cells = [
            (clean_text(F.coalesce(F.col(f"`{n}`"), F.lit(""))) if n in names else F.lit("")).alias(n) for n in names_out
        ]
        placed = rows.select(
            F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"), *cells,
        )
        before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        splits = (  # one row a split: where it begins, and the records before it
            placed.groupBy("_path", "_block")
            .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .select("_path", "_block", "_first", "_before")
        )
        numbered = placed.join(splits, ["_path", "_block"]).select(
            F.regexp_extract("_path", r"([^/]+)$", 1).alias("source_file"),
            (F.col("_at") - F.col("_first") + F.col("_before") + 2).cast("int").alias("line_no"),
            *names_out,
        )
        out = numbered if out is None else out.unionByName(numbered)
    if out is None:
        return spark.createDataFrame([], ", ".join(["source_file string, line_no int", *[f"{n} string" for n in names_out]]))
    out = out.where("headword <> ''")
    if legacy:
        other = out.where("source_role NOT IN ('', 'target_reference') OR corpus_policy NOT IN ('', 'target')")
        if found := other.select("source_file", "headword").limit(20).collect():
            raise GateError("legacy files hold other rows: " + "; ".join(f"{r[0]}: {r[1]}" for r in found))
    stem = F.regexp_replace("source_file", r"\.[^.]+$", "")
    return out.withColumn("raw_term", F.coalesce(F.nullif("raw_term", F.lit("")), "headword")).withColumn(
        "source", F.coalesce(F.nullif(source_title(F.col("source")), F.lit("")), stem)
    )


def json_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a registry file; a repeated id aborts."""
    out = spark.read.option("multiLine", True).json(path).select(F.explode("sources").alias("s")).select("s.*")
    if bad := out.groupBy("id").count().where("count > 1").limit(20).collect():
        raise GateError("repeated ids: " + ", ".join(str(r["id"]) for r in bad))
    return out


def docx_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, table, row, col, text) of all table cells of the Word files under ``path``.

    A file that is no Word file gives one row with a null table and its problem as text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        root = ElementTree.fromstring(z.read("word/document.xml"))
                    for t, table in enumerate(root.iter(W + "tbl")):
                        for r, row in enumerate(table.findall(W + "tr")):
                            for c, cell in enumerate(row.findall(W + "tc")):
                                text = " ".join(
                                    "".join(x.text or "" for x in p.iter(W + "t")) for p in cell.iter(W + "p")
                                )
                                rows.append((name, t, r, c, " ".join(text.split())))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
                    rows.append((name, None, None, None, type(problem).__name__))
            frame = pd.DataFrame(rows, columns=["path", "table", "row", "col", "text"])
            yield frame.astype({"table": "Int32", "row": "Int32", "col": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(
        path
    )
    return files.select("path", "content").mapInPandas(run, "path string, table int, row int, col int, text string")


def word_boxes(cells: DataFrame, least: int = 5) -> DataFrame:
    """Cells of the tables that are word boxes: enough filled cells, all of them plain terms."""
    filled = cells.where(F.col("table").isNotNull() & (F.col("text") != ""))
    boxes = (
        filled.groupBy("path", "table")
        .agg(
            F.count("*").alias("n"),
            F.bool_and(F.col("text").rlike(BOXED) & ~F.lower("text").contains("marks")).alias("plain"),
        )
        .where(F.col("plain") & (F.col("n") >= least))
    )
    return filled.join(boxes.select("path", "table"), ["path", "table"], "left_semi")


def xml_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(page, top, left, font, size, family, text) of the text fragments of page XML, with their fonts' properties."""
    pages = spark.read.format("xml").option("rowTag", "page").load(path)
    font = (
        pages.select(F.explode("fontspec").alias("f"))
        .select(F.col("f._id").alias("font"), F.col("f._size").alias("size"), F.col("f._family").alias("family"))
        .dropDuplicates(["font"])
    )
    text = pages.select(F.col("_number").alias("page"), F.explode("text").alias("t")).select(
        "page",
        F.col("t._top").alias("top"),
        F.col("t._left").alias("left"),
        F.col("t._font").alias("font"),
        F.col("t._VALUE").alias("text")
    )
    return text.join(font, "font", "left").select("page", "top", "left", "font", "size", "family", "text")


def file_inventory(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Registered sources found under ``path``: first by size, then by SHA-256 of the files of a fitting size only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sized = files.join(
        registry.select("expected_byte_size").distinct(), files["length"] == F.col("expected_byte_size"), "left_semi"
    )
    hashed = sized.select("path", "length", F.sha2("content", 256).alias("sha256"))
    found = hashed.join(
        registry, (F.col("length") == F.col("expected_byte_size")) & (F.col("sha256") == F.col("expected_sha256"))
    )
    first = found.groupBy("id").agg(F.min("path").alias("path"), F.count("*").alias("file_count"))
    status = F.when(F.col("path").isNull(), "missing").otherwise("present")
    return registry.join(first, "id", "left").select(
        "id", status.alias("status"), "path", F.coalesce("file_count", F.lit(0)).alias("file_count")
    )


def png_size(content: str):
    """(is a PNG, width, height) from a file's first bytes."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("int")
    return head.startswith(PNG), number(33), number(41)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Arrays joined by bars, booleans in lower case, one header a file; never overwrites unless told to."""
    cells = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        text = F.array_join(column, "|") if kind == "array" else column.cast("string")
        cells.append(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\r\n]+", " ").alias(field.name))
    df.select(*cells).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option(
        "quote", "\u0000"
    ).csv(
        path
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """A short table of aggregates as Markdown; more than ``most`` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise GateError("too many rows for a report")
    cell = lambda x: re.sub(r"\|", r"\\|", "" if x is None else str(x))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def json_with_digest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, sha256, the fields of ``schema``) of each JSON file under ``path``; a file that can't be read has null fields."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(
        path
    )
    parsed = files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), schema).alias("j")
    )
    return parsed.select("path", "sha256", "j.*")


def epub_packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, package, title, problem) of the EPUB files under ``path``.

    The package file must lie inside the archive: a path that is absolute or climbs out is a problem, as is an archive
    without one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                package = title = problem = None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
                        package = next((e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile")), None)
                        if not package or package.startswith("/") or ".." in package.split("/"):
                            package, problem = None, "unsafe_package_path"
                        else:
                            tree = ElementTree.fromstring(z.read(package))
                            title = next(
                                (" ".join((e.text or "").split()) for e in tree.iter() if e.tag.endswith("}title")),
                                None,
                            )
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    problem = type(error).__name__
                rows.append((name, package, title, problem))
            yield pd.DataFrame(rows, columns=["path", "package", "title", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(
        path
    )
    return files.select("path", "content").mapInPandas(run, "path string, package string, title string, problem string")

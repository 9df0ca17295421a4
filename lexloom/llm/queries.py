"""Queries of the training-data operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.unicode import letters_digits_key
from lexloom.llm.canonical import map_to_canonical
from lexloom.llm.copies import all_pairs, collapse, members
from lexloom.llm.encoding import TOKENIZER_DIR, encode_corpus, token_counts
from lexloom.llm.lookalike import inconsistent_texts
from lexloom.llm.packing import fill, fill_containers
from lexloom.llm.subjects import assign_subjects, calibrate, read_terms, subject_shares
from lexloom.llm.survivor import candidates, layers, survivors
from lexloom.operators.packed import FIXED_EXPRESSIONS, segmenter
from lexloom.sources.tables import load, small_rows

MOST_LABELS = 10_000
MOST_KINDS = 1_000
#: Session setting that names the folder of the public tokenizers.
TOKENIZER_SETTING = "spark.lexloom.tokenizers"
CEFR = ("A1", "A2", "B1", "B2", "C1", "C2")
ENTRY = ("headword", "pos", "cefr", "source")


def _spaced(column: str):
    """Lower case, outer white space removed, inner runs of white space as one space."""
    return F.lower(F.btrim(F.regexp_replace(column, r"(?U)\s+", " ")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The part of speech that each freely typed single value stands for, -1 for none."""
    rows = small_rows(load(spark, d, "pos_labels", "label_id", "label", "short_form"), MOST_LABELS)
    names = [(r["label_id"], r["label"], (r["short_form"],) if r["short_form"] else ()) for r in rows if r["label"]]
    known = tuple(sorted({x for _, label, short in names for x in (label, *short)}))
    single = lambda text: len(segmenter(known, FIXED_EXPRESSIONS).split(text)) == 1
    typed = load(spark, d, "source_rows", "row_id", "pos").where(~F.col("pos").isin([n for _, n, _ in names]))
    return map_to_canonical(typed, "pos", names, single).select("row_id", "label_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every term and topic that isn't in the consistent form, in that form."""
    fields = ["raw_term", "topic_or_section"]
    return inconsistent_texts(load(spark, d, "source_rows", "row_id", *fields), "row_id", fields)


def _target_layers(spark: SparkSession, d: str, values: tuple[str, ...] = ()) -> DataFrame:
    registry = (
        load(spark, d, "source_registry", "display_name", "trust_rank")
        .where(F.col("display_name").isNotNull())
        .groupBy(_spaced("display_name").alias("source_name"))
        .agg(F.min("trust_rank").alias("trust_rank"))
    )
    labels = small_rows(load(spark, d, "pos_labels", "label", "short_form"), MOST_LABELS)
    names = sorted({x.casefold() for r in labels for x in r if x})
    rows = (
        load(spark, d, "target_rows", "row_id", "source", "headword", "pos", "cefr", "extracted_at")
        .where(F.col("headword").isNotNull())
        .withColumn("key", letters_digits_key("headword"))
        .withColumn("source_name", _spaced("source"))
        .join(registry, "source_name", "left")
    )
    usable = {
        "headword": F.lit(True),
        "pos": F.regexp_replace(_spaced("pos"), r"\s*\.$", "").isin(names),
        "cefr": F.upper(_spaced("cefr")).isin(*CEFR),
        "source": F.col("trust_rank").isNotNull(),
    }
    return layers(candidates(rows, "key", "row_id", "trust_rank", "extracted_at", usable, values), "key")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The row that gives each field of each group of target rows of one headword."""
    chosen = survivors(_target_layers(spark, d), "key").where("size > 1")
    return chosen.where(F.col("id").isNotNull()).select(
        F.col("first_id").alias("group_row_id"), "field", F.col("id").alias("row_id")
    )


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """One entry for each headword of the target rows, every field from its surviving row."""
    best = survivors(_target_layers(spark, d, ENTRY), "key")
    value = F.when(F.col("id").isNotNull(), F.element_at("values", F.array_position(F.array(*map(F.lit, ENTRY)), F.col("field")).cast("int")))
    return (
        best.groupBy("key")
        .agg(
            F.min("first_id").alias("group_row_id"),
            F.max("size").alias("n_rows"),
            *[F.max(F.when(F.col("field") == f, value)).alias(f) for f in ENTRY],
        )
        .drop("key")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of source rows that are copies of each other in other formatting."""
    return all_pairs(
        members(load(spark, d, "source_rows", "row_id", "raw_term", "headword"), "row_id", ["raw_term", "headword"]),
        "row_id",
    )


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for each set of copies, with their number."""
    return collapse(load(spark, d, "source_rows", "row_id", "raw_term", "headword"), "row_id", ["raw_term", "headword"])


def _tokenizer(spark: SparkSession) -> str:
    return spark.conf.get(TOKENIZER_SETTING, TOKENIZER_DIR)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document; an empty array for null and empty texts."""
    return encode_corpus(load(spark, d, "documents", "doc_id", "text"), _tokenizer(spark))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one that exceeds the capacity, for each kind."""
    kinds = small_rows(load(spark, d, "containers", "container_kind", "capacity_tokens"), MOST_KINDS)
    sizes = token_counts(load(spark, d, "documents", "doc_id", "text"), _tokenizer(spark))
    return fill_containers(sizes, [(r[0], r[1]) for r in kinds])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and needed at least, tokens held and share of space used, for each kind."""
    return fill(p8_packing(spark, d))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return assign_subjects(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every subject that a document treats."""
    return _subjects(spark, d).select("doc_id", "subject_id")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of the corpus by subject; documents with several subjects count for each."""
    sizes = load(spark, d, "documents", "doc_id", "n_chars")
    return (
        _subjects(spark, d)
        .join(sizes, "doc_id")
        .groupBy("subject_id")
        .agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.avg("share").alias("mean_share"))
    )


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """The least share of sentences fitted on half of the labelled documents, with precision and recall on either half."""
    names = load(spark, d, "subjects", "subject_id", "subject")
    labels = load(spark, d, "subject_labels", "doc_id", "subject_id").join(names, "subject_id").select("doc_id", "subject")
    return calibrate(subject_shares(load(spark, d, "documents", "doc_id", "text"), read_terms()), labels)


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_entries": p4_entries, "p5_found": p5_found,
    "p5_collapsed": p5_collapsed, "p7_ids": p7_ids, "p8_packing": p8_packing, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_composition": p9_composition, "p9_quality": p9_quality,
}
_KEY = r"regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}]', '', 'g')"
_SPACED = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_P4_SQL = f"""
WITH reg AS (SELECT {_SPACED.format("display_name")} AS source_name, min(trust_rank) AS trust FROM source_registry GROUP BY 1),
t AS (
  SELECT row_id, extracted_at, {_KEY.format("headword")} AS k, reg.trust,
    {_SPACED.format("pos")} AS p, upper({_SPACED.format("cefr")}) AS c
  FROM target_rows LEFT JOIN reg ON {_SPACED.format("source")} = reg.source_name WHERE headword IS NOT NULL),
g AS (SELECT k, min(row_id) AS group_row_id, count(*) AS n_rows FROM t GROUP BY k HAVING count(*) >= LEAST_ROWS),
names AS (SELECT lower(label) AS n FROM pos_labels UNION SELECT lower(short_form) FROM pos_labels),
u AS (
  SELECT *, 'headword' AS field FROM t
  UNION ALL SELECT *, 'source' FROM t WHERE trust IS NOT NULL
  UNION ALL SELECT *, 'cefr' FROM t WHERE c IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2')
  UNION ALL SELECT *, 'pos' FROM t WHERE regexp_replace(p, '\\s*\\.$', '') IN (SELECT n FROM names)),
r AS (
  SELECT k, field, row_id, row_number() OVER (PARTITION BY k, field ORDER BY trust NULLS LAST, extracted_at DESC NULLS LAST, row_id) AS n
  FROM u)
"""

ORACLES = {
    "p4_found": _P4_SQL.replace("LEAST_ROWS", "2") + "SELECT group_row_id, field, row_id FROM r JOIN g USING (k) WHERE n = 1",
    "p4_entries": _P4_SQL.replace("LEAST_ROWS", "1")
    + """, v AS (SELECT k, field, CASE field WHEN 'headword' THEN headword WHEN 'pos' THEN pos WHEN 'cefr' THEN cefr ELSE source END AS x
  FROM r JOIN target_rows USING (row_id) WHERE n = 1)
SELECT group_row_id, n_rows, """
    + ", ".join(f"max(CASE WHEN field = '{f}' THEN x END) AS {f}" for f in ENTRY)
    + " FROM g JOIN v USING (k) GROUP BY k, group_row_id, n_rows",
    "p5_found": f"""
WITH k AS (SELECT row_id, {_KEY.format("raw_term")} AS a, {_KEY.format("headword")} AS b FROM source_rows
  WHERE raw_term IS NOT NULL AND headword IS NOT NULL),
s AS (SELECT row_id, least(a, b) AS x, greatest(a, b) AS y FROM k)
SELECT p.row_id AS row_id_a, q.row_id AS row_id_b FROM s p JOIN s q ON p.x = q.x AND p.y = q.y AND p.row_id < q.row_id""",
    "p5_collapsed": f"""
WITH k AS (SELECT row_id, raw_term, headword, {_KEY.format("raw_term")} AS a, {_KEY.format("headword")} AS b FROM source_rows
  WHERE raw_term IS NOT NULL AND headword IS NOT NULL),
s AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM k)
SELECT min(row_id) AS row_id, arg_min(raw_term, row_id) AS raw_term, arg_min(headword, row_id) AS headword,
  count(*) AS n_copies, count(DISTINCT (raw_term, headword)) AS n_forms FROM s GROUP BY x, y
UNION ALL SELECT row_id, raw_term, headword, 1, 1 FROM source_rows WHERE raw_term IS NULL OR headword IS NULL""",
}

"""Named queries of the audits, gates and remaining text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import audits as U
from lexloom.operators.ordered import blocked
from lexloom.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""WITH f AS (SELECT file_id, count(*) AS found FROM raw_lines GROUP BY 1), e AS (SELECT file_id, 100 AS expected
  FROM raw_files)
SELECT coalesce(f.file_id, e.file_id) AS file_id, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM f
  FULL JOIN e ON f.file_id = e.file_id WHERE coalesce(expected, 0) <> coalesce(found, 0)""")
def distribution_gate(s, d):
    expected = load(s, d, "raw_files", "file_id").withColumn("expected", F.lit(100))
    return U.distribution(load(s, d, "raw_lines", "file_id"), ["file_id"], expected)


@query("SELECT registry_source_id, count(*) AS n FROM source_rows GROUP BY 1 HAVING count(*) NOT BETWEEN 50 AND 400")
def count_range_gate(s, d):
    return U.within(load(s, d, "source_rows", "registry_source_id"), ["registry_source_id"], 50, 400)


@query("""WITH e AS (SELECT DISTINCT doc_id FROM documents WHERE kind = 'glossary'), o AS (SELECT doc_id, count(*) AS n
  FROM subject_labels GROUP BY 1)
SELECT coalesce(e.doc_id, o.doc_id) AS doc_id,
  CASE WHEN e.doc_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'unseen' ELSE 'repeated' END AS state
FROM e FULL JOIN o ON e.doc_id = o.doc_id WHERE e.doc_id IS NULL OR n IS NULL OR n > 1""")
def correction_audit(s, d):
    return U.correction_audit(
        load(s, d, "documents", "doc_id", "kind").where("kind = 'glossary'"),
        load(s, d, "subject_labels", "doc_id"),
        "doc_id",
    )


@query("""WITH a AS (SELECT file_id, line_no, string_split(raw_line, chr(9))[1] AS v
  FROM raw_lines), b AS (SELECT file_id + 1 AS file_id, line_no, v FROM a),
j AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.line_no, b.line_no) AS "at", a.v AS l, b.v AS r FROM a
  FULL JOIN b ON a.file_id = b.file_id AND a.line_no = b.line_no
 WHERE a.v IS DISTINCT FROM b.v OR a.file_id IS NULL OR b.file_id IS NULL)
SELECT file_id, min("at") AS "at", arg_min([l], "at")[1] AS "left", arg_min([r], "at")[1] AS "right" FROM j GROUP BY 1""")
def first_mismatch(s, d):
    a = load(s, d, "raw_lines", "file_id", "line_no", "raw_line").select(
        "file_id", "line_no", F.split("raw_line", "\t")[0].alias("v")
    )
    return U.first_mismatch(
        a, a.select((F.col("file_id") + 1).alias("file_id"), "line_no", "v"), ["file_id"], "line_no", "v"
    )


@query(
    """SELECT registry_source_id, count(*) AS n_rows, count(DISTINCT lower(headword)) AS unique_terms, count(*) - count(DISTINCT lower(headword)) - max(CASE WHEN headword IS NULL THEN 1 ELSE 0 END) AS duplicates FROM source_rows GROUP BY 1"""
)
def duplicate_statistics(s, d):
    return U.duplicate_statistics(
        load(s, d, "source_rows", "registry_source_id", "headword"), "registry_source_id", F.lower("headword")
    )


@query("""WITH r AS (SELECT registry_source_id AS id, count(*) AS n, count(DISTINCT source_file) AS files, count(*) FILTER (cefr IS NULL) AS unlevelled FROM source_rows GROUP BY 1),
c AS (SELECT g.id, [x FOR x IN [CASE WHEN coalesce(n > 100, false) THEN NULL ELSE 'few_rows' END,
  CASE WHEN coalesce(unlevelled * 2 < n, false) THEN NULL ELSE 'unlevelled' END,
  CASE WHEN search_root_key IS NOT NULL THEN NULL ELSE 'no_root' END,
 CASE WHEN coalesce(regexp_matches(expected_sha256, '^[0-9a-f]{64}$'), false) THEN NULL ELSE 'no_digest' END] IF x IS NOT NULL] AS f FROM source_registry g LEFT JOIN r USING (id))
SELECT id, array_to_string(f, ',') AS failures, len(f) = 0 AS passed FROM c""")
def completion_evidence(s, d):
    rows = load(s, d, "source_rows", F.col("registry_source_id").alias("id"), "cefr")
    counted = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("cefr").isNull()).alias("unlevelled"))
    joined = load(s, d, "source_registry", "id", "search_root_key", "expected_sha256").join(counted, "id", "left")
    codes = {
        "few_rows": F.col("n") > 100,
        "unlevelled": F.col("unlevelled") * 2 < F.col("n"),
        "no_root": F.col("search_root_key").isNotNull(),
        "no_digest": F.col("expected_sha256").rlike("^[0-9a-f]{64}$"),
    }
    return U.evidence_codes(joined, codes).select("id", F.array_join("failures", ",").alias("failures"), "passed")


@query("""SELECT k, string_agg(cefr || '=' || r, ',' ORDER BY cefr) AS entries
  FROM (SELECT lower(trim(headword, ' ')) AS k, cefr, min(row_id) AS r FROM target_rows
  WHERE headword IS NOT NULL AND cefr IS NOT NULL GROUP BY 1, 2) GROUP BY k""")
def links_as_map(s, d):
    rows = load(s, d, "target_rows", "row_id", "headword", "cefr").where("headword IS NOT NULL").withColumn(
        "k", F.lower(F.btrim("headword"))
    )
    out = U.keyed_map(rows, ["k"], "cefr", "row_id")
    pairs = F.transform(F.map_entries("entries"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("k", F.array_join(pairs, ",").alias("entries"))


@query(
    "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20"
)
def recent_history(s, d):
    return U.recent(
        load(s, d, "events", "user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20
    )


@query("""SELECT row_id, headword FROM source_rows
  WHERE (contains(lower(headword), 'fund') OR contains(lower(topic_or_section), 'market')) AND cefr = 'B2' AND source_format = 'pdf'""")
def catalogue_browse(s, d):
    rows = load(s, d, "source_rows", "row_id", "headword", "topic_or_section", "cefr", "source_format")
    return U.browse(rows, "Fund", ["headword"], {"cefr": "B2", "source_format": "pdf"}, {}).unionByName(
        U.browse(
            rows.where("NOT coalesce(contains(lower(headword), 'fund'), false)"),
            "MARKET",
            ["topic_or_section"],
            {"cefr": "B2", "source_format": "pdf"},
            {},
        )
    ).select("row_id", "headword")


@query("""SELECT user_id, round(sum(seconds), 3)::DOUBLE AS seconds, count(*) FILTER (running <= 720) AS in_budget
  FROM (SELECT user_id, day, seconds, sum(seconds) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running
FROM (SELECT *, date_trunc('day', ts) AS day, 30.0 + event_id % 60 AS seconds FROM events)) GROUP BY 1""")
def daily_budget(s, d):
    events = load(s, d, "events", "user_id", "event_id", "ts").withColumn("day", F.date_trunc("day", "ts")).withColumn(
        "seconds", F.lit(30.0) + F.col("event_id") % 60
    )
    running = blocked(
        events,
        ["user_id", "day"],
        ["ts", "event_id"],
        F.date_trunc("hour", "ts"),
        {"running": ("sum", F.col("seconds"))},
    )
    return running.groupBy("user_id").agg(
        F.round(F.sum("seconds"), 3).alias("seconds"), F.count_if(F.col("running") <= 720).alias("in_budget")
    )


@query(r"""SELECT row_id, coalesce(length(definition) <= 100 AND NOT regexp_matches(definition, ' \+ |[=/→]') AND NOT contains(lower(definition), 'infinitive') AND regexp_matches(definition, '^[\p{L}][\p{L}\p{M}0-9 ''’.,!?()-]*\z'), false) AS valid,
 CASE WHEN headword IS NULL OR trim(headword, ' ') = '' THEN 'empty' WHEN length(headword) > 48 THEN 'too_long' WHEN regexp_matches(headword, '[.!?;:]') THEN 'sentence_mark' WHEN NOT regexp_matches(headword, '^[\p{L}][\p{L} ''-]*\z') THEN 'other_character' END AS problem FROM source_rows""")
def candidate_checks(s, d):
    return load(s, d, "source_rows", "row_id", "definition", "headword").select(
        "row_id",
        X.valid_candidate(F.col("definition")).alias("valid"),
        X.target_problem(F.col("headword")).alias("problem")
    )


@query(
    r"""SELECT row_id, CASE WHEN regexp_matches(raw_term, '(?s)^(.*?)\s+[–—-]\s+(.*)\z') THEN 1 ELSE 0 END AS has_sides,
  regexp_replace(topic_or_section, '\s*\d+\z', '') AS topic, try_cast(nullif(regexp_extract(topic_or_section, '(\d+)\z', 1), '') AS INT) AS sense
FROM source_rows"""
)
def sides_and_senses(s, d):
    topic, sense = X.without_sense(F.col("topic_or_section"))
    right = X.definition_sides(F.col("raw_term"))[1]
    rows = load(s, d, "source_rows", "row_id", "raw_term", "topic_or_section")
    return rows.select("row_id", right.isNotNull().cast("int").alias("has_sides"), topic.alias("topic"), sense.alias("sense"))

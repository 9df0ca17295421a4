"""Named queries of the smaller helpers: page lists, fixes, locators, word parts, places and modes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import aggregates as A
from lexloom.operators import audits as U
from lexloom.operators import ordered as R
from lexloom.operators import wordlists as W
from lexloom.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: White space as a class of RE2, as Spark's Unicode class has it.
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.replace("WS", _WS)
        return f

    return register


@query("""WITH o AS (SELECT l_orderkey, list_sort(list(l_linenumber % 6)) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(p, ',') AS pages, CASE WHEN len([x FOR x IN p IF x < 1 OR x > 4]) > 0 THEN 'out_of_range'
  WHEN len(list_distinct(p)) <> len(p) THEN 'repeated' END AS problem,
  CASE WHEN len(list_distinct(p)) >= 4 THEN 'all' WHEN len(p) > 0 THEN 'some' ELSE 'none' END AS state FROM o""")
def page_lists(s, d):
    lines = load(s, d, "lineitem", "l_orderkey", (F.col("l_linenumber") % 6).alias("page"))
    orders = lines.groupBy("l_orderkey").agg(F.collect_list("page").alias("pages"))
    chosen, problem = U.page_list(F.col("pages"), F.lit(4))
    state = U.pages_state(F.lit(None).cast("int"), F.col("pages"), F.lit(4))
    return orders.select(
        "l_orderkey", F.array_join(chosen, ",").alias("pages"), problem.alias("problem"), state.alias("state")
    )


@query("""WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
SELECT a.user_id, a.event_id, a.place FROM n a JOIN n b ON a.user_id = b.user_id AND a.place = b.place + 10
  WHERE a.event_type = b.event_type""")
def tasks_ten_apart(s, d):
    events = load(s, d, "events", "user_id", "event_id", "ts", "event_type")
    numbered = R.blocked(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), {"place": ("sum", F.lit(1))})
    return U.at_distance(numbered, ["user_id"], "place", "event_type", 10).select("user_id", "event_id", "place")


@query("""WITH l AS (SELECT lower(headword) AS k, lower(trim(pos, ' ')) AS p FROM source_rows WHERE headword IS NOT NULL),
g AS (SELECT k, list_sort(list(DISTINCT p)) AS ps FROM l WHERE p IN ('noun', 'verb', 'adjective', 'adverb') GROUP BY 1)
SELECT k AS "key", array_to_string(ps, ',') AS labels, len(ps) > 1 AS several FROM g""")
def homographs(s, d):
    rows = load(s, d, "source_rows", "headword", "pos").where("headword IS NOT NULL")
    labels = F.array(F.lower(F.btrim("pos")))
    out = A.several_of(rows.select(F.lower("headword").alias("key"), "pos"), "key", labels, ["noun", "verb", "adjective", "adverb"])
    return out.withColumn("labels", F.array_join("labels", ","))


@query("SELECT arg_min(event_type, n) AS event_type FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def least_loaded_lane(s, d):
    return A.least_loaded(load(s, d, "events", "event_type"), "event_type", 7)


@query("""SELECT coalesce(l.label, s.pos) AS pos, count(*) AS n FROM source_rows s LEFT JOIN pos_labels l ON s.pos = l.short_form GROUP BY 1
UNION ALL SELECT 'unused: ' || short_form, 0 FROM pos_labels WHERE short_form IS NOT NULL AND short_form NOT IN (SELECT pos FROM source_rows WHERE pos IS NOT NULL)""")
def reviewed_fixes(s, d):
    fixes = load(s, d, "pos_labels", F.col("short_form").alias("pos"), F.col("label").alias("fixed")).where("pos IS NOT NULL")
    rows = load(s, d, "source_rows", F.col("pos"), F.col("pos").alias("form"))
    fixed, unused = W.apply_fixes(rows, fixes, "pos", "form")
    counted = fixed.groupBy(F.col("form").alias("pos")).agg(F.count("*").alias("n"))
    return counted.unionByName(unused.select(F.concat(F.lit("unused: "), "pos").alias("pos"), F.lit(0).cast("long").alias("n")))


@query(r"""SELECT doc_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(text, '(\p{L})-[\t-\r ]*\n[\t-\r ]*(\p{Ll})', '\1\2', 'g'), 'WS+', ' ', 'g'), ' '), '\.$', '')) AS digest
FROM documents WHERE text IS NOT NULL""")
def line_break_joins(s, d):
    docs = load(s, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(X.joined_breaks(F.col("text"))).alias("digest"))


@query(r"""SELECT row_id, CASE WHEN regexp_matches(t, '^(.*?)[\t-\r ]*/([^/]+)/[\t-\r ]*$') THEN regexp_extract(t, '^(.*?)[\t-\r ]*/([^/]+)/[\t-\r ]*$', 1) ELSE t END AS term,
  nullif(regexp_extract(t, '^(.*?)[\t-\r ]*/([^/]+)/[\t-\r ]*$', 2), '') AS ipa
FROM (SELECT row_id, headword || CASE WHEN cefr IS NULL THEN '' ELSE ' /' || cefr || '/' END AS t FROM target_rows WHERE headword IS NOT NULL)""")
def transcription_parts(s, d):
    spoken = F.concat("headword", F.coalesce(F.concat(F.lit(" /"), "cefr", F.lit("/")), F.lit(""))).alias("t")
    rows = load(s, d, "target_rows", "row_id", "headword", "cefr").where("headword IS NOT NULL").select("row_id", spoken)
    term, ipa = X.ipa_part(F.col("t"))
    return rows.select("row_id", term.alias("term"), ipa.alias("ipa"))


@query(r"""SELECT row_id, CASE WHEN t IS NULL OR trim(t, ' ') = '' THEN 'empty' WHEN len([p FOR p IN string_split(t, ',') IF NOT (
  (regexp_matches(trim(p, ' '), '^G\d{1,2}$') AND TRY_CAST(regexp_extract(p, '(\d+)', 1) AS INT) BETWEEN 1 AND 14)
  OR (regexp_matches(trim(p, ' '), '^\d{1,2}$') AND TRY_CAST(regexp_extract(p, '(\d+)', 1) AS INT) BETWEEN 1 AND 25))]) > 0 THEN 'bad_part' END AS problem
FROM (SELECT row_id, pdf_page || ', G' || (line_no % 16) AS t FROM source_rows)""")
def locator_problems(s, d):
    rows = load(s, d, "source_rows", "row_id", "pdf_page", "line_no")
    text = F.concat("pdf_page", F.lit(", G"), (F.col("line_no") % 16).cast("string"))
    return rows.select("row_id", X.locator_problem(text).alias("problem"))


@query("""SELECT p_size AS page, printf('%02d', CAST(floor((p_size - 6) / 3.0) AS INT) + 1) AS lesson, count(*) AS n FROM part
  WHERE p_size >= 6 GROUP BY 1, 2""")
def lessons(s, d):
    pages = load(s, d, "part", F.col("p_size").alias("page")).where("page >= 6")
    return pages.groupBy("page", X.lesson_number(F.col("page")).alias("lesson")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, substring(trim(regexp_replace(regexp_replace(text, '\p{Cc}+', ' ', 'g'), 'WS+', ' ', 'g'), ' '), 1, 500) AS title
FROM documents WHERE text IS NOT NULL""")
def metadata_texts(s, d):
    docs = load(s, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.select("doc_id", X.metadata_text(F.col("text")).alias("title"))


@query(r"""SELECT row_id, regexp_replace(topic_or_section, '[\t-\r ]*[0-9]+\z', '') AS word, TRY_CAST(nullif(regexp_extract(topic_or_section, '([0-9]+)\z', 1), '') AS INT) AS sense
FROM source_rows WHERE topic_or_section IS NOT NULL""")
def sense_numbers(s, d):
    rows = load(s, d, "source_rows", "row_id", "topic_or_section").where("topic_or_section IS NOT NULL")
    word, sense = X.without_sense(F.col("topic_or_section"))
    return rows.select("row_id", word.alias("word"), sense.alias("sense"))


@query(r"""WITH t AS (SELECT row_id, trim(regexp_replace(definition, 'WS+', ' ', 'g'), ' ') AS s, trim(regexp_replace(headword, 'WS+', ' ', 'g'), ' ') AS w
  FROM source_rows WHERE definition IS NOT NULL AND headword IS NOT NULL),
v AS (SELECT row_id, len(string_split(s, ' ')) >= 3 AS long, w <> '' AND contains(' ' || regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g') || ' ',
  ' ' || trim(regexp_replace(lower(w), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') || ' ') AS seen FROM t)
SELECT row_id, CASE WHEN long AND seen THEN 'pending_human_review' ELSE 'needs_revision' END AS use FROM v""")
def sentence_uses(s, d):
    rows = load(s, d, "source_rows", "row_id", "definition", "headword").where("definition IS NOT NULL AND headword IS NOT NULL")
    return rows.select("row_id", X.sentence_use(F.col("definition"), F.col("headword")).alias("use"))


@query("SELECT source_file FROM source_rows UNION SELECT source_file FROM target_rows")
def all_paths(s, d):
    return load(s, d, "source_rows", "source_file").union(load(s, d, "target_rows", "source_file")).distinct()


@query(r"""WITH a AS (SELECT row_id, trim(regexp_replace(regexp_replace(lower(raw_term), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t,
  trim(regexp_replace(regexp_replace(lower(substring(headword, 1, 4)), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS p FROM source_rows
  WHERE raw_term IS NOT NULL AND headword IS NOT NULL)
SELECT row_id, p <> '' AND starts_with(t, p) AS begins FROM a""")
def begun_answers(s, d):
    rows = load(s, d, "source_rows", "row_id", "raw_term", "headword").where("raw_term IS NOT NULL AND headword IS NOT NULL")
    return rows.select("row_id", X.starts_answer(F.col("raw_term"), F.substring("headword", 1, 4)).alias("begins"))


@query(r"""SELECT regexp_matches(lower(headword), '(acy|ance|ancy|ation|dom|ence|ency|hood|ism|ity|ment|ness|ship|sion|tion)\z') AS abstract, count(*) AS n
FROM source_rows WHERE headword IS NOT NULL GROUP BY 1""")
def abstract_endings(s, d):
    rows = load(s, d, "source_rows", "headword").where("headword IS NOT NULL")
    return rows.groupBy(X.abstract_noun(F.col("headword")).alias("abstract")).agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT row_id, source || CASE WHEN row_id % 3 = 0 THEN '.PDF' ELSE '' END AS source,
  CASE WHEN source_format = 'pdf' THEN 'books/' || source_file || '.pdf#page=' || pdf_page ELSE source_ref END AS ref FROM source_rows)
SELECT row_id, coalesce(regexp_extract(CASE WHEN contains(lower(ref), '.pdf#page=') THEN string_split(ref, '#page=')[1]
  WHEN suffix(lower(source), '.pdf') THEN source END, '([^/]*)$', 1), '') AS file FROM t""")
def source_pdfs(s, d):
    rows = load(s, d, "source_rows", "row_id", "source", "source_format", "source_file", "pdf_page", "source_ref")
    source = F.concat("source", F.when(F.col("row_id") % 3 == 0, ".PDF").otherwise(""))
    ref = F.when(
        F.col("source_format") == "pdf", F.concat(F.lit("books/"), "source_file", F.lit(".pdf#page="), "pdf_page")
    ).otherwise(F.col("source_ref"))
    return rows.select("row_id", X.source_pdf(source, ref).alias("file"))


@query("""SELECT user_id, event_id, CAST(floor((n - 1) / 5) AS BIGINT) + 1 AS wave FROM (SELECT user_id, event_id, event_type,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
WHERE event_type = 'purchase'""")
def wave_numbers(s, d):
    events = load(s, d, "events", "user_id", "event_id", "ts", "event_type")
    hit = F.col("event_type") == "purchase"
    return R.waves(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), hit, 5).select("user_id", "event_id", "wave")


@query("""SELECT p_partkey, CASE WHEN ((p_partkey % 20) % 2 = 0) = ((p_partkey % 20) < 10) THEN 'read' ELSE 'spell' END AS mode FROM part""")
def alternating_modes(s, d):
    return R.alternating(load(s, d, "part", "p_partkey"), F.col("p_partkey"), 10, "read", "spell")


@query("""WITH c AS (SELECT source_format AS k, count(*) AS n FROM source_rows WHERE source_format IS NOT NULL GROUP BY 1)
SELECT string_agg(CASE WHEN k = 'pdf' THEN 'portable' ELSE k END || '=' || n, ',' ORDER BY CASE WHEN k = 'pdf' THEN 'portable' ELSE k END) AS statistics
FROM c WHERE k <> 'docx'""")
def public_statistics(s, d):
    rows = load(s, d, "source_rows", "source_format").where("source_format IS NOT NULL")
    counts = rows.groupBy("source_format").agg(F.count("*").alias("n"))
    built = A.statistics_map(counts, "source_format", "n")
    public = A.renamed_keys(F.col("statistics"), {"pdf": "portable"}, drop=["docx"])
    pairs = F.transform(
        F.array_sort(F.map_entries(public)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return built.select(F.array_join(pairs, ",").alias("statistics"))

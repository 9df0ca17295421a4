"""Named queries of the engine's own operators, each over whole tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.alternatives import CARRIED_VERBS, PREPOSITIONS, slash_alternatives
from lexloom.functions.unicode import casefold, nfkd_ascii
from lexloom.operators import aggregates as A
from lexloom.operators import digests as D
from lexloom.operators import gates as G
from lexloom.operators import layout as L
from lexloom.operators import ordered as R
from lexloom.operators import practice as P
from lexloom.operators import wordlists as W
from lexloom.operators.folds import predictions
from lexloom.sources.tables import load
from lexloom.streaming.practice import stream_counters
from lexloom.streaming.run import read_stream, run_complete, run_retests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROLE_POLICY = {
    "target_reference": "target", "lexical_candidate": "candidate_only", "activity_reference": "methods_only",
    "pedagogy_reference": "methods_only",
}


def query(sql: str | None = None):
    """Registers a query, and its SQL if there is one, under the function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: White space as a class of RE2, and a text without any at its ends.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


# --- text -----------------------------------------------------------------------------------------------------------


@query(r"""SELECT row_id, trim(regexp_replace(regexp_replace(lower(raw_term), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS answer, """
  f"lower({_stripped('raw_term')}) = lower({_stripped('headword')}) AS same FROM source_rows")
def normalize_answer(s, d):
    return load(s, d, "source_rows", "row_id", "raw_term", "headword").select(
        "row_id",
        X.normalize_answer("raw_term").alias("answer"),
        X.same_spelling(F.col("raw_term"), F.col("headword")).alias("same")
    )


_CLEAN = r"trim(regexp_replace(translate({0}, chr(160)||'‘’‚‛“”„´–—―', ' ''''''''''''''''---'), '[\s\x{{0b}}\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


@query(
    "SELECT row_id, " + _CLEAN.format("topic_or_section") + " AS topic FROM source_rows WHERE topic_or_section IS NOT NULL"
)
def clean_marks(s, d):
    return load(s, d, "source_rows", "row_id", "topic_or_section").where(F.col("topic_or_section").isNotNull()).select(
        "row_id", X.collapse(X.plain_marks("topic_or_section")).alias("topic")
    )


@query()
def nfkc_clean(s, d):
    return load(s, d, "source_rows", "row_id", "raw_term").where(F.col("raw_term").isNotNull()).select(
        "row_id", X.clean_text("raw_term").alias("clean")
    )


@query()
def lexical_forms(s, d):
    clean = load(s, d, "source_rows", "row_id", "raw_term").select("row_id", X.clean_text("raw_term").alias("clean"))
    return clean.select(
        "row_id", X.lexical_form(F.col("clean")).alias("form"), X.lexical_key(F.col("clean")).alias("key")
    )


@query(r"""WITH c AS (SELECT row_id, trim(regexp_replace(lower(definition), '\s+', ' ', 'g')) AS x FROM source_rows
  WHERE definition IS NOT NULL)
SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
 '^[•·▪◦*-]+\s*', ''), '\b(somebody|someone)\b', 'sb', 'g'), '\bsomething\b', 'sth', 'g'), '\s*/\s*', '/', 'g'), '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'), ' ,;:.') AS key FROM c""")
def definition_keys(s, d):
    rows = load(s, d, "source_rows", "row_id", "definition").where(F.col("definition").isNotNull())
    return rows.select("row_id", X.lexical_key(F.btrim(F.regexp_replace("definition", r"\s+", " "))).alias("key"))


@query(r"""SELECT p_partkey, coalesce(nullif(trim(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 54), '-'), ''), 'entry')
  || '-' || left(sha1(lower(p_name)), 8) AS slug FROM part""")
def stable_slug(s, d):
    return load(s, d, "part", "p_partkey", "p_name").select("p_partkey", X.stable_slug(F.col("p_name")).alias("slug"))


@query(
    r"""SELECT c_custkey, 'hard-word-' || regexp_replace(lower(c_name), '\s+', '-', 'g') || '-' || left(sha256(c_name), 8) AS public_id FROM customer"""
)
def public_id_sha256(s, d):
    return load(s, d, "customer", "c_custkey", "c_name").select(
        "c_custkey", X.public_id(F.col("c_name")).alias("public_id")
    )


@query(
    r"""SELECT row_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(concat_ws(' ', cefr, notes, definition)), '\b[ABC][12]\b'))), '|') AS levels FROM source_rows"""
)
def level_extract(s, d):
    text = F.concat_ws(" ", "cefr", "notes", "definition")
    return load(s, d, "source_rows", "row_id", "cefr", "notes", "definition").select(
        "row_id", F.array_join(X.cefr_levels(text), "|").alias("levels")
    )


def _pos_sql() -> str:
    text = r"trim(regexp_replace(lower(coalesce(pos, '')), '\s+', ' ', 'g'))"
    rules = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{label}' END" for label, p in X.POS_RULES)
    found = f"[x FOR x IN [{rules}] IF x IS NOT NULL]"
    return (
        f"WITH c AS (SELECT row_id, {text} AS t FROM source_rows), f AS (SELECT row_id, t, {found} AS l FROM c) "
        "SELECT row_id, CASE WHEN t = '' THEN '' WHEN len(l) = 0 THEN 'unspecified' ELSE array_to_string(l, '|') END AS labels FROM f"
    )


@query(_pos_sql())
def pos_multi_label(s, d):
    typed = load(s, d, "source_rows", "row_id", "pos").select("row_id", X.pos_text("pos").alias("typed"))
    return typed.select("row_id", F.array_join(X.pos_labels(F.col("typed")), "|").alias("labels"))


@query(r"""WITH p AS (SELECT row_id, unnest(regexp_extract_all(headword, '(?:[^,(]|\([^()]*\))+')) AS v FROM source_rows)
SELECT """ + _stripped("v") + " AS part, count(*) AS n FROM p WHERE " + _stripped("v") + " <> '' GROUP BY 1")
def comma_split_explode(s, d):
    return A.histogram(load(s, d, "source_rows", "row_id", "headword"), X.comma_groups(F.col("headword")), "part")


@query(
    r"""SELECT p_partkey, lower(trim(regexp_replace(p_brand, '[123]$', ''))) AS word, coalesce(try_cast(nullif(regexp_extract(p_brand, '([123])$', 1), '') AS INT), 1) AS code FROM part"""
)
def trailing_code_parse(s, d):
    word, code = X.code_at_end(F.col("p_brand"))
    return load(s, d, "part", "p_partkey", "p_brand").select("p_partkey", word.alias("word"), code.alias("code"))


@query(r"""SELECT CASE WHEN headword IS NULL OR trim(regexp_replace(headword, '[\s\x{a0}\x{0b}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) = '' THEN 'empty'
 WHEN length(headword) > 120 OR len(string_split(trim(regexp_replace(headword, '[\s\x{a0}\x{0b}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), ' ')) > 16 THEN 'implausibly_long'
 WHEN NOT regexp_matches(headword, '\p{L}') THEN 'no_letter' WHEN regexp_matches(headword, '\p{Co}') THEN 'private_use_glyph'
 WHEN regexp_matches(headword, '\p{Cc}') THEN 'control_character' WHEN regexp_matches(headword, '[|\\]') THEN 'stray_delimiter' ELSE 'sound' END AS problem, count(*) AS n FROM source_rows GROUP BY 1""")
def headword_problems(s, d):
    rows = load(s, d, "source_rows", "headword")
    return rows.groupBy(F.coalesce(X.headword_problem(F.col("headword")), F.lit("sound")).alias("problem")).agg(
        F.count("*").alias("n")
    )


@query(
    r"""SELECT line_id, replace(replace(replace(replace(replace(raw_line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM raw_lines"""
)
def escape_html(s, d):
    return load(s, d, "raw_lines", "line_id", "raw_line").select(
        "line_id", X.escape_html(F.col("raw_line")).alias("html")
    )


@query(r"""SELECT row_id, concat_ws('; ', nullif(notes, ''), nullif(definition, '')) AS joined FROM target_rows""")
def append_notes(s, d):
    return load(s, d, "target_rows", "row_id", "notes", "definition").select(
        "row_id", X.joined_notes(F.col("notes"), F.col("definition")).alias("joined")
    )


@query(
    r"""SELECT CASE WHEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 80 THEN 'native' ELSE 'ocr' END AS route, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1"""
)
def text_route(s, d):
    texts = load(s, d, "documents", "text").where(F.col("text").isNotNull())
    return texts.groupBy(X.has_text_layer(F.col("text")).alias("route")).agg(F.count("*").alias("n"))


_SLASH_SQL = r"""WITH t AS (SELECT row_id, trim(regexp_replace(raw_term, 'WS+', ' ', 'g'), ' ') AS x FROM source_rows
  WHERE raw_term IS NOT NULL),
p AS (SELECT row_id, [trim(y, ' ') FOR y IN string_split(x, '/') IF trim(y, ' ') <> ''] AS ps FROM t),
s AS (SELECT *, CASE WHEN len(ps) > 1 THEN regexp_extract(ps[-1], '\s(\([^()]+\))$', 1) ELSE '' END AS tail FROM p),
q AS (SELECT row_id, [CASE WHEN tail = '' OR suffix(y, tail) THEN y ELSE y || ' ' || tail END FOR y IN ps] AS ps FROM s),
w AS (SELECT *, string_split(ps[1], ' ') AS a, string_split(ps[2], ' ') AS b,
  regexp_extract(ps[1], '^(.*\S) \S+$', 1) AS head FROM q),
r AS (SELECT row_id, CASE
  WHEN len(ps) = 2 THEN [
    ps[1] || CASE WHEN lower(b[-1]) IN PREPS AND lower(a[-1]) NOT IN PREPS THEN ' ' || b[-1] ELSE '' END,
    CASE WHEN lower(a[1]) = 'be' AND lower(b[1]) <> 'be' THEN 'Be ' ELSE '' END
      || CASE WHEN len(a) > 1 AND len(b) = 1 AND lower(a[1]) IN VERBS THEN head || ' ' ELSE '' END || ps[2]]
  WHEN len(ps) > 2 AND len(a) > 1 AND len([y FOR y IN ps[2:] IF lower(y) NOT IN PREPS]) = 0
    THEN [ps[1]] || [head || ' ' || y FOR y IN ps[2:]]
  ELSE ps END AS out FROM w)
SELECT row_id, unnest(generate_series(0, len(out) - 1))::INT AS n, unnest(out) AS term FROM r WHERE len(out) > 0"""


@query(
    _SLASH_SQL.replace("WS", r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    .replace("PREPS", str(PREPOSITIONS))
    .replace("VERBS", str(CARRIED_VERBS))
)
def slash_expansions(s, d):
    terms = load(s, d, "source_rows", "row_id", "raw_term").where(F.col("raw_term").isNotNull())
    return terms.select("row_id", F.posexplode(slash_alternatives(F.col("raw_term"))).alias("n", "term"))


@query()
def folded_terms(s, d):
    return load(s, d, "target_rows", "row_id", "headword").select(
        "row_id", casefold("headword").alias("folded"), nfkd_ascii("headword").alias("ascii")
    )


@query(r"""WITH t AS (SELECT row_id, lower(trim(regexp_replace(headword, '\s+', ' ', 'g'))) AS w, lower(trim(regexp_replace(raw_term, '\s+', ' ', 'g'))) AS p FROM target_rows)
SELECT row_id, CASE WHEN w = '' THEN false ELSE contains(' ' || regexp_replace(p, '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' ' || trim(regexp_replace(w, '[^\p{L}\p{N}]+', ' ', 'g')) || ' ') END AS visible FROM t WHERE w IS NOT NULL AND p IS NOT NULL""")
def visible_terms(s, d):
    rows = load(s, d, "target_rows", "row_id", "headword", "raw_term").dropna()
    return rows.select("row_id", X.visible(F.col("raw_term"), F.col("headword")).alias("visible"))


# --- gates ----------------------------------------------------------------------------------------------------------


@query(r"""SELECT row_id, unnest([x FOR x IN [CASE WHEN regexp_matches(raw_term, '\.\s*$') THEN 'ends_with_period' END,
 CASE WHEN lower(left(headword, 1)) <> lower(left(raw_term, 1)) THEN 'first_letter' END,
 CASE WHEN lower(trim(raw_term, ' ')) <> lower(trim(headword, ' ')) THEN 'term_differs' END,
 CASE WHEN cefr IS NOT NULL AND NOT regexp_matches(cefr, '^[ABC][12]$') THEN 'level' END] IF x IS NOT NULL]) AS issue
  FROM source_rows""")
def quality_issues(s, d):
    rules = [
        G.Rule("ends_with_period", F.col("raw_term").rlike(r"\.\s*$")),
        G.Rule("first_letter", F.lower(F.substring("headword", 1, 1)) != F.lower(F.substring("raw_term", 1, 1))),
        G.Rule("term_differs", F.lower(F.btrim("raw_term")) != F.lower(F.btrim("headword"))),
        G.Rule("level", F.col("cefr").isNotNull() & ~F.col("cefr").rlike("^[ABC][12]$")),
    ]
    return G.violations(load(s, d, "source_rows", "row_id", "raw_term", "headword", "cefr"), rules, "row_id")


_EXPECTED = "CASE source_role " + " ".join(f"WHEN '{r}' THEN '{p}'" for r, p in ROLE_POLICY.items()) + " END"


@query(
    f"SELECT row_id, source_role, corpus_policy, {_EXPECTED} AS expected FROM source_rows WHERE corpus_policy IS DISTINCT FROM {_EXPECTED}"
)
def role_policy_fd(s, d):
    rows = load(s, d, "source_rows", "row_id", "source_role", "corpus_policy")
    return G.dependency_broken(rows, "source_role", "corpus_policy", ROLE_POLICY)


@query("""SELECT r.row_id, CASE WHEN g.id IS NULL THEN 'unknown_id' WHEN r.source_role IS DISTINCT
  FROM g.source_role THEN 'source_role_differs'
 WHEN r.corpus_policy IS DISTINCT FROM g.corpus_policy THEN 'corpus_policy_differs' END AS issue
FROM source_rows r LEFT JOIN source_registry g ON r.registry_source_id = g.id
WHERE g.id IS NULL OR r.source_role IS DISTINCT FROM g.source_role OR r.corpus_policy IS DISTINCT FROM g.corpus_policy
UNION ALL SELECT -t.row_id, 'unknown_id' FROM target_rows t LEFT JOIN source_registry g ON t.source = g.display_name
  WHERE g.id IS NULL""")
def fk_gate(s, d):
    registry = load(s, d, "source_registry")
    rows = load(s, d, "source_rows", "row_id", "registry_source_id", "source_role", "corpus_policy")
    own = G.reference_broken(rows, registry, "registry_source_id", "id", ["source_role", "corpus_policy"])
    targets = load(s, d, "target_rows", (-F.col("row_id")).alias("row_id"), "source")
    named = G.reference_broken(targets, registry, "source", "display_name", [])
    return own.select("row_id", "issue").unionByName(named.select("row_id", "issue"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS state
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM subject_labels) b USING (doc_id)
  WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def coverage_missing_unexpected(s, d):
    return G.coverage(load(s, d, "documents", "doc_id"), load(s, d, "subject_labels", "doc_id"), "doc_id")


@query("""SELECT 'with_orders' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
  WHERE o_custkey IS NOT NULL)""")
def semi_anti(s, d):
    customer, orders = load(s, d, "customer", "c_custkey"), load(s, d, "orders", "o_custkey")
    on = customer["c_custkey"] == orders["o_custkey"]
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(customer.join(orders, on, "left_semi"), "with_orders").unionByName(
        count(customer.join(orders, on, "left_anti"), "without")
    )


@query("""(SELECT 'left' AS side, source, n FROM (SELECT lower(source) AS source, count(*) AS n FROM target_rows
  GROUP BY 1 EXCEPT ALL SELECT lower(source), count(*) FROM source_rows GROUP BY 1))
UNION ALL (SELECT 'right', source, n FROM (SELECT lower(source) AS source, count(*) AS n FROM source_rows
  GROUP BY 1 EXCEPT ALL SELECT lower(source), count(*) FROM target_rows GROUP BY 1))""")
def set_equality(s, d):
    count = lambda t: load(s, d, t, "source").groupBy(F.lower("source").alias("source")).agg(
        F.count("*").alias("n")
    )
    return G.set_difference(count("target_rows"), count("source_rows"))


@query("""SELECT source FROM (SELECT DISTINCT source FROM target_rows INTERSECT SELECT display_name FROM source_registry)
  WHERE source IS NOT NULL""")
def intersect_sources(s, d):
    return load(s, d, "target_rows", "source").intersect(load(s, d, "source_registry", F.col("display_name").alias("source"))).where(
        "source IS NOT NULL"
    )


# --- joins ----------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT lower(trim(headword, ' ')) AS k, max(row_id) AS id FROM source_rows
  WHERE corpus_policy = 'target' GROUP BY 1),
c AS (SELECT lower(trim(headword, ' ')) AS k, max(row_id) AS id FROM source_rows WHERE corpus_policy = 'candidate_only'
  GROUP BY 1)
SELECT t.row_id, coalesce(a.id, c.id) AS match_id,
  CASE WHEN a.id IS NOT NULL THEN 'active' WHEN c.id IS NOT NULL THEN 'candidate' ELSE 'unmatched' END AS status
FROM target_rows t LEFT JOIN a ON lower(trim(t.headword, ' ')) = a.k LEFT JOIN c ON lower(trim(t.headword, ' ')) = c.k""")
def priority_lookup(s, d):
    key = F.lower(F.btrim("headword")).alias("k")
    rows = load(s, d, "source_rows", "row_id", "headword", "corpus_policy").where(
        F.col("corpus_policy").isin("target", "candidate_only")
    )
    # one build side for both lookups; the last duplicate wins
    known = rows.groupBy(key).agg(
        F.max(F.when(F.col("corpus_policy") == "target", F.col("row_id"))).alias("active"),
        F.max(F.when(F.col("corpus_policy") == "candidate_only", F.col("row_id"))).alias("candidate"),
    )
    status = F.when(F.col("active").isNotNull(), "active").when(F.col("candidate").isNotNull(), "candidate").otherwise(
        "unmatched"
    )
    return load(s, d, "target_rows", "row_id", "headword").select("row_id", key).join(known, "k", "left").select(
        "row_id", F.coalesce("active", "candidate").alias("match_id"), status.alias("status")
    )


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority,
  CASE WHEN o_orderkey IS NULL THEN 'generated' ELSE 'reviewed' END AS asset
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND (l_returnflag = 'R') = (o_orderstatus = 'F')""")
def composite_key_left_join(s, d):
    lines = load(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumn(
        "k", F.col("l_returnflag") == "R"
    )
    orders = load(s, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").withColumn(
        "ok", F.col("o_orderstatus") == "F"
    )
    joined = lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("k") == F.col("ok")), "left")
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "o_orderpriority",
        F.when(F.col("o_orderkey").isNull(), "generated").otherwise("reviewed").alias("asset"),
    )


@query(
    "SELECT label_id, accent, kind, label || '/' || accent || '/' || kind AS path FROM pos_labels, (VALUES ('en-GB'), ('en-US')) a(accent), (VALUES ('word'), ('sentence')) k(kind)"
)
def cross_expand(s, d):
    # a product with two short literal lists is an explode, not a join
    accents, kinds = F.array(F.lit("en-GB"), F.lit("en-US")), F.array(F.lit("word"), F.lit("sentence"))
    rows = load(s, d, "pos_labels", "label_id", "label").select("*", F.explode(accents).alias("accent")).select(
        "*", F.explode(kinds).alias("kind")
    )
    return rows.select("label_id", "accent", "kind", F.concat_ws("/", "label", "accent", "kind").alias("path"))


@query("""WITH a AS (SELECT lower(headword) AS k, min(cefr) AS b, avg(line_no) AS v FROM target_rows WHERE headword IS NOT NULL GROUP BY 1),
n AS (SELECT lower(headword) AS k, min(cefr) AS b, avg(line_no) AS v FROM source_rows WHERE headword IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(a.k, n.k) AS k, a.k AS ak, n.k AS nk, a.b AS ab, n.b AS nb, round(a.v, 3)::DECIMAL(28,6) AS av, round(n.v, 3)::DECIMAL(28,6) AS nv
  FROM a FULL JOIN n ON a.k = n.k)
SELECT k, CASE WHEN ak IS NULL THEN 'added' WHEN nk IS NULL THEN 'removed' ELSE 'changed' END AS state,
  CASE WHEN ak IS NULL OR nk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ab IS DISTINCT FROM nb THEN 'b' END, CASE WHEN abs(av - nv) > 2.5 THEN 'v' END) END AS changed
FROM j WHERE ak IS NULL OR nk IS NULL OR ab IS DISTINCT FROM nb OR abs(av - nv) > 2.5""")
def manifest_diff_tolerance(s, d):
    def manifest(table):
        rows = load(s, d, table, "headword", "cefr", "line_no").where("headword IS NOT NULL")
        return rows.groupBy(F.lower("headword").alias("k")).agg(F.min("cefr").alias("b"), F.round(F.avg("line_no"), 3).alias("v"))

    return D.diff(manifest("target_rows"), manifest("source_rows"), "k", ["b"], {"v": 2.5})


@query("""WITH t AS (SELECT source_file, line_no, row_id, headword FROM target_rows)
SELECT a.row_id, b.row_id AS next_row_id, a.headword IS NOT DISTINCT FROM b.headword AS same
  FROM t a JOIN t b ON a.source_file = b.source_file AND b.line_no = a.line_no + 1""")
def positional_diff(s, d):
    a = load(s, d, "target_rows", "source_file", "line_no", "row_id", "headword")
    b = a.select(
        "source_file",
        (F.col("line_no") - 1).alias("line_no"),
        F.col("row_id").alias("next_row_id"),
        F.col("headword").alias("_h"),
    )
    return a.join(b, ["source_file", "line_no"]).select(
        "row_id", "next_row_id", F.col("headword").eqNullSafe(F.col("_h")).alias("same")
    )


@query("""WITH b AS (SELECT user_id, event_id AS band_id, epoch(ts) AS lo, epoch(ts) + 3600 AS hi FROM events
  WHERE event_type = 'signup')
SELECT e.event_id, b.band_id FROM events e JOIN b ON e.user_id = b.user_id AND epoch(e.ts) >= b.lo AND epoch(e.ts) < b.hi""")
def range_band_join(s, d):
    events = load(s, d, "events", "event_id", "user_id", "ts", "event_type").withColumn("at", F.unix_micros("ts") / 1e6)
    bands = events.where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("band_id"), F.col("at").alias("lo"), (F.col("at") + 3600).alias("hi")
    )
    return R.band_join(events.select("event_id", "user_id", "at"), bands, ["user_id"], "at", "lo", "hi", 3600.0).select(
        "event_id", "band_id"
    )


@query("""SELECT s_name AS name, 'base' AS origin FROM supplier UNION ALL SELECT c_name, 'batch' FROM customer
  WHERE c_name NOT IN (SELECT s_name FROM supplier)""")
def insert_if_absent(s, d):
    base = load(s, d, "supplier", F.col("s_name").alias("name")).withColumn("origin", F.lit("base"))
    return D.insert_if_absent(
        base, load(s, d, "customer", F.col("c_name").alias("name")).withColumn("origin", F.lit("batch")), "name"
    )


@query("""WITH c(event_type, fixed) AS (VALUES ('error', 'failure'), ('error', 'retry'), ('signup', 'enrol'))
SELECT coalesce(c.fixed, e.event_type) AS outcome, count(*) AS n FROM events e LEFT JOIN c USING (event_type) GROUP BY 1""")
def corrections_override(s, d):
    fixes = F.create_map(
        F.lit("error"), F.array(F.lit("failure"), F.lit("retry")), F.lit("signup"), F.array(F.lit("enrol"))
    )
    events = load(s, d, "events", "event_type")
    out = events.select(
        F.explode(F.coalesce(F.try_element_at(fixes, F.col("event_type")), F.array("event_type"))).alias("outcome")
    )
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT registry_source_id AS id, count(*) AS evidence FROM source_rows
  GROUP BY 1), t AS (SELECT source AS display_name, count(*) AS targets FROM target_rows GROUP BY 1),
dd AS (SELECT source AS id, count(*) AS documents FROM documents GROUP BY 1)
SELECT g.id, coalesce(evidence, 0) AS evidence, coalesce(targets, 0) AS targets, coalesce(documents, 0) AS documents,
 CASE WHEN coalesce(evidence, 0) > 0 AND coalesce(documents, 0) > 0 THEN 'both' WHEN coalesce(evidence, 0) > 0 THEN 'evidence_only' ELSE 'pending' END AS state
FROM source_registry g LEFT JOIN r USING (id) LEFT JOIN t USING (display_name) LEFT JOIN dd USING (id)""")
def multi_source_ledger(s, d):
    count = lambda t, key, name, to: load(s, d, t, key).groupBy(F.col(key).alias(to)).agg(
        F.count("*").alias(name)
    )
    out = load(s, d, "source_registry", "id", "display_name")
    out = out.join(count("source_rows", "registry_source_id", "evidence", "id"), "id", "left")
    out = out.join(count("target_rows", "source", "targets", "display_name"), "display_name", "left")
    out = out.join(count("documents", "source", "documents", "id"), "id", "left").na.fill(
        0, ["evidence", "targets", "documents"]
    )
    state = F.when((F.col("evidence") > 0) & (F.col("documents") > 0), "both").when(F.col("evidence") > 0, "evidence_only").otherwise(
        "pending"
    )
    return out.select("id", "evidence", "targets", "documents", state.alias("state"))


# --- aggregates -----------------------------------------------------------------------------------------------------


def _keyed(s, d):
    rows = load(s, d, "source_rows", "row_id", "headword", "source", "cefr", "corpus_policy").where(
        "headword IS NOT NULL"
    )
    return rows.withColumn("key", X.normalize_answer("headword")).where("key <> ''")


_KEYED = r"(SELECT *, trim(regexp_replace(regexp_replace(lower(headword), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM source_rows WHERE headword IS NOT NULL)"


@query(f"""WITH k AS (SELECT * FROM {_KEYED}
  WHERE key <> ''), f AS (SELECT key, headword, count(*) AS n, min(row_id) AS first FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, headword <> lower(headword), length(headword), lower(headword), first) AS rn FROM f)
SELECT key, headword AS display, t.n_rows, t.n_sources, t.first_row
  FROM r JOIN (SELECT key, count(*) AS n_rows, count(DISTINCT source) AS n_sources, min(row_id) AS first_row FROM k
  GROUP BY key) t USING (key) WHERE rn = 1""")
def lexeme_census(s, d):
    rows = _keyed(s, d)
    totals = rows.groupBy("key").agg(
        F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"), F.min("row_id").alias("first_row")
    )
    return A.display_form(rows, "key", "headword", "row_id").join(totals, "key")


@query(f"""WITH k AS (SELECT *, CASE corpus_policy WHEN 'target' THEN 0 WHEN 'candidate_only' THEN 1 ELSE 2 END AS rk
  FROM {_KEYED} WHERE key <> ''),
b AS (SELECT key, min(rk) AS best FROM k GROUP BY key)
SELECT k.key, arg_min(headword, row_id) FILTER (rk = best) AS headword, CASE best WHEN 0 THEN 'active' WHEN 1 THEN 'candidate_only' ELSE 'support_only' END AS status,
 count(*) FILTER (rk = 0) AS n_target, count(*) FILTER (rk = 1) AS n_candidate, count(*) FILTER (rk = 2) AS n_other,
 coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (rk = best AND source IS NOT NULL)), '|'), '') AS source, coalesce(array_to_string(list_sort(list(DISTINCT cefr) FILTER (rk = best AND cefr IS NOT NULL)), '|'), '') AS cefr
FROM k JOIN b USING (key) GROUP BY k.key, best""")
def policy_partitioned_entry(s, d):
    out = A.policy_entry(_keyed(s, d), "key", "corpus_policy", "row_id", "headword", ["source", "cefr"])
    return out.withColumns({c: F.array_join(c, "|") for c in ("source", "cefr")})


@query("""SELECT registry_source_id, count(*) AS n_rows, count(DISTINCT headword) AS n_headwords, array_to_string(list_sort(list(DISTINCT source_format) FILTER (source_format IS NOT NULL)), '|') AS formats,
 array_to_string(list_sort(list(DISTINCT cefr) FILTER (cefr IS NOT NULL)), '|') AS levels, min(try_cast(pdf_page AS INT)) AS first_page, max(try_cast(pdf_page AS INT)) AS last_page FROM source_rows GROUP BY 1""")
def source_manifest(s, d):
    rows = load(s, d, "source_rows", "registry_source_id", "headword", "source_format", "cefr", "pdf_page")
    page = F.expr("try_cast(pdf_page AS int)")
    # two levels, so that one source with a third of the rows is counted by many tasks
    by_head = rows.groupBy("registry_source_id", "headword").agg(
        F.count("*").alias("n"),
        F.collect_set("source_format").alias("f"),
        F.collect_set("cefr").alias("c"),
        F.min(page).alias("lo"),
        F.max(page).alias("hi")
    )
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), "|")
    return by_head.groupBy("registry_source_id").agg(
        F.sum("n").alias("n_rows"),
        F.count("headword").alias("n_headwords"),
        joined("f").alias("formats"),
        joined("c").alias("levels"),
        F.min("lo").alias("first_page"), F.max("hi").alias("last_page"),
    )


@query("""SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open_lines, count(DISTINCT l_partkey) AS parts,
 round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS discounted FROM lineitem""")
def conditional_stats(s, d):
    return load(s, d, "lineitem", "l_returnflag", "l_linestatus", "l_partkey", "l_discount", "l_extendedprice").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        F.count_distinct("l_partkey").alias("parts"),
        F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0)), 2).alias(
            "discounted"
        ),
    )


@query(r"""SELECT w AS value, count(*) AS n
  FROM (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' ')) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '' GROUP BY 1""")
def exploded_histogram(s, d):
    return A.histogram(load(s, d, "documents", "text"), F.split(X.normalize_answer("text"), " ")).where("value <> ''")


@query("""SELECT 'large' AS flag, count(*) FILTER (p_size > 25) AS n FROM part
  UNION ALL SELECT 'costly', count(*) FILTER (p_retailprice > 1500) FROM part
  UNION ALL SELECT 'first_brand', count(*) FILTER (p_brand LIKE 'Brand#1%') FROM part""")
def flag_counts_unpivot(s, d):
    flags = {
        "large": F.col("p_size") > 25,
        "costly": F.col("p_retailprice") > 1500,
        "first_brand": F.col("p_brand").startswith("Brand#1"),
    }
    return A.unpivot_counts(load(s, d, "part", "p_size", "p_retailprice", "p_brand"), flags)


@query("""WITH f AS (SELECT definition, min(headword) AS o FROM source_rows
  WHERE headword IS NOT NULL AND definition IS NOT NULL GROUP BY 1 HAVING count(DISTINCT headword) = 1
 UNION ALL SELECT topic_or_section, min(headword) FROM source_rows
  WHERE headword IS NOT NULL AND topic_or_section IS NOT NULL GROUP BY 1 HAVING count(DISTINCT headword) = 1)
SELECT min(definition) AS item, o AS headword FROM f GROUP BY o HAVING count(*) = 1""")
def single_owner_rule(s, d):
    rows = load(s, d, "source_rows", "definition", "topic_or_section", "headword").where("headword IS NOT NULL")
    items = rows.select("headword", F.explode(F.array_compact(F.array("definition", "topic_or_section"))).alias("item"))
    return A.single_owner(items, "item", "headword")


@query("""SELECT format, source_role, corpus_policy, count(*) AS n FROM source_registry
  GROUP BY GROUPING SETS ((format), (source_role), (corpus_policy), ())""")
def grouping_sets_inventory(s, d):
    table = load(s, d, "source_registry", "format", "source_role", "corpus_policy")
    return table.groupingSets([["format"], ["source_role"], ["corpus_policy"], []], "format", "source_role", "corpus_policy").agg(
        F.count("*").alias("n")
    )


@query("SELECT lang, kind, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, kind)")
def rollup_documents(s, d):
    return load(s, d, "documents", "lang", "kind", "n_chars").rollup("lang", "kind").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars")
    )


@query(
    "SELECT md5(text) AS text_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1"
)
def keep_first_dedup(s, d):
    docs = load(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select(
        "doc_id", F.md5("text").alias("text_key")
    )
    return docs.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH t AS (SELECT lower(trim(headword, ' ')) AS k, row_id, headword, source, cefr FROM target_rows
  WHERE headword IS NOT NULL)
SELECT k, arg_min(headword, row_id) AS headword, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), '|'), '') AS sources, coalesce(array_to_string(list_sort(list(DISTINCT cefr) FILTER (cefr IS NOT NULL)), '|'), '') AS levels FROM t GROUP BY k""")
def dedup_union_attrs(s, d):
    rows = load(s, d, "target_rows", "row_id", "headword", "source", "cefr").where("headword IS NOT NULL")
    return rows.groupBy(F.lower(F.btrim("headword")).alias("k")).agg(
        F.min_by("headword", "row_id").alias("headword"),
        F.array_join(A.sorted_set("source"), "|").alias("sources"),
        F.array_join(A.sorted_set("cefr"), "|").alias("levels")
    )


@query("""SELECT row_id, row_number() OVER (PARTITION BY lower(headword) ORDER BY row_id) AS nth FROM target_rows
  WHERE headword IS NOT NULL""")
def dup_ordinal(s, d):
    rows = load(s, d, "target_rows", "row_id", "headword").where("headword IS NOT NULL").withColumn(
        "k", F.lower("headword")
    )
    return R.blocked(rows, ["k"], ["row_id"], F.floor(F.col("row_id") / 100_000), {"nth": ("sum", F.lit(1))}).select(
        "row_id", "nth"
    )


@query(
    """SELECT user_id, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'error') AS failed, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1"""
)
def or_union_needs(s, d):
    return load(s, d, "events", "user_id", "event_type", "ts").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("bought"),
        F.bool_or(F.col("event_type") == "error").alias("failed"),
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )


@query("""WITH g AS (SELECT l_partkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
z AS (SELECT l_partkey, coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(r, 0) AS r FROM g)
SELECT l_partkey, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS best, list_sort([a, n, r], 'DESC')[1] - list_sort([a, n, r], 'DESC')[2] AS margin FROM z""")
def argmax_with_tie_order(s, d):
    lines = load(s, d, "lineitem", "l_partkey", "l_returnflag", "l_quantity")
    sums = lines.groupBy("l_partkey").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0)).alias(
                f
            ) for f in "ANR"
        ]
    )
    best, margin = A.argmax_with_margin({f: F.col(f) for f in "ANR"})
    return sums.select("l_partkey", best.alias("best"), margin.alias("margin"))


@query("""SELECT label, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier
  FROM (SELECT label, (vec_id % 100) / 100.0 AS p, CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.0 END AS y FROM embeddings)
  GROUP BY label""")
def brier_score(s, d):
    rows = load(s, d, "embeddings", "vec_id", "label")
    out = P.brier(rows, ["label"], (F.col("vec_id") % 100) / 100.0, F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0))
    return out.withColumn("brier", F.round("brier", 9))


# --- ordered --------------------------------------------------------------------------------------------------------

@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events"""
)
def forward_fill(s, d):
    events = load(s, d, "events", "event_id", "user_id", "ts", "event_type").withColumn(
        "mark", F.when(F.col("event_type") == "signup", F.col("event_id"))
    )
    return R.forward_fill(events, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), "mark", "section").select(
        "event_id", "section"
    )


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM events)
SELECT user_id, island, min(event_id) AS first, count(*) AS n_lines, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text FROM i GROUP BY 1, 2""")
def gap_island_assemble(s, d):
    events = load(s, d, "events", "event_id", "user_id", "ts", "event_type")
    marked = R.islands(
        events, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), F.col("event_type") == "signup"
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda r: r["event_type"]
    )
    return marked.groupBy("user_id", "island").agg(
        F.min("event_id").alias("first"), F.count("*").alias("n_lines"), F.array_join(ordered, " ").alias("text")
    )


@query("""WITH dd AS (SELECT DISTINCT l_orderkey // 1000 AS book, l_orderkey AS n
  FROM lineitem), g AS (SELECT book, n, n - row_number() OVER (PARTITION BY book ORDER BY n) AS g FROM dd),
r AS (SELECT book, g, min(n) AS a, max(n) AS z FROM g
  GROUP BY 1, 2) SELECT book, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, '、' ORDER BY a) AS pages
  FROM r GROUP BY book""")
def compact_ranges(s, d):
    rows = load(s, d, "lineitem", "l_orderkey").select(
        F.floor(F.col("l_orderkey") / 1000).alias("book"), F.col("l_orderkey").alias("n")
    )
    return R.compact_ranges(rows, ["book"], "n")


@query("""WITH h AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS hit,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS miss FROM events),
m AS (SELECT *, (sum(miss) OVER w)::BIGINT AS misses, (sum(hit) OVER w)::BIGINT AS hits
  FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, hits, misses, sum(hit) OVER (PARTITION BY user_id, misses ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS combo FROM m""")
def running_combo(s, d):
    events = load(s, d, "events", "event_id", "user_id", "ts", "event_type")
    hit, miss = F.when(F.col("event_type") == "purchase", 1).otherwise(0), F.when(F.col("event_type") == "error", 1).otherwise(0)
    day = F.date_trunc("day", "ts")
    counted = R.blocked(events, ["user_id"], ["ts", "event_id"], day, {"hits": ("sum", hit), "misses": ("sum", miss)})
    # the combo is what was hit since the last miss: hits now less hits at that miss
    at_miss = F.when(F.col("event_type") == "error", F.col("hits"))
    out = R.blocked(counted, ["user_id"], ["ts", "event_id"], day, {"before": ("last", at_miss)})
    return out.select("event_id", "hits", "misses", (F.col("hits") - F.coalesce("before", F.lit(0))).alias("combo"))


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events
  WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2""")
def latest_state_wins(s, d):
    core = load(s, d, "events", "event_id", "user_id", "ts", "event_type", "value").where(
        F.col("event_type").isin("purchase", "error")
    )
    return A.latest(core, ["user_id", "event_type"], ["ts", "event_id"], ["value", "ts"])


@query("""SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS micros
  FROM events""")
def days_since_last(s, d):
    events = load(s, d, "events", "event_id", "user_id", "ts")
    # the row before, in blocks: the last (ts, id) inside the block or of the block before
    at = F.unix_micros("ts")
    day = F.date_trunc("day", "ts")
    inside = Window.partitionBy("user_id", "_b").orderBy("ts", "event_id")
    marked = events.withColumn("_b", day).withColumn("_at", at).withColumn("_lag", F.lag("_at").over(inside))
    ends = marked.groupBy("user_id", "_b").agg(F.max("_at").alias("_end"))
    prior = ends.select(
        "user_id", "_b", F.lag("_end").over(Window.partitionBy("user_id").orderBy("_b")).alias("_prior")
    )
    return marked.join(prior, ["user_id", "_b"], "left").select(
        "event_id", (F.col("_at") - F.coalesce("_lag", "_prior")).alias("micros")
    )


@query("""SELECT p_partkey, ((p_partkey - 1 - 750 + 100 * (SELECT count(*) FROM part)) % (SELECT count(*)
  FROM part)) // 10 AS batch, ((p_partkey - 1 - 750 + 100 * (SELECT count(*) FROM part)) % (SELECT count(*)
  FROM part)) % 10 AS place FROM part""")
def round_robin_batch(s, d):
    part = load(s, d, "part", "p_partkey").withColumn("n", F.col("p_partkey") - 1)
    return R.round_robin(part, "n", 10, part.count(), 750).select("p_partkey", "batch", "place")


@query("""WITH r AS (SELECT event_id, user_id, sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_cost FROM (SELECT *, 60 + event_id % 90 AS cost FROM events))
SELECT event_id, running_cost FROM r WHERE running_cost <= 720""")
def budgeted_plan(s, d):
    events = load(s, d, "events", "event_id", "user_id", "ts").withColumn("cost", 60 + F.col("event_id") % 90)
    return R.budget(events, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), "cost", 720).select(
        "event_id", "running_cost"
    )


@query(
    "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, lower(p_name), p_partkey LIMIT 60 OFFSET 60"
)
def sorted_page(s, d):
    return load(s, d, "part", "p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), F.lower("p_name"), "p_partkey").offset(60).limit(
        60
    )


@query()
def line_clusters(s, d):
    lines = load(s, d, "events", "event_id", "user_id", "ts").withColumn("at", F.unix_micros("ts") / 1e6)
    return L.cluster_lines(lines.select("event_id", "user_id", "at"), ["user_id"], "at", "event_id", 86_400.0)


# --- digests --------------------------------------------------------------------------------------------------------


@query(
    "SELECT n_nationkey, sha256(concat_ws(chr(31), 'v' || n_nationkey, coalesce('v' || n_name, 'n'), coalesce('v' || n_regionkey, 'n'))) AS digest FROM nation"
)
def row_digest(s, d):
    return load(s, d, "nation").select(
        "n_nationkey", D.row_digest("n_nationkey", "n_name", "n_regionkey").alias("digest")
    )


@query("""WITH b AS (SELECT file_id, line_no // 100 AS block, count(*) AS n, sha256(string_agg(sha256('v' || raw_line), '' ORDER BY line_no)) AS g
  FROM raw_lines GROUP BY 1, 2)
SELECT file_id, sum(n)::BIGINT AS n, sha256(string_agg(g, '' ORDER BY block)) AS sequence_digest FROM b GROUP BY 1""")
def sequence_digest(s, d):
    lines = load(s, d, "raw_lines", "file_id", "line_no", "raw_line").withColumn("digest", D.row_digest("raw_line"))
    return D.sequence_digest(lines, ["file_id"], "line_no", "digest", 100)


@query(
    """SELECT id, sha256('{"format":' || coalesce('"' || format || '"', 'null') || ',"id":"' || id || '","trust_rank":' || trust_rank || '}') AS binding FROM source_registry"""
)
def binding_digest(s, d):
    reg = load(s, d, "source_registry", "id", "format", "trust_rank")
    return reg.select("id", F.sha2(D.canonical_json({c: F.col(c) for c in reg.columns}), 256).alias("binding"))


@query()
def multiset_digests(s, d):
    rows = load(s, d, "source_rows", "registry_source_id", "raw_term", "headword", "pos").withColumn(
        "digest", D.row_digest("raw_term", "headword", "pos")
    )
    return D.multiset_digest(rows, ["registry_source_id"], "digest")


@query("""SELECT a.row_id FROM target_rows a WHERE NOT EXISTS (SELECT 1 FROM source_rows b
  WHERE a.headword = b.headword AND a.source = b.source)""")
def stale_specs(s, d):
    specs = load(s, d, "target_rows", "row_id", "headword", "source")
    return D.stale(specs, load(s, d, "source_rows", "headword", "source"), "headword", "source").select("row_id")


# --- practice -------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'error')) AS attempts, count(*) FILTER (event_type = 'purchase') AS correct, count(*) FILTER (event_type = 'error') AS failed,
 count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS exposures, max(ts) AS last_at FROM events GROUP BY 1""")
def practice_counters(s, d):
    return P.counters(
        load(s, d, "events", "user_id", "event_type", "ts"),
        ["user_id"],
        F.col("event_type") == "purchase",
        F.col("event_type") == "error",
    )


@query(
    """SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2"""
)
def first_answers(s, d):
    return P.first_answers(
        load(s, d, "events", "user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]
    )


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, event_id, ts, event_type, lead(n, 3) OVER (PARTITION BY user_id ORDER BY n) AS by_task, min(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS FOLLOWING AND UNBOUNDED FOLLOWING) AS by_time FROM e)
SELECT a.user_id, a.event_id, e.event_id AS release_id FROM a
  LEFT JOIN e ON e.user_id = a.user_id AND by_task IS NOT NULL AND by_time IS NOT NULL AND e.n = greatest(by_task, by_time)
  WHERE a.event_type = 'error'""")
def retest_release(s, d):
    return P.retests(
        load(s, d, "events", "user_id", "event_id", "ts", "event_type"), "user_id", F.col("event_type") == "error"
    )


@query(
    """SELECT user_id, least(count(*) FILTER (event_type = 'purchase'), 4) AS level, max(ts) + to_days([1, 3, 7, 14, 30][least(count(*) FILTER (event_type = 'purchase'), 4) + 1]) AS due FROM events GROUP BY 1"""
)
def interval_schedule(s, d):
    level = F.least(F.count_if(F.col("event_type") == "purchase"), F.lit(4)).alias("level")
    out = load(s, d, "events", "user_id", "event_type", "ts").groupBy("user_id").agg(level, F.max("ts").alias("last"))
    return out.select(
        "user_id", "level", F.timestamp_add("DAY", P.interval_days(F.col("level")), F.col("last")).alias("due")
    )


@query("""SELECT user_id, event_type, max(value) AS best FROM events GROUP BY 1, 2""")
def best_value_upsert(s, d):
    return load(s, d, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(
        F.max("value").alias("best")
    )


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events
  GROUP BY 1, 2""")
def windowed_counts(s, d):
    events = load(s, d, "events", "ts", "event_type", "value")
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(
        F.col("w.start").alias("day"), "event_type", "n", "value"
    )


# --- streams --------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (" + ORACLES["retest_release"] + ") WHERE release_id IS NOT NULL")
def stream_retest_release(s, d):
    events = read_stream(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    return run_retests(events)


@query(ORACLES["first_answers"])
def stream_first_answers_run(s, d):
    events = read_stream(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    return run_complete(P.first_answers(events, ["user_id", "event_type"], ["ts", "event_id"]))


@query("SELECT day AS from_ts, event_type, n, value FROM (" + ORACLES["windowed_counts"] + ")")
def stream_windowed_counts(s, d):
    counts = run_complete(stream_counters(read_stream(s, d, "events").select("ts", "event_type", "value")))
    return counts.withColumn("value", F.round("value", 6))


# --- word lists and folds -------------------------------------------------------------------------------------------

_HEAD = r"^(.+ \([a-z ]+\.?\)) – "


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS line_no FROM documents WHERE kind = 'glossary' AND text IS NOT NULL),
m AS (SELECT *, regexp_matches(line, '^(.+ \([a-z ]+\.?\)) – ') AS h FROM l),
e AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS entry FROM m)
SELECT doc_id, entry, min(CASE WHEN h THEN regexp_extract(line, '^(.+ \([a-z ]+\.?\)) – ', 1) END) AS head, min(line_no)::INT AS first_line, count(*) AS n_lines,
 coalesce(string_agg(trim(line, ' '), ' ' ORDER BY line_no) FILTER (NOT h AND trim(line, ' ') <> ''), '') AS rest FROM e
  GROUP BY 1, 2""")
def glossary_entries(s, d):
    docs = load(s, d, "documents", "doc_id", "text", "kind").where("kind = 'glossary'")
    return W.entries_by_head(W.lines_of(docs, "doc_id", "text"), ["doc_id"], _HEAD)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS line_no FROM documents WHERE kind = 'dialogue' AND text IS NOT NULL),
e AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '\?\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS entry FROM l)
SELECT doc_id, entry, min(line_no)::INT AS first_line, trim(regexp_replace(string_agg(trim(line, ' '), ' ' ORDER BY line_no), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS text, bool_or(regexp_matches(line, '\?\s*$')) AS complete FROM e GROUP BY 1, 2""")
def turns_until_question(s, d):
    docs = load(s, d, "documents", "doc_id", "text", "kind").where("kind = 'dialogue'")
    return W.entries_until(W.lines_of(docs, "doc_id", "text"), ["doc_id"], r"\?\s*$")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^Unit (\d+) ') THEN regexp_extract(line, '^Unit (\d+) ', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT section, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM e WHERE NOT regexp_matches(line, '^Unit (\d+) ')
  GROUP BY 1""")
def section_lines(s, d):
    docs = load(s, d, "documents", "doc_id", "text")
    lines = W.with_sections(W.lines_of(docs, "doc_id", "text"), ["doc_id"], r"^Unit (\d+) ")
    return lines.groupBy("section").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


@query(r"""WITH j AS (SELECT registry_source_id, topic_or_section, source_file, string_agg(definition, ' ' ORDER BY line_no) AS x FROM source_rows WHERE definition IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT registry_source_id, topic_or_section, source_file, unnest([trim(regexp_replace(y, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') FOR y IN string_split(x, ',') IF trim(regexp_replace(y, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') <> '']) AS term FROM j)
SELECT term, count(*) AS n FROM t GROUP BY 1""")
def comma_stream_terms(s, d):
    keys = ["registry_source_id", "topic_or_section", "source_file"]
    rows = load(s, d, "source_rows", *keys, "line_no", "definition").where("definition IS NOT NULL")
    return W.comma_stream(rows, keys, "line_no", "definition").groupBy("term").agg(F.count("*").alias("n"))


@query(r"""SELECT CASE WHEN NOT contains(x, '|') THEN 'no_delimiter' WHEN trim(string_split(x, '|')[1], ' ') NOT IN ('noun', 'verb', 'n', 'v') THEN 'unknown_code'
 WHEN trim(regexp_replace(x, '^[^|]*\|', ''), ' ') = '' THEN 'empty_term' WHEN regexp_matches(regexp_replace(x, '^[^|]*\|', ''), '[㐀-鿿]') THEN 'wrong_script' ELSE 'entry' END AS outcome, count(*) AS n
FROM (SELECT coalesce(pos, '') || CASE WHEN row_id % 9 = 0 THEN '' ELSE '|' END || coalesce(topic_or_section, '') AS x
  FROM source_rows) WHERE trim(x, ' ') <> '' GROUP BY 1""")
def coded_line_outcomes(s, d):
    bar = F.when(F.col("row_id") % 9 == 0, "").otherwise("|")
    rows = load(s, d, "source_rows", "row_id", "pos", "topic_or_section")
    lines = rows.select(
        F.concat(F.coalesce("pos", F.lit("")), bar, F.coalesce("topic_or_section", F.lit(""))).alias("line")
    )
    out = W.coded_lines(lines, {"noun": "noun", "n": "noun", "verb": "verb", "v": "verb"})
    return out.groupBy(F.coalesce("problem", F.lit("entry")).alias("outcome")).agg(F.count("*").alias("n"))


@query(r"""SELECT s.page, s.term FROM (SELECT DISTINCT lower(source) || '#' || pdf_page AS page, lower(headword) AS term
  FROM target_rows WHERE source IS NOT NULL AND pdf_page IS NOT NULL AND headword IS NOT NULL) s
WHERE NOT EXISTS (SELECT 1 FROM source_rows r
  WHERE lower(r.source) || '#' || r.pdf_page = s.page AND contains(lower(r.raw_term), s.term))""")
def plan_not_visible(s, d):
    page = F.concat_ws("#", F.lower("source"), "pdf_page").alias("page")
    known = "source IS NOT NULL AND pdf_page IS NOT NULL"
    plan = load(s, d, "target_rows", "source", "pdf_page", "headword").where(known).select(page, F.lower("headword").alias("term")).dropna().distinct()
    pages = load(s, d, "source_rows", "source", "pdf_page", "raw_term").where(known).select(page, F.lower("raw_term").alias("body")).dropna()
    return W.missing_from_pages(plan, pages, F.col("body").contains(F.col("term")))


@query()
def online_predictions(s, d):
    events = load(s, d, "events", "user_id", "event_id", "ts", "event_type")
    answer = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 0)
    rows = events.select("user_id", "event_id", "ts", answer.alias("y"), (F.unix_micros("ts") / 1e6).alias("at"))
    return predictions(rows, ["user_id"], ["ts", "event_id"], "y", "at")

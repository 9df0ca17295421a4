"""Text normalisation as native column expressions.

Patterns keep to what Java and RE2 share where a query is checked against SQL. All functions return null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.unicode import casefold, nfkc, nfkd_ascii

# Qualifiers in brackets that belong to the form itself.
OPTIONAL_COMPLEMENTS = (
    "as", "by", "by/with", "for", "from", "in", "not", "of", "off", "on", "on/upon", "out", "over", "sth", "sth else",
    "sth/sb", "sb", "sb/sth", "to", "together", "up", "with", "with sb", "with sth", "with/together",
)
# Optional spelling suffixes in brackets.
OPTIONAL_SUFFIXES = ("s", "es", "d", "e", "h", "me", "my", "dy", "graph", "theque", "time", "wards")
# Two forms that no rule gives, "as typed, form".
FIXED_FORMS = (("(a)round", "around"), ("kilo(gram[me]) / kg", "kilogram / kg"))
# Endings of abstract nouns.
ABSTRACT_SUFFIXES = (
    "acy", "ance", "ancy", "ation", "dom", "ence", "ency", "hood", "ism", "ity", "ment", "ness", "ship", "sion", "tion"
)
# Part-of-speech labels and the patterns that name them, in order; a text gets every label that matches.
POS_RULES = (
    ("proper noun", r"\bproper noun\b|\bproper n\b"),
    ("phrasal verb", r"\bphrasal verb\b|\bphr v\b"),
    ("verb phrase", r"\bverb phrase\b|\bvp\b"),
    ("noun phrase", r"\bnoun phrase\b|\bnp\b"),
    ("adjective phrase", r"\badjective phrase\b|\badjp\b"),
    ("adverb phrase", r"\badverb phrase\b|\badvp\b"),
    ("prepositional phrase", r"\bprepositional phrase\b|\bprep phr\b|\bpp\b"),
    ("idiom", r"\bidiom\b"),
    ("phrase", r"^phr\.?$|\bgeneral phrase\b|\bexpression\b|^exp\.?$"),
    ("question word", r"\bquestion word\b"),
    ("auxiliary verb", r"\bauxiliary verb\b|\bav\b"),
    ("modal verb", r"\bmodal verb\b|\bmv\b|\bmodal v\b"),
    ("noun", r"\bnoun\b|(?:^|[^a-z])n(?:\.|\b)"),
    ("verb", r"\bverb\b|(?:^|[^a-z])v(?:\.|\b)"),
    ("adjective", r"\badjective\b|\badj(?:\.|\b)"),
    ("adverb", r"\badverb\b|\badv(?:\.|\b)"),
    ("preposition", r"\bpreposition\b|\bprep(?:\.|\b)"),
    ("conjunction", r"\bconjunction\b|\bconj(?:\.|\b)"),
    ("pronoun", r"\bpronoun\b|\bpron(?:\.|\b)"),
    ("determiner", r"\bdeterminer\b|\bdet(?:\.|\b)"),
    ("article", r"\barticle\b|\bart(?:\.|\b)"),
    ("exclamation", r"\bexclamation\b|\bexclam(?:\.|\b)|\bint(?:\.|\b)"),
    ("number", r"\bnumber\b"),
)


def strip(x: Column | str) -> Column:
    """``x`` without white space of any kind at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column | str) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def plain_marks(x: Column | str) -> Column:
    """Curly quotes as apostrophes, long dashes as hyphens, no-break spaces as spaces."""
    return F.translate(x, " ‘’‚‛“”„´–—―", " ''''''''---")


def clean_text(x: Column | str) -> Column:
    """Compatibility form, plain marks, single spaces."""
    return collapse(plain_marks(nfkc(x)))


def normalize_answer(x: Column | str) -> Column:
    """Lower-case ASCII letters, digits, apostrophes and single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9' ]+", " "), " +", " "))


def lexical_form(text: Column) -> Column:
    """The form of a term without remarks in brackets; ``text`` is clean already.

    A bracket at the end goes unless it is an optional complement, whose brackets go; optional suffixes and other
    inner brackets go; brackets that open the term stay.
    """
    for typed, form in FIXED_FORMS:
        text = F.when(F.lower(text) == typed, F.lit(form)).otherwise(text)
    tail = r"^(.*?)\s+\(([^()]*)\)$"

    def shorter(form: Column) -> Column:
        base, inner = F.regexp_extract(form, tail, 1), F.regexp_extract(form, tail, 2)
        return (
            F.when(~form.rlike(tail), form)
            .when(F.lower(inner).isin(*OPTIONAL_COMPLEMENTS), F.concat_ws(" ", base, inner))
            .otherwise(base)
        )

    brackets = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    trimmed = F.when(brackets > 0, F.reduce(F.sequence(F.lit(1), F.greatest(brackets, F.lit(1))), text, lambda acc, _: shorter(acc))).otherwise(
        text
    )
    no_suffix = F.regexp_replace(trimmed, r"(\w)\((?:" + "|".join(OPTIONAL_SUFFIXES) + r")\)", "$1")
    opened = F.regexp_replace(no_suffix, r"(\s)\((sb|sth)\)(\s)", "$1$2$3")
    return collapse(F.regexp_replace(opened, r"\s+\([^()]+\)(\s)", "$1"))


def lexical_key(text: Column) -> Column:
    """Grouping key of a term: lexical form case-folded, bullets and outer marks off, sb and sth for persons and things."""
    x = F.regexp_replace(casefold(lexical_form(text)), r"^[•·▪◦*-]+\s*", "")
    x = F.regexp_replace(x, r"\b(?:somebody|someone)\b", "sb")
    x = F.regexp_replace(x, r"\bsomething\b", "sth")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*/\s*", "/"), r"\s*-\s*", "-")
    return F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" ,;:."))


def stable_slug(x: Column) -> Column:
    """ASCII slug of up to 54 characters and eight hex digits of the SHA-1 of the lower-case text."""
    slug = F.btrim(F.regexp_replace(F.lower(nfkd_ascii(x)), "[^a-z0-9]+", "-"), F.lit("-"))
    stem = F.coalesce(F.nullif(F.btrim(F.substring(slug, 1, 54), F.lit("-")), F.lit("")), F.lit("entry"))
    return F.concat_ws("-", stem, F.substring(F.sha1(F.encode(casefold(x), "UTF-8")), 1, 8))


def public_id(x: Column, prefix: str = "hard-word-") -> Column:
    words = F.concat_ws("-", F.split(F.lower(x), r"\s+"))
    return F.concat(F.lit(prefix), words, F.lit("-"), F.substring(F.sha2(x, 256), 1, 8))


def cefr_levels(x: Column) -> Column:
    """Distinct levels named in a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(x), F.lit(r"\b[ABC][12]\b"), F.lit(0))))


def pos_text(x: Column | str) -> Column:
    """A part of speech as typed in the form that :func:`pos_labels` reads."""
    return F.lower(collapse(F.coalesce(x, F.lit(""))))


def pos_labels(text: Column) -> Column:
    """Every part of speech a text names; [unspecified] for other text, [] for none.

    ``text`` is a column of :func:`pos_text`: two dozen patterns read it, so it should be worked out in a projection
    of its own before.
    """
    found = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in POS_RULES]))
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.size(found) == 0, F.array(F.lit("unspecified")))
        .otherwise(found)
    )


def comma_groups(x: Column) -> Column:
    """Parts between commas, commas in brackets aside."""
    parts = F.regexp_extract_all(x, F.lit(r"(?:[^,(]|\([^()]*\))+"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def code_at_end(x: Column, default: int = 1) -> tuple[Column, Column]:
    """(text, code) of a token such as ``word3``; the code is 1, 2 or 3."""
    code = F.regexp_extract(F.btrim(x), r"([123])$", 1)
    return (
        F.lower(F.btrim(F.regexp_replace(F.btrim(x), r"[123]$", ""))),
        F.coalesce(F.nullif(code, F.lit("")).cast("int"), F.lit(default)),
    )


def headword_problem(x: Column, most_chars: int = 120, most_words: int = 16) -> Column:
    """Why a text is no headword; null if it is one."""
    words = F.size(F.split(collapse(x), " "))
    return (
        F.when(x.isNull() | (collapse(x) == ""), F.lit("empty"))
        .when((F.length(x) > most_chars) | (words > most_words), F.lit("implausibly_long"))
        .when(~x.rlike(r"\p{L}"), F.lit("no_letter"))
        .when(x.rlike(r"\p{Co}"), F.lit("private_use_glyph"))
        .when(x.rlike(r"\p{Cc}"), F.lit("control_character"))
        .when(x.rlike(r"[|\\]"), F.lit("stray_delimiter"))
    )


def source_title(file_name: Column) -> Column:
    """``NameOfBook_WLM_ExtendedUnit7.tsv`` as ``Name Of Book Extended Unit 07``; other names without their ending."""
    stem = F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", "")
    pattern = r"^([A-Za-z]+)_(?:[A-Z]+_)?([A-Za-z]*?)Unit(\d+)$"
    spaced = lambda c: F.regexp_replace(
        F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2"
    )
    parts = F.concat_ws(
        " ",
        spaced(F.regexp_extract(stem, pattern, 1)),
        F.nullif(F.regexp_extract(stem, pattern, 2), F.lit("")),
        F.concat(F.lit("Unit "), F.lpad(F.regexp_extract(stem, pattern, 3), 2, "0")),
    )
    return F.when(stem.rlike(pattern), parts).otherwise(stem)


def visible(page: Column, term: Column) -> Column:
    """Whether a term stands on a page as whole words, letter case and spacing aside."""
    text, wanted = F.lower(collapse(page)), F.lower(collapse(term))
    return F.when(wanted == "", F.lit(False)).otherwise(
        F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" ")).contains(
            F.concat(F.lit(" "), F.btrim(F.regexp_replace(wanted, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
        )
    )


def escape_html(x: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x


def joined_notes(*notes: Column) -> Column:
    """Non-empty notes joined by ``; ``."""
    return F.concat_ws("; ", *[F.nullif(n, F.lit("")) for n in notes])


def same_spelling(a: Column, b: Column) -> Column:
    """Equal but for letter case and outer white space."""
    return F.lower(strip(a)) == F.lower(strip(b))


def has_text_layer(x: Column, least: int = 80) -> Column:
    """``native`` with at least so many letters and digits, else ``ocr``."""
    return F.when(F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= least, F.lit("native")).otherwise(F.lit("ocr"))


def valid_candidate(x: Column, most: int = 100) -> Column:
    """Whether a text can be a word-list candidate: short, no formula or arrow, letters and plain marks only."""
    return F.coalesce(
        (F.length(x) <= most) & ~x.rlike(r" \+ |[=/→]") & ~F.lower(x).contains("infinitive") & x.rlike(
            r"^[\p{L}][\p{L}\p{M}0-9 '’.,!?()-]*\z"
        ),
        F.lit(False)
    )


def target_problem(x: Column, most: int = 48) -> Column:
    """Why a text is no teaching target; null if it is one."""
    return (
        F.when(x.isNull() | (F.btrim(x) == ""), "empty").when(F.length(x) > most, "too_long").when(
            x.rlike(r"[.!?;:]"), "sentence_mark"
        )
        .when(~x.rlike(r"^[\p{L}][\p{L} '-]*\z"), "other_character")
    )


def definition_sides(x: Column) -> tuple[Column, Column]:
    """(left, right) of ``term – definition``; a text without a spaced dash has no right side."""
    pattern = r"(?s)^(.*?)\s+[–—-]\s+(.*)\z"
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x), F.when(
        x.rlike(pattern), F.regexp_extract(x, pattern, 2)
    )


def without_sense(x: Column) -> tuple[Column, Column]:
    """(headword, sense number) of a headword with trailing sense digits."""
    return F.regexp_replace(x, r"\s*\d+\z", ""), F.nullif(F.regexp_extract(x, r"(\d+)\z", 1), F.lit("")).cast("int")


def joined_breaks(x: Column) -> Column:
    """Words divided at a line end joined, other line ends as spaces, no final period."""
    return F.regexp_replace(collapse(F.regexp_replace(x, r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2")), r"\.$", "")


def ipa_part(x: Column) -> tuple[Column, Column]:
    """(term, transcription) of ``term /…/``."""
    pattern = r"^(.*?)\s*/([^/]+)/\s*$"
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x), F.when(
        x.rlike(pattern), F.regexp_extract(x, pattern, 2)
    )


def locator_problem(x: Column, groups: int = 14, units: int = 25) -> Column:
    """Whether every part of a comma-separated locator is ``G`` and 1..groups, or 1..units; null if so."""
    part = lambda p: ((p.rlike(r"^G\d{1,2}$")) & F.regexp_extract(p, r"(\d+)", 1).cast("int").between(1, groups)) | (
        p.rlike(r"^\d{1,2}$") & F.regexp_extract(p, r"(\d+)", 1).cast("int").between(1, units)
    )
    return F.when(x.isNull() | (F.btrim(x) == ""), "empty").when(
        ~F.forall(F.transform(F.split(x, ","), lambda p: F.btrim(p)), lambda p: F.coalesce(part(p), F.lit(False))),
        "bad_part",
    )


def sentence_use(sentence: Column, word: Column) -> Column:
    """``needs_revision`` unless a sentence of three words or more holds the word as a whole word; never judged right."""
    long_enough = F.size(F.split(collapse(sentence), " ")) >= 3
    return F.when(long_enough & visible(sentence, word), "pending_human_review").otherwise("needs_revision")


def unescape_html(x: Column) -> Column:
    """The five named marks and no-break spaces of HTML as characters; the ampersand last."""
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(mark))
    return x


def metadata_text(x: Column, most: int = 500) -> Column:
    """A metadata value without control characters, in single spaces, of at most so many characters by definition."""
    return F.substring(collapse(F.regexp_replace(x, r"\p{Cc}+", " ")), 1, most)


def gate_key(text: Column) -> Column:
    """As :func:`lexical_key`, but a bracket at the end always goes with what it holds."""
    return lexical_key(F.regexp_replace(text, r"(\s+\([^()]*\))+$", ""))


def key_values(x: Column) -> Column:
    """``Key: value`` lines as a map; a line without a colon is left out, of a repeated key the first counts."""
    lines = F.filter(F.split(x, r"\r?\n"), lambda line: line.contains(":"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.btrim(F.substring_index(line, ":", 1)).alias("key"),
            F.btrim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"),
        ),
    )
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def sentence_of(chunks: Column) -> Column:
    """Chunks joined by spaces, no space before a mark."""
    return F.regexp_replace(F.array_join(chunks, " "), r"\s+([,.;!?])", "$1")


def lesson_number(page: Column, first: int = 6, pages: int = 3) -> Column:
    """Two-digit number of the lesson of ``pages`` pages each that ``page`` is in, counted from page ``first``."""
    return F.format_string("%02d", F.floor((page - first) / pages) + 1)


def starts_answer(target: Column, typed: Column) -> Column:
    """Whether what is typed so far is a beginning of the target, both as answers; nothing typed is none."""
    begun = normalize_answer(typed)
    return (begun != "") & normalize_answer(target).startswith(begun)


def abstract_noun(x: Column) -> Column:
    """Whether a word ends as abstract nouns do."""
    return F.lower(x).rlike("(" + "|".join(ABSTRACT_SUFFIXES) + r")\z")


def source_pdf(source: Column, ref: Column) -> Column:
    """File name of the PDF a row comes from, by its reference ``….pdf#page=`` or its source; empty if neither tells."""
    named = F.when(F.lower(ref).contains(".pdf#page="), F.substring_index(ref, "#page=", 1)).when(
        F.lower(source).endswith(".pdf"), source
    )
    return F.coalesce(F.regexp_extract(named, r"([^/]*)$", 1), F.lit(""))

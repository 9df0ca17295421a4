"""Slash alternatives of a term, expanded into whole terms, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import collapse

# Prepositions that a second alternative shares with the first, and verbs that carry over to the second.
PREPOSITIONS = ("about", "at", "for", "from", "in", "into", "of", "on", "to", "with")
CARRIED_VERBS = ("be", "come", "get", "give", "go", "have", "make", "take")
_TAIL = r"\s(\([^()]+\))$"


def slash_alternatives(term: Column) -> Column:
    """The terms that a text with slashes stands for, in order; a text without one is its own only term.

    A bracket after the last alternative belongs to all of them. Of two alternatives, one word after a phrase that
    begins with a carried verb takes the phrase's other words (``get on/off``: ``get off``); a preposition after the
    second, and none after the first, belongs to both; ``be`` before the first stands before the second as well. Of
    more than two, lone prepositions after a phrase each take the place of its last word. Null gives null, a blank text
    an empty array. The work is linear in the number of alternatives.
    """
    text = collapse(term)
    parts = F.filter(F.transform(F.split(text, "/"), lambda p: F.btrim(p)), lambda p: p != "")
    n = F.size(parts)
    shared = F.when(n > 1, F.regexp_extract(F.element_at(parts, -1), _TAIL, 1)).otherwise("")
    with_tail = F.transform(
        parts,
        lambda p: F.when((shared == "") | p.endswith(shared), p).otherwise(F.concat(p, F.lit(" "), shared)),
    )

    words = lambda p: F.split(p, " ")
    head = lambda p: F.regexp_extract(p, r"^(.*\S) \S+$", 1)  # noqa: E731 - all words but the last
    first, second = F.get(with_tail, F.lit(0)), F.get(with_tail, F.lit(1))
    a, b = words(first), words(second)
    last_a, last_b = F.lower(F.element_at(a, -1)), F.lower(F.element_at(b, -1))
    carried = (F.size(a) > 1) & (F.size(b) == 1) & F.lower(a[0]).isin(*CARRIED_VERBS)
    to_both = last_b.isin(*PREPOSITIONS) & ~last_a.isin(*PREPOSITIONS)
    to_be = (F.lower(a[0]) == "be") & (F.lower(b[0]) != "be")
    pair = F.array(
        F.when(to_both, F.concat(first, F.lit(" "), F.element_at(b, -1))).otherwise(first),
        F.concat(
            F.when(to_be, F.lit("Be ")).otherwise(""),
            F.when(carried, F.concat(head(first), F.lit(" "))).otherwise(""),
            second,
        ),
    )
    lone = F.forall(F.slice(with_tail, 2, F.greatest(n - 1, F.lit(1))), lambda p: F.lower(p).isin(*PREPOSITIONS))
    many = F.transform(
        with_tail, lambda p, i: F.when((i > 0) & (F.size(a) > 1) & lone, F.concat(head(first), F.lit(" "), p)).otherwise(p)
    )
    return F.when(n == 2, pair).when(n > 2, many).otherwise(parts)

"""Audits of extracted tables: counts, distributions, corrections, sequences, and evidence codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """(keys, expected, found) where a group's row count isn't the expected one; absent groups count 0 on either side."""
    found = df.groupBy(*keys).agg(F.count("*").alias("found"))
    joined = found.alias("f").join(
        expected.select(*keys, "expected").alias("e"),
        [F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys],
        "full_outer",
    )
    counts = [
        F.coalesce(F.col("e.expected"), F.lit(0)).alias("expected"),
        F.coalesce(F.col("f.found"), F.lit(0)).alias("found"),
    ]
    return joined.select(*[F.coalesce(F.col(f"f.{k}"), F.col(f"e.{k}")).alias(k) for k in keys], *counts).where(
        "expected <> found"
    )


def within(df: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Groups whose row count is outside [least, most]."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") < least) | (F.col("n") > most))


def correction_audit(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, state) of corrections not seen, seen more than once, or seen without being expected."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(1))
    b = observed.groupBy(key).agg(F.count("*").alias("_n"))
    state = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_n").isNull(), "unseen").when(
        F.col("_n") > 1, "repeated"
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where(F.col("state").isNotNull())


def first_mismatch(a: DataFrame, b: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, at, left, right): the first place where two ordered sequences differ, for each key where they do.

    ``order`` numbers the places of both sides; a missing place differs from any value, null included.
    """
    left = a.select(*keys, order, F.struct(value).alias("_l"))
    right = b.select(*keys, order, F.struct(value).alias("_r"))
    differ = left.join(right, [*keys, order], "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r")))
    first = F.min_by(F.struct(order, "_l", "_r"), order).alias("m")
    return differ.groupBy(*keys).agg(first).select(
        *keys,
        F.col(f"m.{order}").alias("at"),
        F.col(f"m._l.{value}").alias("left"),
        F.col(f"m._r.{value}").alias("right"),
    )


def duplicate_statistics(df: DataFrame, source: str, term: Column) -> DataFrame:
    """Rows, distinct terms and repeats of each source, from two levels of counts."""
    per_term = df.groupBy(source, term.alias("_term")).agg(F.count("*").alias("_n"))
    return per_term.groupBy(source).agg(
        F.sum("_n").alias("n_rows"),
        F.count("_term").alias("unique_terms"),
        (F.sum("_n") - F.count("*")).alias("duplicates")
    )


def evidence_codes(df: DataFrame, codes: dict[str, Column]) -> DataFrame:
    """``df`` with the failing codes in order and whether there are none; a null condition fails."""
    failing = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in codes.items()])
    )
    return df.withColumn("failures", failing).withColumn("passed", F.size("failures") == 0)


def keyed_map(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, entries): a map from ``name`` to ``value``, smallest value of a repeated name. For few names a key."""
    one = df.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min(value).alias(value))
    return one.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("entries")
    )


def recent(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The ``most`` first rows of each key in ``order``; Spark drops the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def browse(
    df: DataFrame, text: str | None, columns: list[str], equal: dict[str, object], contains: dict[str, object]
) -> DataFrame:
    """Conjunctive catalogue filter: a text in any of ``columns`` (case aside), equal values, members of array columns."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
        df = df.where(hit)
    for c, v in equal.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    for c, v in contains.items():
        df = df.where(F.array_contains(c, v))
    return df


def page_list(pages: Column, total: Column) -> tuple[Column, Column]:
    """(sorted pages, problem): all pages 1..total where none are named; pages out of range or named twice are a problem."""
    chosen = F.when(pages.isNull() | (F.size(pages) == 0), F.sequence(F.lit(1), F.greatest(total, F.lit(1)))).otherwise(
        F.array_sort(pages)
    )
    problem = (
        F.when(total < 1, "no_pages")
        .when(F.exists(chosen, lambda p: (p < 1) | (p > total)), "out_of_range")
        .when(F.size(F.array_distinct(chosen)) != F.size(chosen), "repeated")
    )
    return chosen, problem


def same_type_and_value(a: Column, b: Column) -> Column:
    """Equality of two JSON texts in which ``true`` isn't 1 and 1 isn't 1.0; the order of keys doesn't matter."""
    x, y = F.try_parse_json(a), F.try_parse_json(b)
    return F.coalesce(
        (F.schema_of_variant(x) == F.schema_of_variant(y)) & (F.to_json(x) == F.to_json(y)), a.eqNullSafe(b)
    )


def at_distance(df: DataFrame, keys: list[str], order: str, value: str, distance: int) -> DataFrame:
    """Rows whose value stands exactly ``distance`` places before as well. ``order`` numbers the places of a key."""
    earlier = df.select(*keys, (F.col(order) + distance).alias(order), F.col(value).alias("_earlier"))
    return df.join(earlier, [*keys, order]).where(F.col(value) == F.col("_earlier")).drop("_earlier")


def pages_state(count: Column, pages: Column, total: Column) -> Column:
    """``all``, ``some`` or ``none`` from a number of pages or a list of them, whichever is given."""
    n = F.coalesce(F.when(pages.isNotNull(), F.size(F.array_distinct(pages))), count, F.lit(0))
    return F.when(n >= total, "all").when(n > 0, "some").otherwise("none")

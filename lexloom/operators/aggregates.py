"""Grouping operators. All reduce on the map side before any shuffle; none collects a group of unbounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display_form(df: DataFrame, key: str, form: str, order: str) -> DataFrame:
    """(key, display): the commonest form; then lower case, the shortest, alphabetical, first seen."""
    counted = df.groupBy(key, form).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.struct(
        (-F.col("n")).alias("n"), (F.col(form) != F.lower(form)).cast("int").alias("cased"), F.length(form).alias("l"),
        F.lower(form).alias("folded"), F.col("first"),
    )
    return counted.groupBy(key).agg(F.min_by(form, rank).alias("display"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key; a deterministic survivor, found with partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Values of the latest row of each key."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"r.{v}").alias(v) for v in values])


def sorted_set(x: Column | str) -> Column:
    """Distinct values in order. For attributes of few distinct values: the array holds each once."""
    return F.array_sort(F.collect_set(x))


def histogram(df: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """Counts of the elements of an array column."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def unpivot_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(flag, n): how many rows have each flag, in one pass."""
    counted = df.agg(*[F.count_if(c).alias(f) for f, c in flags.items()])
    return counted.unpivot([], list(flags), "flag", "n")


def argmax_with_margin(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(name of the largest score, margin to the second); of equal scores the one named first wins."""
    entries = [
        F.struct(s.alias("s"), F.lit(-i).alias("r"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())
    ]
    ranked = F.sort_array(F.array(*[s for s in scores.values()]), asc=False)
    return F.array_max(F.array(*entries))["n"], ranked[0] - ranked[1]


def single_owner(df: DataFrame, item: str, owner: str) -> DataFrame:
    """(item, owner) where the item has one owner and the owner has one such item."""
    sole = df.groupBy(item).agg(F.min(owner).alias(owner), F.max(owner).alias("_last")).where(
        F.col(owner) == F.col("_last")
    )
    return sole.groupBy(owner).agg(F.min(item).alias(item), F.count("*").alias("_n")).where("_n = 1").select(
        item, owner
    )


def policy_entry(df: DataFrame, key: str, policy: str, order: str, headword: str, values: list[str]) -> DataFrame:
    """One entry for each key from rows of several policies: target rows win, then candidates, then the rest.

    The sets of values are those of the winning policy alone; counts are kept for every policy. Everything is a
    conditional aggregate of one shuffle, so a key of a third of all rows is reduced before it moves.
    """
    def of(name: str) -> Column:
        return F.count_if(F.col(policy) == name)

    ranked = df.withColumn(
        "_rank", F.when(F.col(policy) == "target", 0).when(F.col(policy) == "candidate_only", 1).otherwise(2)
    )
    by_rank = ranked.groupBy(key, "_rank").agg(
        F.count("*").alias("n"),
        F.min_by(headword, F.col(order)).alias("headword"),
        F.count_if(F.col(policy) == "enrich_only").alias("enrich"),
        *[sorted_set(v).alias(v) for v in values],
    )
    best = F.struct("_rank", "headword", *values)
    return (
        by_rank.groupBy(key)
        .agg(
            F.min_by(best, F.col("_rank")).alias("b"),
            F.sum(F.when(F.col("_rank") == 0, F.col("n")).otherwise(0)).alias("n_target"),
            F.sum(F.when(F.col("_rank") == 1, F.col("n")).otherwise(0)).alias("n_candidate"),
            F.sum(F.when(F.col("_rank") == 2, F.col("n")).otherwise(0)).alias("n_other"),
        )
        .select(
            key, F.col("b.headword").alias("headword"),
            F.when(F.col("b._rank") == 0, "active").when(F.col("b._rank") == 1, "candidate_only").otherwise("support_only").alias(
                "status"
            ),
            "n_target", "n_candidate", "n_other", *[F.col(f"b.{v}").alias(v) for v in values],
        )
    )


def several_of(df: DataFrame, key: str, labels: Column, among: list[str]) -> DataFrame:
    """(key, labels, several): which labels of ``among`` a key's rows have, and whether more than one.

    With parts of speech this tells homographs.
    """
    found = df.select(key, F.explode(F.array_intersect(labels, F.array(*map(F.lit, among)))).alias("label"))
    return found.groupBy(key).agg(sorted_set("label").alias("labels")).withColumn("several", F.size("labels") > 1)


def shuffled(df: DataFrame, id_column: str, base: str, seed: int) -> DataFrame:
    """``df`` with a reproducible random ``place``: rounds in which each ``base`` comes once, so repeats are far apart.

    Only the last of a round and the first of the next can be neighbours of one base.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_column))
    turn = F.row_number().over(Window.partitionBy(base).orderBy(order, id_column))
    return df.withColumn("round", turn).withColumn("place", F.xxhash64(F.lit(seed), F.col("round"), F.col(base)))


def least_loaded(load: DataFrame, lane: str, seed: int) -> DataFrame:
    """The lane with the fewest rows; of equal ones a reproducible random one. Null lanes don't count."""
    counted = load.where(F.col(lane).isNotNull()).groupBy(lane).agg(F.count("*").alias("n"))
    return counted.agg(F.min_by(lane, F.struct("n", F.xxhash64(F.lit(seed), F.col(lane)))).alias(lane))


def statistics_map(counts: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a map ``statistics`` of a table of counts, which has a row for each key and few of them."""
    return counts.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("statistics"))


def renamed_keys(x: Column, names: dict[str, str], drop: list[str]) -> Column:
    """A map without the keys ``drop``, others under new names; a new name that is there already aborts."""
    kept = F.map_filter(x, lambda k, v: ~k.isin(*drop)) if drop else x
    if not names:
        return kept
    new = F.create_map(*[F.lit(t) for pair in names.items() for t in pair])
    return F.transform_keys(kept, lambda k, v: F.coalesce(F.try_element_at(new, k), k))

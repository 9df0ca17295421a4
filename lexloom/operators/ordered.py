"""Order-dependent operators.

A plain window puts all rows of one key into one task. :func:`blocked` computes the same running values with the
rows of a key spread over blocks of the order (a day, a range of ids): running values inside each block, a prefix
over the short table of block totals, and a join of the two. A key that holds a third of all rows is then as many
tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked(
    df: DataFrame, keys: list[str], order: list[str], block: Column, running: dict[str, tuple[str, Column]]
) -> DataFrame:
    """``df`` with running values up to and including each row.

    ``running`` maps a name to (kind, expression); kinds are ``sum``, ``max``, ``last`` (last non-null value).
    ``block`` must not decrease in the order. Rows must have a total order; null keys form a key of their own.
    """
    marked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last_of = F.struct(*order)
    within, total, prefix, result = {}, [], {}, {}
    for name, (kind, x) in running.items():
        if kind == "sum":
            within[f"_{name}"] = F.sum(x).over(inside)
            total.append(F.sum(x).alias(f"_t_{name}"))
            prefix[f"_p_{name}"] = F.sum(f"_t_{name}").over(before)
            result[name] = F.coalesce(f"_p_{name}", F.lit(0)) + F.coalesce(f"_{name}", F.lit(0))
        elif kind == "max":
            within[f"_{name}"] = F.max(x).over(inside)
            total.append(F.max(x).alias(f"_t_{name}"))
            prefix[f"_p_{name}"] = F.max(f"_t_{name}").over(before)
            result[name] = F.greatest(f"_p_{name}", f"_{name}")
        elif kind == "last":
            within[f"_{name}"] = F.last(x, ignorenulls=True).over(inside)
            total.append(F.max_by(x, F.when(x.isNotNull(), last_of)).alias(f"_t_{name}"))
            prefix[f"_p_{name}"] = F.last(f"_t_{name}", ignorenulls=True).over(before)
            result[name] = F.coalesce(f"_{name}", f"_p_{name}")
        else:
            raise ValueError(kind)
    totals = marked.groupBy(*keys, "_block").agg(*total).select(
        *keys, "_block", *[c.alias(n) for n, c in prefix.items()]
    )
    renamed = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_block"])], *prefix)
    same = F.lit(True)
    for i, c in enumerate([*keys, "_block"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return marked.select("*", *[c.alias(n) for n, c in within.items()]).join(renamed, same, "left").select(
        *df.columns, *[c.alias(n) for n, c in result.items()]
    )


def forward_fill(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    return blocked(df, keys, order, block, {name: ("last", F.col(value))})


def islands(
    df: DataFrame, keys: list[str], order: list[str], block: Column, starts: Column, name: str = "island"
) -> DataFrame:
    """Number of the run each row belongs to; ``starts`` holds where a new run begins."""
    return blocked(df, keys, order, block, {name: ("sum", F.when(starts, 1).otherwise(0))})


def ranges(df: DataFrame, keys: list[str], number: str, block_size: int = 100_000) -> DataFrame:
    """(keys, first, last) of each run of consecutive integers.

    Runs are found inside blocks of the number line and then joined over block borders, where a table of one row
    a run is left.
    """
    distinct = df.select(*keys, number).where(F.col(number).isNotNull()).distinct()
    w = Window.partitionBy(*keys, "_b").orderBy(number)
    runs = (
        distinct.withColumn("_b", F.floor(F.col(number) / block_size))
        .withColumn("_g", F.col(number) - F.row_number().over(w))
        .groupBy(*keys, "_b", "_g")
        .agg(F.min(number).alias("first"), F.max(number).alias("last"))
    )
    over = Window.partitionBy(*keys).orderBy("first")
    fresh = F.when(F.lag("last").over(over) == F.col("first") - 1, 0).otherwise(1)
    return (
        runs.withColumn("_fresh", fresh)
        .withColumn("_run", F.sum("_fresh").over(over.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_run")
    )


def compact_ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, pages) with runs written as ``1-3、5``. The text of a key is as long as it has runs."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat_ws("-", "first", "last")
    )
    runs = ranges(df, keys, number).select(*keys, "first", text.alias("t"))
    return runs.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "t"))), lambda r: r["t"]), "、").alias(
            "pages"
        )
    )


def band_join(
    points: DataFrame, bands: DataFrame, keys: list[str], at: str, low: str, high: str, width: float
) -> DataFrame:
    """Points with every band [low, high) that holds them.

    The number line is cut into cells of ``width``; a band goes to each cell it touches and a point to one, so the
    join is an equi-join on key and cell with a residual condition, never a nested loop. ``width`` should be about
    the usual length of a band.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    a = points.withColumn("_cell", cell(at))
    b = bands.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return a.join(b, [*keys, "_cell"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def budget(df: DataFrame, keys: list[str], order: list[str], block: Column, cost: str, most: float) -> DataFrame:
    """Rows in order for as long as their running cost stays within ``most``."""
    return blocked(df, keys, order, block, {"running_cost": ("sum", F.col(cost))}).where(F.col("running_cost") <= most)


def round_robin(df: DataFrame, number: str, size: int, total: int, cursor: int = 0) -> DataFrame:
    """Batch and place of each row of a dense numbering 0..total-1, starting at ``cursor`` and wrapping around."""
    place = F.pmod(F.col(number) - cursor, F.lit(total))
    return df.withColumn("batch", F.floor(place / size)).withColumn("place", F.pmod(place, F.lit(size)))


def waves(df: DataFrame, keys: list[str], order: list[str], block: Column, hit: Column, per_wave: int) -> DataFrame:
    """The rows that hold ``hit``, with the number of their ``wave``: ``per_wave`` of them each, from 1 on."""
    counted = blocked(df.where(hit), keys, order, block, {"_hits": ("sum", F.lit(1))})
    return counted.withColumn("wave", F.floor((F.col("_hits") - 1) / per_wave) + 1).drop("_hits")


def alternating(df: DataFrame, number: Column, size: int, first: str, second: str) -> DataFrame:
    """``df`` with a ``mode`` that alternates by ``number`` for ``size`` rows, and the complement for the next ``size``."""
    place = F.pmod(number, F.lit(2 * size))
    return df.withColumn("mode", F.when((F.pmod(place, F.lit(2)) == 0) == (place < size), first).otherwise(second))

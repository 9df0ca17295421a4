"""State of practice events: counters, delayed retests, schedules.

Batch forms; :mod:`lexloom.streaming.practice` has the same rules over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ordered import blocked

# Baseline intervals in days by level, and the gates of a delayed retest.
INTERVAL_DAYS = (1, 3, 7, 14, 30)
RETEST_TASKS, RETEST_SECONDS = 3, 300


def counters(events: DataFrame, keys: list[str], correct: Column, failed: Column) -> DataFrame:
    """Attempts, hits, misses and the last time of each key; rows that are neither are exposures."""
    return events.groupBy(*keys).agg(
        F.count_if(correct | failed).alias("attempts"),
        F.count_if(correct).alias("correct"),
        F.count_if(failed).alias("failed"),
        F.count_if(~(correct | failed)).alias("exposures"),
        F.max("ts").alias("last_at"),
    )


def first_answers(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key, others are repeats."""
    rest = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return events.groupBy(*keys).agg(first).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def retests(events: DataFrame, user: str, failed: Column, block_seconds: int = 86_400) -> DataFrame:
    """(user, event_id, release_id): for each failure, the first later event that passes the retest gates.

    An event releases a failure that lies at least ``RETEST_TASKS`` events and ``RETEST_SECONDS`` seconds back. Both
    conditions only become true with time, so the first event to meet them is the later of the first event of either.
    The one comes from a join on running numbers, the other from a backward fill over events and probes in order of
    time. Both work in blocks of time, so no user's rows are one task, and no pairs of events are made.
    """
    micros = F.unix_micros("ts")
    rows = events.select(
        F.col(user).alias("user"),
        "ts",
        "event_id",
        micros.alias("at"),
        F.coalesce(failed, F.lit(False)).alias("failed"),
    )
    block = block_seconds * 1_000_000
    numbered = blocked(rows, ["user"], ["at", "event_id"], F.floor(F.col("at") / block), {"n": ("sum", F.lit(1))})
    failures = numbered.where("failed")
    nth = numbered.select(
        F.col("user").alias("_user"),
        (F.col("n") - RETEST_TASKS).alias("_n"),
        F.struct("at", "event_id").alias("by_tasks")
    )
    by_tasks = failures.join(nth, F.col("user").eqNullSafe(F.col("_user")) & (F.col("n") == F.col("_n")))
    # backward in time: events come before the probes of their own time, later ids before earlier ones
    seen = rows.select(
        "user",
        (-F.col("at")).alias("back"),
        F.lit(0).alias("probe"),
        (-F.col("event_id")).alias("tie"),
        F.struct("at", "event_id").alias("event"),
    )
    probes = failures.select(
        "user",
        (-(F.col("at") + RETEST_SECONDS * 1_000_000)).alias("back"),
        F.lit(1).alias("probe"),
        (-F.col("event_id")).alias("tie"),
        F.lit(None).cast(seen.schema["event"].dataType).alias("event"),
    )
    order = ["back", "probe", "tie"]
    filled = blocked(
        seen.unionByName(probes), ["user"], order, F.floor(F.col("back") / block), {"by_time": ("last", F.col("event"))}
    )
    waits = filled.where("probe = 1").select(F.col("user").alias("_user"), (-F.col("tie")).alias("_id"), "by_time")
    gates = by_tasks.select("user", "event_id", "by_tasks").join(
        waits, F.col("user").eqNullSafe(F.col("_user")) & (F.col("event_id") == F.col("_id"))
    )
    release = F.when(F.col("by_time").isNotNull(), F.greatest("by_tasks", "by_time"))
    released = gates.select(
        F.col("user").alias("_u"), F.col("event_id").alias("_e"), release["event_id"].alias("release_id")
    )
    return failures.join(
        released, F.col("user").eqNullSafe(F.col("_u")) & (F.col("event_id") == F.col("_e")), "left"
    ).select(F.col("user").alias(user), "event_id", "release_id")


def interval_days(level: Column) -> Column:
    """Days until the next practice of a level (0 and up)."""
    return F.element_at(
        F.array(*map(F.lit, INTERVAL_DAYS)),
        F.least(F.greatest(level, F.lit(0)), F.lit(len(INTERVAL_DAYS) - 1)).cast("int") + 1,
    )


def brier(df: DataFrame, keys: list[str], p: Column, y: Column) -> DataFrame:
    """Mean squared error of probabilities."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"))

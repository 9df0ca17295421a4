"""Streaming twins of the practice operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.practice import RETEST_SECONDS, RETEST_TASKS, retests

RETEST_SCHEMA = "user_id long, event_id long, release_id long"
_STATE = "seen long, waiting string"


def stream_counters(events: DataFrame, window: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Events by type and window of event time.

    In append mode later events than the watermark allows are dropped, and a window comes out when the watermark has
    passed it; in complete mode all events count and all windows come out.
    """
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("from_ts"), "event_type", "n", "value")
    )


def stream_first_answers(events: DataFrame, keys: list[str], lateness: str = "2 hours") -> DataFrame:
    """One event of each key within the watermark, the first to arrive.

    Which of the events of one micro-batch arrives first is arbitrary. The event that is first in time takes all of the
    input: the batch form ``first_answers`` over the stream, in complete mode.
    """
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def stream_retests(events: DataFrame) -> DataFrame:
    """(user_id, event_id, release_id): as the batch form, for events that arrive in order.

    State of a user: how many events were seen, and the failures that wait for release. A failure leaves the state
    when it is released, so the state is as large as the failures of the last few minutes. All events of a user in one
    micro-batch are one frame; :func:`waiting_retests` does without.
    """

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, text = state.get if state.exists else (0, "")
        waiting = [tuple(x.split(":")) for x in text.split(",") if x]
        waiting = [(int(e), int(n), float(t)) for e, n, t in waiting]
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for event, kind, at in zip(rows["event_id"], rows["event_type"], rows["ts"]):
            now = at.timestamp()
            open_ = []
            for failure, number, since in waiting:
                if seen - number >= RETEST_TASKS and now - since >= RETEST_SECONDS:
                    out.append((key[0], failure, int(event)))
                else:
                    open_.append((failure, number, since))
            waiting = open_
            if kind == "error":
                waiting.append((int(event), seen, now))
            seen += 1
        state.update((seen, ",".join(f"{e}:{n}:{t!r}" for e, n, t in waiting)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "release_id"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, RETEST_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def waiting_retests(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` with the rule of :func:`stream_retests`, for any number of events of a user.

    Each micro-batch goes through the batch form, which works in blocks of time, together with the events that wait
    from before: of each user those since the first failure that isn't released, the last few minutes at most. Versions
    under ``folder``: ``found`` has (user_id, event_id, release_id) of the failures at hand, ``open`` the waiting events.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(
            "user_id", "event_id", "ts", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed")
        )
        before = latest_version(spark, f"{folder}/open", number)
        if before is not None:
            rows = rows.unionByName(before)
        retests(rows, "user_id", F.col("failed")).write.mode("overwrite").parquet(f"{folder}/found/version={number}")
        found = spark.read.parquet(f"{folder}/found/version={number}")
        held = found.where("release_id IS NULL").select(F.col("user_id").alias("_u"), F.col("event_id").alias("_e"))
        since = (
            rows.where("failed")
            .join(held, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("event_id") == F.col("_e")), "left_semi")
            .groupBy(F.col("user_id").alias("_u"))
            .agg(F.min(F.struct("ts", "event_id")).alias("since"))
        )
        later = F.col("user_id").eqNullSafe(F.col("_u")) & (F.struct("ts", "event_id") >= F.col("since"))
        rows.join(since, later, "left_semi").write.mode("overwrite").parquet(f"{folder}/open/version={number}")

    return step


def best_scores(folder: str):
    """A function for ``foreachBatch`` that keeps the best value of each (user, type) in versions under ``folder``.

    Every micro-batch writes a version of its own number from the last one before it, so a batch that runs again
    after a failure writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
        before = latest_version(batch.sparkSession, folder, number)
        if before is not None:
            fresh = fresh.unionByName(before).groupBy("user_id", "event_type").agg(F.max("best").alias("best"))
        fresh.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return merge


def latest_version(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The complete version with the largest number (under ``before``), None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [s.getPath() for s in files.listStatus(path)]
    done = [
        int(p.getName()[8:]) for p in names if p.getName().startswith("version=") and files.exists(
            p.suffix("/_SUCCESS")
        )
    ]
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{folder}/version={max(done)}") if done else None

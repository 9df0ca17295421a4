"""Running a stream over all files that are there, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.session import shared_folder
from lexloom.streaming.practice import RETEST_SCHEMA, latest_version, waiting_retests


def read_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` as a stream of its files; timestamps without zone are UTC instants."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        df = reader.parquet(path)
    else:  # a stream reads folders: the folder of the one file, and that file alone
        df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    naive = {f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(naive) if naive else df


def run_available(df: DataFrame) -> DataFrame:
    """Runs ``df`` over all input that is there, with a checkpoint, into parquet files, and reads these.

    In append mode, so an aggregate gives only the windows that the watermark has passed; those still open when the
    input ends are not written. :func:`run_complete` has them.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "stream")
    stream = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def run_complete(df: DataFrame) -> DataFrame:
    """Runs the aggregate ``df`` over all input that is there, and reads all of its groups, open windows too.

    Every micro-batch writes the whole result as a version of its own number, and the last one is read. State is
    never dropped and late events count, so the result is that of the batch form; the state is as large as the result.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/versions/version={number}")

    _run_batches(df, write, folder, "complete")
    last = latest_version(spark, f"{folder}/versions")
    return spark.createDataFrame([], df.schema) if last is None else last


def run_retests(events: DataFrame) -> DataFrame:
    """(user_id, event_id, release_id) of the released failures in all ``events`` that are there, in order of arrival."""
    spark = events.sparkSession
    folder = shared_folder(spark, "stream")
    _run_batches(events, waiting_retests(folder), folder, "append")
    if latest_version(spark, f"{folder}/found") is None:
        return spark.createDataFrame([], RETEST_SCHEMA)
    found = spark.read.schema(f"{RETEST_SCHEMA}, version long").parquet(f"{folder}/found")
    return found.where("release_id IS NOT NULL").drop("version")


def _run_batches(df: DataFrame, step: Callable[[DataFrame, int], None], folder: str, mode: str) -> None:
    stream = (
        df.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()

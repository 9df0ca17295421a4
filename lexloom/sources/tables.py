"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, directory: str, name: str, *columns: str | Column) -> DataFrame:
    """Table ``name``, only ``columns`` where given; timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(naive) if naive else df


def small_rows(df: DataFrame, most: int) -> list:
    """Rows of a dictionary or configuration table, refused beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} rows can't be held on the driver")
    return rows

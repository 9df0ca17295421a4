"""Layout fragments to lines and entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchored(values: list[float], reach: float) -> list[int]:
    """Cluster numbers of ascending values: a new cluster begins beyond ``reach`` from the first value of the last."""
    out, anchor, number = [], None, -1
    for v in values:
        if anchor is None or v - anchor > reach:
            anchor, number = v, number + 1
        out.append(number)
    return out


def cluster_lines(fragments: DataFrame, keys: list[str], at: str, tie: str, reach: float) -> DataFrame:
    """``fragments`` with the number of the line each belongs to, within ``keys``.

    The rule is anchored at each line's first fragment, so it can't be told from gaps between neighbours alone.
    Keys are of bounded size (a column of a page); rows arrive sorted and are read as a stream, with one anchor kept
    for the key at hand, so not even a large key is held in memory. Rows with a null position get a null line.
    """
    schema = fragments.schema.add("line", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, number = None, None, -1
        for batch in batches:
            lines = []
            for *own, v in batch[[*keys, at]].itertuples(index=False, name=None):
                own = tuple(None if x != x else x for x in own)
                if own != key:
                    key, anchor, number = own, None, -1
                if v is None or v != v:
                    lines.append(None)
                    continue
                if anchor is None or v - anchor > reach:
                    anchor, number = v, number + 1
                lines.append(number)
            yield batch.assign(line=pd.array(lines, dtype="Int32"))

    ordered = fragments.repartition(*keys).sortWithinPartitions(*keys, at, tie)
    return ordered.mapInPandas(run, schema)


def nearest_column(left: str, bases: list[float]):
    """Number of the column base nearest to ``left``; of equal distances the first."""
    distances = F.array(*[F.abs(F.col(left) - F.lit(b)) for b in bases])
    return F.array_position(distances, F.array_min(distances)).cast("int") - 1


def assemble(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Text of each entry: its lines in order, joined by spaces. For entries of bounded length."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])
    return lines.groupBy(*keys).agg(
        F.min(order).alias("first"), F.count("*").alias("n_lines"), F.array_join(parts, " ").alias("text")
    )

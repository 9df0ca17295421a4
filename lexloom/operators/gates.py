"""Data-quality gates: declarative rules, a table of violations, and a fail-closed check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` holds for a row that violates the rule; null counts as not broken."""

    name: str
    broken: Column


class GateError(ValueError):
    """Raised by :func:`require`."""


def violations(df: DataFrame, rules: list[Rule], *columns: str) -> DataFrame:
    """One row (columns, issue) for every broken rule of every row."""
    issues = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
    return df.select(*columns, F.explode(issues).alias("issue"))


def require(broken: DataFrame, shown: int = 20) -> None:
    """Raises with the first ``shown`` violations and the number of the others, if there are any."""
    first = broken.limit(shown).collect()
    if first:
        more = broken.count() - len(first)
        lines = [", ".join(f"{k}={v!r}" for k, v in row.asDict().items()) for row in first]
        raise GateError("\n".join(lines + [f"… and {more} more"] * (more > 0)))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def dependency_broken(df: DataFrame, determinant: str, dependent: str, expected: dict[str, str]) -> DataFrame:
    """Rows whose ``dependent`` isn't what ``determinant`` demands; an unknown determinant demands nothing possible."""
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])[F.col(determinant)]
    return df.withColumn("expected", wanted).where(~F.col(dependent).eqNullSafe(F.col("expected")))


def reference_broken(df: DataFrame, registry: DataFrame, key: str, registry_key: str, agree: list[str]) -> DataFrame:
    """Rows whose key is unknown to the registry or whose attributes disagree with it, with the issue."""
    known = registry.select(F.col(registry_key).alias("_key"), *[F.col(a).alias(f"_{a}") for a in agree])
    joined = df.join(known, F.col(key) == F.col("_key"), "left")
    issue = F.when(F.col("_key").isNull(), F.lit("unknown_id"))
    for a in agree:
        issue = issue.when(~F.col(a).eqNullSafe(F.col(f"_{a}")), F.lit(f"{a}_differs"))
    return joined.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("_key", *[f"_{a}" for a in agree])


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state) of what is expected but missing, and of what is there unexpectedly."""
    a = expected.select(F.col(key)).distinct().withColumn("_e", F.lit(True))
    b = actual.select(F.col(key)).distinct().withColumn("_a", F.lit(True))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where(F.col("state").isNotNull())


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other doesn't have, with their side; empty for equal multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right"))
    )

"""Digests, canonical JSON, and the comparison of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with the keys in order; nulls are written."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns' texts, a null and an empty text told apart."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def sequence_digest(df: DataFrame, keys: list[str], order: str, digest: str, block: int = 10_000) -> DataFrame:
    """(keys, n, digest) over the rows of each key in order.

    A tree of two levels: rows of the same ``block`` numbers of the order are digested together, then the digests of
    a key's blocks, so that a key of very many rows is the work of many tasks.
    """

    def in_order(x: str, by: str) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(by, x))), lambda r: r[x])
        return F.sha2(F.array_join(ordered, ""), 256)

    blocks = df.withColumn("_block", F.floor(F.col(order) / block)).groupBy(*keys, "_block").agg(
        F.count("*").alias("_n"), in_order(digest, order).alias("_digest")
    )
    return blocks.groupBy(*keys).agg(F.sum("_n").alias("n"), in_order("_digest", "_block").alias("sequence_digest"))


def multiset_digest(df: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, n, digest) that doesn't depend on row order: a sum of hash parts, reduced on the map side.

    For keys of any size; equal multisets have equal digests.
    """
    part = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(part(a)).alias(f"part_{i}") for i, a in enumerate((1, 16, 31, 46))]
    )


def diff(old: DataFrame, new: DataFrame, key: str, exact: list[str], tolerant: dict[str, float]) -> DataFrame:
    """(key, state, changed) of every entry that was added, removed, or changed beyond its tolerance.

    Numbers are compared as decimals of their text, so that a tolerance of 0.1 means just that.
    """
    a = old.select(F.col(key), F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in [*exact, *tolerant]])
    b = new.select(F.col(key), F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in [*exact, *tolerant]])
    number = lambda c: F.col(c).cast("string").cast("decimal(28,6)")
    checks = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in exact]
    for c, most in tolerant.items():
        far = F.abs(number(f"a_{c}") - number(f"b_{c}")) > F.lit(str(most)).cast("decimal(28,6)")
        one_null = F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()
        checks.append(F.when(one_null | F.coalesce(far, F.lit(False)), F.lit(c)))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    changed = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.array_compact(F.array(*checks))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        a.join(b, key, "full_outer")
        .select(key, state.alias("state"), changed.alias("fields"))
        .where((F.col("state") != "changed") | (F.size("fields") > 0))
        .select(key, "state", F.array_join("fields", ",").alias("changed"))
    )


def stale(specs: DataFrame, manifest: DataFrame, key: str, binding: str) -> DataFrame:
    """Specifications without an entry of the same binding in the manifest: the work still to do."""
    return specs.join(manifest.select(key, binding), [key, binding], "left_anti")


def insert_if_absent(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return base.unionByName(batch.join(base.select(key).distinct(), key, "left_anti"))


def tree_digest(files: DataFrame, keys: list[str], name: str, digest: str, domain: str) -> DataFrame:
    """(keys, tree_digest) of a folder: SHA-256 over a domain prefix and the files' names and digests in order of name.

    For folders whose listing fits one row.
    """
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct(name, digest))),
        lambda f: F.concat(f[name], F.lit("\0"), f[digest], F.lit("\0")),
    )
    return files.groupBy(*keys).agg(F.sha2(F.concat(F.lit(domain), F.array_join(parts, "")), 256).alias("tree_digest"))

"""Best representative of each duplicate group, field by field.

A record is compared by the set of its usable fields (completeness), its trust and its recency: one that has every
usable field of another, is as trusted and as recent, and better in one of these, dominates it. The records that none
dominates are the skyline, layer 0; layer n + 1 are those dominated by a record of layer n and by none further down.
The lexicographic policy (trust, recency, smallest id) orders the records of a layer, and the survivor takes each
field from the first layer that has a usable value, the first of that layer in the order of the policy. As a record
with fewer fields never dominates one that has a field it lacks, the value taken is the one the policy prefers among all
records with a usable value.

Before any group comes together, the records of one group, set of usable fields and trust are reduced to their best
one, which dominates the others, so that a group holds no more rows than there are sets and trust ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_TRUST = 2**31 - 1


def candidates(
    df: DataFrame, key: str, id_column: str, trust: str, recency: str, usable: dict[str, Column], values: tuple[str, ...] = ()
) -> DataFrame:
    """(key, ok, minus_trust, best, n, first_id): of each set of usable fields and trust the most recent record.

    ``best`` is (recency, minus_id, values): a record that this drops is dominated by the one kept. A record without
    trust comes last, one without date counts as the oldest, a null or unknown condition as unusable. Records with a
    null key form a group of their own; repeated records count towards its size. Extra columns aren't read.
    """
    ok = F.struct(*[F.coalesce(condition, F.lit(False)).alias(f) for f, condition in usable.items()])
    # nulls first in max: a record of unknown date counts as the oldest
    record = F.struct(
        F.col(recency).alias("recency"), (-F.col(id_column)).alias("minus_id"), F.array(*values).cast("array<string>").alias("values")
    )
    return df.groupBy(key, ok.alias("ok"), (-F.coalesce(F.col(trust), F.lit(NO_TRUST))).alias("minus_trust")).agg(
        F.max(record).alias("best"), F.count("*").alias("n"), F.min(id_column).alias("first_id")
    )


def layers(candidate: DataFrame, key: str) -> DataFrame:
    """(key, size, first_id, records): the candidates of each key in the order of the policy, with their layer (depth).

    In that order every record comes after those that dominate it, so one fold gives all layers. The arrays hold at
    most one record for each set of usable fields and trust rank.
    """
    record = F.struct("minus_trust", "best.recency", "best.minus_id", "ok", "best.values")
    grouped = candidate.groupBy(key).agg(
        F.sort_array(F.collect_list(record), asc=False).alias("all"),
        F.sum("n").alias("size"),
        F.min("first_id").alias("first_id"),
    )
    names = candidate.schema["ok"].dataType.names
    kinds = dict(grouped.select(F.explode("all").alias("r")).select("r.*").dtypes)
    kind = ", ".join(f"{c}: {kinds[t]}" for c, t in (("id", "minus_id"), ("recency", "recency"), ("ok", "ok"), ("values", "values")))
    none = F.array().cast(f"array<struct<depth: int, place: int, {kind}>>")

    def dominates(a: Column, r: Column) -> Column:  # a comes before r, so it is as trusted
        newer = F.coalesce(a["recency"] > r["recency"], a["recency"].isNotNull() & r["recency"].isNull())
        same = a["recency"].eqNullSafe(r["recency"]) & (a["id"] <= -r["minus_id"])
        complete = F.lit(True)
        for name in names:
            complete = complete & (a["ok"][name] | ~r["ok"][name])
        return complete & (newer | same)

    def with_layer(done: Column, r: Column) -> Column:
        above = F.array_max(F.transform(F.filter(done, lambda a: dominates(a, r)), lambda a: a["depth"]))
        depth = F.coalesce(above + 1, F.lit(0)).alias("depth")
        new = F.struct(
            depth, F.size(done).alias("place"), (-r["minus_id"]).alias("id"), r["recency"], r["ok"], r["values"]
        ).cast(f"struct<depth: int, place: int, {kind}>")
        return F.concat(done, F.array(new))

    return grouped.select(key, "size", "first_id", F.aggregate("all", none, with_layer).alias("records"))


def survivors(layered: DataFrame, key: str) -> DataFrame:
    """(key, field, size, first_id, id, values): the record whose value of the field survives; id is null if none has one."""
    names = layered.schema["records"].dataType.elementType["ok"].dataType.names

    def chosen(name: str) -> Column:
        able = F.filter("records", lambda r: r["ok"][name])
        first = F.array_min(F.transform(able, lambda r: F.struct(r["depth"], r["place"], r["id"], r["values"])))
        return F.struct(F.lit(name).alias("field"), first["id"].alias("id"), first["values"].alias("values"))

    fields = F.explode(F.array(*[chosen(n) for n in names])).alias("f")
    return layered.select(key, "size", "first_id", fields).select(key, "f.field", "size", "first_id", "f.id", "f.values")

"""Duplicates hidden by formatting: collapse, count, and list.

Byte-identical rows collapse first, with counts, before anything is canonicalised; only the distinct survivors get a
canonical text, and are then grouped again on that full text, summing the counts. No pairs are made for collapsing;
where all pairs are asked for, large groups are cut into blocks and pairs of blocks meet in separate tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.unicode import letters_digits_key

#: Rows of a group that one task pairs with as many others at most.
BLOCK = 256


def canonical_key(fields: list[str]):
    """Full canonical text of a record: letters and digits of each field, in sorted order of the fields' texts."""
    return F.concat_ws("\x1f", F.array_sort(F.array(*[letters_digits_key(f) for f in fields])))


def _distinct_rows(df: DataFrame, fields: list[str], *aggregates) -> DataFrame:
    complete = df
    for f in fields:
        complete = complete.where(F.col(f).isNotNull())
    return complete.groupBy(*fields).agg(*aggregates)


def classes(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """One row for each distinct formatting: the fields, canonical text, and number of byte-identical rows."""
    distinct = _distinct_rows(
        df.select(id_column, *fields), fields, F.count("*").alias("copies"), F.min(id_column).alias("first_id")
    )
    return distinct.withColumn("canonical", canonical_key(fields))


def collapse(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """One record for each canonical text: its smallest id and fields, and how many rows and formattings it had.

    Rows with a null in ``fields`` have no canonical text and stand each for itself (one row, one copy). Texts
    without any letter or digit are equal to each other, field by field.
    """
    survivors = classes(df, id_column, fields)
    joined = (
        survivors.groupBy("canonical")
        .agg(
            F.min(F.struct(F.col("first_id"), *fields)).alias("kept"),
            F.sum("copies").alias("n_copies"),
            F.count("*").alias("n_forms"),
        )
        .select(
            F.col("kept.first_id").alias(id_column),
            *[F.col(f"kept.{f}").alias(f) for f in fields],
            "n_copies",
            "n_forms",
        )
    )
    nulls = F.lit(False)
    for f in fields:
        nulls = nulls | F.col(f).isNull()
    alone = df.where(nulls).select(
        id_column, *fields, F.lit(1).cast("long").alias("n_copies"), F.lit(1).cast("long").alias("n_forms")
    )
    return joined.unionByName(alone)


def members(df: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """(class id, id, size) of every row that has copies; the class id is the smallest id of the class.

    Rows with a null in ``fields`` have no canonical text and so no copies; a repeated row is a member each time.
    """
    forms = _distinct_rows(
        df.select(id_column, *fields), fields, F.count("*").alias("copies"), F.min(id_column).alias("first_id")
    ).withColumn("canonical", canonical_key(fields))
    sized = forms.groupBy("canonical").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("size")).where(
        "size > 1"
    )
    form_class = forms.select(*fields, "canonical").join(sized, "canonical").select(*fields, "class_id", "size")
    return df.select(id_column, *fields).join(form_class, fields).select("class_id", id_column, "size")


def all_pairs(member: DataFrame, id_column: str) -> DataFrame:
    """Every pair of rows of one class as (a, b), a < b.

    A row repeated with the same id is no pair with itself. A class of n rows is cut by hash into ceil(n / BLOCK) blocks; a row goes to one copy for each block it has to
    meet, so a task never holds more than about 2 * BLOCK rows of a class, however large the class is.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(id_column), blocks).cast("int")
    rows = member.select("class_id", F.col(id_column).alias("id"), blocks.alias("n"), own.alias("block"))
    # the meeting of blocks i <= j is the key (i, j)
    meets = rows.select(
        "class_id", "id", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    ).select(
        "class_id", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    a = meets.select("class_id", "i", "j", F.col("id").alias("row_id_a"), F.col("block").alias("block_a"))
    b = meets.select("class_id", "i", "j", F.col("id").alias("row_id_b"), F.col("block").alias("block_b"))
    return (
        a.join(b, ["class_id", "i", "j"])
        .where(F.col("row_id_a") < F.col("row_id_b"))
        .where((F.col("i") == F.col("j")) | (F.col("block_a") != F.col("block_b")))
        .select("row_id_a", "row_id_b")
    )

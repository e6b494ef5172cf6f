"""Unions, differences and de-duplication where it matters which row stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rank import first_per_group


def first_wins(df: DataFrame, keys: Sequence[str], sequence: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``sequence``; null is a key like others."""
    return first_per_group(df, keys, list(sequence))


def union_first_wins(parts: Sequence[DataFrame], key: str, sequence: Column) -> DataFrame:
    """Union of tables with the same columns; of rows with one key that of the earliest table, and of its
    first in ``sequence``, stays. ``source`` is the table's position."""
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("source", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return first_per_group(out, [key], [F.col("source"), sequence])


def disjoint_union(base: DataFrame, extension: DataFrame, key: str) -> DataFrame:
    """Union of two tables whose keys must not meet; an error (when it runs) where they do."""
    both = base.select(key).where(F.col(key).isNotNull()).intersect(extension.select(key)).withColumn("__both", F.lit(True))
    checked = extension.join(both, key, "left")
    message = F.concat(F.lit(f"{key} is in both tables: "), F.col(key).cast("string"))
    ok = checked.where(F.when(F.col("__both"), F.raise_error(message)).otherwise(F.lit(True))).drop("__both")
    return base.unionByName(ok.select(*base.columns))


def verdict_changes(previous: DataFrame, current: DataFrame, key: str, verdict: str) -> DataFrame:
    """Keys whose verdict is ``gained``, ``lost`` or ``changed`` between two tables of one row a key."""
    a, b = previous.select(key, F.col(verdict).alias("before")), current.select(key, F.col(verdict).alias("after"))
    joined = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("__a").isNull(), "gained").when(F.col("__b").isNull(), "lost").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "before", "after", "kind")


def missing_rows(expected: DataFrame, present: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """``present`` and, for each expected key it lacks, a row with ``columns`` (others null)."""
    absent = expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")
    return present.unionByName(absent.select(key, *[c.alias(n) for n, c in columns.items()]), allowMissingColumns=True)

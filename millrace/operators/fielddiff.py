"""Field-level differences between two states of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregate import ratio


def _long(df: DataFrame, key: str, fields: Sequence[str], name: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
    return df.select(key, F.explode(cells).alias("x")).select(key, "x.field", f"x.{name}")


def field_changes(previous: DataFrame, current: DataFrame, key: str, fields: Sequence[str], status: str | None = None, transient: Sequence[str] = ()) -> DataFrame:
    """``key, field, old_value, new_value`` where a field of an entity in both states differs (null is a
    value of its own). Entities whose current ``status`` is transient are passed over: a failed look
    says nothing about what changed. One join on the key, then an unpivot within the row."""
    a = previous.select(key, F.struct(*fields).alias("__old"))
    if status:
        current = current.where(~F.coalesce(F.col(status).isin(*transient), F.lit(False)))
    b = current.select(key, F.struct(*fields).alias("__new"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__old.{f}").cast("string").alias("old_value"), F.col(f"__new.{f}").cast("string").alias("new_value")) for f in fields])
    changed = F.filter(cells, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    return a.join(b, key).select(key, F.explode(changed).alias("c")).select(key, "c.field", "c.old_value", "c.new_value")


def replay_scores(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: expected, observed and common changes, precision and recall (null of nothing)."""
    e = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    o = observed.select(*keys).distinct().withColumn("o", F.lit(1))
    both = e.join(o, list(keys), "full_outer").agg(F.count("e").alias("expected"), F.count("o").alias("observed"), F.count_if(F.expr("e = 1 AND o = 1")).alias("common"))
    return both.select("*", ratio(F.col("common"), F.col("observed")).alias("precision"), ratio(F.col("common"), F.col("expected")).alias("recall"))


def unpivot(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, value`` of all fields, values as text."""
    return _long(df, key, fields, "value")

"""Writers. A write is atomic by the committer; state is written to versioned paths, never in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_json_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", compression or "none").json(path)


def append_shards(df: DataFrame, path: str, rows_per_file: int = 250) -> None:
    """Append gzip JSON shards of at most ``rows_per_file`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").json(path)


def write_worksheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def merge_worksheet(rows: DataFrame, labels: DataFrame, key: str, label: str, order: str, allowed: list[str]) -> DataFrame:
    """``rows`` with the latest valid label of each key. A label outside ``allowed`` is an error (when it
    runs); blank ones are passed over."""
    given = labels.where(F.trim(F.coalesce(F.col(label), F.lit(""))) != "")
    checked = given.where(F.when(F.col(label).isin(*allowed), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col(label)))))
    latest = checked.groupBy(key).agg(F.max(F.struct(F.col(order), F.col(label)))[label].alias(label))
    return rows.drop(label).join(latest, key, "left")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite the partitions that ``df`` has rows for, and no others: a day written twice is there once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def insert_absent(df: DataFrame, present: DataFrame, key: str, path: str) -> None:
    """Append rows whose key is not there yet, the first of each key."""
    order = Window.partitionBy(key).orderBy(*[c for c in df.columns if c != key])
    first = df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    first.join(present.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)


def capped_history(df: DataFrame, owner: str, at: str, key: str, most: int = 100) -> DataFrame:
    """The newest ``most`` rows of each owner."""
    order = Window.partitionBy(owner).orderBy(F.desc_nulls_last(at), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")

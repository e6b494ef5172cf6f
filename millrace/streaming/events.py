"""Event-time operators that run on a stream and on a table alike, and ways to run them to the end.

The reference model has no stream engine; windows and watermarks are an addition. State that the batch
operators keep in tables (ledgers, newest states) is kept here by ``foreachBatch`` over the same
functions, so that replayed batches change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.state import ledger, merge_ledgers
from millrace.session import ensure_checkpoint_dir


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by window of ``width`` and keys: ``start`` and ``end`` of the window, keys, aggregates.
    ``late`` is the watermark (streams need one to close windows); null times belong to no window."""
    source = events.withWatermark(at, late) if late else events
    grouped = source.where(F.col(at).isNotNull()).groupBy(F.window(at, width), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sliding(events: DataFrame, at: str, width: str, step: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    source = events.withWatermark(at, late) if late else events
    grouped = source.where(F.col(at).isNotNull()).groupBy(F.window(at, width, step), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by session: events of the same keys less than ``gap`` apart."""
    source = events.withWatermark(at, late) if late else events
    grouped = source.where(F.col(at).isNotNull()).groupBy(F.session_window(at, gap), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggregates)


def deduplicated(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first arrival of each key within the watermark; on a table, one row a key and time."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates([*keys, at])


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, append mode, and return what it wrote. Output and checkpoint
    lie in the shared checkpoint folder."""
    spark = stream.sparkSession
    at = _folder(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def for_each_batch(stream: DataFrame, name: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """Fold the batches of a stream into one table: ``fold(state so far, batch)``. Every batch writes a
    new version of the state, and a replayed batch starts from the version before it."""
    spark = stream.sparkSession
    at = _folder(spark, name)
    versions: dict[int, str] = {}

    def step(batch: DataFrame, number: int) -> None:
        before = versions.get(max((n for n in versions if n < number), default=-1))
        state = fold(spark.read.parquet(before) if before else None, batch)
        versions[number] = f"{at}/v{number}"
        state.write.mode("overwrite").parquet(versions[number])

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not versions:
        return fold(None, spark.createDataFrame([], stream.schema))
    return spark.read.parquet(versions[max(versions)])


def stream_ledger(stream: DataFrame, key: str, at: str, decision: str) -> DataFrame:
    """The ledger of a stream, kept batch by batch."""
    return for_each_batch(stream, "ledger", lambda state, batch: (lambda new: merge_ledgers(state, new, key) if state is not None else new)(ledger(batch, key, at, decision)))

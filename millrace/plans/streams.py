"""Queries over the event stream: windows and sessions, on the table and as streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import read_table
from millrace.streaming import events as streams

def _aggregates() -> dict:
    return {"n": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}


def event_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return streams.tumbling(read_table(spark, folder, "events"), "ts", "1 hour", ["event_type"], _aggregates())


def event_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return streams.sliding(read_table(spark, folder, "events"), "ts", "2 hours", "1 hour", [], _aggregates())


def event_session(spark: SparkSession, folder: str) -> DataFrame:
    return streams.sessions(read_table(spark, folder, "events"), "ts", "6 hours", ["user_id"], _aggregates())


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read_table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/event[s].parquet")


def stream_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger kept batch by batch from a stream equals that of the table."""
    return streams.stream_ledger(_stream(spark, folder), "user_id", "ts", "event_type")


def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type after duplicates within the watermark are dropped from the stream."""
    stream = _stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants
    once = streams.run_to_end(streams.deduplicated(stream, ["event_id"], "ts", "1 day"), "deduplicated")
    return once.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (event_tumbling, event_sliding, event_session, stream_ledger, stream_deduplicated)}
_TOTAL = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total"
ORACLE = {
    "event_tumbling": f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, {_TOTAL} FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3""",
    "event_sliding": f"""SELECT s AS start, s + INTERVAL 2 HOUR AS "end", count(*) AS n, {_TOTAL} FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2""",
    "event_session": f"""SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, {_TOTAL} FROM (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new_ FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, k""",
    "stream_ledger": "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, ts) AS decision, count(*) AS n_events FROM events GROUP BY 1",
    "stream_deduplicated": "SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2",
}

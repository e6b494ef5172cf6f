"""Keyed state kept in tables: ledgers, upserts, retention, newest states, resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ledger(events: DataFrame, key: str, at: str, decision: str) -> DataFrame:
    """``first_seen``, ``last_seen``, the latest ``decision`` (of equal times the larger) and the number of
    events by key. Grouped maxima only: state of any size merges by the same expression."""
    return events.groupBy(key).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max(F.struct(F.col(at), F.col(decision)))[decision].alias("decision"), F.count("*").alias("n_events")
    )


def merge_ledgers(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two ledgers as one: what one ledger over the events of both would be."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max(F.struct("last_seen", "decision"))["decision"].alias("decision"), F.sum("n_events").alias("n_events")
    )


def to_skip(state: DataFrame, as_of: Column, days: int, negative: Sequence[str]) -> DataFrame:
    """Keys with a negative decision that is younger than ``days``: not worth another look yet."""
    return state.where(F.col("decision").isin(*negative) & (F.col("last_seen") > as_of - F.make_dt_interval(F.lit(days))))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: Sequence[str] = ()) -> DataFrame:
    """``old`` with rows of ``new`` (one a key) added or put in place. A null new value of a ``keep_old``
    column leaves the old one. To be written to a new path or version: plain files have no MERGE."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("__old"))
    b = new.select(key, F.struct(*columns).alias("__new"))
    pick = lambda c: F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}")) if c in keep_old else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return a.join(b, key, "full_outer").select(key, *[pick(c).alias(c) for c in columns])


def expired(df: DataFrame, at: str, kind: str, policy: dict[str, int], default_days: int, as_of: Column) -> Column:
    """Whether a row's time plus the days its kind may be kept is past; false for a null time."""
    days = F.lit(default_days)
    for name, n in policy.items():
        days = F.when(F.col(kind) == name, F.lit(n)).otherwise(days)
    return F.coalesce(F.col(at) + F.make_dt_interval(days) <= as_of, F.lit(False))


def newest_state(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """The newest state of each key; replayed events change nothing."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(at), F.col(state))).alias("__s")).select(key, F.col(f"__s.{state}").alias(state), F.col(f"__s.{at}").alias(at))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: keys of ``work`` not in ``done``."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def freshness(written_at: Column, as_of: Column, warn_days: int = 7, stale_days: int = 14) -> Column:
    """``fresh``, ``warn``, ``stale``, or ``unusable`` for a null or future time."""
    days = F.datediff(as_of, written_at)
    return F.when(written_at.isNull() | (days < 0), "unusable").when(days > stale_days, "stale").when(days > warn_days, "warn").otherwise("fresh")


def merged_fields(profiles: DataFrame, events: DataFrame, key: str, at: str, fields: Sequence[str]) -> DataFrame:
    """``profiles`` (one row a key) with each of ``fields`` from the latest event that has it: a null in a later
    event takes nothing away, and a field without events stays. Of events at one time the larger value counts.
    Keys that only events have become rows. Events fold map-side, whatever their number."""
    order = lambda f: F.struct(F.col(at), F.col(f))
    latest = events.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.when(F.col(f).isNotNull(), order(f)))[f].alias(f"__{f}") for f in fields], F.count("*").alias("n_events"))
    joined = profiles.where(F.col(key).isNotNull()).join(latest, key, "full_outer")
    others = [c for c in profiles.columns if c != key and c not in fields]
    return joined.select(key, *[F.coalesce(F.col(f"__{f}"), F.col(f)).alias(f) for f in fields], *others, F.coalesce("n_events", F.lit(0)).alias("n_events"))


def after_cursor(events: DataFrame, cursor: DataFrame, key: str, at: str) -> DataFrame:
    """Events newer than their key's ``cursor`` (a table ``key, at``, one row a key); of a key without a cursor,
    or with a null one, all. Events without a time are never new."""
    marks = cursor.select(key, F.col(at).alias("__mark"))
    joined = events.where(F.col(at).isNotNull()).join(marks, key, "left")
    return joined.where(F.col("__mark").isNull() | (F.col(at) > F.col("__mark"))).drop("__mark")


def advanced(cursor: DataFrame, events: DataFrame, key: str, at: str) -> DataFrame:
    """The cursor after ``events`` were taken: the latest time of each key in either."""
    return cursor.select(key, at).unionByName(events.select(key, at)).where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias(at))

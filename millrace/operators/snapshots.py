"""What changed between full snapshots.

``EXCEPT ALL`` in both directions removes the rows that two consecutive snapshots share; a full join
of the two residues by key labels what is left: only in the later snapshot ``added``, only in the
earlier ``removed``, in both ``changed``. Both directions come from one signed multiset count: a row
of the later snapshot counts 1, one of the earlier -1; what is above zero is left of the later rows
without the earlier, what is below of the earlier without the later. Rows carry a digest of their
content, so that what is shuffled is a key, a date and 16 bytes however wide the table is, and all
pairs of snapshots are compared in one pass. Rows are dealt out by key and snapshot once, and the
counts and the join stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_versions(df: DataFrame, key: Column, snapshot: Column, version: Column, content: Column) -> DataFrame:
    """One row ``(key, snapshot, digest)`` for each key and snapshot: that of the latest ``version``.

    Superseded and repeated rows fold away map-side (a maximum, no window). Equal versions with
    different content: the larger digest, so that the result never depends on the order of rows. A null
    version counts as the earliest. Rows whose key or snapshot is null belong to nothing and are left
    out; null content is a content of its own."""
    picked = df.select(key.alias("key"), snapshot.alias("snapshot"), F.struct(version.alias("version"), F.unhex(F.md5(F.coalesce(content, F.lit("\0null")).cast("binary"))).alias("digest")).alias("row"))
    picked = picked.where(F.col("key").isNotNull() & F.col("snapshot").isNotNull())
    return picked.groupBy("key", "snapshot").agg(F.max("row").alias("row")).select("key", "snapshot", F.col("row.digest").alias("digest"))


def residues(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two ``EXCEPT ALL`` of ``signed(key, snapshot, digest, sign)``, as distinct ``key, snapshot``: of
    the rows with sign 1 without those with sign -1, and the other way round."""
    dealt = signed.repartition("key", "snapshot")
    counts = dealt.groupBy("key", "snapshot", "digest").agg(F.sum("sign").alias("n"))
    left = lambda test: counts.where(test).select("key", "snapshot").distinct()
    return left("n > 0"), left("n < 0")


def changes(rows: DataFrame, dates: DataFrame | None = None, most_snapshots: int = 10_000) -> DataFrame:
    """``(key, snapshot, change_kind)`` of ``rows(key, snapshot, digest)``, for each pair of consecutive
    snapshots; ``snapshot`` is the later of the two. A key has one row for a snapshot at most.

    An empty table, or one with a single snapshot, gives no rows. The list of snapshot dates is read by
    the driver, from the only column of ``dates`` if given (a scan of the raw column is cheaper than one
    of ``rows``): it grows with deliveries, not with rows; more than ``most_snapshots`` is an error."""
    column = (dates if dates is not None else rows.select("snapshot")).toDF("snapshot").where("snapshot IS NOT NULL")
    found = [r[0] for r in column.distinct().orderBy("snapshot").limit(most_snapshots + 1).collect()]
    if len(found) > most_snapshots:
        raise ValueError(f"more than {most_snapshots} snapshots: compare them in ranges of dates")
    kind = rows.schema["snapshot"].dataType
    if len(found) < 2:
        return rows.select("key", "snapshot", F.lit("").alias("change_kind")).where(F.lit(False))
    lit = lambda d: F.lit(d).cast(kind)
    following = F.create_map(*[x for a, b in zip(found, found[1:], strict=False) for x in (lit(a), lit(b))])
    snapshot = F.col("snapshot")
    later = F.struct(F.when(snapshot != lit(found[0]), snapshot).alias("snapshot"), F.lit(1).alias("sign"))
    earlier = F.struct(following[snapshot].alias("snapshot"), F.lit(-1).alias("sign"))
    signed = rows.select("key", "digest", F.inline(F.array(later, earlier))).where("snapshot IS NOT NULL")
    new, old = residues(signed)
    both = new.withColumn("is_new", F.lit(True)).join(old.withColumn("is_old", F.lit(True)), ["key", "snapshot"], "full_outer")
    label = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").otherwise("changed")
    return both.select("key", "snapshot", label.alias("change_kind"))

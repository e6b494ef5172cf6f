"""Ranking, limits, samples and quotas. Every order is total: a key breaks ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import seeded_rank


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group. Spark prunes each task's rows to ``n`` a group before it
    shuffles them, so a hot group costs no more than others."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (newest first), kept whole."""
    return first_per_group(df, keys, order)


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows with the smallest seeded hashes of their key: a top-k, no sort of all rows."""
    return df.withColumn("sample_rank", seeded_rank(seed, F.col(key), ":")).orderBy("sample_rank", key).limit(n)


def distinct_group_sample(df: DataFrame, key: str, group: str, n: int, seed: str, excluded: DataFrame | None = None) -> DataFrame:
    """As ``hash_sample``, at most one row of a group and none of a group in ``excluded``."""
    ranked = df.where(F.col(group).isNotNull()).withColumn("sample_rank", seeded_rank(seed, F.col(key), ":"))
    if excluded is not None:
        ranked = ranked.join(excluded.select(group).distinct(), group, "left_anti")
    return first_per_group(ranked, [group], [F.col("sample_rank"), F.col(key)]).orderBy("sample_rank", key).limit(n)


def hash_places(df: DataFrame, groups: Sequence[str], key: str, seed: str, separator: str, slices: int = 256) -> DataFrame:
    """``df`` with ``place`` (from 0) within its group in seeded hash order, and ``population_n``.

    The hash's first digits cut each group into ``slices`` of about the same size; a slice is ranked by
    itself and shifted by the counts of those before it. However large a group is, no task ranks more
    than its share."""
    named = df.withColumn("__hash", seeded_rank(seed, F.col(key), separator))
    named = named.withColumn("__slice", F.floor(F.conv(F.substring("__hash", 1, 4), 16, 10).cast("int") * slices / 65536).cast("int"))
    counts = named.groupBy(*groups, "__slice").agg(F.count("*").alias("__in"))
    by = Window.partitionBy(*groups)
    before = F.sum("__in").over(by.orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__in")
    tagged = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    counts = counts.select(*tagged, F.col("__slice").alias("__s"), before.alias("__before"), F.sum("__in").over(by).alias("population_n"))
    same = F.col("__slice") == F.col("__s")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = F.row_number().over(Window.partitionBy(*groups, "__slice").orderBy("__hash", key))
    placed = named.join(counts, same).withColumn("place", F.col("__before") + within - 1)
    return placed.drop("__hash", "__slice", "__s", "__before", *[f"__g{i}" for i in range(len(groups))])


def split_assignment(df: DataFrame, stratum: str, key: str, seed: str, shares: dict[str, float]) -> DataFrame:
    """``place`` within the stratum by seeded hash, ``population_n``, and the ``split`` whose cumulative
    share (rounded half to even) first exceeds the place."""
    out = hash_places(df, [stratum], key, seed, "|")
    total, label = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        total += shares[name]
        test = F.col("place") < F.bround(F.lit(round(total, 9)) * F.col("population_n"))
        label = F.when(test, name) if label is None else label.when(test, name)
    return out.withColumn("split", F.lit(names[-1]) if label is None else label.otherwise(names[-1]))


def largest_remainder(sizes: DataFrame, group: str, size: str, limit: int) -> DataFrame:
    """Proportional quotas that add up to ``limit``: floors first, then one more for the largest
    fractions, ties by key, never above the size. ``sizes`` is a small table, a row a group."""
    total = Window.partitionBy()
    exact = F.col(size) * F.lit(limit) / F.sum(size).over(total)
    base = sizes.withColumn("quota", F.least(F.col(size), F.floor(exact))).withColumn("__fraction", exact - F.floor(exact))
    left = F.lit(limit) - F.sum("quota").over(total)
    place = F.row_number().over(Window.orderBy(F.desc("__fraction"), group))
    more = (place <= left) & (F.col("quota") < F.col(size))
    return base.withColumn("quota", F.col("quota") + more.cast("int")).select(group, size, "quota")


def stratified_sample(df: DataFrame, stratum: str, key: str, limit: int, seed: str) -> DataFrame:
    """Rows by largest-remainder quota of their stratum, in seeded hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    quotas = largest_remainder(sizes, stratum, "size", limit).select(F.col(stratum).alias("__q"), "quota")
    placed = hash_places(df, [stratum], key, seed, ":").join(quotas, F.col(stratum).eqNullSafe(F.col("__q")))
    return placed.where(F.col("place") < F.col("quota")).drop("__q", "quota", "place", "population_n")


def round_robin(df: DataFrame, groups: Sequence[str], key: str, limit: int, seed: str) -> DataFrame:
    """Up to ``limit`` rows, one of each group in turn (``turn`` from 1), in seeded hash order within a
    group. No group gives more than ``limit`` rows, so each is pruned to that before it is shuffled."""
    hashed = df.withColumn("__hash", seeded_rank(seed, F.col(key), ":"))
    turn = F.row_number().over(Window.partitionBy(*groups).orderBy("__hash", key))
    return hashed.withColumn("turn", turn).where(F.col("turn") <= limit).drop("__hash").orderBy("turn", *groups, key).limit(limit)


def best_unless_tied(df: DataFrame, key: str, score: str, tie_break: str) -> DataFrame:
    """The best row of each key with ``ambiguous`` where the two best scores are equal."""
    order = [F.desc_nulls_last(score), F.col(tie_break)]
    two = first_per_group(df, [key], order, 2)
    by = Window.partitionBy(key).orderBy(*order)
    ranked = two.withColumn("__r", F.row_number().over(by)).withColumn("__next", F.lead(score).over(by))
    return ranked.where("__r = 1").withColumn("ambiguous", F.coalesce(F.col("__next") == F.col(score), F.lit(False))).drop("__r", "__next")


def none_above_cap(df: DataFrame, keys: Sequence[str], flag: str, cap: int) -> DataFrame:
    """``flag`` switched off for groups with more than ``cap`` flagged rows (a null flag is off). Groups are
    counted apart and the few above the cap joined back: a hot group is no window partition."""
    on = F.coalesce(F.col(flag), F.lit(False))
    counted = df.where(on).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > cap)
    over = counted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(True).alias("__over"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = df.join(over, same, "left").withColumn(flag, on & F.col("__over").isNull())
    return joined.drop("__over", *[f"__k{i}" for i in range(len(keys))])


def change_from_previous(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``previous``, ``delta`` and ``percent`` (of the previous absolute value, two places; null for 0). One
    row for each ``key`` and ``order``, such as a year: aggregated before, a key's rows are few however many
    events it has."""
    previous = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    out = df.withColumn("previous", previous)
    delta = F.col(value) - F.col("previous")
    return out.withColumn("delta", F.round(delta, 2)).withColumn("percent", F.round(F.try_divide(100 * delta, F.abs(F.col("previous"))), 2))


def priority_sample(df: DataFrame, priority: str, key: str, limit: int, seed: str) -> DataFrame:
    """Rows by priority (higher first, null last), in seeded hash order within one; a top-k."""
    hashed = df.withColumn("__hash", seeded_rank(seed, F.col(key), ":"))
    return hashed.orderBy(F.desc_nulls_last(priority), "__hash", key).limit(limit).drop("__hash")


def filled_sample(df: DataFrame, stratum: str, key: str, limit: int, seed: str) -> DataFrame:
    """Floors of proportional quotas by stratum in seeded hash order, the rest filled from all others in
    another hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__size"))
    total = Window.partitionBy()
    quotas = sizes.select(F.col(stratum).alias("__q"), F.floor(F.col("__size") * limit / F.sum("__size").over(total)).alias("__quota"))
    placed = hash_places(df, [stratum], key, seed, ":").join(quotas, F.col(stratum).eqNullSafe(F.col("__q")))
    chosen = placed.withColumn("__first", F.col("place") < F.col("__quota")).drop("__q", "__quota", "place", "population_n")
    order = [F.desc("__first"), seeded_rank(seed + ":rest", F.col(key), ":"), F.col(key)]
    return chosen.orderBy(*order).limit(limit).drop("__first")

"""Aggregations: counters, percentile rules, ratios, agreement and recall measures.

All are plain grouped aggregates with map-side partial sums. Empty inputs and null values have stated
results; ratios of nothing are null unless ``zero`` is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(part: Column, whole: Column, zero: bool = False, places: int = 4) -> Column:
    """``part`` over ``whole`` to ``places``; null for an empty whole, or 0 with ``zero``."""
    value = F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)
    return F.coalesce(value, F.lit(0.0)) if zero else value


def counters(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key; null is a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def counter_map(df: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """One row: the counter as JSON text with sorted keys (nulls under ``null``). For closed sets of keys:
    more than ``most`` are an error (when it runs), and no more than that come together in one task."""
    counted = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k")).agg(F.count("*").alias("n")).limit(most + 1)
    text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))))
    return counted.agg(F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} values of {key}: keep the counter in rows"))).otherwise(text).alias("counts"))


def nearest_rank(q: float, n: str = "n") -> Column:
    """Place (from 0) of the rule ``max(1, ceil(q*n))``, for ``value_at_place``."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q} is not within 0 and 1")
    return F.greatest(F.lit(1), F.ceil(F.col(n) * F.lit(q))) - 1


def value_at_place(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Column], n: str = "n", ranges: int = 64) -> DataFrame:
    """For each key the values at zero-based ``places`` (expressions over the count ``n``) of its sorted
    non-null numeric values.

    Equal values are counted together first. The counts are cut into ``ranges`` of values (at approximate
    quantiles of all values, a scalar subquery of so many numbers), each range of each group is ranked by
    itself and shifted by what lies below: a group with a third of all rows is ranked by many tasks."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__same"))
    parts = [F.lit(i / ranges) for i in range(1, ranges)]
    bounds = df.select(F.percentile_approx(F.col(value).cast("double"), F.array(*parts), 4 * ranges)).scalar()
    counted = counted.withColumn("__cut", F.coalesce(bounds, F.array().cast("array<double>")))
    counted = counted.withColumn("__range", F.size(F.filter("__cut", lambda b: b < F.col(value)))).drop("__cut")
    sums = counted.groupBy(*keys, "__range").agg(F.sum("__same").alias("__in"))
    by = Window.partitionBy(*keys)
    below = F.sum("__in").over(by.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__in")
    sums = sums.select(*keys, "__range", below.alias("__below"), F.sum("__in").over(by).alias(n))
    tagged = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    sums = sums.select(*tagged, F.col("__range").alias("__r"), "__below", n)
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.join(sums, same).withColumn("__upto", F.col("__below") + F.sum("__same").over(within))
    hits = [F.min(F.when(F.col("__upto") > place, F.col(value))).alias(name) for name, place in places.items()]
    return placed.groupBy(*keys, n).agg(*hits)


def lower_index(q: float, n: str = "n") -> Column:
    """Place of the rule ``sorted[int((n-1)*q)]``."""
    return F.floor((F.col(n) - 1) * F.lit(q))


def clamped_index(q: float, n: str = "n") -> Column:
    """Place of the rule ``sorted[min(n-1, int(n*q))]``."""
    return F.least(F.col(n) - 1, F.floor(F.col(n) * F.lit(q)))


def wilson_lower(successes: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval to four places; null for an empty total."""
    n, p = total.cast("double"), successes.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    zz = z * z
    bound = (p + zz / (2 * n) - z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)
    return F.when(total > 0, F.round(bound, 4))


def cohen_kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement beyond chance of two labels: ``n, kappa``. 1.0 where chance agrees always, null for no
    rows; rows with a null label are left out. One pass makes the confusion counts, the rest is over those."""
    pairs = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    cells = pairs.groupBy(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b")).agg(F.count("*").alias("c"))
    none = F.lit(0).cast("bigint")
    as_first = F.struct(F.col("a").alias("label"), F.col("c").alias("x"), none.alias("y"), F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(none).alias("same"))
    as_second = F.struct(F.col("b").alias("label"), none.alias("x"), F.col("c").alias("y"), none.alias("same"))
    labels = cells.select(F.explode(F.array(as_first, as_second)).alias("s")).groupBy("s.label").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"), F.sum("s.same").alias("same"))
    sums = labels.agg(F.coalesce(F.sum("x"), none).alias("n"), F.sum("same").alias("same"), F.sum(F.col("x").cast("double") * F.col("y")).alias("both"))
    total = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    po, pe = F.col("same") / total, F.col("both") / (total * total)
    return sums.select("n", F.when(F.col("n") > 0, F.when(pe == 1, 1.0).otherwise(F.round(F.try_divide(po - pe, 1 - pe), 4))).alias("kappa"))


def class_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1`` of each label, to four places; 0 where nothing was predicted or
    is gold. Rows with a null label are left out."""
    both = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    cells = both.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("g").alias("label"), F.col("c").alias("gold"), F.lit(0).cast("bigint").alias("pred"), F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("gold"), F.col("c").alias("pred"), F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("s")
    )
    sums = sides.groupBy("s.label").agg(F.sum("s.gold").alias("gold"), F.sum("s.pred").alias("pred"), F.sum("s.hit").alias("hit"))
    return sums.select("label", ratio(F.col("hit"), F.col("pred"), zero=True).alias("precision"), ratio(F.col("hit"), F.col("gold"), zero=True).alias("recall"), ratio(2 * F.col("hit"), F.col("gold") + F.col("pred"), zero=True).alias("f1"))


def weighted_confusion(df: DataFrame, stratum: str, population: str, kind: Column) -> DataFrame:
    """Weights N/n of each stratum (its population over its rows) and sums of them by ``kind``. Rows are
    counted by stratum and kind before anything else."""
    cells = df.groupBy(stratum, population, kind.alias("kind")).agg(F.count("*").alias("c"))
    weight = (F.col(population) / F.sum("c").over(Window.partitionBy(stratum))).cast("decimal(20,6)")
    weighted = cells.select("kind", "c", (weight * F.col("c")).alias("w"))
    return weighted.groupBy("kind").agg(F.sum("c").alias("n"), F.round(F.sum("w"), 4).cast("double").alias("weight"))


def recall_at(df: DataFrame, query: str, rank: str, hit: Column, ks: Sequence[int]) -> DataFrame:
    """Share of queries with a hit among their first ``k`` results, for each ``k``."""
    best = df.groupBy(query).agg(F.min(F.when(hit, F.col(rank))).alias("best"))
    return best.agg(F.count("*").alias("n_queries"), *[ratio(F.count_if(F.col("best") <= k), F.count("*")).alias(f"recall_at_{k}") for k in ks])


def pool_recall(pool: DataFrame, found: DataFrame, kind: str, entity: str, fact: str) -> DataFrame:
    """For each kind of fact: 0.7 times the share of pool entities plus 0.3 times the share of pool facts
    that ``found`` has, to six places. Facts are distinct rows; nulls are left out."""
    cols = [kind, entity, fact]
    p, f = (d.select(*cols).na.drop().distinct() for d in (pool, found))
    joined = p.join(f.withColumn("hit", F.lit(True)), cols, "left")
    per = joined.groupBy(kind, entity).agg(F.count("*").alias("facts"), F.count_if("hit").alias("hits"))
    score = 0.7 * F.sum((F.col("hits") > 0).cast("int")) / F.count("*") + 0.3 * F.sum("hits") / F.sum("facts")
    return per.groupBy(kind).agg(F.count("*").alias("entities"), F.sum("facts").alias("facts"), F.round(score, 6).alias("recall"))


def digest(df: DataFrame, key: str) -> DataFrame:
    """``n`` and one SHA-256 over all non-null keys, whatever their order: it covers their number and the
    sums of the four quarters of their hashes, so that every task sends a few numbers."""
    sha = F.sha2(F.col(key).cast("string"), 256)
    quarter = lambda i: F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(quarter(i)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)])
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("sha256"))

"""Joins that carry a rule: lookups, strict pairs, references, re-keying, shared keys, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attach_list(left: DataFrame, right: DataFrame, key: str, name: str, element: Column, order: Column, most: int = 100_000) -> DataFrame:
    """``left`` with the sorted list of its matches' ``element`` values; an empty list without matches.
    Lists hold all of a key's matches: for keys whose matches are bounded, such as the facts of one entity. A
    key with more than ``most``, counted before any list is made, is an error (when it runs)."""
    counts = right.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    over = counts.select(F.count("*")).scalar()
    right = right.where(F.when(over > 0, F.raise_error(F.lit(f"a key of {key} has more than {most} matches"))).otherwise(F.lit(True)))
    lists = right.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), element.alias("e")))), lambda x: x["e"]).alias(name))
    joined = left.join(lists, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def strict_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join; an error (when it runs) if a key is on one side only or repeated."""
    a = left.withColumn("__left", F.count("*").over(Window.partitionBy(key)))
    b = right.withColumn("__right", F.count("*").over(Window.partitionBy(key)))
    joined = a.join(b, key, "full_outer")
    bad = F.coalesce(F.col("__left"), F.lit(0)) * F.coalesce(F.col("__right"), F.lit(0)) != 1
    checked = F.when(bad, F.raise_error(F.concat(F.lit(f"{key} is not one to one: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True))
    return joined.where(checked).drop("__left", "__right")


def membership(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in both, in the previous only and in the current only. Null is no key."""
    sides = previous.select(key, F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(current.select(key, F.lit(0).alias("p"), F.lit(1).alias("c")))
    per = sides.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return per.agg(F.count_if(F.expr("p = 1 AND c = 1")).alias("both"), F.count_if(F.expr("p = 1 AND c = 0")).alias("previous_only"), F.count_if(F.expr("p = 0 AND c = 1")).alias("current_only"))


def compare_sides(reference: DataFrame, ours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of either side, with ``side``: matched, reference_only or ours_only."""
    a = reference.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = ours.select(*keys).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "reference_only").when(F.col("__a").isNull(), "ours_only").otherwise("matched")
    return a.join(b, list(keys), "full_outer").select(*keys, side.alias("side"))


def dangling(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References without a target; a null reference dangles."""
    return references.join(targets.select(key).distinct(), key, "left_anti")


def rekey(rows: DataFrame, child: str, parents: DataFrame, parent: str, known: DataFrame) -> DataFrame:
    """``rows`` with ``entity`` and ``how``: the mapped parent, the key itself if it is a known entity,
    or null and unmapped. ``parents`` holds one parent a child, ``known`` the entities under ``parent``."""
    mapped = rows.join(parents.select(child, F.col(parent).alias("__parent")), child, "left")
    itself = known.select(F.col(parent).alias(child)).distinct().withColumn("__known", F.lit(True))
    out = mapped.join(itself, child, "left")
    how = F.when(F.col("__parent").isNotNull(), "mapped").when(F.col("__known"), "already_parent").otherwise("unmapped")
    entity = F.coalesce(F.col("__parent"), F.when(F.col("__known"), F.col(child)))
    return out.withColumn("entity", entity).withColumn("how", how).drop("__parent", "__known")


def shared_keys(df: DataFrame, shared: str, owner: str, least: int = 2) -> DataFrame:
    """Values of ``shared`` with at least ``least`` distinct owners, most first. Pairs are made distinct
    before they are counted, so a value with a third of all rows is counted in parts."""
    pairs = df.select(shared, owner).where(F.col(shared).isNotNull() & F.col(owner).isNotNull()).distinct()
    return pairs.groupBy(shared).agg(F.count("*").alias("owners")).where(F.col("owners") >= least)


def demote_shared(df: DataFrame, shared: str, owner: str, exempt: Column) -> DataFrame:
    """``df`` with ``demoted``: the row's shared value has other owners too, and not every row of it nor
    this row is exempt. Owners are counted apart and joined back: a hot value is no window partition."""
    marked = df.withColumn("__exempt", F.coalesce(exempt, F.lit(False)))
    pairs = marked.where(F.col(shared).isNotNull()).groupBy(shared, owner).agg(F.min("__exempt").alias("__all"))
    owners = pairs.groupBy(shared).agg(F.count(owner).alias("__owners"), F.min("__all").alias("__all"))
    joined = marked.join(owners, shared, "left")
    demoted = F.coalesce((F.col("__owners") >= 2) & ~F.col("__all") & ~F.col("__exempt"), F.lit(False))
    return joined.withColumn("demoted", demoted).drop("__exempt", "__owners", "__all")


def fill_empty(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``left`` with its null or empty texts in ``columns`` taken from ``right`` (one row a key)."""
    other = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = left.join(other, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")))
    return joined.drop(*[f"__{c}" for c in columns])


def replayed(requests: DataFrame, responses: DataFrame, url: str, status: str) -> DataFrame:
    """Requests answered from frozen responses (one a URL); an unknown URL is an error row, ``status`` null
    and ``error`` set, never a request that is lost."""
    joined = requests.join(responses.withColumn("__known", F.lit(True)), url, "left")
    return joined.withColumn("error", F.when(F.col("__known").isNull(), "unknown_url")).drop("__known")


def chain_match(truth: Column, predicted: Column, chain: Column) -> Column:
    """How a predicted domain meets the truth: ``same``, ``redirect`` (the truth lies on the chain of
    redirects), or ``other``; ``none`` without a prediction."""
    return F.when(predicted.isNull(), "none").when(predicted == truth, "same").when(F.coalesce(F.array_contains(chain, truth), F.lit(False)), "redirect").otherwise("other")

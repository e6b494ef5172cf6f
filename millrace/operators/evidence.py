"""Evidence rows: deterministic ids, availability, violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.orgid import digits_only
from millrace.operators.rank import hash_places


def evidence_id(*parts: Column) -> Column:
    """``ev-`` and the first 16 hexadecimal digits of SHA-256 over the parts (null as empty), joined by a bar."""
    return F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def with_ids(rows: DataFrame, org: str, field: str, url: str, key: str) -> DataFrame:
    """``rows`` with ``evidence_id``; rows alike in organisation, field and URL are numbered in the order of
    a hash of ``key`` (``hash_places``), so that a group with a third of all rows is numbered in slices."""
    placed = hash_places(rows, [org, field, url], key, "evidence", "|")
    return placed.withColumn("evidence_id", evidence_id(digits_only(F.col(org)), F.col(field), F.col(url), F.col(key), F.col("place"))).drop("place", "population_n")


#: Availability of a claim by its evidence's status; any other status, and none, is not checked.
AVAILABILITY = {
    "available": "available", "not_found": "not_available", "not_available": "not_available", "blocked": "blocked",
    "failed": "failed", "source_error": "failed", "not_applicable": "not_applicable", "ambiguous": "ambiguous",
}
#: JSON texts of values that are empty.
EMPTY_VALUES = ("", "null", "[]", "{}")


def availability(status: Column, value: Column) -> Column:
    """Availability of a claim from its evidence's status and value (JSON text); an available value that is
    empty is not available, and unknown or null statuses are not checked."""
    table = F.create_map(*[F.lit(x) for pair in AVAILABILITY.items() for x in pair])
    read = F.coalesce(F.try_element_at(table, status), F.lit("not_checked"))
    empty = F.coalesce(value, F.lit("")).isin(*EMPTY_VALUES)
    return F.when((read == "available") & empty, "not_available").otherwise(read)


def violations(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``key, rule`` for each rule a row breaks (its condition is false or null)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return rows.select(key, F.explode(broken).alias("rule"))


def claims_long(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, value`` of the fields that are filled, values as text."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(key, F.explode(cells).alias("c")).select(key, "c.field", "c.value").where("value IS NOT NULL AND value != ''")


def completeness(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """``key, score``: the sum of the weights of the fields that are filled, to three places."""
    filled = [F.when(F.coalesce(F.col(f).cast("string") != "", F.lit(False)), w).otherwise(0.0) for f, w in weights.items()]
    return rows.select(key, F.round(sum(filled[1:], filled[0]), 3).alias("score"))


def merge_available(claims: Column, states: Column, available: str = "available") -> Column:
    """The entries of a map of claims whose state (a map under the same keys) is ``available``."""
    return F.map_filter(claims, lambda k, _: F.coalesce(F.try_element_at(states, k) == available, F.lit(False)))


def complete_for(states: Column, modules: Sequence[str], done: Sequence[str]) -> Column:
    """Whether every one of ``modules`` has a state in ``done``; a missing module or a null map is not complete."""
    checks = F.array(*[F.coalesce(F.try_element_at(states, F.lit(m)).isin(*done), F.lit(False)) for m in modules])
    return states.isNotNull() & F.forall(checks, lambda c: c)


def sole_value(candidates: Column, priorities: Column) -> Column:
    """The value among ``candidates`` (an array) of the best (lowest) priority, or null where candidates of
    that priority disagree: better no value than a guess. Null candidates don't count."""
    pairs = F.filter(F.arrays_zip(candidates.alias("v"), priorities.alias("p")), lambda x: x["v"].isNotNull() & x["p"].isNotNull())
    best = F.array_min(F.transform(pairs, lambda x: x["p"]))
    values = F.array_distinct(F.transform(F.filter(pairs, lambda x: x["p"] == best), lambda x: x["v"]))
    return F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1)))


def label_spread(choice: Column, confidence: Column, labels: Sequence[str]) -> Column:
    """Probabilities over closed labels: the confidence for the choice, the rest shared evenly by the others;
    all alike where the choice is no label or the confidence is null."""
    known = F.coalesce(choice.isin(*labels), F.lit(False)) & confidence.isNotNull()
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    rest = (1 - held) / max(1, len(labels) - 1)
    return F.create_map(*[x for label in labels for x in (F.lit(label), F.round(F.when(~known, 1 / len(labels)).when(choice == label, held).otherwise(rest), 6))])


def promotion(candidate: DataFrame, baseline: DataFrame, kind: str, score: str, least_gain: float = 0.02, most_loss: float = 0.01) -> DataFrame:
    """One row: kinds compared, the largest gain and loss, and whether the candidate is ``promoted``: some kind
    gains at least ``least_gain`` and none loses more than ``most_loss``. A kind one side lacks scores 0 there."""
    a = candidate.select(kind, F.col(score).alias("a"))
    b = baseline.select(kind, F.col(score).alias("b"))
    delta = F.round(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 6)
    sums = a.join(b, kind, "full_outer").agg(F.count("*").alias("kinds"), F.max(delta).alias("gain"), F.min(delta).alias("loss"))
    return sums.withColumn("promoted", F.coalesce((F.col("gain") >= least_gain) & (F.col("loss") >= -most_loss), F.lit(False)))

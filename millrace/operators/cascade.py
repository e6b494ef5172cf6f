"""Rules in order, and additive scores, as column algebra that stays within generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(rules: Sequence[tuple[str, Column, float]], otherwise: str, score: float) -> list[Column]:
    """``rule`` and ``score`` of the first rule whose condition holds. A null condition doesn't hold; the
    order of rules is their meaning."""
    rule, points = None, None
    for name, condition, value in rules:
        test = F.coalesce(condition, F.lit(False))
        rule = F.when(test, name) if rule is None else rule.when(test, name)
        points = F.when(test, value) if points is None else points.when(test, value)
    if rule is None:
        return [F.lit(otherwise).alias("rule"), F.lit(score).alias("score")]
    return [rule.otherwise(otherwise).alias("rule"), points.otherwise(score).alias("score")]


def additive_score(parts: Sequence[Column], most: float = 1.0) -> Column:
    """Sum of the parts (null counts as 0), at most ``most``."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.least(F.lit(most), total)


def gap_reasons(tests: Sequence[tuple[str, Column]]) -> Column:
    """Names of the tests that fail, in order; a null test fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), n) for n, t in tests]))


#: Fixed values, in order: a state some candidate must have, the states all candidates must be among (null:
#: any), whether the strong source must have failed, and what the entity's state is then.
STATE_ORDER = (
    ("failed", None, True, "failed"),
    ("failed", ("failed", "not_available"), False, "not_available"),
    ("ambiguous", None, False, "ambiguous"),
    ("blocked", ("blocked", "not_available"), False, "blocked"),
    ("failed", None, False, "not_available"),
)


def final_state(states: Column, published: Column, strong_failed: Column) -> Column:
    """State of an entity from the states of its candidates (an array): ``available`` if one is published,
    ``not_available`` without candidates or if all are so, else the first line of ``STATE_ORDER`` that holds,
    else ``ambiguous``."""
    among = lambda kinds: F.forall(states, lambda s: s.isin(*kinds))
    out = F.when(published, "available").when(states.isNull() | (F.size(states) <= 0) | among(("not_available",)), "not_available")
    for some, all_of, strong, state in STATE_ORDER:
        test = F.coalesce(F.array_contains(states, some), F.lit(False))
        test = test & among(all_of) if all_of else test
        out = out.when(test & strong_failed if strong else test, state)
    return out.otherwise("ambiguous")

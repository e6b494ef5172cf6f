"""Decision lists learned by sequential covering.

Rules are conjunctions of thresholds on named statistics. A rule is grown on two thirds of the labelled
rows by adding the condition with the largest information gain until it covers no row of another
label, pruned on the last third, and what it covers is removed; the list ends where a further rule
would be wrong more often than right. Thresholds come from a stated grid, so that rules stay readable.
A list is emitted as one ordered Spark ``CASE``, evaluated natively over all rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        value = row[self.statistic]
        return value is not None and (value >= self.threshold if self.at_least else value < self.threshold)

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds gives ``positive``, none gives ``negative``."""

    positive: str
    negative: str
    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def label(self, row: dict[str, float]) -> str:
        return self.positive if any(all(c.holds(row) for c in r) for r in self.rules) else self.negative

    def column(self) -> Column:
        """The list as an ordered conditional expression; a null statistic meets no condition."""
        if not self.rules:
            return F.lit(self.negative)
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column()
            out = F.when(test, self.positive) if out is None else out.when(test, self.positive)
        return out.otherwise(self.negative)

    def __str__(self) -> str:
        lines = [f"if {' and '.join(map(str, r))}: {self.positive}" for r in self.rules]
        return "\n".join([*lines, f"else: {self.negative}"])


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    p0, n0 = before
    p1, n1 = after
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0


def _order(row: dict) -> tuple[int, str]:
    text = repr(sorted((k, repr(v)) for k, v in row.items()))
    return zlib.crc32(text.encode()), text


def grow_and_prune(rows: list[dict], label: str) -> tuple[list[dict], list[dict]]:
    """Two thirds and one third of the rows of each label. Rows are dealt in the order of a hash of their
    content, so the split depends on no order of arrival, and a label with one row only has it in the first
    part, where rules grow."""
    grow: list[dict] = []
    prune: list[dict] = []
    dealt: dict[str, int] = {}
    for r in sorted(rows, key=_order):
        n = dealt[r[label]] = dealt.get(r[label], 0) + 1
        (grow if n % 3 else prune).append(r)
    return grow, prune


def learn(rows: list[dict], label: str, positive: str, negative: str, grid: dict[str, list[float]], most_rules: int = 16) -> DecisionList:
    """Learn a list from labelled ``rows`` over the statistics and thresholds of ``grid``; earlier
    statistics win ties. Rows of one label only give a list without rules."""
    out = DecisionList(positive, negative)
    candidates = [Condition(s, up, t) for s, ts in grid.items() for t in ts for up in (True, False)]

    def table(part: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        held = np.array([[c.holds(r) for c in candidates] for r in part], bool).reshape(len(part), len(candidates))
        return held, np.array([r[label] == positive for r in part], bool)

    (grow, is_grown), (prune, is_pruned) = map(table, grow_and_prune(rows, label))
    left, kept = np.ones(len(grow), bool), np.ones(len(prune), bool)
    while len(out.rules) < most_rules and is_grown[left].any():
        rule: list[int] = []
        covered = left.copy()
        while (now := (int(is_grown[covered].sum()), int((~is_grown[covered]).sum())))[1]:
            inside = grow[covered]
            ps, ns = inside[is_grown[covered]].sum(axis=0), inside[~is_grown[covered]].sum(axis=0)
            gains = [_gain(now, (int(p), int(n))) for p, n in zip(ps, ns, strict=True)]
            best = int(np.argmax(gains))
            if gains[best] <= 1e-9:
                break
            rule.append(best)
            covered &= grow[:, best]
        if not rule:
            break
        if is_pruned[kept].any():
            worth = []
            for k in range(1, len(rule) + 1):
                at = kept & prune[:, rule[:k]].all(axis=1)
                p, n = int(is_pruned[at].sum()), int((~is_pruned[at]).sum())
                worth.append((p - n) / (p + n) if p + n else -1.0)
            keep = worth.index(max(worth)) + 1
            if worth[keep - 1] <= 0:
                break
            rule = rule[:keep]
        out.rules.append(tuple(candidates[c] for c in rule))
        left &= ~grow[:, rule].all(axis=1)
        kept &= ~prune[:, rule].all(axis=1)
    return out

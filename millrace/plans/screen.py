"""A closed screening language: a question becomes an inspectable plan, a plan becomes columns.

The driver parses: a lexer cuts the question into marked tokens (field, comparator, amount, place, ...),
and a table of token patterns says which runs of them are a criterion. Every criterion is a native column
expression, so that Catalyst pushes the scalar ones to the scan. A question with a term the language can't
answer, or with nothing it knows, is not run."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of the language.
#: Comparison phrases.
COMPARATORS = {">=": ">=", "<=": "<=", ">": ">", "<": "<", "=": "=", "more than": ">", "over": ">", "above": ">", "at least": ">=", "fewer than": "<", "less than": "<", "under": "<", "at most": "<="}
#: Multiples of amounts.
UNITS = {"thousand": 1_000, "m": 1_000_000, "million": 1_000_000, "bn": 1_000_000_000, "billion": 1_000_000_000}
#: Terms that need data which isn't there.
UNSUPPORTED = ("sentiment", "glassdoor", "linkedin", "traffic", "buzz", "without a website")
#: Numeric fields by the words that name them.
NUMERIC = {"employee": "employees", "employees": "employees", "revenue": "revenue", "job": "active_jobs", "jobs": "active_jobs", "rating": "rating", "review": "review_count", "reviews": "review_count"}
#: States a company is in or not, as a comparison with zero.
STATES = {
    "profitable": ("annual_result", ">"), "positive annual result": ("annual_result", ">"),
    "unprofitable": ("annual_result", "<"), "loss making": ("annual_result", "<"), "loss-making": ("annual_result", "<"), "negative annual result": ("annual_result", "<"),
    "hiring": ("active_jobs", ">"),
}
#: What a company has or not, and the comparison that asks for it.
POSSESSIONS = {
    "website": ("website", "present", True), "official website": ("website", "present", True),
    "accounts": ("financials", "available", True), "annual accounts": ("financials", "available", True),
    "jobs": ("active_jobs", ">", 0.0), "job": ("active_jobs", ">", 0.0), "active jobs": ("active_jobs", ">", 0.0), "active job": ("active_jobs", ">", 0.0),
}
#: What a result can be ranked by, and the most rows a ranking gives.
RANKED_BY, RANKED_MOST = ("revenue", "employees"), 100
#: Words that end a place, lead to a possession, link a name to its value, or say nothing.
PLACE_ENDS, HAVING, LINKS, FILL = ("with", "and", "having", "that", "where"), ("with", "has", "have"), ("is", "contains", "="), ("nok", "registered", "active", "an", "a", "official")


@dataclass(frozen=True)
class Test:
    field: str
    operator: str
    value: object


@dataclass
class Plan:
    query: str
    tests: list[Test] = field(default_factory=list)
    sort: str | None = None
    limit: int | None = None
    unsupported: list[str] = field(default_factory=list)

    @property
    def executable(self) -> bool:
        return bool(self.tests or self.sort) and not self.unsupported


class Token(NamedTuple):
    """A word, number, symbol or quoted text, lower case but for quotations."""

    kind: str
    text: str


_LEXER = re.compile(r"(?P<quoted>\"[^\"]*\"|(?<!\w)'[^']*')|(?P<number>\d+(?:[.,]\d+)*)|(?P<symbol>[<>]=?|=)|(?P<word>[^\W\d_](?:[\w'.-]*\w)?)|(?P<other>\S)")


def tokens(query: str) -> list[Token]:
    """The tokens of a question; layout doesn't matter."""
    found = [Token(str(m.lastgroup), m[0]) for m in _LEXER.finditer(query)]
    return [Token(k, t[1:-1]) if k == "quoted" else Token(k, t.lower()) for k, t in found]


class Cursor:
    """A place in a question, with readers that return a value and where it ends, or nothing."""

    def __init__(self, of: list[Token]):
        self.of = of

    def phrase(self, at: int, table) -> tuple[str, int] | None:
        """The longest phrase of ``table`` that stands at ``at``."""
        for n in (3, 2, 1):
            run = self.of[at : at + n]
            text = " ".join(t.text for t in run)
            if len(run) == n and text in table and all(t.kind in ("word", "symbol") for t in run):
                return text, at + n
        return None

    def past(self, at: int, table) -> int:
        """Where the run of words of ``table`` at ``at`` ends."""
        while (p := self.phrase(at, table)) is not None:
            at = p[1]
        return at

    def amount(self, at: int) -> tuple[float, int] | None:
        at = self.past(at, ("nok",))
        if at >= len(self.of) or self.of[at].kind != "number":
            return None
        value, at = float(self.of[at].text.replace(",", ".")), at + 1
        unit = self.phrase(at, UNITS)
        return (value * UNITS[unit[0]], unit[1]) if unit else (value, at)


# ---------------------------------------------------------------- criteria: each reads a test at a place, or nothing
def _field_first(c: Cursor, at: int) -> Test | None:
    if (name := c.phrase(at, NUMERIC)) and (how := c.phrase(name[1], COMPARATORS)) and (amount := c.amount(how[1])):
        return Test(NUMERIC[name[0]], COMPARATORS[how[0]], amount[0])
    return None


def _amount_first(c: Cursor, at: int) -> Test | None:
    if (how := c.phrase(at, COMPARATORS)) and (amount := c.amount(how[1])) and (name := c.phrase(c.past(amount[1], FILL), NUMERIC)):
        return Test(NUMERIC[name[0]], COMPARATORS[how[0]], amount[0])
    return None


def _state(c: Cursor, at: int) -> Test | None:
    return Test(STATES[p[0]][0], STATES[p[0]][1], 0.0) if (p := c.phrase(at, STATES)) else None


def _possession(c: Cursor, at: int) -> Test | None:
    if (lead := c.phrase(at, HAVING)) and (thing := c.phrase(c.past(lead[1], ("a", "an")), POSSESSIONS)):
        return Test(*POSSESSIONS[thing[0]])
    return None


def _place(c: Cursor, at: int) -> Test | None:
    if not (lead := c.phrase(at, ("in", "municipality"))):
        return None
    at = c.past(lead[1], LINKS)
    end = at
    while end < len(c.of) and c.of[end].kind == "word" and c.of[end].text not in PLACE_ENDS:
        end += 1
    return Test("municipality", "eq", " ".join(t.text for t in c.of[at:end])) if end > at else None


def _form(c: Cursor, at: int) -> Test | None:
    if (lead := c.phrase(at, ("legal form", "organisation form"))) and (at := c.past(lead[1], LINKS)) < len(c.of) and c.of[at].kind == "word":
        return Test("legal_form", "eq", c.of[at].text)
    return None


def _industry(c: Cursor, at: int) -> Test | None:
    if (lead := c.phrase(at, ("industry",))) and (at := c.past(lead[1], LINKS)) < len(c.of) and c.of[at].kind == "quoted":
        return Test("industry", "contains", c.of[at].text.lower())
    return None


CRITERIA = (_place, _form, _field_first, _amount_first, _state, _possession, _industry)


def _ranking(c: Cursor, at: int) -> tuple[str, int] | None:
    top = c.phrase(at, ("top",))
    if top and top[1] + 2 < len(c.of) and c.of[top[1]].text.isdecimal() and c.of[top[1] + 1].text == "by" and c.of[top[1] + 2].text in RANKED_BY:
        return c.of[top[1] + 2].text, min(int(c.of[top[1]].text), RANKED_MOST)
    return None


def parse(query: str) -> Plan:
    """The plan of a question; layout and letter case don't matter. The first criterion on a field counts.
    A place in a question about jobs is where the jobs are."""
    text = " ".join(query.split())
    plan = Plan(text, unsupported=[t for t in UNSUPPORTED if t in text.lower()])
    cursor = Cursor(tokens(text))
    found: dict[str, Test] = {}
    for at in range(len(cursor.of)):
        for criterion in CRITERIA:
            if (test := criterion(cursor, at)) is not None:
                found.setdefault(test.field, test)
        if plan.sort is None and (ranking := _ranking(cursor, at)):
            plan.sort, plan.limit = ranking
    if "active_jobs" in found and "municipality" in found:
        found["municipality"] = replace(found["municipality"], field="job_location", operator="contains")
    plan.tests = list(found.values())
    return plan


_NUMERIC_TESTS: dict[str, Callable[[Column, object], Column]] = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}


def condition(test: Test, value: Column) -> Column:
    """A test as a column that is never null: an absent number compares false, an absent text is empty."""
    if test.operator == "eq":
        return F.lower(F.coalesce(value.cast("string"), F.lit(""))) == str(test.value).lower()
    if test.operator == "contains":
        return F.contains(F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.lit(str(test.value).lower()))
    if test.operator in ("present", "available"):
        return F.coalesce(value.cast("boolean"), F.lit(False)) == F.lit(bool(test.value))
    return F.coalesce(_NUMERIC_TESTS[test.operator](value, F.lit(test.value)), F.lit(False))


def screen(companies: DataFrame, query: str, columns: dict[str, Column], key: str, modules: dict[str, str] | None = None) -> DataFrame:
    """All rows of ``companies`` that pass the question's plan: ``key``, the tested fields, and ``citations``
    (the modules the tests read). ``columns`` says what each field of the language is; a field it lacks
    is absent everywhere. A question for the top rows gives so many, by the plan's field, null last, then by
    key; any other gives every match. A question that can't be run gives no rows."""
    plan = parse(query)
    rows = companies.where(F.lit(plan.executable))
    fields = list(dict.fromkeys([t.field for t in plan.tests] + ([plan.sort] if plan.sort else [])))
    for t in plan.tests:
        rows = rows.where(condition(t, columns.get(t.field, F.lit(None))))
    cited = sorted({(modules or {}).get(f, "registry") for f in fields})
    picked = rows.select(key, *[columns.get(f, F.lit(None).cast("string")).alias(f) for f in fields if f != key], F.lit(",".join(cited)).alias("citations"))
    return picked.orderBy(F.desc_nulls_last(plan.sort), F.asc(key)).limit(plan.limit) if plan.sort else picked

"""Questions about single entities: topics are routed to fields, every fact names where it is from."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Topics of the language: a pattern, and the facts (name, module) it asks for.
TOPICS: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "size": (r"employees?|how (?:big|large)|size", (("employees", "registry"),)),
    "place": (r"where|municipality|located|address", (("municipality", "registry"), ("municipality_number", "registry"))),
    "industry": (r"industry|business|what does|sector", (("industry_code", "registry"), ("industry_label", "registry"))),
    "form": (r"legal form|organisation form|what kind of company", (("legal_form", "registry"),)),
    "website": (r"website|homepage|url", (("website", "website"),)),
    "accounts": (r"accounts|filed|annual report", (("latest_submitted_accounts", "financials"),)),
    "status": (r"bankrupt|liquidat|active", (("bankrupt", "registry"), ("liquidating", "registry"))),
}


def topics(question: str) -> list[str]:
    low = " ".join(question.lower().split())
    return [name for name, (pattern, _) in TOPICS.items() if re.search(rf"\b(?:{pattern})", low)]


def answer(entities: DataFrame, question: str, key: str) -> DataFrame:
    """``key, fact, value, module`` for every fact the question asks for; facts that are null or empty are
    given with a null value, so that "not known" is an answer. A question of no topic gives no rows."""
    facts = [f for t in topics(question) for f in TOPICS[t][1] if f[0] in entities.columns]
    if not facts:
        return entities.where(F.lit(False)).select(key, F.lit("").alias("fact"), F.lit("").alias("value"), F.lit("").alias("module"))

    def cell(name: str, module: str) -> Column:
        return F.struct(F.lit(name).alias("fact"), F.nullif(F.trim(F.col(name).cast("string")), F.lit("")).alias("value"), F.lit(module).alias("module"))

    return entities.select(key, F.explode(F.array(*[cell(*f) for f in facts])).alias("c")).select(key, "c.fact", "c.value", "c.module")

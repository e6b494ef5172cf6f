"""Whether a page is an entity's own: signals as columns over landed pages, rules in order as data.

A page's texts are an array of parts (title, description, host, ...); organisation numbers in them are
read once. Everything is column algebra within a row: nothing is joined or shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.orgid import digits_only, numbers_in
from millrace.functions.text import ascii_fold, fold_tokens
from millrace.operators.cascade import first_rule

# Fixed values of the rules.
#: Words of a name that don't tell one entity from another.
LEGAL_WORDS = ("as", "asa", "ans", "da", "enk", "iks", "sa", "sam", "sti", "stiftelsen", "nuf", "ab", "b", "v", "limited", "ltd", "inc", "plc", "the", "og", "and")
#: What parked and placeholder pages say.
PARKED = ("domain is for sale", "domain for sale", "hugedomains", "parked at", "miss hosting", "her flytter snart en ny gjest", "has been informing visitors", "find the best information and most relevant links on all topics related to")
#: What pages of groups and brands say.
GROUP_WORDS = ("gruppen", "gruppe", "group", "konsern", "konsernet", "our schools", "our companies", "subsidiaries", "brands", "brand", "international schools")
#: Other numbers from which a page counts as a directory, and characters from which its text is substantive.
MANY_NUMBERS, SUBSTANTIVE = 3, 100
#: Signals in the order in which they decide, with what the score is then.
RULES = (
    ("group_or_brand", 0.3), ("parked", 0.1), ("directory_with_own_number", 0.85), ("contradicting_number", 0.0), ("own_number", 1.0),
    ("whole_name", 0.95), ("single_name_with_content", 0.95), ("single_name_as_registered", 0.95), ("most_of_name", 0.85), ("half_of_name", 0.65),
)
OTHERWISE = ("weak", 0.3)
#: Least scores of the statuses.
STATUSES = (("exact", 0.9), ("review", 0.8))


def core_tokens(name: Column) -> Column:
    """Distinct folded tokens of a name, without legal words and single characters."""
    legal = F.array(*[F.lit(w) for w in LEGAL_WORDS])
    return F.array_distinct(F.filter(F.coalesce(fold_tokens(name), F.array().cast("array<string>")), lambda t: (F.length(t) > 1) & ~F.array_contains(legal, t)))


def assess(rows: DataFrame, keep: Sequence[str], name: Column, number: Column, home: Column, texts: Column, title: Column, content: Column, related: Column, registered: Column) -> DataFrame:
    """The columns ``keep`` of ``rows``, and ``rule``, ``score`` and ``status`` (``exact``, ``review`` or
    ``related_or_uncertain``) by the first of ``RULES`` that holds.

    ``home`` are the parts that identify a home page, ``texts`` all other parts (arrays of text), ``content``
    its main text, ``related`` the numbers of the entity's group and ``registered`` whether the registry lists
    the page. Nulls anywhere count as empty. Tokens, folded texts and numbers are made once, in a projection
    of their own that the rules read."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.coalesce(home, none), lambda p: p.isNotNull())
    others = F.filter(F.coalesce(texts, none), lambda p: p.isNotNull())
    text = F.coalesce(content, F.lit(""))
    kept = [F.col(f"`{k}`") for k in keep]
    read = rows.select(
        *kept, core_tokens(name).alias("__core"), digits_only(F.coalesce(number, F.lit(""))).alias("__own"), F.transform(parts, core_tokens).alias("__parts"), core_tokens(title).alias("__titled"),
        F.array_join(F.concat(parts, F.array(text)), " ").alias("__home"), F.array_join(F.concat(parts, others), " ").alias("__all"), text.alias("__content"),
        F.coalesce(related, none).alias("__related"), F.coalesce(registered, F.lit(False)).alias("__registered"),
    )
    read = read.withColumns({"__words": core_tokens(F.col("__all")), "__folded": F.coalesce(ascii_fold(F.col("__all")), F.lit("")), "__at_home": numbers_in(F.col("__home")), "__numbers": numbers_in(F.col("__all"))})
    own, core, titled, folded = F.col("__own"), F.col("__core"), F.col("__titled"), F.col("__folded")
    read = read.withColumns({
        "__n": F.size("__core"), "__shared": F.size(F.array_intersect("__core", "__words")), "__others": F.size(F.array_remove("__at_home", own)),
        "__contradicting": F.size(F.array_except("__numbers", F.concat(F.array(own), F.col("__related")))), "__has_own": (own != "") & F.array_contains("__at_home", own),
        "__whole": (F.size("__core") > 0) & F.exists("__parts", lambda p: F.size(F.array_except(core, p)) == 0),
        "__brand": F.exists(titled, lambda t: (F.length(t) > 3) & ~F.array_contains(core, t)),
        "__named": F.exists(titled, lambda t: F.array_contains(core, t) | F.contains(t, F.array_join(core, ""))),
        "__foreign": F.exists(F.array(*[F.lit(w) for w in GROUP_WORDS]), lambda w: F.contains(folded, w) & ~F.array_contains(core, w)),
        "__parked": F.exists(F.array(*[F.lit(w) for w in PARKED]), lambda w: F.contains(folded, w)),
    })
    n, shared, whole, many = F.col("__n"), F.col("__shared"), F.col("__whole"), F.col("__others")
    found = {
        "group_or_brand": (n > 0) & F.col("__brand") & ~F.col("__named") & F.col("__foreign"),
        "parked": F.col("__parked"),
        "directory_with_own_number": F.col("__has_own") & (many >= MANY_NUMBERS),
        "contradicting_number": F.col("__contradicting") > 0,
        "own_number": F.col("__has_own"),
        "whole_name": (n >= 2) & whole,
        "single_name_with_content": (n == 1) & whole & (F.length(F.trim("__content")) >= SUBSTANTIVE),
        "single_name_as_registered": (n == 1) & whole & F.col("__registered") & (many == 0),
        "most_of_name": (4 * shared >= 3 * n) & (shared >= 2),
        "half_of_name": (2 * shared >= n) & (shared >= 2),
    }
    scored = read.select(*kept, *first_rule([(rule, found[rule], value) for rule, value in RULES], *OTHERWISE))
    status = None
    for label, least in STATUSES:
        status = F.when(F.col("score") >= least, label) if status is None else status.when(F.col("score") >= least, label)
    return scored.withColumn("status", status.otherwise("related_or_uncertain"))

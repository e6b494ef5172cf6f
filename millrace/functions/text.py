"""Text functions as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin_table() -> tuple[str, str]:
    """Lower-case Latin letters beyond ASCII whose decomposition starts with an ASCII letter, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a.lower(), b.lower()) for a, b in pairs if b.isascii() and b.isalpha() and len(a.lower()) == 1 and a.lower() not in "øåæ"]
    unique = dict(pairs)
    return "".join(unique), "".join(unique.values())


_FROM, _TO = _latin_table()

#: Words of names that say nothing about who is meant.
GENERIC_NAME_WORDS = ("as", "asa", "ans", "da", "enk", "sa", "ba", "nuf", "sti", "esek", "og", "i", "the", "and", "norge", "norway", "gruppen", "group", "holding", "avd")


def ascii_fold(value: Column) -> Column:
    """Lower case, ``ø``→``o``, ``å``→``a``, ``æ``→``ae``, other accents dropped, then anything beyond ASCII
    dropped. Null stays null."""
    lower = F.replace(F.lower(value), F.lit("æ"), F.lit("ae"))
    plain = F.translate(lower, "øå" + _FROM, "oa" + _TO)
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def fold_tokens(value: Column) -> Column:
    """Runs of ``[a-z0-9]`` of the folded value, ``aa``→``a`` and ``oe``→``o`` in each; empty for null."""
    tokens = F.regexp_extract_all(F.coalesce(ascii_fold(value), F.lit("")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit("aa"), F.lit("a")), F.lit("oe"), F.lit("o")))


def identity_tokens(value: Column) -> Column:
    """Folded tokens of more than one character that are no generic or legal word, first occurrences."""
    generic = F.array(*[F.lit(w) for w in GENERIC_NAME_WORDS])
    return F.array_distinct(F.filter(fold_tokens(value), lambda t: (F.length(t) > 1) & ~F.array_contains(generic, t)))


def token_overlap(left: Column, right: Column) -> Column:
    """Share of the tokens of ``left`` (an array) that ``right`` has too; null if ``left`` has none."""
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, right)) / F.size(left))


def slug(value: Column) -> Column:
    """Folded value with hyphens between its runs of letters and digits."""
    return F.array_join(F.regexp_extract_all(F.coalesce(ascii_fold(value), F.lit("")), F.lit("[a-z0-9]+"), F.lit(0)), "-")


def name_slugs(name: Column) -> Column:
    """Domain labels a name may be found under: its identity tokens joined, hyphenated, joined with the
    legal form ``as``, and the first token alone, first occurrences, no empty ones."""
    tokens = identity_tokens(name)
    joined, hyphened = F.array_join(tokens, ""), F.array_join(tokens, "-")
    labels = F.array(joined, hyphened, F.when(joined != "", F.concat(joined, F.lit("as"))), F.try_element_at(tokens, F.lit(1)))
    return F.array_distinct(F.filter(labels, lambda s: s.isNotNull() & (s != "")))


#: Norwegian inflection endings, in the order in which they are tried.
ENDINGS = ("heten", "heter", "ende", "ane", "ene", "er", "en", "et", "a", "e", "s")


def stem_tokens(value: Column, least: int = 3) -> Column:
    """Folded tokens without a Norwegian inflection ending, where at least ``least`` letters stay."""
    ending = rf"^(.{{{least},}}?)({'|'.join(ENDINGS)})$"
    return F.array_sort(F.array_distinct(F.transform(fold_tokens(value), lambda t: F.regexp_replace(t, ending, "$1"))))


def squeezed(value: Column) -> Column:
    """``value`` with every run of whitespace as one space, trimmed."""
    return F.trim(F.regexp_replace(value, r"[\s\p{Z}]+", " "))


def first_sentence(value: Column, limit: int = 300) -> Column:
    """The squeezed value up to its first sentence end, at most ``limit`` characters."""
    text = squeezed(value)
    return F.substring(F.coalesce(F.nullif(F.regexp_extract(text, r"^[^.!?]*[.!?]", 0), F.lit("")), text), 1, limit)


def holds_span(body: Column, span: Column) -> Column:
    """Whether ``span`` stands word for word in ``body`` once both are squeezed; false for null and empty spans."""
    return F.coalesce((squeezed(span) != "") & F.contains(squeezed(body), squeezed(span)), F.lit(False))


def holds_token_run(tokens: Column, run: Column) -> Column:
    """Whether the tokens of ``run`` stand in ``tokens`` consecutively; false for an empty run."""
    starts = F.when(F.size(tokens) >= F.size(run), F.sequence(F.lit(1), F.size(tokens) - F.size(run) + 1)).otherwise(F.array())
    return (F.size(run) > 0) & F.exists(starts, lambda i: F.slice(tokens, i, F.size(run)) == run)


def phone_digits(value: Column) -> Column:
    """Eight digits of a Norwegian phone number, country code dropped; null if there are not eight."""
    digits = F.regexp_replace(F.regexp_replace(value, r"^\s*(\+|00)47", ""), "[^0-9]", "")
    return F.when(F.length(digits) == 8, digits)


def email_domain(value: Column) -> Column:
    """Domain of an e-mail address in lower case; null without one."""
    return F.when(value.contains("@"), F.nullif(F.lower(F.trim(F.substring_index(value, "@", -1))), F.lit("")))


def number_value(value: Column) -> Column:
    """A number written with spaces as separators of thousands and a decimal comma; null if it is none."""
    return F.regexp_replace(F.regexp_replace(value, r"[\s\p{Z}]", ""), ",", ".").try_cast("double")


def capped(weight: float, value: Column) -> Column:
    """``weight`` times ``value`` held between 0 and 1 (null counts as 0), to three places."""
    return F.round(F.lit(weight) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("double"), F.lit(0.0)))), 3)


def seeded_rank(seed: str, key: Column, separator: str = "|") -> Column:
    """Hexadecimal SHA-256 of seed and key: its order is a random order that never changes."""
    return F.sha2(F.concat(F.lit(seed + separator), key.cast("string")), 256)


def search_queries(name: Column, place: Column, number: Column) -> Column:
    """Search questions for an entity: its quoted name with its place, its number with its name, first
    occurrences; parts that are null or blank are left out, and so are questions without a name."""
    clean = lambda c: F.nullif(squeezed(c), F.lit(""))
    quoted = F.concat(F.lit('"'), clean(name), F.lit('"'))
    by_place = F.when(clean(name).isNotNull(), F.concat_ws(" ", quoted, clean(place)))
    by_number = F.when(clean(name).isNotNull() & clean(number).isNotNull(), F.concat_ws(" ", clean(number), quoted))
    return F.array_distinct(F.array_compact(F.array(by_place, by_number)))

"""URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of more than one label that matter here; others have one label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.nz", "co.jp", "com.br", "oslo.no", "kommune.no", "priv.no", "mil.no", "dep.no", "herad.no", "vgs.no", "blogspot.com", "github.io")


def homepage(value: Column) -> Column:
    """A URL with a scheme, from one that may lack it; null for blanks and values without a dot."""
    text = F.trim(value)
    with_scheme = F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), text).otherwise(F.concat(F.lit("https://"), F.regexp_replace(text, "^/+", "")))
    return F.when(F.contains(text, F.lit(".")) & ~text.rlike(r"\s"), with_scheme)


def host(value: Column) -> Column:
    """Host of a URL in lower case without ``www.``; null if there is none."""
    name = F.regexp_extract(F.lower(homepage(value)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(name, r"^www\.", ""), F.lit(""))


_WHOLE = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)[^/?#]*([^?#]*?)/*(\?[^#]+)?\??(?:#.*)?$"


def url_key(value: Column) -> Column:
    """What makes two URLs the same page: host, path without its last slash, and query, in lower case."""
    low = F.lower(homepage(value))
    return F.when(low.rlike(_WHOLE), F.regexp_replace(low, _WHOLE, "$1$2$3"))


def registered_domain(value: Column) -> Column:
    """The last two labels of the host, three under a longer public suffix."""
    name = host(value)
    return F.when(F.substring_index(name, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def under_any(name: Column, domains: list[str]) -> Column:
    """Whether host ``name`` is one of ``domains`` or below one; false for null."""
    tests = [(name == d) | F.endswith(name, F.lit("." + d)) for d in domains]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def path_parts(value: Column) -> Column:
    """Segments of a URL's path in lower case, no empty ones."""
    path = F.regexp_extract(F.lower(homepage(value)), r"^[a-z][a-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")


def term_weight(value: Column, weights: dict[str, int], otherwise: int) -> Column:
    """The smallest weight of the terms that a URL holds; ``otherwise`` if it holds none."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.least(F.lit(otherwise), *[F.when(F.contains(low, F.lit(t)), w).otherwise(otherwise) for t, w in weights.items()])

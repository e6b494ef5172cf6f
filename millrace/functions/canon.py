"""Canonical forms: texts and JSON documents that mean the same become the same string."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(value: Column) -> Column:
    """``value`` in Unicode composition form NFC. Only texts with a character beyond Latin-1 leave the
    JVM: below that every text is composed already."""
    needs = value.rlike(r"[^\x00-\xFF]")
    return F.when(needs, F.pandas_udf(_nfc, StringType())(F.when(needs, value))).otherwise(value)


def folded_text(value: Column) -> Column:
    """``value`` without differences of letter case, kind and amount of whitespace, or composition;
    null becomes the empty text."""
    spaced = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\p{Z}]+", " "))
    return F.lower(composed(spaced))


def canonical_json(value: object, without: frozenset[str] = frozenset()) -> str:
    """One spelling of a JSON value: keys sorted, array elements sorted, no layout, whole numbers
    without a fraction; keys in ``without`` left out at any depth. A string that is itself the JSON
    text of an array counts as that array."""
    if isinstance(value, str):
        if value[:1] == "[" and value[-1:] == "]":
            try:
                return canonical_json(json.loads(value), without)
            except ValueError:
                pass
        return encode_basestring(value)
    if isinstance(value, dict):
        return "{" + ",".join([encode_basestring(k) + ":" + canonical_json(v, without) for k, v in sorted(value.items()) if k not in without]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(sorted([canonical_json(v, without) for v in value])) + "]"
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return repr(value)


def json_digest(without: Iterable[str] = ()) -> Callable[[Column], Column]:
    """A column function: MD5 of the canonical form of a JSON text. Null gives null; text that is no
    JSON is compared as it stands, but for whitespace."""
    dropped = frozenset(without)

    def digest(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            form = canonical_json(json.loads(text), dropped)
        except (ValueError, RecursionError):
            form = "text:" + re.sub(r"\s+", " ", text).strip()
        return hashlib.md5(form.encode("utf-8", "surrogatepass")).hexdigest()

    def digests(text: pd.Series) -> pd.Series:
        return text.map(digest, na_action="ignore")

    return F.pandas_udf(digests, StringType())

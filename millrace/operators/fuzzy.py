"""Fuzzy likeness of names, where no native expression has the same meaning."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.functions.text import ascii_fold, squeezed


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    def ratio(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        return round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)

    return pd.Series([ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def sequence_ratio(left: Column, right: Column) -> Column:
    """Ratio of matching blocks of two folded texts (0 to 1); null if either is null. Equal texts and pairs
    with a null never leave the JVM."""
    a, b = squeezed(ascii_fold(left)), squeezed(ascii_fold(right))
    same = a == b
    unlike = F.coalesce(~same, F.lit(False))
    measured = F.pandas_udf(_ratios, DoubleType())(F.when(unlike, a), F.when(unlike, b))
    return F.when(same, 1.0).when(unlike, measured)


def match_score(name_share: Column, channels: dict[str, tuple[float, Column]], popularity: Column) -> Column:
    """Score of a candidate place: four times the share of name tokens, the weights of the channels that
    agree, and up to one for popularity on a logarithmic scale."""
    score = 4 * F.coalesce(name_share, F.lit(0.0))
    for weight, agrees in channels.values():
        score = score + F.when(F.coalesce(agrees, F.lit(False)), weight).otherwise(0.0)
    known = F.greatest(F.lit(1.0), F.coalesce(popularity.cast("double"), F.lit(1.0)))
    return F.round(score + F.least(F.lit(1.0), F.log10(known) / 5), 4)

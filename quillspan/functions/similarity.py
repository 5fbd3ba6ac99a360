"""Sequence similarity in the sense of difflib, for what native predicates have left over."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import bounds


def _ratio(a: str | None, b: str | None, junk: bool) -> float | None:
    if a is None or b is None:
        return None
    return 1.0 if a == b else SequenceMatcher(isjunk=None, a=a, b=b, autojunk=junk).ratio()


@F.pandas_udf(T.DoubleType())
def _with_junk(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y, True) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _without_junk(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y, False) for x, y in zip(a, b, strict=True)], dtype="float64")


def _reaches(a: str | None, b: str | None, threshold: float) -> bool | None:
    if a is None or b is None:
        return None
    # difflib's matches never exceed the longest common subsequence
    if 2 * bounds.common(bounds.masks(a), len(a), b) < threshold * (len(a) + len(b)):
        return False
    return bounds.reaches(a, b, threshold)


def _close(threshold: float):
    @F.pandas_udf(T.BooleanType())
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_reaches(x, y, threshold) for x, y in zip(a, b, strict=True)], dtype="object")

    return close


def ratio(a: Column, b: Column, junk: bool = True) -> Column:
    """difflib's ratio of a to b, which is not symmetric; ``junk``: frequent characters may be skipped."""
    return (_with_junk if junk else _without_junk)(a, b)


def similar_or_unsure(a: Column, b: Column, threshold: float) -> Column:
    """True or false where native tests decide, null where only a sequence comparison can."""
    apart = F.abs(F.length(a) - F.length(b)) > F.greatest(F.length(a), F.length(b)) * (1 - threshold)
    empty = F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe("")
    return F.when(empty, False).when(F.contains(a, b) | F.contains(b, a), True).when(apart, False)


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Sameness of two normalised texts: one contains the other, or lengths and ratio are close.

    The comparison runs on rows that the native tests leave open; others hand it nulls.
    """
    known = similar_or_unsure(a, b, threshold)
    open_ = known.isNull()
    close = _close(threshold)(F.when(open_, a), F.when(open_, b))
    return F.coalesce(known, close, F.lit(False))

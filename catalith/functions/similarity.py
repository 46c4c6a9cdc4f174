"""Similarity of texts: the share of letters in a longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_letters(a: str, b: str) -> int:
    """Length of a longest common subsequence; a bit for each letter of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        same = row & masks.get(c, 0)
        row = (row + same | row - same) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for equal texts, 0 for texts without a common letter."""
    return 200.0 * common_letters(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """``ratio`` of the texts with their words in order."""
    return ratio(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split())))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Over Arrow batches; words are sorted once for each distinct text."""
    known: dict[str, str] = {}
    for text in {*a.dropna(), *b.dropna()}:
        known[text] = " ".join(sorted(text.split()))
    return pd.Series([ratio(known.get(x, ""), known.get(y, "")) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])

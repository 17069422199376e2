"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pattern of a token: a run of letters, digits and underscores, or a run of other printing characters.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
#: Fixed pattern of a word of a content.
WORD = r"[\p{L}\p{N}]+"


def token_count(text: Column) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def words(content: Column) -> Column:
    """Lower-cased words in order, with repeats; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(WORD), F.lit(0))


def usable(v: Column, dim: int) -> Column:
    """A vector that is not null, of dim finite values, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def stack(s: pd.Series) -> np.ndarray:
    """A column of equally long vectors as one float32 matrix."""
    if not len(s):
        return np.zeros((0, 1), np.float32)
    return np.stack([np.asarray(x, np.float32) for x in s])


def unit(m: np.ndarray) -> np.ndarray:
    # float64 norms: values near the float32 limits must not overflow or vanish
    n = np.abs(m).max(axis=1, keepdims=True).astype(np.float64)
    x = m / n
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long vectors in double precision."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t
    )
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hot_keys(df: DataFrame, key: str, rows: int, share: int = 64) -> DataFrame:
    """Values of key that hold more than 1/share of all rows: fewer than share of them, so they may be broadcast."""
    limit = max(1000, rows // share)
    return df.groupBy(key).count().filter((F.col("count") > limit) & F.col(key).isNotNull()).select(key)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str, rows: int) -> DataFrame:
    """left join right (unique in key) where a few keys may hold a third of left.

    Rows of hot keys meet the few matching rows of right by broadcast (at most 64 of them);
    all others by a shuffle join.
    """
    hot = F.broadcast(hot_keys(left, key, rows))
    few = F.broadcast(right.join(hot, key, "left_semi").limit(64))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(
        left.join(hot, key, "left_anti").join(right, key, how)
    )

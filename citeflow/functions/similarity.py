"""Title and venue similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bound


def compared_words(x: Column) -> Column:
    """The words that texts are compared by: those of ``comparable``."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\W+", " "), " "), "")


def word_set(x: Column) -> Column:
    return F.array_except(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\W+", " "), " "), F.array(F.lit("")))  # distinct as well


def overlap(x: Column, y: Column) -> Column:
    """Shared words over all words of two word sets, 0 if either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """``overlap`` of two texts' words, each split once."""
    return bound(F.struct(word_set(a).alias("x"), word_set(b).alias("y")), lambda p: overlap(p["x"], p["y"]))


def sorted_words(x: Column) -> Column:
    return F.array_join(F.array_sort(compared_words(x)), " ")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time (Python integers as bit vectors)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    rows = full = (1 << len(a)) - 1
    for c in b:
        hit = rows & places.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def _indel_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([2 * common_subsequence(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a, b)])


def _indel(a: Column, b: Column) -> Column:
    return F.pandas_udf(_indel_batch, "double")(a, b)


def token_sort(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Indel similarity of the sorted words. Pairs whose lengths rule out ``at_least`` get 0 without Python."""
    return sorted_similarity(sorted_words(a), sorted_words(b), at_least)


def sorted_similarity(x: Column, y: Column, at_least: float = 0.0) -> Column:
    n, m = F.length(x), F.length(y)
    keep = F.when(n + m > 0, 2 * F.least(n, m) / (n + m)).otherwise(0.0) >= at_least
    return F.when(keep, _indel(F.when(keep, x).otherwise(""), F.when(keep, y).otherwise(""))).otherwise(0.0)


def similarity(a: Column, b: Column, mode: str = "jaccard", at_least: float = 0.0) -> Column:
    return jaccard(a, b) if mode == "jaccard" else token_sort(a, b, at_least)

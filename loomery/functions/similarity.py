"""Set similarities of two text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words


def grams(col: Column, n: int = 4) -> Column:
    """Distinct character n-grams; none for shorter texts."""
    at = F.when(F.length(col) >= n, F.sequence(F.lit(1), F.length(col) - (n - 1))).otherwise(F.array().cast("array<int>"))
    # the outer lambda binds the characters, which the inner one would split off again for each gram
    bound = F.transform(F.array(F.split(col, "")), lambda c: F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(c, i, n), ""))))
    return F.element_at(bound, 1)


def word_set(col: Column) -> Column:
    return F.array_distinct(words(col))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def char_jaccard(a: Column, b: Column, n: int = 4) -> Column:
    """Equal texts are alike; texts shorter than n are alike only if equal."""
    return F.when(a == b, 1.0).when((F.length(a) < n) | (F.length(b) < n), 0.0).otherwise(jaccard(grams(a, n), grams(b, n)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))

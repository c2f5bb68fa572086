"""Similarity measures as column expressions; ratios with a zero denominator are 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b != 0, b))


def jaccard(ov: Column, q: Column, m: Column) -> Column:
    return ratio(ov, q + m - ov)


def ani(containment: Column, ksize: Column) -> Column:
    """Average nucleotide identity from a containment: its k-th root, 0 and 1 kept exact."""
    return F.when(containment == 0, F.lit(0.0)).when(containment == 1, F.lit(1.0)).otherwise(F.pow(containment, F.lit(1.0) / ksize))


def angular(dot: Column, square_q: Column, square_m: Column) -> Column:
    """Angular similarity of two abundance vectors; held to [0, 1] against rounding."""
    cosine = ratio(dot, F.sqrt(square_q.cast("double")) * F.sqrt(square_m.cast("double")))
    return F.lit(1.0) - F.lit(2.0) * F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / F.pi()


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def plain_idf(n: Column, df: Column) -> Column:
    return F.log(n / df)


def ident(name: Column) -> Column:
    """The part of a name before the first space."""
    return F.substring_index(name, " ", 1)


def rounded(x: Column, digits: int) -> Column:
    """``F.round(x, digits)`` of doubles, to the same values; decimals are made only of values that lie next to a tie, or are negative or large."""
    wide = x * F.lit(10.0**digits)
    part = wide - F.floor(wide)
    plain = (wide >= 0) & (wide < 1e10) & (F.abs(part - 0.5) > 1e-4)
    return F.when(plain, F.floor(wide + 0.5) / F.lit(10.0**digits)).when(x == F.floor(x), x).otherwise(F.round(x, digits))

"""Numeric column functions: clips, discounts, dot products, losses and number text."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_double(x) -> Column:
    """Number, or NULL when the value cannot be read as one."""
    return _c(x).try_cast("double")


def clip_unit(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def clip_rating(x, fallback) -> Column:
    """Clip into the 1..5 scale; an undefined value takes the fallback."""
    x = _c(x)
    bounded = F.least(F.greatest(x, F.lit(1.0)), F.lit(5.0))
    return F.when(x.isNull() | F.isnan(x), _c(fallback)).otherwise(bounded)


def dot(u, v) -> Column:
    """Inner product of two numeric arrays."""
    prods = F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def cosine(u, v) -> Column:
    """Cosine of two arrays clipped to [0, 1]; 0 when either is all zeros."""
    norm = F.sqrt(dot(u, u) * dot(v, v))
    return F.when(norm > 0, clip_unit(dot(u, v) / norm)).otherwise(F.lit(0.0))


def damped(raw, count) -> Column:
    """Score divided by log2(2 + rating count)."""
    return _c(raw) / F.log2(F.lit(2.0) + _c(count))


def rank_discount(rank) -> Column:
    return F.lit(1.0) / F.log2(_c(rank) + F.lit(1.0))


def ideal_dcg(n_relevant, k: int) -> Column:
    """Best reachable DCG for a user with ``n_relevant`` relevant items in a list of ``k``."""
    total, table = 0.0, [0.0]
    for i in range(1, k + 1):
        total += 1.0 / math.log2(i + 1)
        table.append(total)
    pos = F.least(_c(n_relevant), F.lit(k)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in table]), pos)


def f_measure(p, r) -> Column:
    p, r = _c(p), _c(r)
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def mean_or_zero(x) -> Column:
    return F.coalesce(F.avg(_c(x)), F.lit(0.0))


def log_sigmoid_loss(pos, neg) -> Column:
    """Pairwise logistic ranking loss of one (positive, negative) score pair."""
    return -F.log(F.lit(1.0) / (F.lit(1.0) + F.exp(_c(neg) - _c(pos))) + F.lit(1e-10))


def hinge_loss(pos, neg, weight=1.0) -> Column:
    """Rank-weighted margin loss of one score pair."""
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else _c(weight)
    return w * F.greatest(F.lit(1.0) - _c(pos) + _c(neg), F.lit(0.0))


def ratio_text(num, den) -> Column:
    """A ratio of counts as text with two decimals, in integer arithmetic.

    Number formatting rounds ties differently from engine to engine; counts do not.
    """
    num, den = _c(num).cast("long"), _c(den).cast("long")
    hundredths = F.expr("0L") + F.floor((F.lit(200) * num + den) / (F.lit(2) * den))
    whole = F.floor(hundredths / F.lit(100)).cast("long").cast("string")
    frac = F.lpad((hundredths % F.lit(100)).cast("long").cast("string"), 2, "0")
    return F.concat(whole, F.lit("."), frac)

"""Scalar expressions of the feature and metric operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import EPS, NULL_TOKENS


def null_tokens(c: Column) -> Column:
    """Null for the strings that stand for null."""
    return F.when(~c.isin(NULL_TOKENS), c)


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p.cast("double"), eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log1p_float(x: Column) -> Column:
    """log(1 + x) taken in double precision and kept in single precision."""
    return F.log1p(x.cast("double")).cast("float")


def any_true(*conditions: Column) -> Column:
    """Whether any condition holds; an unknown one doesn't."""
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])


def invalid_probability(p: Column) -> Column:
    x = p.cast("double")
    return F.isnan(x) | (x < 0) | (x > 1)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def fold(key: Column, folds: int) -> Column:
    """Fold of a whole number: its product with the multiplier modulo 2^64, modulo ``folds``.

    The product is taken in two halves of 32 bits, so it is exact for any long without
    unsigned types: with m = a 2^32 + b and key = c 2^32 + d, the product modulo 2^64 is
    ((a d + b c) mod 2^32) 2^32 + b d.
    """
    multiplier = 11400714819323198485
    big = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    half = big(1 << 32)
    a, b = big(multiplier >> 32), big(multiplier & 0xFFFFFFFF)
    c = F.shiftrightunsigned(key.cast("long"), 32).cast("decimal(10,0)")
    d = key.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(10,0)")
    high = ((a * d).cast("decimal(38,0)") + (b * c).cast("decimal(38,0)")) % half
    product = (high.cast("decimal(20,0)") * half).cast("decimal(38,0)") + (b * d).cast("decimal(38,0)")
    return ((product % big(1 << 64)) % F.lit(folds).cast("decimal(20,0)")).cast("int")

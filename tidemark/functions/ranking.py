"""Global ranks and prefix sums without a window over all rows.

Rows are put into buckets by a monotone function of the sort key; a bucket is ranked by
itself, and the sums of the buckets before it, a table of a bounded number of rows for each
segment, are added. Borders of buckets are quantiles of the data, so buckets are of like size
whatever the distribution. A value so common that it is a border has a bucket of its own, and
where a second key settles ties, that bucket is cut by quantiles of the key: a constant column
lands in many tasks. Buckets are a function of the data and not of how it is partitioned, so a
task that runs again gives the same ranks.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets by value, and by key where values are equal, about.
PARTS, KEY_PARTS = 1024, 64
_ACCURACY = 10_000
#: Bytes of a string, behind what all strings begin with, that tell its bucket.
TEXT_BYTES = 6


def _borders(found: list[float] | None) -> list[float]:
    """Borders that give each quantile a bucket of its own."""
    at = sorted({float(x) for x in found or [] if x is not None and math.isfinite(x)} or {0.0})
    own = sorted({y for x in at for y in (x, math.nextafter(x, math.inf))})
    return [-math.inf, *own, math.inf]


def _quantiles(x: Column, parts: int) -> Column:
    return F.percentile_approx(x, [i / parts for i in range(1, parts)], _ACCURACY)


def bucketed(df: DataFrame, value: Column, key: Column | None = None, name: str = "__bucket") -> DataFrame:
    """``df`` with a bucket that doesn't fall as (``value``, ``key``) rises; both are numbers.

    Reads ``df`` once for at most ``PARTS + KEY_PARTS`` quantiles. NaN comes last.
    """
    number, second = value.cast("double"), key.cast("double") if key is not None else F.lit(0.0)
    ends = df.agg(_quantiles(F.when(~F.isnan(number), number), PARTS).alias("v"), _quantiles(second, KEY_PARTS).alias("k")).first()
    borders = _borders(ends["v"])
    cut = lambda t, column, at, out: Bucketizer(splits=at, inputCol=column, outputCol=out, handleInvalid="keep").transform(t)
    tagged = cut(df.withColumn("__rank_x", number), "__rank_x", borders, "__rank_v")
    place = F.col("__rank_v").cast("long") * (2 * KEY_PARTS)
    if key is None:
        return tagged.withColumn(name, place).drop("__rank_x", "__rank_v")
    tagged = cut(tagged.withColumn("__rank_y", second), "__rank_y", _borders(ends["k"]), "__rank_k")
    alone = F.col("__rank_v").cast("long") % 2 == 1  # from a border to the next number there is
    return tagged.withColumn(name, place + F.when(alone, F.col("__rank_k").cast("long")).otherwise(F.lit(0))).drop("__rank_x", "__rank_v", "__rank_y", "__rank_k")


def common_prefix(low: str | None, high: str | None) -> int:
    """Bytes that all strings between two strings begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def text_number(s: Column, skip: Column | int = 0) -> Column:
    """The bytes of a string behind the first ``skip`` as a number that rises with the string."""
    begin = (skip if isinstance(skip, Column) else F.lit(skip)) * 2 + 1
    digits = F.substr(F.hex(F.encode(s, "UTF-8")), begin.cast("int"), F.lit(2 * TEXT_BYTES))
    return F.conv(F.rpad(digits, 2 * TEXT_BYTES, "0"), 16, 10).cast("long")


def prefix_sums(df: DataFrame, order: list, sums: dict[str, Column], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``df``, which has a ``__bucket``, with a column for each of ``sums``: its sum over all
    rows before this one.

    ``order`` is consistent with the bucket (falling with it if ``descending``) and decides
    fully; ``by`` are segments with sums of their own.
    """
    by = by or []
    totals = df.groupBy(*by, "__bucket").agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    turn = F.desc("__bucket") if descending else F.asc("__bucket")
    before = Window.partitionBy(*by).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*by, "__bucket", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__a_{n}") for n in sums])
    own = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select("*", *[F.coalesce(F.sum(e).over(own), F.lit(0)).alias(f"__o_{n}") for n, e in sums.items()])
    joined = inner.join(ahead, [*by, "__bucket"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__a_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def global_rank(df: DataFrame, value: Column, order: list, name: str = "rank", by: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """``df`` with a row number from 0 in the order given, which begins with ``value`` and, if
    there is one, ``key``."""
    return prefix_sums(bucketed(df, value, key), order, {name: F.lit(1).cast("long")}, by).drop("__bucket")

"""Aggregates whose definitions differ from the built-in ones of like name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import bucketed, prefix_sums
from tidemark.sources.scratch import keep


def n_unique(c: Column) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def null_count(c: Column) -> Column:
    return F.count_if(c.isNull())


def rate(condition: Column) -> Column:
    """Share of rows where the condition holds, of those where it is known."""
    return F.avg(condition.cast("int"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)).cast("double"))


def quantiles(df: DataFrame, column: str, nearest: list[float], by: list[str] | None = None, median: bool = False) -> DataFrame:
    """Quantiles by the nearest of the sorted values: index round(q (n - 1)), halves up.

    One row for each combination of ``by`` with a value, columns ``q_<percent>``; with
    ``median`` the mean of the two middle values, too. Values are counted first and counts summed
    up in buckets, so no task sees all rows or all distinct values.
    """
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    counts = keep(counts, "value-counts")
    ranked = prefix_sums(bucketed(counts, F.col("__v")), [F.col("__v")], {"__before": F.col("__n")}, by)
    sizes = counts.withColumn("__one", F.lit(1)).groupBy("__one", *by).agg(F.sum("__n").alias("__total"))  # a row for each segment
    sized = ranked.withColumn("__one", F.lit(1)).join(F.broadcast(sizes), ["__one", *by])
    at = lambda place: F.min(F.when(F.col("__before") + F.col("__n") > place, F.col("__v")))
    last = F.col("__total") - 1
    picks = [at(F.floor(q * last + 0.5)).alias(f"q_{round(q * 100)}") for q in nearest]
    if median:
        picks.append(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median"))
    return sized.groupBy(*by).agg(*picks) if by else sized.agg(*picks)

"""Ranking, probability and calibration metrics of predictions.

Every function takes a table with ``clk`` (0 or 1) and ``prediction`` and optional segment
columns in ``by``. Rankings run over distinct scores, in buckets; no window sees all rows.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import bucketed, global_rank, prefix_sums
from tidemark.functions.scalars import clip, invalid_probability, ratio
from tidemark.schemas import EPS
from tidemark.sources.scratch import keep


def _y() -> Column:
    return F.col("clk").cast("long")


def _p() -> Column:
    return F.col("prediction").cast("double")


def log_loss_term(y: Column, p: Column, eps: float = EPS) -> Column:
    q = clip(p.cast("double"), eps, 1 - eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def _scores(df: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(*by, _p().alias("score")).agg(F.sum(_y()).alias("pos"), F.sum(1 - _y()).alias("neg"))


def ranking_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``auc`` (ties count half) and ``average_precision``; null where a class is missing.

    Average precision is null without a positive row only.
    """
    by = by or []
    scores = bucketed(keep(_scores(df, by), "scores"), F.col("score"))
    rising = prefix_sums(scores, [F.col("score")], {"below": F.col("neg")}, by)
    falling = prefix_sums(rising, [F.desc("score")], {"pos_above": F.col("pos"), "all_above": F.col("pos") + F.col("neg")}, by, descending=True)
    hits = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("all_above") + F.col("pos") + F.col("neg"))
    return falling.groupBy(*by).agg(F.try_divide(hits, pairs).alias("auc"), F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos").cast("double")).alias("average_precision"))


def probability_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, clicks, rates, log loss (predictions clipped for it alone), Brier score, COPC and bias."""
    actual, mean = F.avg(_y()), F.avg(_p())
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.sum(_y()).alias("clicks"), actual.alias("actual_ctr"), mean.alias("mean_prediction"),
        F.avg(log_loss_term(_y(), _p())).alias("logloss"), F.avg((_p() - _y()) * (_p() - _y())).alias("brier"),
        ratio(actual, mean).alias("copc"), (100 * (ratio(mean, actual) - 1)).alias("bias_pct"),
    )


def metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Probability and ranking metrics, one row for each segment that occurs."""
    a, b = probability_metrics(df, by), ranking_metrics(df, by)
    if by:
        return a.join(b, by)
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def user_auc(df: DataFrame, user: str = "user_raw", by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC of each user with a click and a row without one.

    Average ranks come from counts of distinct scores within a user, so a heavy user's rows
    are summed before the window.
    """
    key = [*(by or []), user]
    order = Window.partitionBy(*key).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _scores(df, key).withColumn("tied", F.col("pos") + F.col("neg"))
    ranked = ranked.withColumn("rank", F.coalesce(F.sum("tied").over(order), F.lit(0)) + (F.col("tied") + 1) / 2.0)
    per_user = ranked.groupBy(*key).agg(F.sum("tied").alias("rows"), F.sum("pos").alias("positive_rows"), F.sum("neg").alias("negative_rows"), F.sum(F.col("pos") * F.col("rank")).alias("rank_sum"))
    auc = F.try_divide(F.col("rank_sum") - F.col("positive_rows") * (F.col("positive_rows") + 1) / 2.0, F.col("positive_rows").cast("double") * F.col("negative_rows"))
    return per_user.withColumn("user_auc", auc).drop("rank_sum")


def gauc(df: DataFrame, user: str = "user_raw", by: list[str] | None = None) -> DataFrame:
    """Mean of users' AUC weighted by their rows, and how many users and rows it covers."""
    ok = F.col("user_auc").isNotNull()
    n = F.col("rows")
    return user_auc(df, user, by).groupBy(*(by or [])).agg(
        F.try_divide(F.sum(F.when(ok, F.col("user_auc") * n)), F.sum(F.when(ok, n)).cast("double")).alias("gauc"),
        F.count("*").alias("total_users"), F.count_if(ok).alias("eligible_users"), F.avg(ok.cast("int")).alias("eligible_user_rate"),
        F.sum(n).alias("total_rows"), F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("eligible_rows"),
        F.try_divide(F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).cast("double"), F.sum(n).cast("double")).alias("eligible_row_coverage"),
    )


def equal_count_bins(df: DataFrame, bins: int = 10, key: str = "impression_id", by: list[str] | None = None) -> DataFrame:
    """``df`` with ``bin`` from 1: floor(rank bins / n) + 1 in the order of prediction and
    key, which is a number."""
    by = by or []
    ranked = global_rank(df, F.col("prediction"), [F.col("prediction"), F.col(key)], "__rank", by, F.col(key))
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    if by:
        sized = ranked.join(F.broadcast(sizes), by)  # a row for each segment
    else:
        sized = ranked.withColumn("__one", F.lit(1)).join(F.broadcast(sizes.withColumn("__one", F.lit(1))), "__one").drop("__one")
    return sized.withColumn("bin", (F.floor(F.col("__rank") * bins / F.col("__n")) + 1).cast("int")).drop("__rank", "__n")


def equal_width_bins(df: DataFrame, bins: int = 20, column: str = "prediction") -> DataFrame:
    """``df`` with ``bin`` from 1: floor(p bins) + 1 within the outer bins."""
    return df.withColumn("bin", (clip(F.floor(F.col(column).cast("double") * bins), 0, bins - 1) + 1).cast("int"))


def reliability(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, extreme and mean predictions, click rate and gap of each bin."""
    actual, mean = F.avg(_y()), F.avg(_p())
    return binned.groupBy(*(by or []), "bin").agg(
        F.count("*").alias("rows"), F.sum(_y()).alias("clicks"), F.min(_p()).alias("min_prediction"), F.max(_p()).alias("max_prediction"),
        mean.alias("mean_prediction"), actual.alias("actual_ctr"), F.abs(mean - actual).alias("gap"), ratio(actual, mean).alias("copc"),
    )


def calibration_error(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean gap of a reliability table, weighted by rows."""
    return table.groupBy(*(by or [])).agg(F.try_divide(F.sum(F.col("gap") * F.col("rows")), F.sum("rows").cast("double")).alias("ece"))


def known_in_train(df: DataFrame, train: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with a flag for each column of ``columns``: whether train has its value."""
    for column, name in columns.items():
        keys = train.select(F.col(column)).filter(F.col(column).isNotNull()).distinct().withColumn(name, F.lit(True))
        df = df.join(keys, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def cold_start_segment(user: Column, ad: Column) -> Column:
    return (
        F.when(user & ad, "known_user_known_ad").when(user, "known_user_new_ad").when(ad, "new_user_known_ad").otherwise("new_user_new_ad")
    )


def checked_join(predictions: DataFrame, context: DataFrame, key: str = "impression_id", probabilities: bool = True) -> DataFrame:
    """Predictions with their context, one row of each.

    Raises on a repeated key, a missing context or another label and, unless ``probabilities``
    is off because predictions are scores of any size, on a probability out of range.
    """
    right = context.withColumnRenamed("clk", "__clk")
    p, c = (d.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] for d in (predictions, context))
    if (p or 0) > 1 or (c or 0) > 1:
        raise ValueError(f"{key} isn't unique")
    joined = predictions.join(right, key, "left")
    bad, lost, other = joined.agg(
        F.count_if(F.col("prediction").isNull() | invalid_probability(F.col("prediction"))), F.count_if(F.col("__clk").isNull()), F.count_if(F.col("__clk") != F.col("clk"))
    ).first()
    for n, what in ((bad if probabilities else 0, "invalid predictions"), (lost, "rows without context"), (other, "rows with another label")):
        if n:
            raise ValueError(f"{n} {what}")
    return joined.drop("__clk")


def slice_diagnostics(df: DataFrame, slices: list[list[str]]) -> DataFrame:
    """Probability metrics for several groupings in one pass; ``slice`` and ``value`` name them."""
    arms = F.array(*[F.struct(F.lit("+".join(s) or "overall").alias("slice"), F.concat_ws("|", *[F.col(c).cast("string") for c in s]).alias("value")) for s in slices])
    long = df.select("clk", "prediction", F.explode(arms).alias("s")).select("clk", "prediction", "s.slice", "s.value")
    return probability_metrics(long, ["slice", "value"])


def evidence_bucket(n: Column) -> Column:
    """Buckets of a count of past rows: none, below 10, below 100, more."""
    return F.when(n == 0, "0").when(n < 10, "1-9").when(n < 100, "10-99").otherwise("100+")


def bootstrap(df: DataFrame, rounds: int = 20, key: str = "impression_id", seed: int = 7) -> DataFrame:
    """``round`` and the metrics' mean prediction, click rate and log loss of resampled rows.

    Each row's weight in a round is a Poisson draw of mean 1 from a hash of its key, so rounds
    need no second copy of the table and come out the same however it is partitioned. Draws go
    as far as 53 bits of a hash can tell, which is 17.
    """
    draws = F.array(*[F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), F.lit(r)), 11) / float(1 << 53) for r in range(rounds)])
    terms = [math.exp(-1) / math.factorial(k) for k in range(20)]
    steps = [x for x in accumulate(terms) if x < 1 - 2.0**-53]  # probabilities of a draw of at most 0, 1, ...
    weight = sum([(F.col("u") >= F.lit(s)).cast("int") for s in steps[1:]], (F.col("u") >= F.lit(steps[0])).cast("int"))
    rows = df.select("clk", "prediction", F.posexplode(draws).alias("round", "u")).withColumn("w", weight).filter("w > 0")
    w = F.col("w")
    mean = lambda x: F.sum(x * w) / F.sum(w)
    return rows.groupBy("round").agg(F.sum(w).alias("rows"), mean(_y()).alias("actual_ctr"), mean(_p()).alias("mean_prediction"), mean(log_loss_term(_y(), _p())).alias("logloss"))

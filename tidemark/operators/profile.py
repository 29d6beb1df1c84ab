"""Profiles of raw tables, splits and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.aggregates import n_unique, null_count, quantiles, rate
from tidemark.functions.timeparts import beijing_date
from tidemark.schemas import BTAGS, PRICE_SENTINEL


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    """A one-row table as ``stat``, ``value``."""
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.stat", "x.value")


def raw_stats(sample: DataFrame, ads: DataFrame, users: DataFrame, log: DataFrame) -> DataFrame:
    """``tbl``, ``stat``, ``value``: sizes, ranges and violations of the four raw tables."""
    c = F.col
    parts = {
        "raw_sample": sample.agg(F.count("*").alias("rows"), n_unique(c("user")).alias("users"), n_unique(c("adgroup_id")).alias("ads"), F.min("time_stamp").alias("min_ts"), F.max("time_stamp").alias("max_ts"), F.avg("clk").alias("ctr"), F.count_if(~c("clk").isin(0, 1)).alias("bad_clk"), F.count_if(c("clk") + c("nonclk") != 1).alias("bad_sum")),
        "ad_feature": ads.agg(F.count("*").alias("rows"), n_unique(c("adgroup_id")).alias("ads"), n_unique(c("brand")).alias("brands"), null_count(c("brand")).alias("null_brand"), F.min("price").alias("min_price"), F.max("price").alias("max_price")),
        "user_profile": users.agg(F.count("*").alias("rows"), n_unique(c("userid")).alias("users"), null_count(c("pvalue_level")).alias("null_pvalue"), null_count(c("new_user_class_level")).alias("null_class")),
        "behavior_log": log.agg(F.count("*").alias("rows"), n_unique(c("user")).alias("users"), F.min("time_stamp").alias("min_ts"), F.max("time_stamp").alias("max_ts"), F.count_if(~c("btag").isin(BTAGS)).alias("bad_btag")),
    }
    out = None
    for name, wide in parts.items():
        rows = _long(wide, wide.columns).select(F.lit(name).alias("tbl"), "stat", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def price_profile(ads: DataFrame) -> DataFrame:
    """Prices with and without the sentinel, with exact quantiles of the clean ones."""
    clean = ads.filter(F.col("price") != PRICE_SENTINEL)
    whole = ads.agg(F.count("*").alias("rows"), null_count(F.col("price")).alias("null_price"), F.count_if(F.col("price") == PRICE_SENTINEL).alias("sentinels"), n_unique(F.col("brand")).alias("brands"))
    some = clean.agg(F.min("price").alias("min"), F.avg("price").alias("mean"), F.max("price").alias("max"))
    places = quantiles(clean, "price", [0.01, 0.25, 0.75, 0.95, 0.99], median=True)
    out = None
    for wide in (whole, some, places):
        rows = _long(wide, wide.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The commonest values, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature``, ``value``, ``n`` of several columns in one pass."""
    arms = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(arms).alias("x")).groupBy("x.feature", "x.value").agg(F.count("*").alias("n"))


def date_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy(beijing_date(F.col("time_stamp")).alias("event_date_bj")).agg(F.count("*").alias("n"))


def window_split(log: DataFrame, start, end) -> DataFrame:
    """Rows before, within and after a range of Beijing dates, the end left out."""
    day = beijing_date(F.col("time_stamp"))
    part = F.when(day < F.lit(start), "before").when(day >= F.lit(end), "after").otherwise("within")
    return log.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def split_summary(base: DataFrame) -> DataFrame:
    return base.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.col("clk").cast("long")).alias("clicks"), F.avg("clk").alias("ctr"), F.min("event_date_bj").alias("first_date"), F.max("event_date_bj").alias("last_date"))


def categorical_profile(base: DataFrame, features: list[str], splits: list[str], train: str = "train") -> DataFrame:
    """For each feature and split: nulls, distinct values, and what train didn't have.

    Values are counted first, and an unseen value is one whose count in train is missing: one
    aggregation over (feature, value) in place of lists of values and joins.
    """
    arms = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features])
    counts = base.filter(F.col("split").isin(splits)).select("split", F.explode(arms).alias("x")).groupBy("x.feature", "x.value", "split").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("feature", "value")
    marked = counts.withColumn("seen", F.max((F.col("split") == train).cast("int")).over(whole) == 1)
    known = F.col("value").isNotNull()
    unseen = known & ~F.col("seen")
    total = F.sum("n")
    lost = F.coalesce(F.sum(F.when(unseen | ~known, F.col("n"))), F.lit(0))
    return marked.groupBy("feature", "split").agg(
        total.alias("rows"), F.count_if(known).alias("uniques"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(unseen, F.col("n"))), F.lit(0)).alias("unseen_rows"), F.count_if(unseen).alias("unseen_uniques"), (lost / total).alias("unknown_rate"),
    )


def numeric_profile(base: DataFrame, columns: list[str], by: str = "split") -> DataFrame:
    """Nulls, moments and exact quantiles of several columns in one pass over (feature, value)."""
    arms = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = base.select(by, F.explode(arms).alias("x")).select(by, "x.feature", "x.value")
    plain = long.groupBy("feature", by).agg(null_count(F.col("value")).alias("nulls"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return plain.join(quantiles(long, "value", [0.95, 0.99], ["feature", by], median=True), ["feature", by], "left")


def coverage(features: DataFrame, flags: list[str], by: str = "split") -> DataFrame:
    return features.groupBy(by).agg(F.count("*").alias("rows"), *[rate(F.col(f).cast("int") == 1).alias(f"coverage_{f.removeprefix('has_')}") for f in flags])


def past_coverage(past: DataFrame, entities: list[str], by: list[str]) -> DataFrame:
    return past.groupBy(*by).agg(F.count("*").alias("rows"), *[rate(F.col(f"{n}_has_past_feedback")).alias(f"coverage_{n}_past_feedback") for n in entities])


def history_profile(past: DataFrame, entities: list[str], weight: float = 100.0, by: str = "split") -> DataFrame:
    """Evidence behind each entity's past rate: coverage, quantiles of the number of past
    impressions n with and without zeros, share below 100, and mean of n / (n + weight)."""
    arms = F.array(*[F.struct(F.lit(n).alias("entity"), F.col(f"{n}_past_impressions").alias("n")) for n in entities])
    long = past.select(by, F.explode(arms).alias("x")).select(by, "x.entity", "x.n")
    keys, has = ["entity", by], F.col("n") > 0
    plain = long.groupBy(*keys).agg(
        F.count("*").alias("rows"), rate(has).alias("coverage"), F.max("n").alias("max"), rate(F.col("n") < 100).alias("below_100"),
        F.avg(F.col("n") / (F.col("n") + weight)).alias("mean_own_weight"),
    )
    present = quantiles(long.filter(has), "n", [], keys, median=True).withColumnRenamed("median", "median_if_present")
    return plain.join(quantiles(long, "n", [0.9, 0.99], keys, median=True), keys).join(present, keys, "left")


def unknown_rates(inputs: DataFrame, indices: list[str], by: str = "split") -> DataFrame:
    return inputs.groupBy(by).agg(F.count("*").alias("rows"), *[rate(F.col(i) == 1).alias(f"unknown_{i}") for i in indices])


def importance_shares(table: DataFrame, value: str = "gain") -> DataFrame:
    """Feature importances with their share of the whole, largest first; a row a feature."""
    return table.withColumn("share", F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy()))).orderBy(F.desc(value), "feature")

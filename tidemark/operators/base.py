"""Impressions joined to ads and profiles, with their times and split."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import beijing_time, iso_weekday, split_of, utc_time
from tidemark.schemas import PRICE_SENTINEL, PROFILE

#: Bytes of a side, as Spark's statistics have it, up to which a join is told to broadcast it.
BROADCAST_BYTES = 64 << 20


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its plan's size estimate is within the limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def require_unique(df: DataFrame, key: str) -> None:
    """Raises if a key occurs twice; partial sums are combined before they are shuffled."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"{key} isn't unique")


def clean_ads(ads: DataFrame, check: bool = False) -> DataFrame:
    """Ads with raw ids and prices without the sentinel.

    ``price_is_sentinel`` is null where the price is null; ``log_price`` is log(1 + price) in
    single precision.
    """
    if check:
        require_unique(ads, "adgroup_id")
    sentinel = F.col("price") == PRICE_SENTINEL
    clean = F.when(sentinel, None).otherwise(F.col("price"))
    return ads.select(
        F.col("adgroup_id").alias("adgroup_id_raw"), F.col("cate_id").alias("cate_id_raw"), F.col("campaign_id").alias("campaign_id_raw"),
        F.col("customer").alias("customer_raw"), F.col("brand").alias("brand_raw"), F.col("price").alias("price_raw"),
        sentinel.cast("int").alias("price_is_sentinel"), F.col("brand").isNull().cast("int").alias("brand_is_missing"),
        clean.alias("price_clean"), F.log1p(clean).cast("float").alias("log_price"),
    )


def clean_users(users: DataFrame, check: bool = False) -> DataFrame:
    if check:
        require_unique(users, "userid")
    return users.select(F.col("userid").alias("user_raw"), *[F.col(c).cast("int").alias(c) for c in PROFILE], F.lit(1).alias("has_profile"))


def base_table(sample: DataFrame, ads: DataFrame, users: DataFrame, train: tuple[date, date], val: date, test: date) -> DataFrame:
    """One row for each impression: ad and profile fields are null where there is none."""
    utc = utc_time(F.col("time_stamp"))
    impressions = sample.select(
        "impression_id", F.col("user").alias("user_raw"), "time_stamp", F.col("adgroup_id").alias("adgroup_id_raw"), F.col("pid").alias("pid_raw"), F.col("clk").cast("int").alias("clk")
    )
    timed = (
        impressions.join(if_small(clean_ads(ads)), "adgroup_id_raw", "left")
        .join(if_small(clean_users(users)), "user_raw", "left")
        .withColumn("has_profile", F.coalesce("has_profile", F.lit(0)))
        .withColumn("event_time_utc", utc)
        .withColumn("event_time_bj", beijing_time(F.col("event_time_utc")))
        .withColumn("event_date_bj", F.col("event_time_bj").cast("date"))
    )
    return timed.withColumns({"hour": F.hour("event_time_bj"), "day_of_week": iso_weekday(F.col("event_date_bj")), "split": split_of(F.col("event_date_bj"), train, val, test)})


def without_cold_entities(base: DataFrame) -> DataFrame:
    """Test rule: some users and ads don't occur in train, so that later splits have unseen ones."""
    cold = (F.col("split") == "train") & ((F.col("user_raw") % 10 == 7) | (F.col("adgroup_id_raw") % 10 == 3))
    return base.filter(~cold)

"""Daily behaviour, trailing windows over it, and their join to impressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeparts import beijing_date, midnight, midnight_epoch
from tidemark.schemas import BTAGS, COUNTS, HISTORY_FLAGS, METRICS, RECENCIES, WINDOWS


def daily_behavior(log: DataFrame, start: date, end: date) -> DataFrame:
    """Events of each user and Beijing date from ``start`` up to, not including, ``end``.

    The bounds are plain epoch seconds, so they reach the scan; tags outside the domain drop.
    """
    count = lambda tag: F.count_if(F.col("btag") == tag).alias(f"{tag}_count")
    return (
        log.filter((F.col("time_stamp") >= midnight(start)) & (F.col("time_stamp") < midnight(end)) & F.col("btag").isin(BTAGS))
        .select(F.col("user").alias("user_raw"), "time_stamp", "btag", beijing_date(F.col("time_stamp")).alias("event_date_bj"))
        .groupBy("user_raw", "event_date_bj")
        .agg(
            F.count("*").alias("event_count"), *[count(t) for t in BTAGS], F.max("time_stamp").alias("last_event_timestamp"),
            F.max(F.when(F.col("btag") == "buy", F.col("time_stamp"))).alias("last_buy_timestamp"),
        )
    )


def target_keys(daily: DataFrame, targets: list[date]) -> DataFrame:
    """User and target date of everyone with behaviour in the 14 days before a target date."""
    days = F.array(*[F.lit(d) for d in targets])
    near = F.filter(days, lambda d: (F.date_add("event_date_bj", 1) <= d) & (d <= F.date_add("event_date_bj", max(WINDOWS))))
    return daily.select("user_raw", F.explode(near).alias("event_date_bj")).distinct()


def behavior_windows(daily: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key with history: sums over the 1, 3, 7 and 14 days before its date.

    Keys and daily rows are put together and all frames run over one sort of a user's days;
    the date itself is left out of every frame. A key without behaviour in 14 days has no row.
    """
    sums = [f"{m}_count" for m in METRICS]
    both = daily.select("user_raw", "event_date_bj", *sums, "last_event_timestamp", "last_buy_timestamp", F.lit(False).alias("is_key")).unionByName(
        keys.select("user_raw", "event_date_bj").filter("user_raw IS NOT NULL").distinct().withColumn("is_key", F.lit(True)), allowMissingColumns=True
    )
    by_day = Window.partitionBy("user_raw").orderBy("day")
    frame = lambda w: by_day.rangeBetween(-w, -1)
    most = frame(max(WINDOWS))
    start = midnight_epoch(F.col("event_date_bj"))
    since = lambda c: ((start - F.col(c)) / 86400).cast("float")
    return (
        both.withColumn("day", F.unix_date("event_date_bj"))
        .withColumns(
            {f"{m}_count_{w}d": F.coalesce(F.sum(f"{m}_count").over(frame(w)), F.lit(0)) for w in WINDOWS for m in METRICS}
            | {"last_event": F.max("last_event_timestamp").over(most), "last_buy": F.max("last_buy_timestamp").over(most)}
        )
        .filter("is_key AND last_event IS NOT NULL")
        .select(
            "user_raw", "event_date_bj", F.lit(1).alias(HISTORY_FLAGS[0]), (F.col("buy_count_14d") > 0).cast("int").alias(HISTORY_FLAGS[1]), *COUNTS,
            since("last_event").alias(RECENCIES[0]), since("last_buy").alias(RECENCIES[1]),
        )
    )


def window_lookup(daily: DataFrame, first: date, last: date) -> DataFrame:
    """The windows of every user with history, for each date of a range."""
    targets = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    return behavior_windows(daily, target_keys(daily, targets))


def attach_windows(base: DataFrame, windows: DataFrame) -> DataFrame:
    """Base rows with window features: counts and flags 0 without history, recencies null."""
    joined = base.join(windows, ["user_raw", "event_date_bj"], "left")
    return joined.fillna(0, [*HISTORY_FLAGS, *COUNTS])

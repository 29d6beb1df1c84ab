"""Daily behaviour as a stream: the batch aggregation with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.timeparts import ZONE
from tidemark.schemas import BTAGS


def daily_behavior_stream(log: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Counts of each user and Beijing date; a date is final once ``lateness`` has passed it.

    Beijing is eight hours ahead of UTC throughout the years served, so its dates are days of
    UTC that begin at 16:00.
    """
    timed = log.filter(F.col("btag").isin(BTAGS)).withColumn("event_time", F.timestamp_seconds("time_stamp")).withWatermark("event_time", lateness)
    day = F.window("event_time", "1 day", "1 day", "16 hours")
    counted = timed.groupBy(F.col("user").alias("user_raw"), day.alias("day")).agg(
        F.count("*").alias("event_count"), *[F.count_if(F.col("btag") == t).alias(f"{t}_count") for t in BTAGS], F.max("time_stamp").alias("last_event_timestamp"),
        F.max(F.when(F.col("btag") == "buy", F.col("time_stamp"))).alias("last_buy_timestamp"),
    )
    return counted.withColumn("event_date_bj", F.from_utc_timestamp(F.col("day.start"), ZONE).cast("date")).drop("day")


def write_daily(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends final dates to a Parquet table, each date once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy("event_date_bj")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Recent behaviour of a user as a sequence, from completed dates alone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import beijing_date, midnight
from tidemark.schemas import BTAGS, WINDOWS


def daily_sequences(log: DataFrame, start: date, end: date, most: int = 50) -> DataFrame:
    """``user_raw``, ``event_date_bj``, ``events``: the last ``most`` tags of each day with their times.

    Only a bounded tail of a day is kept, so a row stays small for the busiest user.
    """
    from pyspark.sql import Window

    rows = log.filter((F.col("time_stamp") >= midnight(start)) & (F.col("time_stamp") < midnight(end)) & F.col("btag").isin(BTAGS))
    rows = rows.select(F.col("user").alias("user_raw"), beijing_date(F.col("time_stamp")).alias("event_date_bj"), "time_stamp", "btag")
    order = Window.partitionBy("user_raw", "event_date_bj").orderBy(F.desc("time_stamp"), F.desc("btag"))
    last = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return last.groupBy("user_raw", "event_date_bj").agg(F.sort_array(F.collect_list(F.struct("time_stamp", "btag"))).alias("events"))


def attach_sequences(base: DataFrame, sequences: DataFrame, most: int, days: int = max(WINDOWS)) -> DataFrame:
    """Base rows with ``sequence``: the last ``most`` tags of the ``days`` before their date."""
    keys = base.select("user_raw", "event_date_bj").distinct()
    past = sequences.select("user_raw", F.col("event_date_bj").alias("day"), "events")
    # a row for each day looked back to, so that both columns are keys of the join
    wanted = keys.withColumn("day", F.explode(F.sequence(F.date_sub("event_date_bj", days), F.date_sub("event_date_bj", 1))))
    near = wanted.join(past, ["user_raw", "day"])
    joined = near.groupBy("user_raw", "event_date_bj").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("day", "events"))), lambda x: x["events"])).alias("events"))
    tail = F.slice("events", F.greatest(F.size("events") - most + 1, F.lit(1)), most)
    found = joined.select("user_raw", "event_date_bj", F.transform(tail, lambda x: x["btag"]).alias("sequence"))
    out = base.join(found, ["user_raw", "event_date_bj"], "left")
    return out.withColumn("sequence", F.coalesce("sequence", F.array().cast("array<string>")))

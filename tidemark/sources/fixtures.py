"""The shared test tables in the shape of the raw click tables.

Nulls, the price sentinel, missing profiles and unseen entities aren't in those tables; fixed
rules put them in, the same here and in the SQL of :mod:`tidemark.plans.oracle`.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeparts import epoch_seconds
from tidemark.schemas import PRICE_SENTINEL

TRAIN = (date(2024, 1, 15), date(2024, 1, 28))
VAL, TEST = date(2024, 1, 29), date(2024, 1, 30)
#: Beijing dates of behaviour that count, the end left out.
BEHAVIOR = (date(2024, 1, 1), date(2024, 1, 31))
SPLITS = ["train", "val", "test"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("time_stamp", epoch_seconds(F.col("ts")))


def raw_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions: views and clicks. ``impression_id`` and a ``prediction`` come with them."""
    clicked = (F.col("event_type") == "click").cast("int")
    return (
        _events(spark, sf_dir)
        .filter(F.col("event_type").isin("view", "click"))
        .select(
            F.col("event_id").alias("impression_id"), F.col("user_id").alias("user"), "time_stamp", F.col("k").alias("adgroup_id"),
            F.when(F.col("event_id") % 3 == 0, "P1").otherwise("P2").alias("pid"), (1 - clicked).alias("nonclk"), clicked.alias("clk"),
            (F.floor(F.col("value") / 600 * 10000 + 0.5) / 10000).alias("prediction"),
        )
    )


def behavior_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; ``error`` is a tag outside the domain."""
    names = {"view": "pv", "click": "cart", "signup": "fav", "purchase": "buy"}
    tag = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("user"), "time_stamp", F.coalesce(F.try_element_at(tag, F.col("event_type")), F.col("event_type")).alias("btag"),
        F.col("k").alias("cate"), (F.col("k") % 7).alias("brand"),
    )


def ad_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.col("p_partkey").alias("adgroup_id"), F.col("p_type").alias("cate_id"), F.col("p_size").cast("long").alias("campaign_id"),
        (F.col("p_partkey") % 17).alias("customer"), F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("brand"),
        F.when(F.col("p_size") == 50, F.lit(PRICE_SENTINEL)).otherwise(F.col("p_retailprice")).alias("price"),
    )


def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a balance of 0 or more; the others' profiles are missing."""
    key = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal >= 0")
    return c.select(
        key.alias("userid"), F.col("c_nationkey").cast("long").alias("cms_segid"), (F.col("c_nationkey") % 13).cast("long").alias("cms_group_id"),
        (key % 2 + 1).alias("final_gender_code"), (key % 7).alias("age_level"), F.nullif(key % 4, F.lit(0)).cast("double").alias("pvalue_level"),
        (key % 3 + 1).alias("shopping_level"), (key % 2).alias("occupation"), F.nullif(key % 5, F.lit(0)).cast("double").alias("new_user_class_level"),
    )

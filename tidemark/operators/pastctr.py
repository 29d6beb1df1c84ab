"""Click rates of earlier dates, of all impressions and of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import BROADCAST_BYTES
from tidemark.schemas import ENTITIES, PRIOR_CTR, PRIOR_WEIGHT
from tidemark.sources.scratch import keep

#: Bytes of a lookup's row in a broadcast, about.
LOOKUP_ROW = 128


def global_lookup(impressions: DataFrame, prior: float = PRIOR_CTR) -> DataFrame:
    """For each date the impressions, clicks and click rate of all dates before it."""
    daily = impressions.groupBy("event_date_bj").agg(F.count("*").alias("n"), F.sum(F.col("clk").cast("long")).alias("c"))
    before = Window.orderBy("event_date_bj").rowsBetween(Window.unboundedPreceding, -1)  # a row for each date
    past = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    rate = F.when(F.col("i") > 0, F.try_divide(F.col("k").cast("double"), F.col("i").cast("double"))).otherwise(F.lit(prior))
    return daily.select("event_date_bj", past("n").alias("i"), past("c").alias("k")).select(
        "event_date_bj", F.col("i").alias("global_past_impressions"), F.col("k").alias("global_past_clicks"), rate.cast("float").alias("global_past_ctr")
    )


def entity_lookup(impressions: DataFrame, overall: DataFrame, name: str, column: str, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """For each entity and date with impressions, its past clicks smoothed towards the overall rate.

    Daily sums come first, so a heavy entity has one row a date in the window.
    """
    daily = impressions.filter(F.col(column).isNotNull()).groupBy(column, "event_date_bj").agg(F.count("*").alias("n"), F.sum(F.col("clk").cast("long")).alias("c"))
    before = Window.partitionBy(column).orderBy("event_date_bj").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    joined = daily.select(column, "event_date_bj", past("n").alias("i"), past("c").alias("k")).join(F.broadcast(overall.select("event_date_bj", "global_past_ctr")), "event_date_bj", "left")
    smooth = (F.col("k") + weight * F.col("global_past_ctr").cast("double")) / (F.col("i") + weight)
    return joined.select(
        column, "event_date_bj", F.col("i").alias(f"{name}_past_impressions"), F.col("k").alias(f"{name}_past_clicks"),
        smooth.cast("float").alias(f"{name}_past_ctr"), (F.col("i") > 0).alias(f"{name}_has_past_feedback"),
    )


def entity_lookups(history: DataFrame, overall: DataFrame, entities: dict[str, str] = ENTITIES, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """The lookups of all entities from one pass: ``entity``, ``value`` as text, date, past
    impressions ``i`` and clicks ``k``, and the smoothed ``ctr``."""
    arms = F.array(*[F.struct(F.lit(n).alias("entity"), F.col(c).cast("string").alias("value")) for n, c in entities.items()])
    long = history.select("event_date_bj", "clk", F.explode(arms).alias("x")).select("x.entity", "x.value", "event_date_bj", "clk").filter("value IS NOT NULL")
    daily = long.groupBy("entity", "value", "event_date_bj").agg(F.count("*").alias("n"), F.sum(F.col("clk").cast("long")).alias("c"))
    before = Window.partitionBy("entity", "value").orderBy("event_date_bj").rowsBetween(Window.unboundedPreceding, -1)  # a row a date
    past = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    rated = daily.select("entity", "value", "event_date_bj", past("n").alias("i"), past("c").alias("k")).join(F.broadcast(overall.select("event_date_bj", "global_past_ctr")), "event_date_bj", "left")
    smooth = (F.col("k") + weight * F.col("global_past_ctr").cast("double")) / (F.col("i") + weight)
    return rated.select("entity", "value", "event_date_bj", "i", "k", smooth.cast("float").alias("ctr"))


def past_features(impressions: DataFrame, history: DataFrame | None = None, entities: dict[str, str] = ENTITIES) -> DataFrame:
    """Impressions with the global and all entities' past rates.

    ``history``, by default the impressions themselves, is what rates are taken from. An
    impression whose entity is null or new has no past: zero counts and the overall rate.

    The history is read twice, for the dates and for all entities together, whose lookups are
    written once. A lookup is broadcast if its number of rows, which is known then, is small;
    else rows with a null entity get keys that match nothing and lie apart, so they don't meet
    in one task, and a common key's rows may be split, as the lookup has a shuffle of its own.
    """
    history = impressions if history is None else history
    overall = keep(global_lookup(history), "overall")  # a row for each date
    lookups = keep(entity_lookups(history, overall, entities), "past-rates")
    sizes = {r["entity"]: r["count"] for r in lookups.groupBy("entity").count().collect()}  # a row for each entity
    out = impressions.join(F.broadcast(overall), "event_date_bj", "left")
    for name, column in entities.items():
        own = lookups.filter(F.col("entity") == name).select(F.col("value").alias("__value"), "event_date_bj", *[F.col(c).alias(f"__{c}") for c in ("i", "k", "ctr")])
        nowhere = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("impression_id"), F.lit(4093)).cast("string"))
        keyed = out.withColumn("__value", F.coalesce(F.col(column).cast("string"), nowhere))
        few = sizes.get(name, 0) * LOOKUP_ROW <= BROADCAST_BYTES
        out = keyed.join(F.broadcast(own) if few else own, ["__value", "event_date_bj"], "left")
        out = out.withColumns({
            f"{name}_past_impressions": F.coalesce("__i", F.lit(0)), f"{name}_past_clicks": F.coalesce("__k", F.lit(0)),
            f"{name}_past_ctr": F.coalesce("__ctr", "global_past_ctr"), f"{name}_has_past_feedback": F.coalesce(F.col("__i") > 0, F.lit(False)),
        }).drop("__value", "__i", "__k", "__ctr")
    return out


def feature_names(entities: dict[str, str] = ENTITIES) -> list[str]:
    parts = ["past_impressions", "past_clicks", "past_ctr", "has_past_feedback"]
    return ["global_past_impressions", "global_past_clicks", "global_past_ctr", *[f"{n}_{p}" for n in entities for p in parts]]

"""Audits: tables of checks with the number of rows that break each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import any_true, invalid_probability
from tidemark.schemas import BTAGS, COUNTS, METRICS, RECENCIES, WINDOWS
from tidemark.sources.tables import seeded


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``check``, ``violations``: rows for which each condition holds, in one pass; a condition
    that is unknown isn't broken."""
    wide = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(checks)])
    return wide.select(F.explode(rows).alias("x")).select("x.check", "x.violations")


def require_clean(report: DataFrame) -> None:
    """Raises if a check of the report is broken."""
    broken = report.filter("violations > 0").collect()  # a row for each check
    if broken:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in broken))


def repeated_keys(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each key, as a check."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def row_conservation(before: DataFrame, after: DataFrame, by: list[str], name: str) -> DataFrame:
    """Difference of row counts before and after a step, by segment."""
    a, b = before.groupBy(*by).agg(F.count("*").alias("a")), after.groupBy(*by).agg(F.count("*").alias("b"))
    gap = F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return a.join(b, by, "full").select(F.concat_ws("/", F.lit(name), *by).alias("check"), gap.alias("violations"))


def sample_checks(sample: DataFrame) -> DataFrame:
    return violations(sample, {"clk_not_binary": ~F.col("clk").isin(0, 1), "clk_nonclk_sum": F.col("clk") + F.col("nonclk") != 1})


def log_checks(log: DataFrame) -> DataFrame:
    return violations(log, {"unknown_btag": ~F.col("btag").isin(BTAGS), "null_user": F.col("user").isNull()})


def base_checks(base: DataFrame) -> DataFrame:
    return violations(base, {
        "missing_ad": F.col("cate_id_raw").isNull(), "hour_range": ~F.col("hour").between(0, 23), "weekday_range": ~F.col("day_of_week").between(1, 7),
        "sentinel_left": F.col("price_clean") >= 99999999, "profile_flag": F.col("has_profile") != F.col("cms_segid").isNotNull().cast("int"),
    })


def _sum(cols: list[str]) -> Column:
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out


def daily_checks(daily: DataFrame) -> DataFrame:
    return violations(daily, {
        "additivity": F.col("event_count") != _sum(["pv_count", "cart_count", "fav_count", "buy_count"]), "no_events": F.col("event_count") <= 0,
        "buy_without_time": (F.col("buy_count") > 0) != F.col("last_buy_timestamp").isNotNull(), "buy_after_last": F.col("last_buy_timestamp") > F.col("last_event_timestamp"),
    })


def window_checks(features: DataFrame) -> DataFrame:
    c = lambda m, w: F.col(f"{m}_count_{w}d")
    pairs = list(zip(WINDOWS, WINDOWS[1:]))
    return violations(features, {
        "additivity": any_true(*[c("event", w) != _sum([f"{m}_count_{w}d" for m in METRICS[1:]]) for w in WINDOWS]),
        "monotonicity": any_true(*[c(m, a) > c(m, b) for m in METRICS for a, b in pairs]),
        "negative": any_true(*[F.col(x) < 0 for x in COUNTS]),
        "recency_range": any_true(*[(F.col(r) < 0) | (F.col(r) > 14.0001) for r in RECENCIES]),
        "history_flag": any_true(F.col("has_behavior_history_14d") != (c("event", 14) > 0).cast("int"), F.col("has_buy_history_14d") != (c("buy", 14) > 0).cast("int")),
        "recency_without_history": any_true((F.col("has_behavior_history_14d") == 0) & F.col(RECENCIES[0]).isNotNull(), (F.col("has_buy_history_14d") == 0) & F.col(RECENCIES[1]).isNotNull()),
    })


def index_checks(inputs: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Encoded values lie from 1 to below the vocabulary's size; a fixed domain has no unknown."""
    checks = {f"{f}_range": any_true(F.col(f) < 1, F.col(f) >= n) for f, n in sizes.items()}
    return violations(inputs, checks | {"weekday_unknown": F.col("day_of_week_idx") == 1})


def feature_checks(inputs: DataFrame, columns: list[str]) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return violations(inputs, {f"{c}_not_finite": bad(c) for c in columns})


def past_checks(past: DataFrame, entities: list[str]) -> DataFrame:
    first = past.agg(F.min("event_date_bj")).first()[0]
    on_first = F.col("event_date_bj") == F.lit(first)
    rates = ["global_past_ctr", *[f"{n}_past_ctr" for n in entities]]
    counts = ["global_past_impressions", *[f"{n}_past_{p}" for n in entities for p in ("impressions", "clicks")]]
    return violations(past, {
        "rate_null_or_out_of_range": any_true(*[F.col(r).isNull() | invalid_probability(F.col(r)) for r in rates]),
        "clicks_above_impressions": any_true(*[F.col(f"{n}_past_clicks") > F.col(f"{n}_past_impressions") for n in entities]),
        "flag": any_true(*[F.col(f"{n}_has_past_feedback") != (F.col(f"{n}_past_impressions") > 0) for n in entities]),
        "history_on_first_date": on_first & any_true(*[F.col(c) != 0 for c in counts]),
    })


def hash_sample(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` keys of each ``by``, those with the smallest hash: the same however it is run."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(seeded(key, seed), key)
    return df.select(by, key).distinct().withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__r")


def identity_audit(table: DataFrame, lookup: DataFrame, keys: list[str], columns: list[str], sample: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """For each column the sampled rows whose value differs from the lookup's; two nulls agree."""
    a = table.join(sample, keys, "left_semi").select(*keys, *columns).distinct()
    b = lookup.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    both = a.join(b, keys, "left")
    differs = lambda c: ~F.coalesce(F.abs(F.col(c).cast("double") - F.col(f"__{c}").cast("double")) <= tolerance, F.col(c).isNull() & F.col(f"__{c}").isNull())
    return violations(both, {c: differs(c) for c in columns})

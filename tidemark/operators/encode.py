"""Train-only vocabularies, encoded model inputs, scaling and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.aggregates import quantiles
from tidemark.functions.ranking import common_prefix, global_rank, text_number
from tidemark.functions.scalars import log1p_float
from tidemark.operators.base import if_small
from tidemark.schemas import BINARY, CATEGORICAL, ENTITIES, FIRST_INDEX, FIXED_DOMAINS, MODEL_COUNTS, RECENCIES, RECENCY_FILL, UNKNOWN, index_name
from tidemark.sources.scratch import keep


def _fixed(spark: SparkSession, feature: str) -> DataFrame:
    low, high = min(FIXED_DOMAINS[feature]), max(FIXED_DOMAINS[feature])
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias(feature), (F.col("id") - low + FIRST_INDEX).alias("idx"))


def vocabularies(train: DataFrame, features: list[str] = CATEGORICAL) -> dict[str, DataFrame]:
    """``feature``, ``idx`` for each: distinct values that occur, numbered from 2 in their order.

    All come from one pass: values of all features are made distinct and ranked together, and
    what is found is kept for the joins to follow. Features with a fixed domain are numbered by
    it, whatever occurs. Features are whole numbers or strings.
    """
    learnt = [f for f in features if f not in FIXED_DOMAINS]
    out = {f: _fixed(train.sparkSession, f) for f in features if f in FIXED_DOMAINS}
    if learnt:
        types = {f: train.schema[f].dataType for f in learnt}
        text = lambda f: isinstance(types[f], T.StringType)
        null = F.lit(None)
        arms = [F.struct(F.lit(f).alias("feature"), (null if text(f) else F.col(f)).cast("long").alias("num"), (F.col(f) if text(f) else null).cast("string").alias("txt")) for f in learnt]
        values = keep(train.select(F.explode(F.array(*arms)).alias("x")).select("x.*").filter("num IS NOT NULL OR txt IS NOT NULL").distinct(), "values")
        ends = values.filter("txt IS NOT NULL").groupBy("feature").agg(F.min("txt").alias("a"), F.max("txt").alias("b")).collect()  # a row for each text feature
        skip = F.lit(0)
        for r in ends:
            skip = F.when(F.col("feature") == r["feature"], common_prefix(r["a"], r["b"])).otherwise(skip)
        number = F.when(F.col("num").isNull(), text_number(F.col("txt"), skip)).otherwise(F.col("num"))
        # joins are planned by the size it turns out to have
        ranked = keep(global_rank(values, number, [F.col("num"), F.col("txt")], "idx", ["feature"]), "vocabularies")
        for f in learnt:
            value = F.col("txt") if text(f) else F.col("num").cast(types[f])
            out[f] = ranked.filter(F.col("feature") == f).select(value.alias(f), (F.col("idx") + FIRST_INDEX).alias("idx"))
    return {f: out[f] for f in features}


def vocabulary_sizes(maps: dict[str, DataFrame]) -> dict[str, int]:
    """Indices of each feature, the two reserved ones among them, by one grouped count."""
    parts = None
    for f, m in maps.items():
        rows = m.select(F.lit(f).alias("feature"))
        parts = rows if parts is None else parts.unionByName(rows)
    found = {r["feature"]: r["count"] for r in parts.groupBy("feature").count().collect()}  # a row for each feature
    return {index_name(f): found.get(f, 0) + FIRST_INDEX for f in maps}


def vocabulary(train: DataFrame, feature: str) -> DataFrame:
    """The vocabulary of one feature, as a plan that isn't kept."""
    if feature in FIXED_DOMAINS:
        return _fixed(train.sparkSession, feature)
    values = train.filter(F.col(feature).isNotNull()).select(feature).distinct()
    number = F.col(feature)
    if isinstance(values.schema[0].dataType, T.StringType):
        number = text_number(number, common_prefix(*values.agg(F.min(feature), F.max(feature)).first()))
    ranked = global_rank(values, number, [F.col(feature)], "idx")
    return ranked.withColumn("idx", F.col("idx") + FIRST_INDEX)


def encode(df: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """``df`` with an index for each feature: 1 for null and for what train doesn't have.

    Small vocabularies are broadcast after a look at their size, larger ones joined by Spark's
    own choice; null never matches.
    """
    for feature, values in maps.items():
        df = df.join(if_small(values.select(feature, F.col("idx").alias(index_name(feature)))), feature, "left")
        df = df.withColumn(index_name(feature), F.coalesce(index_name(feature), F.lit(UNKNOWN)).cast("long"))
    return df


def train_median(train: DataFrame, column: str = "log_price") -> float | None:
    return quantiles(train, column, [], median=True).first()[0]


def model_input(features: DataFrame, maps: dict[str, DataFrame], price_fill: float | None) -> DataFrame:
    """Encoded categories, binaries and finished numerics of each impression."""
    encoded = encode(features, maps)
    return encoded.select(
        "impression_id", "event_date_bj", "clk", "split", *[index_name(f) for f in maps], *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in BINARY],
        F.coalesce("log_price", F.lit(price_fill).cast("float")).alias("log_price"), *[log1p_float(F.col(c)).alias(f"log1p_{c}") for c in MODEL_COUNTS],
        *[F.coalesce(c, F.lit(RECENCY_FILL)).cast("float").alias(c) for c in RECENCIES],
    )


def numeric_inputs() -> list[str]:
    return ["log_price", *[f"log1p_{c}" for c in MODEL_COUNTS], *RECENCIES]


def past_inputs(entities: dict[str, str] = ENTITIES) -> tuple[list[str], list[str]]:
    """Numeric and binary columns that past click rates add."""
    return ["global_past_ctr", *[c for n in entities for c in (f"{n}_past_ctr", f"{n}_past_impressions_log")]], [f"{n}_has_past_feedback" for n in entities]


def with_past(inputs: DataFrame, past: DataFrame, entities: dict[str, str] = ENTITIES) -> DataFrame:
    """Model inputs with past click rates, joined by impression; raw counts become logarithms."""
    finished = past.select(
        "impression_id", "global_past_ctr", *[F.col(f"{n}_past_ctr") for n in entities], *[log1p_float(F.col(f"{n}_past_impressions")).alias(f"{n}_past_impressions_log") for n in entities],
        *[F.col(f"{n}_has_past_feedback").cast("int").alias(f"{n}_has_past_feedback") for n in entities],
    )
    return inputs.join(finished, "impression_id", "left")


def scaler(train: DataFrame, columns: list[str], least: float = 1e-8) -> DataFrame:
    """``feature``, ``mean``, ``scale``: population deviation, 1 where it is next to nothing."""
    x = lambda c: F.col(c).cast("double")
    wide = train.agg(*[F.struct(F.avg(x(c)).alias("mean"), F.stddev_pop(x(c)).alias("dev")).alias(c) for c in columns])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["dev"].alias("dev")) for c in columns])).alias("x"))
    return long.select("x.feature", "x.mean", F.when(F.col("x.dev") < least, F.lit(1.0)).otherwise(F.col("x.dev")).alias("scale"))


def scaled(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Columns of ``stats`` centred and divided by their scale."""
    values = {r["feature"]: (r["mean"], r["scale"]) for r in stats.collect()}  # a row for each feature
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in values.items()})


def feature_set(which: str, exclude: list[str] | None = None) -> dict[str, list[str]]:
    """Columns of F1 (context), F1+F2 (and behaviour) or F1+F2+F3 (and past click rates).

    The weekday is left out by the protocol; names in ``exclude`` go too, unknown or repeated
    ones raise.
    """
    if which not in ("F1", "F1+F2", "F1+F2+F3"):
        raise ValueError(f"no feature set {which}")
    exclude = exclude or []
    categorical = [index_name(f) for f in CATEGORICAL]
    binary, numeric = [b for b in BINARY if not b.startswith("has_b")], ["log_price"]
    if which != "F1":
        binary, numeric = list(BINARY), numeric_inputs()
    if which == "F1+F2+F3":
        more, flags = past_inputs()
        numeric, binary = numeric + more, binary + flags
    known = {*categorical, *binary, *numeric}
    if len(set(exclude)) != len(exclude) or not set(exclude) <= known:
        raise ValueError(f"unknown or repeated names in {exclude}")
    gone = {*exclude, "day_of_week_idx"}
    keep = lambda cols: [c for c in cols if c not in gone]
    return {"categorical": keep(categorical), "binary": keep(binary), "numeric": keep(numeric)}


def one_hot_layout(spark: SparkSession, sizes: dict[str, int], dense: list[str]) -> DataFrame:
    """``feature``, ``offset``, ``size``: one block for each category, then the dense tail."""
    rows, at = [], 0
    for f, n in sizes.items():
        rows.append((f, at, n))
        at += n
    rows += [(c, at + i, 1) for i, c in enumerate(dense)]
    return spark.createDataFrame(rows, "feature string, offset long, size long")

"""Calibration after training: folds, Platt scaling, isotonic regression and the choice between them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, fold, logit
from tidemark.operators.metrics import equal_count_bins, log_loss_term, reliability
from tidemark.schemas import EPS
from tidemark.sources.scratch import keep


def selection_rows(df: DataFrame, folds: int = 5, key: str = "impression_id", chosen: bool = True) -> DataFrame:
    """Rows of fold 0 of a hash of the key, or the others."""
    mine = fold(F.col(key), folds) == 0
    return df.filter(mine if chosen else ~mine)


def fit_platt(df: DataFrame, c: float = 1e6):
    """Logistic regression on the logit of the prediction; a function from table to table."""
    rows = VectorAssembler(inputCols=["__z"], outputCol="__x").transform(df.select(F.col("clk").cast("double").alias("clk"), logit(F.col("prediction")).alias("__z")))
    n = rows.count()
    model = LogisticRegression(featuresCol="__x", labelCol="clk", regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(rows)
    w, b = float(model.coefficients[0]), float(model.intercept)
    return lambda t: t.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(w) * logit(F.col("prediction")) + F.lit(b)))))


def fit_isotonic(df: DataFrame):
    """Isotonic regression, ends held; a function from table to table."""
    rows = df.select(F.col("clk").cast("double").alias("label"), F.col("prediction").cast("double").alias("__x"))
    model = IsotonicRegression(featuresCol="__x", labelCol="label", isotonic=True).fit(rows)

    def apply(t: DataFrame) -> DataFrame:
        scored = model.setFeaturesCol("__x").setPredictionCol("__y").transform(t.withColumn("__x", F.col("prediction").cast("double")))
        return scored.withColumn("calibrated", clip(F.col("__y"), EPS, 1 - EPS)).drop("__x", "__y")

    return apply


CALIBRATORS = {"platt": fit_platt, "isotonic": fit_isotonic}


def mean_log_loss(df: DataFrame, column: str = "calibrated") -> float:
    return df.agg(F.avg(log_loss_term(F.col("clk").cast("long"), F.col(column)))).first()[0]


def select_calibrator(val: DataFrame, folds: int = 5) -> tuple[str, dict[str, float]]:
    """The kind with the least log loss on fold 0 when fitted on the others; both losses."""
    fit_on, judge_on = selection_rows(val, folds, chosen=False), selection_rows(val, folds)
    losses = {kind: mean_log_loss(fit(fit_on)(judge_on)) for kind, fit in CALIBRATORS.items()}
    return min(losses, key=losses.get), losses


def calibrate(val: DataFrame, test: DataFrame, folds: int = 5) -> DataFrame:
    """Test rows with ``raw_prediction``, ``calibrated_prediction`` and the ``calibrator`` that
    was chosen on validation and fitted again on all of it."""
    kind, _ = select_calibrator(val, folds)
    out = CALIBRATORS[kind](val)(test)
    return out.select("impression_id", "clk", F.col("prediction").alias("raw_prediction"), F.col("calibrated").alias("calibrated_prediction"), F.lit(kind).alias("calibrator"))


def predictions_of(stage: str, raw: DataFrame, calibrated: DataFrame | None = None) -> DataFrame:
    """The table to evaluate: raw predictions, or the calibrated ones of the test split."""
    if stage == "raw":
        return raw
    if stage != "calibrated" or calibrated is None:
        raise ValueError(f"no predictions of stage {stage}")
    return calibrated.select("impression_id", "clk", F.col("calibrated_prediction").alias("prediction"))


def reliability_of_stages(val: DataFrame, test: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability of test predictions as they are and Platt-scaled on validation, in equal-count
    bins of their own, with a column ``stage``."""
    made = keep(fit_platt(val)(test), "calibrated")
    out = None
    for stage, column in (("raw", "prediction"), ("calibrated", "calibrated")):
        rows = made.select("impression_id", "clk", F.col(column).alias("prediction"))
        table = reliability(equal_count_bins(rows, bins)).withColumn("stage", F.lit(stage))
        out = table if out is None else out.unionByName(table)
    return out


def probability(column: str = "probability"):
    return vector_to_array(F.col(column))[1]

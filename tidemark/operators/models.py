"""Models of click probability on Spark ML, grids over them, and the choice of a run.

The optimisers here are Spark's; :mod:`tidemark.operators.networks` has averaged gradient
descent and embeddings. Trees take categories of up to ``MOST_BINS`` values as they are; those
with more enter them as past click rates, as a categorical split of Spark needs a bin for every
value.
"""

from __future__ import annotations

import platform
from collections.abc import Callable
from typing import Any

import pyspark
from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.encode import scaled, scaler
from tidemark.operators.metrics import metrics
from tidemark.schemas import UNKNOWN
from tidemark.sources.tables import read_manifest, shuffled, write_manifest

SMOKE_ROWS = 10_000
#: Values of a category up to which trees split by it.
MOST_BINS = 256


def _features(columns: dict[str, list[str]], sizes: dict[str, int], one_hot: bool) -> list:
    dense = [*columns["binary"], *columns["numeric"]]
    if not one_hot:
        return [VectorAssembler(inputCols=[*sizes, *dense], outputCol="features", handleInvalid="keep")]
    names = [c for c in columns["categorical"] if c in sizes]
    hot = [f"{c}_hot" for c in names]
    return [OneHotEncoder(inputCols=names, outputCols=hot, dropLast=False, handleInvalid="keep"), VectorAssembler(inputCols=[*hot, *dense], outputCol="features")]


def neutral_unknown(df: DataFrame, indices: list[str], sizes: dict[str, int]) -> DataFrame:
    """Unknown values to an index past the vocabulary, whose one-hot column the encoder drops:
    they then add nothing to a score."""
    return df.withColumns({c: F.when(F.col(c) == UNKNOWN, F.lit(sizes[c])).otherwise(F.col(c)) for c in indices if c in sizes})


def estimator(kind: str, **params: Any):
    common = {"labelCol": "clk", "featuresCol": "features"}
    if kind == "lr":
        return LogisticRegression(**common, **({"regParam": 1e-7, "maxIter": 100, "standardization": False} | params))
    if kind == "gbt":
        return GBTClassifier(**common, **({"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42} | params))
    if kind == "fm":
        return FMClassifier(**common, **({"factorSize": 8, "maxIter": 60, "stepSize": 0.01, "seed": 42} | params))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(**common, **({"maxIter": 60, "seed": 42} | params))
    raise ValueError(f"no model {kind}")


def train(df: DataFrame, kind: str, columns: dict[str, list[str]], sizes: dict[str, int] | None = None, validation: DataFrame | None = None, **params: Any) -> Callable[[DataFrame], DataFrame]:
    """Fits on ``df``; gives a function that adds ``prediction`` to a table.

    Numerics are scaled by what ``df`` holds. ``sizes`` are vocabulary sizes with the two
    reserved indices, of the categories to encode one by one, or for trees to split by where
    there are at most ``MOST_BINS`` values; without them, and for perceptrons, categories stay
    out. Trees with a validation table stop when it no longer improves.
    """
    sizes = sizes or {}
    indices = [c for c in columns["categorical"] if c in sizes]
    stats = scaler(df, columns["numeric"])
    if kind in ("gbt", "mlp"):
        indices = [c for c in indices if kind == "gbt" and sizes[c] <= MOST_BINS]
        if indices:
            params = {"maxBins": max(32, *[sizes[c] for c in indices])} | params

        def ready(t: DataFrame) -> DataFrame:
            out = scaled(t, stats).withColumn("clk", F.col("clk").cast("double"))
            for c in indices:
                out = out.withColumn(c, F.col(c).cast("double")).withMetadata(c, {"ml_attr": {"type": "nominal", "name": c, "num_vals": sizes[c]}})
            return out
    else:
        ready = lambda t: neutral_unknown(scaled(t, stats), indices, sizes).withColumn("clk", F.col("clk").cast("double"))
    one_hot = kind in ("lr", "fm") and bool(indices)
    rows = ready(df)
    if kind == "gbt" and validation is not None:
        rows = rows.withColumn("__held", F.lit(False)).unionByName(ready(validation).withColumn("__held", F.lit(True)))
        params["validationIndicatorCol"] = "__held"
    if kind == "mlp":
        params.setdefault("layers", [len(columns["binary"]) + len(columns["numeric"]), 16, 8, 2])
    model = Pipeline(stages=[*_features(columns, {c: sizes[c] for c in indices}, one_hot), estimator(kind, **params)]).fit(rows)
    score = lambda t: model.transform(ready(t)).withColumn("__p", vector_to_array("probability")[1])

    def apply(t: DataFrame) -> DataFrame:
        return score(t).select("impression_id", F.col("clk").cast("int").alias("clk"), "split", F.col("__p").cast("float").alias("prediction"))

    apply.model, apply.dense = model.stages[-1], [*([] if one_hot else indices), *columns["binary"], *columns["numeric"]]
    return apply


def importances(apply: Callable) -> DataFrame:
    """``feature``, ``gain`` of a tree model's inputs."""
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(g)) for f, g in zip(apply.dense, apply.model.featureImportances.toArray())], "feature string, gain double")


def grid(run: Callable[..., DataFrame], configs: list[dict[str, Any]], done: Callable[[dict], bool] = lambda c: False) -> DataFrame:
    """Validation metrics of each configuration that isn't done; ``run`` gives its predictions.

    Predictions of the test split are refused: choices are made on validation alone.
    """
    out = None
    for i, config in enumerate(configs):
        if done(config):
            continue
        predictions = run(**config)
        if predictions.filter(F.col("split") == "test").limit(1).count():
            raise ValueError("a grid may not see the test split")
        row = metrics(predictions).withColumn("config", F.lit(i)).withColumn("params", F.lit(str(sorted(config.items()))))
        out = row if out is None else out.unionByName(row)
    return out


def refuse_left_predictions(spark: SparkSession, folder: str, split: str = "test") -> None:
    """Raises if a folder of tuning runs holds a file or folder named for the frozen split."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    wait = [path]
    while wait:
        for found in fs.listStatus(wait.pop()):
            if split in found.getPath().getName().lower():
                raise ValueError(f"{found.getPath()} is there before the {split} split may be seen")
            if found.isDirectory():
                wait.append(found.getPath())


def select_near_best(results: DataFrame, tolerance: float = 2e-4) -> DataFrame:
    """Best AUC among runs within ``tolerance`` of the least log loss; ties by log loss, config."""
    least = results.agg(F.min("logloss").alias("least"))
    near = results.withColumn("__one", F.lit(1)).join(least.withColumn("__one", F.lit(1)), "__one").filter(F.col("logloss") <= F.col("least") + tolerance)
    return near.drop("__one", "least").orderBy(F.desc("auc"), "logloss", "config").limit(1)


def select_least_loss(results: DataFrame, family: str | None = None) -> DataFrame:
    """The run with the least log loss, of each family if there are several."""
    from pyspark.sql import Window

    order = Window.partitionBy(*([family] if family else [])).orderBy("logloss", F.desc("auc"), "config")
    return results.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def smoke(df: DataFrame, key: str = "impression_id", rows: int = SMOKE_ROWS) -> DataFrame:
    """A fixed small part of a table, for trial runs whose name ends in ``_smoke``."""
    return shuffled(df, key, 0, rows)


def write_run(spark: SparkSession, path: str, kind: str, params: dict, columns: dict[str, list[str]], results: dict) -> None:
    """What a run was: versions, parameters, features and metrics."""
    versions = {"python": platform.python_version(), "spark": pyspark.__version__}
    write_manifest(spark, path, {"model": kind, "params": params, "columns": columns, "metrics": results, "versions": versions})


def read_run(spark: SparkSession, path: str) -> dict:
    return read_manifest(spark, path, ["model", "params", "columns", "metrics", "versions"])



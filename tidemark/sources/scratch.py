"""Tables that are written once and read several times, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder a cluster names in ``spark.checkpoint.dir``; where it is unset and the session
    runs in one JVM (tests), a temporary folder that is kept for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.scratch.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-scratch-")
        spark.conf.set("tidemark.scratch.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what follows doesn't compute it again, plans joins by the
    size it has, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Readers and writers: typed CSV, Parquet tables and folders, reports and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import null_tokens
from tidemark.schemas import RAW_SCHEMAS


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, tokens: bool = True) -> DataFrame:
    """CSV with a header and a stated schema; with ``tokens`` the strings NULL and null are null
    in every column (an empty field always is). A missing file raises before a job starts."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
    if not tokens:
        return spark.read.schema(wanted).option("header", True).csv(path)
    raw = spark.read.schema(text).option("header", True).csv(path)
    return raw.select(*[null_tokens(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in wanted])


def read_raw(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the four raw tables; names without blanks at their ends."""
    df = read_csv(spark, path, RAW_SCHEMAS[name])
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files, folders or globs; only ``columns`` are read."""
    df = spark.read.parquet(*paths)
    if columns is None:
        return df
    require_columns(df, columns)
    return df.select(*columns)


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def schema_differences(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """``frame``, ``column``, ``found``, ``wanted``: types that differ from the first frame's, null
    for a column that isn't there."""
    shapes = {name: {f.name: f.dataType.simpleString() for f in df.schema} for name, df in frames.items()}
    wanted = next(iter(shapes.values()))
    rows = [(name, c, shape.get(c), wanted.get(c)) for name, shape in shapes.items() for c in sorted({*shape, *wanted}) if shape.get(c) != wanted.get(c)]
    return spark.createDataFrame(rows, "frame string, column string, found string, wanted string")


def require_same_schema(frames: dict[str, DataFrame]) -> None:
    """All frames have the same names and types in the same order."""
    shapes = {name: [(f.name, f.dataType.simpleString()) for f in df.schema] for name, df in frames.items()}
    if len({str(s) for s in shapes.values()}) > 1:
        raise ValueError(f"schemas differ: {shapes}")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A Parquet dataset with zstd and statistics, as many files at once as there are tasks."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_parquet(frames: Iterable[DataFrame], path: str) -> int:
    """Writes frames one after another into one table, whose schema the first gives; their number.

    A frame with other columns or types raises before it is written.
    """
    first, n = None, 0
    for df in frames:
        if first is not None:
            require_same_schema({"first": first, f"frame {n}": df})
        write_parquet(df, path, mode="errorifexists" if first is None else "append")
        first, n = first or df, n + 1
    return n


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """A document as one line of JSON in a folder that any of Spark's stores may hold."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, required: list[str] | None = None) -> dict:
    """The document of :func:`write_manifest`; ``required`` keys must be there."""
    content = json.loads(spark.read.text(path).first()[0])
    missing = [k for k in required or [] if k not in content]
    if missing:
        raise ValueError(f"missing keys: {missing}")
    return content


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()


def seeded(key: str, seed: int) -> Column:
    """A sort key that any engine can compute: the MD5 sum of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int, most: int | None = None) -> DataFrame:
    """Rows in a seeded order, the same however they are partitioned; at most ``most``."""
    ordered = df.orderBy(seeded(key, seed), key)
    return ordered if most is None else ordered.limit(most)


def with_row_index(df: DataFrame, order: list[str], name: str = "impression_id") -> DataFrame:
    """Row numbers from 0 by a natural key: Spark's files have no order of their own.

    ``order`` begins with a number. Numbers within a bucket and the rows before it are added
    up, so no task sees all rows.
    """
    from tidemark.functions.ranking import global_rank

    return global_rank(df, F.col(order[0]), order, name)


def union_splits(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out

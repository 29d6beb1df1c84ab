"""Shared helpers: the scratch folder all executors see, and small column utilities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the documents: maximal runs of anything but space and the five ASCII control blanks.
#: ``bytes.split()`` splits on exactly these six bytes.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Translation table that lower-cases A-Z alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session
    runs in one JVM (tests) a temporary folder of this machine is made and kept for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("tidemark.scratch.dir", None)
        if not found:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="tidemark-scratch-")
            spark.conf.set("tidemark.scratch.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows depends on files that every executor can read, so a
    lost executor costs its running tasks and nothing that was finished.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table given by :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hash_split(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows out by ``cols`` over as many partitions as other shuffles use."""
    return df.repartition(shuffle_partitions(df.sparkSession), *[F.col(c) for c in cols])


def shared_file_system(uri: str):
    """File system and path of a folder in the shared store, for use in any process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def run_per_file(df: DataFrame, work, schema: str, files: int | None = None) -> DataFrame:
    """``mapInArrow`` with about as many tasks as there are rows, ``files`` of them; a row describes a file.

    The rows are few (a file each), so dealing them out costs nothing, and no task gets more
    than its share of files.
    """
    n = max(1, min(df.count() if files is None else files, 16 * shuffle_partitions(df.sparkSession)))
    return df.repartition(n).mapInArrow(work, schema)


def whole_groups(batches, key: str):
    """Arrow tables of whole groups from batches sorted by the long column ``key``.

    Gives each table with the places where its groups begin, the table's length last. What is
    held back is the last group seen, which may go on in the next batch.
    """
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []

    def cut(parts):
        table = pa.Table.from_batches(parts)
        keys = table.column(key).to_numpy()
        return table, np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        begin = int(np.searchsorted(keys, keys[-1], "left"))
        if begin == 0 and (not held or held[-1].column(key)[-1].as_py() == keys[0]):
            held.append(b)
            continue
        yield cut([*held, b.slice(0, begin)] if begin else held)
        held = [b.slice(begin)]
    if held:
        yield cut(held)

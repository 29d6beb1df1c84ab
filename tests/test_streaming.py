from pyspark.sql import functions as F

from tidemark.operators.behavior import daily_behavior
from tidemark.sources import fixtures
from tidemark.streaming.daily import daily_behavior_stream, write_daily

SMALL = "/root/testdata/sf0.001"


def test_stream_agrees_with_batch(spark, tmp_path):
    log = fixtures.behavior_log(spark, SMALL)
    log.orderBy("time_stamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    late = log.agg(F.max("time_stamp")).first()[0] + 3 * 86400  # moves the watermark past all dates
    spark.createDataFrame([(0, late, "pv", 0, 0)], log.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = write_daily(daily_behavior_stream(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = daily_behavior(log, *fixtures.BEHAVIOR)
    cols = sorted(want.columns)
    rows = lambda df: {tuple(map(str, r)) for r in df.select(cols).collect()}
    assert rows(got.filter("event_date_bj < DATE'2024-01-31' AND event_date_bj >= DATE'2024-01-01'")) == rows(want)

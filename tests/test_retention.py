"""The stateful stream of observations that are not too old, with late rows, silent entities and nulls."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from graphev.functions.shared import ship
from graphev.streaming import retention

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def test_old_rows_leave_late_rows_do_not_enter(spark, tmp_path):
    ship(spark)
    at = lambda minutes: NOON + timedelta(minutes=minutes)
    batches = [
        [(at(0), "a", 1.0), (at(30), "a", 2.0), (at(5), "b", 4.0), (None, "a", 9.0), (at(1), None, 9.0)],
        [(at(80), "a", 8.0), (at(20), "c", 16.0), (at(65), "d", None)],  # c is old already when the watermark has passed, but within an hour of it
        [(at(2), "b", 32.0), (at(100), "e", 64.0)],  # b's row is more than an hour late
    ]
    kind = "ts timestamp, entity string, weight double"
    folder = f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
    read = spark.readStream.schema(kind).option("latestFirst", "false").option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.entity: (r.kept, r.weight) for r in retention.last_states(spark, retention.retained_stream(read, 3600)).collect()}
    # the watermark ends at 12:100, so what is older than 12:40 is gone
    assert {k: v for k, v in got.items() if v[0]} == {"a": (1, 8.0), "d": (1, 0.0), "e": (1, 64.0)}
    assert all(v == (0, 0.0) for k, v in got.items() if k in "bc")


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "ts timestamp, entity string, weight double").write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema("ts timestamp, entity string, weight double").parquet(f"{tmp_path}/in")
    assert retention.last_states(spark, retention.retained_stream(read).select("*", F.lit(1).alias("x")).drop("x")).count() == 0

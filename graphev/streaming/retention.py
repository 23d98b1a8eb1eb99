"""L4: keeping only observations that are not too old, as a stateful stream.

Each entity's observations are keyed state. A row comes in unless it is older than ``max_age`` before the
watermark; a timer at the oldest row's end takes rows out when the watermark has passed it, also where
an entity has no new rows. Rows later than the watermark allows are dropped by Spark before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from graphev.functions.shared import new_dir

KEPT = "entity string, kept long, weight double, oldest_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retention(StatefulProcessor):
    def __init__(self, max_age_ms: int):
        self.age = max_age_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ms long, weight double")

    def close(self) -> None:
        pass

    def _keep(self, key, new: list[tuple[int, float]], watermark: int) -> pd.DataFrame:
        known = [(ms, w) for ms, w in self.rows.get()] if self.rows.exists() else []
        kept = sorted((ms, w) for ms, w in known + new if ms + self.age > watermark)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.rows.put(kept)
            self.handle.registerTimer(kept[0][0] + self.age)
        else:
            self.rows.clear()
        return pd.DataFrame({"entity": [key[0]], "kept": [len(kept)], "weight": [float(sum(w for _, w in kept))], "oldest_ms": pd.array([kept[0][0] if kept else None], dtype="Int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), float(w)) for part in rows for ms, w in zip(part["ms"], part["weight"])]
        yield self._keep(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._keep(key, [], timerValues.getCurrentWatermarkInMs())


def retained_stream(events: DataFrame, max_age: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """events, a stream of (ts, entity, weight) -> after each change of an entity its number and sum of
    weights of the rows that are left, and its oldest (KEPT). max_age in seconds. Rows without a time or
    an entity are left out; a null weight counts as 0."""
    rows = events.filter("ts is not null and entity is not null").withWatermark("ts", delay)
    rows = rows.select("ts", "entity", F.unix_millis("ts").alias("ms"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    return rows.groupBy("entity").transformWithStateInPandas(Retention(max_age * 1000), KEPT, "Update", "EventTime")


def last_states(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs the stream over all that is there and gives each entity's last state."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out, marks = new_dir(spark, "retained"), new_dir(spark, "retained-marks")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what its first run has written
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    try:
        query = stream.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.read.schema(f"{KEPT}, batch long").parquet(f"{out}/n=*")
    # timers of one batch come after its rows; of a batch's rows of an entity the emptier one is later
    return rows.groupBy("entity").agg(F.max(F.struct("batch", (-F.col("kept")).alias("k"), "kept", "weight", "oldest_ms")).alias("m")).select("entity", "m.kept", "m.weight", "m.oldest_ms")

"""Structured Streaming forms of the event operators. Sources are any streaming DataFrame with a
timestamp ``ts``; each has its batch twin in operators.operations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ferrule.runtime import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """A stream of the table ``name`` in a folder, a folder of part files or a single file, ``files`` of them
    a micro-batch, with ``ts`` as a timestamp."""
    path = f"{folder}/{name}"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = stream.parquet(path)
    else:
        stream = stream.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and errors by window; windows older than the watermark are closed and their state dropped."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("events"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    return rows.select(F.col("w.start").alias("window_start"), "events", "errors")


def once_each(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_state(stream: DataFrame, late: str = "1 day", idle_ms: int = 86_400_000) -> DataFrame:
    """``(user_id, n, last_type)`` of each user with events in a micro-batch: keyed state that expires
    once the watermark has passed the user's last event by ``idle_ms``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, kind = state.get if state.exists else (0, -1, "")
        newest = 0
        for b in batches:
            n += len(b)
            top = b.loc[b["event_id"].idxmax()]
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
            if int(top["event_id"]) > last:
                last, kind = int(top["event_id"]), str(top["event_type"])
        state.update((n, last, kind))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [kind]})

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last_type string", "n long, last long, kind string", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run all that is available and return the sink: each micro-batch replaces the table (complete) or
    adds to it, under its number, so that a repeated batch overwrites itself. In mode update a row replaces
    the earlier one of its ``keys``: of each key the last batch counts. The table is empty if nothing came."""
    if mode == "update" and not keys:
        raise ValueError("mode update needs the keys that a row replaces")
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{base}/out"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).foreachBatch(sink).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(path)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode == "update":
        others = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")
    return rows.select(*stream.columns)

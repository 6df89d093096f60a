"""Streams of events and decisions, an extension: each gives what the same batch query over the same rows gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files called ``name`` in a folder as a stream with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(rows: DataFrame, mode: str) -> DataFrame:
    """All that a streaming query gives for what is there now, as a table in the shared folder, where state is checkpointed too:
    a sink in memory would have every row in the driver. In the mode ``complete`` a batch has all rows and takes the place of
    the one before."""
    spark, folder = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/pairloom/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    query = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{folder}/rows")  # where no batch ran
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows, or sliding ones."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    per = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("v", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Each user's sessions: runs of events with no pause as long as ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    per = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def running_decisions(log: DataFrame, key: str) -> DataFrame:
    """The latest decision of each key of an append-only log, kept up to date."""
    return log.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.count(F.lit(1)).alias("events"))

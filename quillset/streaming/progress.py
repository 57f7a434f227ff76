"""Progress events: coalescing, windows and sessions, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_progress(events: DataFrame, *, bucket: str = "1 hour") -> DataFrame:
    """The newest event (ts, event_id) of each run, stage and time bucket; terminal ones are all kept."""
    start = F.window("ts", bucket)["start"].alias("bucket")
    newest = events.where("not terminal").groupBy("run_id", "stage", start).agg(F.max(F.struct("ts", "event_id", "value")).alias("e")).select("run_id", "stage", "bucket", F.col("e.event_id").alias("event_id"), F.col("e.value").alias("value"))
    ends = events.where("terminal").select("run_id", "stage", start, "event_id", "value")
    return newest.unionByName(ends)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and stage; the watermark bounds state when ``events`` is a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "stage").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "stage", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """run_id, start, n: bursts of a run's events with gaps under ``gap``."""
    return events.groupBy("run_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("run_id", F.col("session_window.start").alias("start"), "n")


def eta(events: DataFrame) -> DataFrame:
    """fraction and seconds left, from current, total and elapsed; null where nothing is known yet."""
    return events.withColumns({"fraction": F.try_divide("current", "total"), "eta": F.try_divide((F.col("total") - F.col("current")) * F.col("elapsed"), F.col("current"))})


def start_coalescing(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds"):
    """Append each micro-batch's coalesced events as Parquet."""
    return stream.writeStream.foreachBatch(lambda batch, _: coalesce_progress(batch).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def latest_by_run(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

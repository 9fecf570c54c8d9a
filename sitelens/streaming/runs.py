"""Structured Streaming: incremental append of runs with a latest-run table per project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelens.operators.portfolio import latest_runs, storable


def append_stream(runs: DataFrame, target: str, checkpoint: str, watermark: str = "1 hour") -> StreamingQuery:
    """Appends each storable run once (by run id within the watermark) to a Parquet table."""
    once = storable(runs).withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["run_id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_stream(runs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``target/batch=<n>`` tables of the latest run per project and micro-batch; rewriting a batch is harmless."""

    def write(batch: DataFrame, n: int) -> None:
        latest_runs(batch).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return storable(runs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(runs: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Runs per project and window of event time, late rows up to the watermark counted."""
    return runs.withWatermark("created_at", watermark).groupBy(F.window("created_at", window), "project_id").agg(F.count("*").alias("n"))

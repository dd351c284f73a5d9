"""File events as a stream: debounce, processing, rate windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.vault import extension, ignored

QUIET = "45 seconds"


def watched(events: DataFrame, formats: Sequence[str] = ("md",), ignored_dirs: Sequence[str] = (".git", ".obsidian")) -> DataFrame:
    """Created, modified and moved files of the formats, outside of ignored folders."""
    wanted = extension(F.col("path")).isin([f.lower().lstrip(".") for f in formats]) if formats else F.lit(True)
    return events.where(F.col("kind").isin("created", "modified", "moved") & wanted & ~ignored(F.col("path"), ignored_dirs))


def debounced(events: DataFrame, quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """(path, first, last, events): one row a path once it is quiet.

    Works alike on a table and on a stream; a stream needs ``late``, the delay
    after which events are dropped.
    """
    if late:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.session_window("ts", quiet), "path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    return g.select("path", "first", "last", "events")


def process(quiet_paths: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 1) -> StreamingQuery:
    """Handle each batch of paths that fell quiet; the checkpoint admits one writer."""
    return quiet_paths.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{seconds} seconds").start()


def rate_limited(failures: DataFrame, key: str, limit: int = 10, window: str = "60 seconds") -> DataFrame:
    """Keys and windows with at least ``limit`` failures."""
    g = failures.groupBy(F.window("ts", window), key).agg(F.count(F.lit(1)).alias("failures"))
    return g.where(F.col("failures") >= limit).select(key, F.col("window.start").alias("start"), "failures")


def failure_runs(calls: DataFrame, key: str, failed: Column, order: Sequence[str]) -> DataFrame:
    """Longest run of consecutive failures of each key, and whether it opens a breaker."""
    w = W.partitionBy(key).orderBy(*order)
    marked = calls.withColumn("_f", failed.cast("int"))
    runs = marked.withColumn("_g", F.sum(1 - F.col("_f")).over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(key, "_g").agg(F.sum("_f").alias("_n"))
    return runs.groupBy(key).agg(F.max("_n").alias("longest")).withColumn("opens", F.col("longest") >= 5)


def newest_event(log: DataFrame) -> DataFrame:
    """The newest event of a log, its time, and how many there are."""
    return log.agg(F.max_by("event", F.struct("at", "id")).alias("event"), F.max("at").alias("at"), F.count(F.lit(1)).alias("events"))

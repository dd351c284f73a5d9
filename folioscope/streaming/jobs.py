"""A long-running process over an index: one at a time, with periodic jobs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def due(jobs: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Jobs (job, every_seconds) whose last run (job, at) is as long ago, or that never ran."""
    last = runs.groupBy("job").agg(F.max("at").alias("last"))
    j = jobs.join(last, "job", "left")
    waited = (F.unix_micros(now) - F.unix_micros("last")) / F.lit(1_000_000)
    return j.where(F.col("last").isNull() | (waited >= F.col("every_seconds"))).select("job", "every_seconds", "last")


class Lock:
    """A file that only one process can create."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> Lock:
        try:
            self.files.create(self.at, False).close()
        except Exception as e:  # noqa: BLE001  file systems differ in what they raise
            raise RuntimeError(f"another process holds {self.at.toString()}") from e
        return self

    def __exit__(self, *_) -> None:
        self.files.delete(self.at, False)

    def age(self, now: float | None = None) -> float | None:
        """Seconds since the lock was taken; None if it is free."""
        if not self.files.exists(self.at):
            return None
        return (time.time() if now is None else now) - self.files.getFileStatus(self.at).getModificationTime() / 1000


class Periodic:
    """Jobs on the driver, each run when its time has come. A job that fails is
    reported and tried again at its next time."""

    def __init__(self, jobs: dict[str, tuple[float, Callable[[], object]]], now: float = 0.0):
        self.jobs, self.last = jobs, dict.fromkeys(jobs, now)

    def tick(self, now: float) -> dict[str, str]:
        done = {}
        for name, (every, run) in self.jobs.items():
            if now - self.last[name] >= every:
                self.last[name] = now
                try:
                    run()
                    done[name] = "done"
                except Exception as e:  # noqa: BLE001
                    done[name] = f"failed: {e}"
        return done

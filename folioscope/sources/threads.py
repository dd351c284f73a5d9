"""Conversations kept as JSON lines, one folder a thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "ts timestamp, q string, a string, sources array<string>"


class Threads:
    """Threads below a root folder; a save replaces a thread as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, at: str):
        return self._hadoop.Path(at)

    @property
    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"no name of a thread: {name!r}")
        return f"{self.root}/{name}"

    def save(self, name: str, turns: DataFrame) -> None:
        """turns: ts, q, a, sources. The new lines are written beside and moved in place."""
        at, beside = self._at(name), f"{self.root}/.{name}-new"
        turns.select("ts", "q", "a", "sources").orderBy("ts").coalesce(1).write.mode("overwrite").json(beside)
        self._files.delete(self._path(at), True)
        if not self._files.rename(self._path(beside), self._path(at)):
            raise OSError(f"could not move {beside} to {at}")

    def load(self, name: str, last: int | None = None) -> DataFrame:
        """The turns of a thread, or the last of them; none if there is no thread."""
        at = self._at(name)
        if not self._files.exists(self._path(at)):
            return self.spark.createDataFrame([], TURNS)
        rows = self.spark.read.schema(TURNS).json(at)
        return rows.orderBy(F.desc("ts")).limit(last) if last is not None else rows

    def forget(self, name: str) -> bool:
        return self._files.delete(self._path(self._at(name)), True)

    def names(self) -> list[str]:
        if not self._files.exists(self._path(self.root)):
            return []
        return sorted(n for s in self._files.listStatus(self._path(self.root)) if not (n := s.getPath().getName()).startswith("."))

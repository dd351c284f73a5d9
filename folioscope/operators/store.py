"""Incremental maintenance of the tables, as merges of DataFrames.

A table is a folder with a log of commits, each of which names the folders that
make up a version; so a reader never sees half a change.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change starts from."""


class Snapshots:
    """Versioned Parquet tables under a root folder, by a log of commits.

    A commit is a small file that names the version it was made from and the
    parts of the table: folders of rows, and deltas, whose keys take the place
    of all earlier rows with these keys. Data is written first; then the commit
    file of the next number is created, which only one writer can do. A writer
    that finds the number taken either plays its change again on what is there
    now (appends, merges, compactions), or is refused (``replace``), so that no
    commit is lost. A failed writer leaves nothing behind but unnamed folders.

    Deltas are merged on reading: of a key, rows of the last delta that has it
    and of later parts count. After ``MOST_DELTAS`` of them the table is written
    anew. Keys must not be null. The file system must create files exclusively,
    as HDFS and POSIX do.
    """

    MOST_DELTAS = 8

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        #: The versions that this writer has read or written last.
        self._known: dict[str, int] = {}

    # -- files

    def _path(self, at: str):
        return self._hadoop.Path(at)

    def _files(self, at: str):
        return self._path(at).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, at: str) -> list[str]:
        fs = self._files(at)
        return [s.getPath().getName() for s in fs.listStatus(self._path(at))] if fs.exists(self._path(at)) else []

    def size(self, at: str) -> int:
        """Bytes of a folder."""
        fs = self._files(at)
        return fs.getContentSummary(self._path(at)).getLength() if fs.exists(self._path(at)) else 0

    def new_folder(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    # -- commits

    def versions(self, name: str) -> list[int]:
        return sorted(int(n[7:]) for n in self._names(f"{self.root}/{name}") if n.startswith("commit-"))

    def version(self, name: str) -> int:
        """The number of the last commit, 0 for none."""
        return max(self.versions(name), default=0)

    def manifest(self, name: str, version: int | None = None) -> dict:
        """The commit of a version: its base, its parts and what else it says."""
        v = self.version(name) if version is None else version
        if not v:
            return {"base": 0, "parts": [], "about": {}}
        text = ""
        for _ in range(50):
            stream = self._files(self.root).open(self._path(f"{self.root}/{name}/commit-{v}"))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("}"):
                return json.loads(text)
            time.sleep(0.1)  # its writer has created it and not closed it yet
        raise RuntimeError(f"commit {v} of {name} is not whole: {text!r}")

    def commit(self, name: str, change: Callable[[list[dict]], list[dict]], base: int | None = None, about: dict | None = None) -> int:
        """Make what ``change`` makes of the current parts the next version.

        With a base the change is refused if that is not the current version;
        without one it is played again until no other writer is faster.
        """
        fs = self._files(self.root)
        while True:
            v = self.version(name)
            if base is not None and v != base:
                raise Conflict(f"{name} is at version {v}; the change was made from {base}")
            text = json.dumps({"base": v, "parts": change(self.manifest(name, v)["parts"]), "about": about or {}})
            at = self._path(f"{self.root}/{name}/commit-{v + 1}")
            try:
                out = fs.create(at, False)
            except Exception:  # noqa: BLE001  file systems differ in what they raise
                if not fs.exists(at):
                    raise
                continue
            out.write(bytearray(text.encode()))
            out.close()
            self._known[name] = v + 1
            return v + 1

    # -- reading

    def current(self, name: str) -> DataFrame | None:
        v = self.version(name)
        self._known[name] = v
        return self.rows(self.manifest(name, v)["parts"]) if v else None

    def at(self, name: str, version: int) -> DataFrame:
        return self.rows(self.manifest(name, version)["parts"])

    def rows(self, parts: list[dict]) -> DataFrame:
        """The rows of parts, deltas merged."""
        read = self.spark.read
        deltas = [k for k, p in enumerate(parts) if p.get("keys")]
        if not deltas:
            return read.parquet(*(p["rows"] for p in parts))
        frames = [read.parquet(p["rows"]).withColumn("_part", F.lit(k)) for k, p in enumerate(parts) if p.get("rows")]
        out = reduce(lambda a, b: a.unionByName(b), frames)
        for keys in dict.fromkeys(tuple(parts[k]["keys"]) for k in deltas):
            taken = [read.parquet(p[side]).select(*keys, F.lit(k).alias("_part")) for k in deltas if tuple((p := parts[k])["keys"]) == keys for side in ("rows", "gone") if p.get(side)]
            last = reduce(lambda a, b: a.unionByName(b), taken).groupBy(*keys).agg(F.max("_part").alias("_last"))
            out = out.join(last, list(keys), "left").where("_last IS NULL OR _part >= _last").drop("_last")
        first = frames[0].columns
        return out.select(*[c for c in first if c != "_part"])

    # -- changes

    def _write(self, name: str, rows: DataFrame) -> str:
        at = self.new_folder(name)
        rows.write.parquet(at)
        return at

    def replace(self, name: str, rows: DataFrame, base: int | None = None, about: dict | None = None) -> int:
        """Write all rows anew. Refused if there is a commit after ``base``, by
        default the version of this table that this writer knows."""
        base = self._known.get(name, self.version(name)) if base is None else base
        if base != self.version(name):
            raise Conflict(f"{name} is at version {self.version(name)}; the change was made from {base}")
        part = {"rows": self._write(name, rows)}
        return self.commit(name, lambda _: [part], base, about)

    def append(self, name: str, rows: DataFrame) -> int:
        part = {"rows": self._write(name, rows)}
        return self.commit(name, lambda parts: [*parts, part])

    def merge(self, name: str, rows: DataFrame | None, keys: Sequence[str], gone: DataFrame | None = None) -> int:
        """Rows take the place of all that have their keys; those with the keys
        of ``gone`` go. Only these are written."""
        part = {"keys": list(keys)}
        if rows is not None:
            part["rows"] = self._write(name, rows)
        if gone is not None:
            part["gone"] = self._write(name, gone.select(*keys))
        written = [self.spark.read.parquet(part[side]) for side in ("rows", "gone") if side in part]
        if self.version(name) and not any(w.limit(1).count() for w in written):
            return self.version(name)  # nothing changes
        v = self.commit(name, lambda parts: [*parts, part])
        if sum("keys" in p for p in self.manifest(name, v)["parts"]) > self.MOST_DELTAS:
            return self.compacted(name)
        return v

    def compacted(self, name: str, files: int | None = None) -> int:
        """Write the current rows as one part, of so many files; what others
        commit meanwhile stays behind it. Refused if they replace the table."""
        v = self.version(name)
        old = self.manifest(name, v)["parts"]
        rows = self.rows(old)
        part = {"rows": self._write(name, compact(rows, files) if files else rows)}

        def change(parts: list[dict]) -> list[dict]:
            if parts[: len(old)] != old:
                raise Conflict(f"{name} was replaced while it was compacted")
            return [part, *parts[len(old) :]]

        return self.commit(name, change)

    # -- upkeep

    def folders(self, name: str) -> list[str]:
        return [p[side] for p in self.manifest(name)["parts"] for side in ("rows", "gone") if p.get(side)]

    def files(self, name: str) -> int:
        """Number of data files of the current version."""
        return sum(n.endswith(".parquet") for at in self.folders(name) for n in self._names(at))

    def backup(self, names: Sequence[str], stamp: str, keep: int = 5) -> list[str]:
        """Write the current rows to ``backups/stamp``; the newest ``keep``
        backups stay, the dropped ones are returned."""
        for name in names:
            if self.version(name):
                self.current(name).write.mode("overwrite").parquet(f"{self.root}/backups/{stamp}/{name}")
        have = sorted(self._names(f"{self.root}/backups"))
        old = have[:-keep] if keep else []
        for x in old:
            self._files(self.root).delete(self._path(f"{self.root}/backups/{x}"), True)
        return old

    def prune(self, name: str, keep: int = 5) -> list[int]:
        """Drop all but the newest versions, and the folders that only they name."""
        have = self.versions(name)
        old, left = (have[:-keep], have[-keep:]) if keep else ([], have)
        named = lambda vs: {s for v in vs for s in _strings(self.manifest(name, v)["parts"]) if s.startswith(f"{self.root}/{name}/")}
        fs = self._files(self.root)
        for at in named(old) - named(left):
            fs.delete(self._path(at), True)
        for v in old:
            fs.delete(self._path(f"{self.root}/{name}/commit-{v}"), False)
        return old


def _strings(value) -> set[str]:
    """All strings in a manifest's parts."""
    if isinstance(value, str):
        return {value}
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return {s for v in inner for s in _strings(v)}


def held(rows: DataFrame) -> DataFrame:
    """Rows that several steps read, in the checkpoint folder if there is one."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def with_ids(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``new`` with ids: those that its keys have already, else the next ones.

    The next ids are offsets in ranges, so that no task numbers all rows.
    """
    known = existing.select(*keys, F.col("id").alias("_id"))
    j = new.join(known, list(keys), "left")
    spread = j.where("_id IS NULL").withColumn("_h", F.pmod(F.xxhash64(*order), F.lit(256)))
    sizes = spread.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = spread.join(sizes.drop("_n"), "_h").crossJoin(F.broadcast(top)).withColumn("_id", F.col("_top") + F.col("_before") + F.row_number().over(W.partitionBy("_h").orderBy(*order)))
    return j.where("_id IS NOT NULL").select(*new.columns, F.col("_id").alias("id")).unionByName(fresh.select(*new.columns, F.col("_id").alias("id")))


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = (), never: Sequence[str] = ()) -> DataFrame:
    """Rows of both tables by key. New values win; of the columns ``keep_old`` a
    null does not overwrite; of the columns ``never`` the old value stays."""
    columns = [c for c in existing.columns if c not in keys]
    n = new.select(*keys, F.lit(True).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in columns if c in new.columns])
    o = existing.select(*keys, F.lit(True).alias("_o"), *[F.col(c).alias(f"o_{c}") for c in columns])
    j = o.join(n, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o_{c}")
        if c in never:
            return F.when(F.col("_o"), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
        if c in keep_old:
            return F.coalesce(f"n_{c}", f"o_{c}")
        return F.when(F.col("_n"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    return j.select(*[F.col(c) if c in keys else value(c).alias(c) for c in existing.columns])


def sync_tags(note_tags: DataFrame, scanned: DataFrame) -> DataFrame:
    """Associations after a scan: those of the scanned notes are replaced.

    note_tags: note_id, tag; scanned: note_id, tags.
    """
    rest = note_tags.join(scanned.select("note_id").distinct(), "note_id", "left_anti")
    fresh = scanned.select("note_id", F.explode("tags").alias("tag")).where("tag <> ''").distinct()
    return rest.select("note_id", "tag").union(fresh)


def chunk_plan(stored: DataFrame, candidate: DataFrame) -> DataFrame:
    """What a re-scan does with each chunk.

    stored: note_id, chunk_index, id, chunk_hash, page, heading; candidate has no
    id. A stored chunk without hash is stale. keep and reanchor retain the id.
    """
    s = stored.select("note_id", "chunk_index", F.col("id"), F.col("chunk_hash").alias("_h"), F.col("page").alias("_p"), F.col("heading").alias("_t"), F.lit(True).alias("_s"))
    c = candidate.select("note_id", "chunk_index", "chunk_hash", "page", "heading", F.lit(True).alias("_c"))
    j = s.join(c, ["note_id", "chunk_index"], "full_outer")
    same = F.col("_h").eqNullSafe(F.col("chunk_hash")) & F.col("_h").isNotNull()
    moved = ~F.col("_p").eqNullSafe(F.col("page")) | ~F.col("_t").eqNullSafe(F.col("heading"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_c").isNull(), "delete").when(~same, "replace").when(moved, "reanchor").otherwise("keep")
    return j.select("note_id", "chunk_index", "id", action.alias("action"), "chunk_hash", "page", "heading")


def plan_counts(plan: DataFrame) -> DataFrame:
    """Per note: kept, embedded, removed."""
    return plan.groupBy("note_id").agg(
        F.count_if(F.col("action").isin("keep", "reanchor")).alias("kept"), F.count_if(F.col("action").isin("insert", "replace")).alias("embedded"), F.count_if(F.col("action").isin("delete", "replace")).alias("removed")
    )


def replace_claims(existing: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims after their notes were read again, and those of them that are new.

    existing: id, note_id, claim_text, …; scanned: note_id, claim_text (null for
    a note without claims). Equal texts keep their id.
    """
    notes = scanned.select("note_id").distinct()
    texts = scanned.where("claim_text IS NOT NULL").select("note_id", "claim_text").distinct()
    rest = existing.join(notes, "note_id", "left_anti")
    kept = existing.join(texts, ["note_id", "claim_text"], "left_semi")
    added = texts.join(existing, ["note_id", "claim_text"], "left_anti")
    ids = with_ids(added, existing, ["note_id", "claim_text"], ["note_id", "claim_text"])
    return rest.unionByName(kept).unionByName(ids, allowMissingColumns=True), ids


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.select("key").distinct().join(cache, "key", "left_anti")


def cache_put(cache: DataFrame, computed: DataFrame) -> DataFrame:
    return cache.join(computed.select("key"), "key", "left_anti").unionByName(computed.select(*cache.columns))


def prune_missing(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to notes whose file is gone.

    tables: notes (id, path) and any of note_tags, chunks, claims (note_id) and
    freshness (note_path).
    """
    gone = tables["notes"].join(files.select("path"), "path", "left_anti").select("id", "path")
    out = {}
    for name, t in tables.items():
        if name == "notes":
            out[name] = t.join(gone, "id", "left_anti")
        elif "note_id" in t.columns:
            out[name] = t.join(gone.select(F.col("id").alias("note_id")), "note_id", "left_anti")
        else:
            out[name] = t.join(gone.select(F.col("path").alias("note_path")), "note_path", "left_anti")
    return out


class Migration:
    """Re-embedding of all chunks with another model beside the current table."""

    def __init__(self, snapshots: Snapshots, name: str, model: str):
        self.snapshots, self.name, self.shadow = snapshots, name, f"{name}-{model}"

    def pending(self) -> DataFrame:
        """Chunks without a new vector; failed ones come again."""
        now, done = self.snapshots.current(self.name), self.snapshots.current(self.shadow)
        return now if done is None else now.join(done, "id", "left_anti")

    def add(self, embedded: DataFrame) -> None:
        """Only the new vectors are written."""
        columns = self.snapshots.current(self.name).columns
        self.snapshots.append(self.shadow, embedded.where("vector IS NOT NULL").select(*columns))

    def begin(self) -> bool:
        """Start anew; False, and nothing changes, if a migration is under way."""
        if self.snapshots.version(self.shadow):
            return False
        now = self.snapshots.current(self.name)
        self.snapshots.replace(self.shadow, now.limit(0), base=0)
        return True

    def progress(self) -> tuple[int, int]:
        """Chunks done, and all."""
        done = self.snapshots.current(self.shadow)
        return 0 if done is None else done.count(), self.snapshots.current(self.name).count()

    def swap(self) -> bool:
        """Make the new vectors current if none is missing; refused if the
        table changes meanwhile."""
        base = self.snapshots.version(self.name)
        if self.pending().limit(1).count():
            return False
        self.snapshots.replace(self.name, self.snapshots.current(self.shadow), base=base)
        self.abort()
        return True

    def abort(self) -> None:
        at = self.snapshots._path(f"{self.snapshots.root}/{self.shadow}")
        self.snapshots._files(self.snapshots.root).delete(at, True)
        self.snapshots._known.pop(self.shadow, None)


def compact(rows: DataFrame, files: int) -> DataFrame:
    """The same rows in fewer, even partitions."""
    return rows.repartition(files)


def merged_metadata(existing: Column, updates: Column, provenance: Column) -> Column:
    """Front matter after a write: later maps win."""
    join = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    return join(join(F.coalesce(existing, F.create_map().cast("map<string,string>")), updates), provenance)


LINK_HEADING = "## 🔗 Suggested Connections"


def injected(body: Column, links: Column) -> Column:
    """A body with its section of suggested links replaced or appended.

    links: array of (title, reason).
    """
    line = lambda x: F.concat(F.lit("- [["), F.substring(F.regexp_replace(x["title"], r"[\[\]|\n]", " "), 1, 200), F.lit("]] — "), F.substring(F.regexp_replace(x["reason"], r"\s+", " "), 1, 300))
    section = F.concat(F.lit(LINK_HEADING + "\n\n"), F.array_join(F.transform(links, line), "\n"), F.lit("\n"))
    head, at = F.regexp_replace(F.substring_index(body, LINK_HEADING, 1), r"\s+\z", ""), F.instr(body, LINK_HEADING)
    after = F.when(at > 0, F.regexp_extract(F.substring(body, at + len(LINK_HEADING), F.length(body)), r"(?s)\n(#{1,2} .*)\z", 1)).otherwise("")
    return F.concat(head, F.lit("\n\n"), section, F.when(after != "", F.concat(F.lit("\n"), after)).otherwise(""))

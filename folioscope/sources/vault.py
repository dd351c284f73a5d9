"""Files of a vault: scanning, filtering, routing by type."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ignored(path: Column, names: Sequence[str]) -> Column:
    """Whether a segment of a path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)


def extension(path: Column) -> Column:
    """Lower-case extension of a path, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def inside(root: str, path: str) -> bool:
    """Whether a path, links resolved, lies under a root."""
    base, at = os.path.realpath(root), os.path.realpath(path)
    return at == base or at.startswith(base + os.sep)


#: Paths that a scan of some files reads by name.
LISTED = 10_000


def _within(root: str):
    @F.udf("boolean", useArrow=True)
    def check(path: str) -> bool:
        return inside(root, unquote(path.removeprefix("file://").removeprefix("file:")))

    return check


def scan(spark: SparkSession, vault: str, formats: Sequence[str] = ("md",), ignored_dirs: Sequence[str] = (".git", ".obsidian"), sidecar_dir: str | None = None, sniff: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(path, rel, ext, content, size_bytes) of the vault's documents.

    Types are told by extension; with ``sniff`` files without a known one are
    told by their first bytes. Of a local folder, files that a link leads to
    outside of it are left out. only: relative paths (path); up to ``LISTED`` of
    these are read by name, more by a scan of the folder.
    """
    root = vault.rstrip("/") + "/"
    reader = spark.read.format("binaryFile")
    if only is None:
        files = reader.option("recursiveFileLookup", True).load(vault)
    else:
        only = only.select("path").distinct()
        named = [r.path for r in only.limit(LISTED + 1).collect()]
        if len(named) <= LISTED:
            fs = spark._jvm.org.apache.hadoop.fs
            at = fs.Path(vault).getFileSystem(spark._jsc.hadoopConfiguration())
            there = [root + p for p in named if at.exists(fs.Path(root + p))]
            files = reader.load([re.sub(r"([\\*?{}\[\],])", r"\\\1", p) for p in there]) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
        else:
            wanted = F.substring_index("path", root.removeprefix("file://"), -1)
            files = reader.option("recursiveFileLookup", True).load(vault).withColumn("_rel", wanted).join(only.withColumnRenamed("path", "_rel"), "_rel", "left_semi")
    if "://" not in vault or vault.startswith("file:"):
        files = files.where(_within(root.removeprefix("file://"))(F.col("path")))
    rel = F.substring_index("path", root.removeprefix("file://"), -1)
    out = files.select("path", rel.alias("rel"), extension(rel).alias("ext"), "content", F.col("length").alias("size_bytes"))
    out = out.where(~ignored(F.col("rel"), [*ignored_dirs, *([sidecar_dir] if sidecar_dir else [])]))
    wanted = [f.lower().lstrip(".") for f in formats]
    known = F.when(F.col("ext").isin(wanted), F.col("ext"))
    if sniff:
        known = F.coalesce(known, F.when(F.col("ext") == "", sniffed(F.col("content"))))
    return out.withColumn("ext", known).where(F.col("ext").isin(wanted))


def sniffed(content: Column) -> Column:
    """Type of a file by its first bytes; null if unknown."""
    head = F.substring(content, 1, 8)
    text = F.substring(content, 1, 512).cast("string")
    whole = F.substring(content, 1, 4096).cast("string")
    starts = lambda b: F.hex(head).startswith(b.hex().upper())
    return (
        F.when(starts(b"%PDF"), "pdf")
        .when(starts(b"{\\rtf"), "rtf")
        .when(starts(b"PK\x03\x04") & F.contains(whole, F.lit("application/epub+zip")), "epub")
        .when(starts(b"PK\x03\x04") & F.contains(whole, F.lit("application/vnd.oasis.opendocument.text")), "odt")
        .when(starts(b"PK\x03\x04") & F.contains(whole, F.lit("word/")), "docx")
        .when(starts(b"\xd0\xcf\x11\xe0"), "doc")
        .when(text.rlike(r"(?is)^\s*<(!doctype\s+html|html)"), "html")
    )

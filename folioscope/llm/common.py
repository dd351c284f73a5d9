"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that go when the application ends.
_REGISTERED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on one machine (tests) a temporary folder is used.
    What an application writes below it goes when the application ends.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a shared folder")
        held = tempfile.TemporaryDirectory(prefix="folioscope-")
        atexit.register(held.cleanup)
        at = held.name
        spark.conf.set("spark.checkpoint.dir", at)
    out = f"{at.rstrip('/')}/folioscope-{spark.sparkContext.applicationId}"
    if out not in _REGISTERED:
        _REGISTERED.add(out)
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return out


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and
    the rows outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_folioscope_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of what ``df`` reads, 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else 0


def buckets_for(df: DataFrame, most: int) -> int:
    """Buckets of about ``most`` bytes of input, as many as shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // most))


def word_count(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def spread_hash(doc_id: Column) -> Column:
    """32 bits of md5 of the id, as DuckDB can also compute them."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def hashed_sample(df: DataFrame, strata: list[str], per_stratum: int, seed: int) -> DataFrame:
    """At most ``per_stratum`` rows' ids of each stratum, the same on every run.

    Ids are dealt to ``per_stratum`` cells by hash and each cell keeps the id of
    smallest hash, so that the work is a partially aggregated ``min`` and no
    stratum meets in one task.
    """
    h = F.xxhash64(F.lit(seed), "doc_id")
    return (
        df.select(*strata, "doc_id", h.alias("_h"))
        .groupBy(*strata, F.pmod(F.shiftright(F.col("_h"), 20), F.lit(per_stratum)).alias("_cell"))
        .agg(F.min_by("doc_id", "_h").alias("doc_id"))
        .select(*strata, "doc_id")
    )


#: A key counts as hot if it has more than this share of the rows; so there are
#: at most 1 / HOT hot keys, a bound on what is broadcast.
HOT = 1 / 4096
#: Tasks that a hot key's rows are dealt to.
WAYS = 64


def salted(rows: DataFrame, keys: list[str], salt: Column, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a column ``_salt`` that deals hot keys' rows to ``WAYS``
    parts and is 0 for others, and the hot keys (a written table).

    counts: (keys, ``_n``), if known already.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts.select(*keys, "_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = written(counts.where(F.col("_n") > max(2.0, total * HOT)).select(*(F.col(k).alias(f"_hot_{k}") for k in keys)))
    discard(counts)
    return rows.join(F.broadcast(hot), _on_hot(keys), "left").select(*rows.columns, F.when(F.col(f"_hot_{keys[0]}").isNotNull(), F.pmod(salt, F.lit(WAYS))).otherwise(0).cast("int").alias("_salt")), hot


def salted_table(table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """A table of one row a key, with hot keys' rows once for each ``_salt``."""
    ways = F.when(F.col(f"_hot_{keys[0]}").isNotNull(), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    return table.join(F.broadcast(hot), _on_hot(keys), "left").select(*table.columns, F.explode(ways).alias("_salt"))


def _on_hot(keys: list[str]) -> Column:
    on = F.col(keys[0]) == F.col(f"_hot_{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_hot_{k}"))
    return on


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with a table of one row a key, where no task gets all
    rows of a hot key. Keys must not be null."""
    rows, hot = salted(rows, keys, salt, counts)
    return rows.join(salted_table(table, keys, hot), [*keys, "_salt"]).drop("_salt")


def ranked(df: DataFrame, keys: list[str], order: list[str], salt: Column, name: str) -> DataFrame:
    """Adds a 1-based rank within ``keys`` without a task that holds a whole key.

    Rows are dealt to cells (keys, salt); a cell's rows are numbered by
    ``order``, and the counts of the earlier cells of the key are added.
    The rank orders cells by salt first, then rows by ``order``.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_salt", salt)
    cells = df.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = df.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
    same = [inside[k].eqNullSafe(cells[k]) for k in [*keys, "_salt"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return inside.join(cells, on).select(
        *[inside[c] for c in df.columns if c != "_salt"], (F.col("_row") + F.col("_before")).alias(name)
    )

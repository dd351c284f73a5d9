"""The engine's tables as derived from the driver's: Spark and DuckDB forms.

Each view has a function of (spark, sf_dir) and an entry in ``SQL`` that DuckDB
reads as a common table expression over the same parquet tables.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.hashing import content_hash, file_hash

MODEL = "lexical-768"
ROOTS = {"en": "reference", "fr": "journal", "de": "projects"}
FORMATS = ["md", "txt", "html", "pdf"]
#: Ids of chunks are apart for texts of up to 1.35 billion characters.
CHUNKS_PER_NOTE = 1_000_000
#: The day on which freshness is judged.
TODAY = "2025-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that go when the application ends.
_REGISTERED: set[str] = set()


def workspace(spark: SparkSession) -> str:
    """A folder for tables that queries write: the one that the cluster shares,
    or a temporary one on a single machine without it."""
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


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once an application and read by all queries."""
    at = f"{workspace(spark)}/kept/{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        # small row groups: a question reads those of its tokens
        build().write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(at)
    return spark.read.parquet(at)


def _category(lang, source):
    root = F.when(lang == "en", ROOTS["en"]).when(lang == "fr", ROOTS["fr"]).when(lang == "de", ROOTS["de"]).otherwise("inbox")
    return F.concat(root, F.lit("/"), source)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("path"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("title"),
        F.when(F.col("doc_id") % 11 != 0, _category(F.col("lang"), F.col("source"))).alias("category"),
        F.when(F.col("doc_id") % 13 != 0, F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("doc_id") % 4 + 1).cast("int"))).alias("format"),
        content_hash(F.col("text")).alias("content_hash"),
        file_hash(F.col("text")).alias("file_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        day(F.col("doc_id") % 390).alias("last_seen"),
        F.when(F.col("doc_id") % 7 != 0, day(F.col("doc_id") % 390)).alias("last_tagged"),
        "text",
    )


def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = d.select(F.col("doc_id").alias("note_id"), F.explode(F.array(F.col("lang"), F.col("source"))).alias("tag"))
    marks = labels.select(F.col("doc_id").alias("note_id"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))))).alias("tag"))
    return named.union(marks).distinct()


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All known tag names; some of them are on no note."""
    used = note_tags(spark, sf_dir).select(F.col("tag").alias("name"))
    regions = table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"))
    return used.union(regions).distinct()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of 1500 characters, 150 of them shared."""
    from folioscope.operators.chunking import sliding_windows

    return sliding_windows(notes(spark, sf_dir).select(F.col("id").alias("note_id"), "text"), 1500, 150).select(
        (F.col("note_id") * CHUNKS_PER_NOTE + F.col("chunk_index")).alias("id"), "note_id", "chunk_index", F.col("chunk").alias("text_content")
    )


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).alias("id"), F.floor(F.col("vec_id") / 5).alias("note_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.col("embedding").alias("vector"), F.col("label")
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.timestamp_add("DAY", (F.col("vec_id") % 60).cast("int"), F.lit("2024-11-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.floor(F.col("vec_id") / 5).alias("note_id"),
        F.concat(F.lit("claim "), F.col("vec_id")).alias("claim_text"),
        day.alias("extracted_at"),
        F.when(F.col("vec_id") % 17 != 0, F.col("embedding")).alias("vector"),
    )


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).select("id", "extracted_at").where("id % 3 = 0")
    return c.select(
        F.col("id"),
        F.col("id").alias("claim_a_id"),
        (F.col("id") + 1 + F.col("id") % 9).alias("claim_b_id"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("id") % 3 + F.floor(F.col("id") / 3) % 3 + 1).cast("int")).alias("severity"),
        F.element_at(F.array(F.lit("open"), F.lit("dismissed"), F.lit("resolved")), (F.floor(F.col("id") / 5) % 3 + 1).cast("int")).alias("status"),
        F.col("extracted_at").alias("detected_at"),
    )


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).where("id % 3 <> 1")
    return n.select(F.col("path").alias("note_path"), F.col("last_seen").alias("last_verified"), (30 + F.col("id") % 5 * 60).cast("int").alias("window_days"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes' ids and content hashes, made once."""
    return kept(spark, sf_dir, "hashes", lambda: notes(spark, sf_dir).select("id", "content_hash"))


def stored(spark: SparkSession, sf_dir: str):
    """The tables that queries make once an application."""
    from folioscope.operators.store import Snapshots

    return Snapshots(spark, f"{workspace(spark)}/kept/{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}")


def index(spark: SparkSession, sf_dir: str):
    """The full-text index of the chunks, made once."""
    from folioscope.operators.segments import Segments

    text = Segments(stored(spark, sf_dir))
    if not text.tables.version(text.name):
        text.update(chunks(spark, sf_dir))
    return text.index()


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (id, note_id, chunk_index, vector) with their offline vectors, made once."""
    from folioscope.functions.providers import embedded

    return kept(spark, sf_dir, "lexical", lambda: embedded(chunks(spark, sf_dir).select("id", "note_id", "chunk_index", "text_content"), "text_content"))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes (id, vector) with the mean of their chunks' vectors, made once."""
    from folioscope.functions.vectors import mean_pool

    return kept(spark, sf_dir, "pooled", lambda: mean_pool(lexical(spark, sf_dir), ["note_id"]).select(F.col("note_id").alias("id"), "vector"))


SQL = {
    "notes": r"""notes AS (
  SELECT doc_id AS id, source || '/' || doc_id || '.md' AS path, 'doc-' || doc_id AS title,
    CASE WHEN doc_id % 11 <> 0 THEN CASE lang WHEN 'en' THEN 'reference' WHEN 'fr' THEN 'journal' WHEN 'de' THEN 'projects' ELSE 'inbox' END || '/' || source END AS category,
    CASE WHEN doc_id % 13 <> 0 THEN ['md', 'txt', 'html', 'pdf'][doc_id % 4 + 1] END AS format,
    sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{2,}', chr(10) || chr(10), 'g'), '[ \t\r\x0b\f]+(\n|\z)', '\1', 'g'), '\A\s+|\s+\z', '', 'g')) AS content_hash,
    sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS size_bytes,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 390 AS INT)) AS last_seen,
    CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 390 AS INT)) END AS last_tagged, text
  FROM documents)""",
    "note_tags": """note_tags AS (
  SELECT doc_id AS note_id, unnest([lang, source]) AS tag FROM documents
  UNION SELECT doc_id, 'good' FROM labels WHERE quality = 1
  UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)""",
    "tags": """tags AS (SELECT tag AS name FROM note_tags UNION SELECT lower(r_name) FROM region)""",
    "chunks": """chunks AS (
  SELECT note_id * 1000000 + k AS id, note_id, CAST(k AS INT) AS chunk_index, substr(text, CAST(k * 1350 + 1 AS BIGINT), 1500) AS text_content
  FROM (SELECT doc_id AS note_id, text, unnest(generate_series(0, CAST(ceil(greatest(length(text) - 1500, 0) / 1350.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0))""",
    "raw_vectors": """raw_vectors AS (
  SELECT vec_id + 1 AS id, vec_id // 5 AS note_id, CAST(vec_id % 5 AS INT) AS chunk_index, embedding AS vector, label FROM embeddings)""",
    "claims": """claims AS (
  SELECT vec_id AS id, vec_id // 5 AS note_id, 'claim ' || vec_id AS claim_text, TIMESTAMP '2024-11-01' + to_days(CAST(vec_id % 60 AS INT)) AS extracted_at,
    CASE WHEN vec_id % 17 <> 0 THEN embedding END AS vector FROM embeddings)""",
    "contradictions": """contradictions AS (
  SELECT id, id AS claim_a_id, id + 1 + id % 9 AS claim_b_id, ['high', 'medium', 'low'][id % 3 + id // 3 % 3 + 1] AS severity,
    ['open', 'dismissed', 'resolved'][id // 5 % 3 + 1] AS status, extracted_at AS detected_at FROM claims WHERE id % 3 = 0)""",
    "freshness": """freshness AS (
  SELECT path AS note_path, last_seen AS last_verified, CAST(30 + id % 5 * 60 AS INT) AS window_days FROM notes WHERE id % 3 <> 1)""",
}


def sql(views: str, body: str) -> str:
    """A DuckDB statement over the named views."""
    return "WITH " + ",\n".join(SQL[v] for v in views.split()) + "\n" + body if views else body

"""Mixing sources to target weights by systematic sampling.

The size of a document is its number of words. Sources in code point order
(null last) weigh 5, 2, 1, repeating, and share the sum of all sizes in that
proportion; no source gets more than ``MOST`` times its size, and what is over
is shared again among the others (water filling, in closed form over the
sources ordered by cap per weight). Within a source every document has the same
expected number of copies, target over size. Documents are ordered by size
class, so that each stretch of the order has all kinds of sizes only once; the
prefix sums of the expected copies plus one random offset a source are cut at
the integers, and a document is emitted once for each integer crossed. Of
``TRIES`` random offsets a source takes the one whose words come nearest to its
target, which matters where a few long documents make up most of a source.

Cases: a null text has size 0; a null source is a source of its own; a source
whose documents are all empty gets target 0 and nothing is taken; equal and
repeated rows are each sampled; an empty table gives an empty result; other
columns are not read by ``plan`` and are carried along by ``mix``. Offsets and
ties come from hashes of the ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import WORD, ranked, spread_hash, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Cells of one size class of a source are at most this many, by hash.
SPREAD = 64
#: Random offsets that a source chooses from.
TRIES = 32


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) a source."""
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    s = (
        s.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(after))
        .withColumn("_k", F.row_number().over(order))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        .withColumn("_fits", F.col("_left") * F.col("_w") <= F.col("_cap") * F.col("_weights"))
    )
    level = F.min_by(F.col("_level"), F.when(F.col("_fits"), F.col("_k"))).over(every)
    return s.select("source", "source_size", F.least(F.col("_cap").cast("double"), level * F.col("_w")).alias("target"))


def size_class(size: Column) -> Column:
    """The number of bits of a size and the five highest of them."""
    bits = F.length(F.bin(size))
    return bits * 32 + F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 5, F.lit(0))))


def offset(source: Column, seed: int, turn: int) -> Column:
    """A random offset of a source, in [0, 1)."""
    named = F.concat(F.lit(f"{seed}:{turn}:"), F.coalesce(source, F.lit("")), F.when(source.isNull(), "null").otherwise(""))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs``."""
    # texts are read once; one row a source has a size that the planner can see
    d = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("_h", spread_hash(F.col("doc_id"))))
    goal = written(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    salt = size_class(F.col("size")) * SPREAD + F.col("_h") % SPREAD
    d = ranked(d, ["source"], ["size", "_h", "doc_id"], salt, "_rank")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    d = written(d.join(goal.withColumn("_each", each).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))))

    def copies(u: Column) -> Column:
        return F.floor(F.col("_each") * F.col("_rank") + u) - F.floor(F.col("_each") * (F.col("_rank") - 1) + u)

    # the offsets are constants of a source, tried in one pass
    offsets = written(goal.select(F.col("source").alias("_of"), *(offset(F.col("source"), seed, k).alias(f"_u{k}") for k in range(TRIES))))
    tried = d.join(offsets, F.col("source").eqNullSafe(F.col("_of")))
    words = tried.groupBy("source", "target").agg(*(F.sum(copies(F.col(f"_u{k}")) * F.col("size")).alias(f"_t{k}") for k in range(TRIES)), *(F.first(f"_u{k}").alias(f"_u{k}") for k in range(TRIES)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"_t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), F.col(f"_u{k}").alias("u")) for k in range(TRIES))))
    chosen = written(words.select(F.col("source").alias("_of"), best["u"].alias("_u")))
    out = d.join(chosen, F.col("source").eqNullSafe(F.col("_of")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies(F.col("_u")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the plan takes them, with their columns."""
    copies = written(plan(docs, **how).select(F.col("doc_id").alias("_fs_id"), F.col("source"), F.col("size").alias("_fs_size"), F.col("copies").cast("int").alias("_fs_copies")))
    same = F.col("doc_id").eqNullSafe(F.col("_fs_id"))
    if copies.groupBy("_fs_id").count().where("count > 1").limit(1).count():
        # rows of one id are told apart by their order
        order = [F.col("source").asc_nulls_last(), "_fs_size"]
        rows = docs.withColumn("_fs_size", word_count(F.col("text"))).withColumn("_fs_row", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
        copies = copies.withColumn("_fs_nth", F.row_number().over(W.partitionBy("_fs_id").orderBy(*order)))
        same = same & (F.col("_fs_row") == F.col("_fs_nth"))
    else:
        rows = docs
    taken = copies.where("_fs_copies > 0").drop("source", "_fs_size")
    joined = rows.join(taken.hint("shuffle_hash"), same)
    return joined.withColumn("_fs_copy", F.explode(F.sequence(F.lit(1), F.col("_fs_copies")))).select(*[joined[c] for c in docs.columns])


#: The same plan in DuckDB's dialect.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
c AS (
  SELECT *, row_number() OVER o AS k,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), w * min_by(CAST(remaining AS DOUBLE) / CAST(weights AS DOUBLE), k) FILTER (WHERE remaining * w <= cap * weights) OVER ()) AS target
  FROM c),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
           length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) * 32
             + size // CAST(pow(2, greatest(length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) - 5, 0)) AS BIGINT),
           h % 64, size, h, doc_id) AS n
  FROM d),
e AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, r.n, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT source, k, CAST('0x' || substr(md5('1:' || k || ':' || coalesce(source, '') || CASE WHEN source IS NULL THEN 'null' ELSE '' END), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM t, range({TRIES}) k(k)),
tried AS (
  SELECT e.source, u.u, k, abs(sum(CAST(floor(each * n + u) - floor(each * (n - 1) + u) AS BIGINT) * size) - any_value(target)) AS off
  FROM e JOIN u ON e.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
chosen AS (SELECT source, arg_min(u, (off, k)) AS u FROM tried GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(floor(each * n + u) - floor(each * (n - 1) + u) AS BIGINT) * size AS taken
FROM e JOIN chosen c ON e.source IS NOT DISTINCT FROM c.source
"""

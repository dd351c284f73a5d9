"""Relational questions about notes, tags, categories and their tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_category(column: Column, category: str) -> Column:
    """The category itself or a descendant."""
    return (column == category) | F.startswith(column, F.lit(category + "/"))


def note_filter(notes: DataFrame, note_tags: DataFrame, category: str | None = None, formats: Sequence[str] = (), tags: Sequence[str] = ()) -> DataFrame | None:
    """Ids of the notes that meet all criteria; None without any.

    Formats are compared in lower case without a dot, a missing one is ``md``;
    every tag must be on the note, whatever its case.
    """
    if category is None and not formats and not tags:
        return None
    out = notes
    if category is not None:
        out = out.where(in_category(F.col("category"), category))
    if formats:
        out = out.where(F.lower(F.coalesce("format", F.lit("md"))).isin([f.lower().lstrip(".") for f in formats]))
    if tags:
        wanted = sorted({t.lower() for t in tags})
        having = note_tags.where(F.lower("tag").isin(wanted)).groupBy("note_id").agg(F.count_distinct(F.lower("tag")).alias("_n")).where(F.col("_n") == len(wanted))
        out = out.join(having, out["id"] == having["note_id"], "left_semi")
    return out.select("id")


def by_category(notes: DataFrame, category: str, recursive: bool = True) -> DataFrame:
    wanted = in_category(F.col("category"), category) if recursive else F.col("category") == category
    return notes.where(wanted).select("id", "title", "category")


def anchors(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Page and heading of the chunk with exactly this text; the lowest id wins."""
    hit = chunks.join(asked, ["note_id", "text_content"])
    return hit.groupBy("note_id", "text_content").agg(F.min_by(F.struct("page", "heading"), "id").alias("a")).select("note_id", "text_content", "a.page", "a.heading")


def change_status(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """For each scanned path whether its bytes or only its text are as stored."""
    s = stored.select("path", F.col("file_hash").alias("_f"), F.col("content_hash").alias("_c"))
    j = scanned.join(s, "path", "left")
    status = F.when(F.col("_f") == F.col("file_hash"), "unchanged_bytes").when(F.col("_c") == F.col("content_hash"), "unchanged_text").when(F.col("_c").isNull(), "new").otherwise("changed")
    return j.select("path", status.alias("status"))


def signature(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """Cheap figures that change when the table does."""
    size = F.size(vector)
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"), F.sum(size.cast("long") * 4).alias("bytes"), (F.min(size) == F.max(size)).alias("uniform"))


def tag_frequency(note_tags: DataFrame, limit: int | None = None) -> DataFrame:
    out = note_tags.groupBy("tag").agg(F.count("note_id").alias("freq")).orderBy(F.desc("freq"), "tag")
    return out.limit(limit) if limit else out


def category_frequency(notes: DataFrame) -> DataFrame:
    return notes.where("category <> ''").groupBy("category").agg(F.count(F.lit(1)).alias("freq"))


def subtree_counts(notes: DataFrame) -> DataFrame:
    """Notes at or under each node of the category tree: one row a prefix of the
    path, then one aggregation."""
    parts = F.split("category", "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return notes.where("category <> ''").select(F.explode(nodes).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("notes"))


def dashboard(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    n = notes.agg(F.count(F.lit(1)).alias("total"), F.count("last_tagged").alias("tagged"), F.count_if(F.col("category") != "").alias("categorised"))
    return n.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def duplicate_groups(notes: DataFrame) -> DataFrame:
    """(content_hash, n, first_id) of non-empty contents that several notes have."""
    g = notes.where("content_hash <> ''").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return g.where("n > 1")


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """The notes that share a non-empty content, a row each, with their group's
    size and lowest id; no group is gathered."""
    return notes.select("content_hash", "id").join(duplicate_groups(notes), "content_hash").select("content_hash", "n", "first_id", "id")


def unused_tags(tags: DataFrame, note_tags: DataFrame) -> DataFrame:
    return tags.join(note_tags, tags["name"] == note_tags["tag"], "left_anti")


def orphans(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes whose path is not among the files."""
    return notes.join(files, "path", "left_anti").select("id", "path")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The chunk of lowest id of each note."""
    return chunks.groupBy("note_id").agg(F.min("id").alias("chunk_id"), F.min_by("vector", "id").alias("vector"))


def reconcile_tags(rows: DataFrame, canonical: dict[str, str], tags: str = "tags") -> DataFrame:
    """Tags in canonical form, each once, in order of first appearance."""
    from folioscope.functions.text import tag_name

    names = F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv]) if canonical else None
    one = lambda t: F.coalesce(F.element_at(names, tag_name(t)), tag_name(t)) if canonical else tag_name(t)
    return rows.withColumn(tags, F.array_distinct(F.filter(F.transform(tags, one), lambda t: t != "")))


#: Cells into which a round of a quantile divides what is left of a group.
CELLS = 1024


def quantile(rows: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Nearest-rank quantile: the sorted value at round(q * (n - 1)), half to even.

    A number. Each of two rounds counts a group's rows in ``CELLS`` cells between
    its least and greatest value and goes on with the cell of the wanted rank; of
    the distinct values that are left the one of that rank is taken. Windows run
    over counts of cells, never over the rows of a group.
    """
    keys = list(keys)
    left = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    goal = left.groupBy(*keys).agg(F.rint(F.lit(q) * (F.count(F.lit(1)) - 1)).cast("long").alias("_rank"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))

    def with_goal(rows: DataFrame) -> DataFrame:
        named = goal.withColumnsRenamed({k: f"_goal_{k}" for k in keys})
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_goal_{k}")) for k in keys], F.lit(True))
        return rows.join(named, on).drop(*[f"_goal_{k}" for k in keys])

    for _ in range(2):
        width = F.col("_high").cast("double") - F.col("_low").cast("double")
        cell = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("_v").cast("double") - F.col("_low").cast("double")) / width * CELLS))).otherwise(0)
        placed = with_goal(left).select(*keys, "_v", "_rank", cell.alias("_cell"))
        counts = placed.groupBy(*keys, "_cell", "_rank").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        goal = counts.withColumn("_before", before).where("_before <= _rank AND _rank < _before + _n").select(*keys, (F.col("_rank") - F.col("_before")).alias("_rank"), "_low", "_high")
        left = with_goal(left).where("_v BETWEEN _low AND _high").select(*keys, "_v")
    counts = with_goal(left.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_v"))
    return counts.withColumn("_upto", upto).where("_rank < _upto AND _rank >= _upto - _n").select(*keys, F.col("_v").alias(name))


def newest(rows: DataFrame, order: str, keep: int) -> DataFrame:
    """Rows beyond the newest ``keep``, for deletion; of rows as old as the last
    kept one none goes.

    The newest are found by a distributed top-k, and its last value is one row.
    """
    if keep <= 0:
        return rows
    last = rows.select(order).orderBy(F.desc(order)).limit(keep).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_last"))
    return rows.join(F.broadcast(last), (F.col("_n") == keep) & (F.col(order) < F.col("_last"))).select(*rows.columns)


def last_turns(turns: DataFrame, keep: int) -> DataFrame:
    """The last turns of each conversation; none for ``keep`` of 0 or less."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(0, keep)).drop("_k")


def budgeted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, most: int, separator: int = 2) -> DataFrame:
    """Texts that fit a budget of characters, taken in order; one that does not
    fit is skipped and later ones may still fit. Adds ``taken`` and ``used``.

    The fold is per key over the candidates of one question, which are as many
    as were retrieved.
    """
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.length(text).alias("_len")))).alias("_c"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))

    def add(a: Column, x: Column) -> Column:
        cost = x["_len"] + F.when(a["used"] > 0, separator).otherwise(0)
        fits = a["used"] + cost <= most
        return F.struct(F.when(fits, a["used"] + cost).otherwise(a["used"]).alias("used"), F.concat(a["taken"], F.array(F.when(fits, F.size(a["taken"]) + 1).otherwise(-1))).alias("taken"))

    folded = listed.withColumn("_f", F.aggregate("_c", start, add))
    pairs = folded.select(*keys, F.col("_f.used").alias("used"), F.explode(F.arrays_zip(F.col("_c").alias("c"), F.col("_f.taken").alias("t"))).alias("_z"))
    return pairs.select(*keys, *[F.col(f"_z.c.{o}").alias(o) for o in order], (F.col("_z.t") > 0).alias("taken"), "used")


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id is not done yet, also below the largest done one."""
    return rows.join(done, "id", "left_anti")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

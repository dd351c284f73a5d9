"""Resolving names: titles, categories, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import fold, tag_name


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: the better of edit similarity and of containment, scaled down."""
    x, y = fold(a), fold(b)
    longest = F.greatest(F.length(x), F.length(y))
    edit = F.when(longest == 0, 0.0).otherwise(100 * (1 - F.levenshtein(x, y) / longest))
    within = F.when((F.length(x) > 0) & (F.length(y) > 0) & (F.contains(y, x) | F.contains(x, y)), 90.0).otherwise(0.0)
    return F.greatest(edit, within)


#: Words of a mention by which similar titles are looked up.
RAREST = 3


def resolved_mentions(mentions: DataFrame, notes: DataFrame, least: float = 55.0) -> DataFrame:
    """(mention, id, how): by exact path, else by exact title, else the most
    similar title, if it is similar enough; ties go to the lowest id.

    mentions: mention; notes: id, path, title. The similar titles are those that
    share one of the mention's ``RAREST`` rarest words.
    """
    m = mentions.select("mention").distinct()
    path = m.join(notes, F.col("mention") == F.col("path")).select("mention", "id", F.lit(0).alias("_o"), F.lit(100.0).alias("_s"))
    title = m.join(notes, F.lower("mention") == F.lower("title")).select("mention", "id", F.lit(1).alias("_o"), F.lit(100.0).alias("_s"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(fold(c), F.lit("([a-z0-9]{2,})"), 1))
    asked, named = m.select("mention", words(F.col("mention")).alias("words")), notes.select("id", "title", words(F.col("title")).alias("words"))
    # by the words that fewest titles have: a word of all titles would pair all
    df = named.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("_df"))
    rare = asked.select("mention", F.explode("words").alias("w")).join(df, "w").groupBy("mention").agg(F.slice(F.sort_array(F.collect_list(F.struct("_df", "w"))), 1, RAREST).alias("r"))
    rare = rare.select("mention", F.explode("r.w").alias("w"))
    near = rare.join(named.select("id", "title", F.explode("words").alias("w")), "w").select("mention", "id", "title").distinct()
    near = near.select("mention", "id", F.lit(2).alias("_o"), similarity(F.col("mention"), F.col("title")).alias("_s")).where(F.col("_s") >= least)
    best = F.row_number().over(W.partitionBy("mention").orderBy("_o", F.desc("_s"), "id"))
    found = path.union(title).union(near).withColumn("_k", best).where("_k = 1")
    return found.select("mention", "id", F.element_at(F.array(F.lit("path"), F.lit("title"), F.lit("similar")), F.col("_o") + 1).alias("how"))


def category_key(path: Column) -> Column:
    """A category path in comparable form, segment by segment."""
    return F.array_join(F.filter(F.transform(F.split(path, "/"), tag_name), lambda s: s != ""), "/")


def resolved_categories(rows: DataFrame, categories: DataFrame, column: str = "category") -> DataFrame:
    """``rows`` with their category as the tree spells it; null if it has none."""
    known = categories.groupBy(category_key(F.col("path")).alias("_key")).agg(F.min("path").alias("_path"))
    j = rows.withColumn("_k", category_key(F.col(column))).join(known, F.col("_k") == F.col("_key"), "left")
    return j.select(*[F.col("_path").alias(c) if c == column else F.col(c) for c in rows.columns])


def add_category(categories: DataFrame, path: str) -> DataFrame:
    """The tree with a path and the paths above it."""
    parts = [p for p in path.strip("/").split("/") if p]
    rows = [("/".join(parts[: k + 1]), "/".join(parts[:k]), parts[k]) for k in range(len(parts))]
    new = categories.sparkSession.createDataFrame(rows, "path string, parent string, name string").join(categories.select("path"), "path", "left_anti")
    top = categories.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("_top"))
    numbered = new.crossJoin(top).withColumn("ordinal", (F.col("_top") + F.size(F.split("path", "/"))).cast("int"))
    return categories.unionByName(numbered.select("path", "parent", "name", "ordinal"))


def remove_category(categories: DataFrame, path: str) -> DataFrame:
    """The tree without a path and what is below it."""
    return categories.where((F.col("path") != path) & ~F.startswith("path", F.lit(path + "/")))


def available(name: Column, models: Column) -> Column:
    """Whether a model is among the names, with or without its tag."""
    return F.array_contains(models, name) | F.array_contains(models, F.concat(name, F.lit(":latest")))


def generated(metadata: Column) -> Column:
    """Whether a note was written by the engine itself."""
    value = F.lower(F.trim(F.coalesce(F.element_at(metadata, "generated"), F.lit(""))))
    return ~value.isin("", "false", "0", "no", "null")

"""The link graph of notes: edges, statistics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import split_anchor, wikilinks


def title_index(notes: DataFrame) -> DataFrame:
    """(key, id): lower-case titles, the lowest id of those that share one."""
    return notes.where("title IS NOT NULL").groupBy(F.lower("title").alias("key")).agg(F.min("id").alias("id"))


def wikilink_edges(notes: DataFrame) -> DataFrame:
    """(src, dst, label) from links in Markdown notes: each pair once, with the
    anchor of its first link; own and unknown titles are left out.

    notes: id, title, format, text.
    """
    links = notes.where("coalesce(format, 'md') = 'md'").select(F.col("id").alias("src"), F.posexplode(wikilinks(F.col("text"))).alias("place", "target"))
    title, anchor = split_anchor(F.col("target"))
    named = links.select("src", "place", F.lower(title).alias("key"), anchor.alias("anchor")).join(title_index(notes), "key").where("src <> id")
    return named.groupBy("src", F.col("id").alias("dst")).agg(F.min_by(F.struct("anchor"), "place").alias("a")).select("src", "dst", F.col("a.anchor").alias("label"))


def contradiction_edges(contradictions: DataFrame, claims: DataFrame) -> DataFrame:
    """(src, dst, severity): undismissed contradictions at the level of notes, src < dst."""
    c = claims.select("id", "note_id")
    j = contradictions.where("status <> 'dismissed'").join(c.withColumnsRenamed({"id": "claim_a_id", "note_id": "a"}), "claim_a_id").join(c.withColumnsRenamed({"id": "claim_b_id", "note_id": "b"}), "claim_b_id")
    pairs = j.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "id", "severity")
    return pairs.groupBy("src", "dst").agg(F.min_by("severity", "id").alias("severity"))


def nodes(notes: DataFrame, note_tags: DataFrame) -> DataFrame:
    tags = note_tags.groupBy("note_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return notes.join(tags, notes["id"] == tags["note_id"], "left").select("id", "title", "path", "category", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def build(links: DataFrame, suggested: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(src, dst, kind, weight, label) of all kinds of edges."""
    return (
        links.select("src", "dst", F.lit("wikilink").alias("kind"), F.lit(1.0).alias("weight"), "label")
        .unionByName(suggested.select("src", "dst", F.lit("suggested").alias("kind"), F.col("score").alias("weight"), F.lit(None).cast("string").alias("label")))
        .unionByName(contradictions.select("src", "dst", F.lit("contradiction").alias("kind"), F.lit(1.0).alias("weight"), F.col("severity").alias("label")))
    )


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


def dot_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def as_dot(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (part, line) of a DOT file, to be written in order of part."""
    head = nodes_.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("digraph notes {").alias("line"))
    tail = nodes_.sparkSession.range(1).select(F.lit(3).alias("part"), F.lit("}").alias("line"))
    n = nodes_.select(F.lit(1).alias("part"), F.concat(F.lit("  n"), F.col("id"), F.lit(" [label="), dot_quoted(F.coalesce("title", F.lit(""))), F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  n"), F.col("src"), F.lit(" -> n"), F.col("dst"), F.lit(" [label="), dot_quoted(F.col("kind")), F.lit("];")).alias("line"))
    return head.union(n).union(e).union(tail)


def as_json(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a row: nodes, then edges with weights of 6 decimals."""
    n = nodes_.select(F.lit("node").alias("type"), F.to_json(F.struct("id", "title", "path", "category", "tags")).alias("json"))
    e = edges.select(F.lit("edge").alias("type"), F.to_json(F.struct("src", "dst", "kind", F.round("weight", 6).alias("weight"), "label")).alias("json"))
    return n.union(e)


WIDTH, HEIGHT, GAP_X, GAP_Y = 260, 80, 60, 30


def canvas_places(nodes_: DataFrame) -> DataFrame:
    """A column of cards a category, in order of category and title."""
    # columns are numbered over the few categories, not over the notes
    columns = nodes_.select(F.coalesce("category", F.lit("")).alias("c")).distinct().withColumn("col", F.row_number().over(W.orderBy("c")) - 1)
    n = nodes_.withColumn("c", F.coalesce("category", F.lit(""))).join(columns, "c")
    row = F.row_number().over(W.partitionBy("c").orderBy("title", "id")) - 1
    return n.select("id", (F.col("col") * (WIDTH + GAP_X)).alias("x"), (row * (HEIGHT + GAP_Y)).alias("y"))

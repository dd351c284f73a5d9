"""Cutting texts into chunks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1500, 150

log = logging.getLogger(__name__)


def window_step(size: int, overlap: int) -> int:
    return size - (overlap if overlap < size else size // 2)


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of a text; the last one reaches its end."""
    step = window_step(size, overlap)
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sliding_windows(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """note_id, chunk_index, chunk from note_id, text."""
    return rows.select("note_id", F.posexplode(windows(F.col("text"), size, overlap)).alias("chunk_index", "chunk"))


def paragraphs(text: Column) -> Column:
    """Stripped pieces between blank lines."""
    stripped = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", ""))
    return F.filter(stripped, lambda p: p != "")


def packed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed greedily into chunks; a longer one becomes windows."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flushed(a: Column) -> Column:
        return F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])

    def add(a: Column, p: Column) -> Column:
        joined = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n\n"), p))
        pair = lambda done, left: F.struct(done.alias("done"), left.alias("open"))
        return (
            F.when(F.length(p) > size, pair(F.concat(flushed(a), windows(p, size, overlap)), F.lit("")))
            .when(F.length(joined) <= size, pair(a["done"], joined))
            .otherwise(pair(flushed(a), p))
        )

    return F.aggregate(paragraphs(text), empty, add, flushed)


def pack_paragraphs(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """note_id, chunk_index, chunk from note_id, text."""
    return rows.select("note_id", F.posexplode(packed(F.col("text"), size, overlap)).alias("chunk_index", "chunk"))


def pack_sections(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """note_id, chunk_index, chunk, page, heading from note_id and sections
    (array of text, page, heading, order); chunks inherit their section's anchor."""
    s = rows.select("note_id", F.explode(F.sort_array(F.transform("sections", lambda x: F.struct(x["order"].alias("order"), x["page"].alias("page"), x["heading"].alias("heading"), x["text"].alias("text"))))).alias("s"))
    c = s.select("note_id", F.col("s.order").alias("_o"), F.col("s.page").alias("page"), F.col("s.heading").alias("heading"), F.posexplode(packed(F.col("s.text"), size, overlap)).alias("_k", "chunk"))
    listed = c.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("_o", "_k", "chunk", "page", "heading"))).alias("c"))
    return listed.select("note_id", F.posexplode("c").alias("chunk_index", "c")).select("note_id", "chunk_index", "c.chunk", "c.page", "c.heading")


#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.", "fig.", "no.", "p.", "pp."]


def sentences(text: Column) -> Column:
    """Sentences: cut after an end mark before a capital, a quote or a bracket,
    unless the piece before ends in an abbreviation."""
    # most places are passed by their first character
    pieces = F.filter(F.split(text, r"(?=\s)(?<=[.!?])\s+(?=[A-Z\"'(\[])"), lambda p: F.trim(p) != "")
    short = lambda p: F.array_contains(F.array(*map(F.lit, ABBREVIATIONS)), F.lower(F.substring_index(p, " ", -1)))

    def add(a: Column, p: Column) -> Column:
        last = F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
        return F.when(short(last), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), p)))).otherwise(F.concat(a, F.array(p)))

    # few texts have such a piece; the pieces of the others are the sentences
    joined = lambda x: F.when(F.exists(x, short), F.aggregate(x, F.array().cast("array<string>"), add)).otherwise(x)
    return F.transform(F.array(pieces), joined)[0]


def semantic(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = SIZE, least: float = 0.55, overlap: int = OVERLAP) -> DataFrame:
    """note_id, chunk_index, chunk: sentences joined while the next one is near
    the mean of those before. Without vectors, paragraphs are packed."""
    listed = rows.select("note_id", sentences(F.col("text")).alias("sentences"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out = []
            for said in b.column("sentences"):
                said = said.as_py()
                try:
                    v = np.array(embed(said), float) if said else np.zeros((0, 1))
                except Exception:  # noqa: BLE001  the provider may fail in any way
                    log.warning("no vectors for the sentences of a text; paragraphs are packed", exc_info=True)
                    out.append(None)
                    continue
                done, held, mean, length = [], [], None, 0
                for s, x in zip(said or [], v, strict=True):
                    near = mean is not None and float(mean @ x) / (float(np.sqrt(mean @ mean) * np.sqrt(x @ x)) or 1.0) >= least
                    if held and (not near or length + 1 + len(s) > size):
                        done.append(" ".join(held))
                        held, mean = [], None
                    length = length + 1 + len(s) if held else len(s)
                    held.append(s)
                    mean = x if mean is None else mean + x
                out.append([*done, " ".join(held)] if held else done)
            failed = pa.array([x is None for x in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("note_id"), pa.array(out, pa.list_(pa.string())), pc.if_else(failed, b.column("text"), None)], ["note_id", "chunks", "text"])

    # only texts without vectors are packed
    cut = listed.mapInArrow(run, "note_id long, chunks array<string>, text string")
    return cut.select("note_id", F.posexplode(F.coalesce("chunks", packed(F.col("text"), size, overlap))).alias("chunk_index", "chunk"))


def chunked(rows: DataFrame, engine: str = "markdown", **how) -> DataFrame:
    """Chunks by the engine named; unknown names pack paragraphs."""
    if engine == "semantic" and "embed" in how:
        return semantic(rows, **how)
    how.pop("embed", None)
    return pack_sections(rows, **how) if "sections" in rows.columns else pack_paragraphs(rows, **how)

"""Keys that decide whether something has changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Text without differences of formatting: runs of blanks are one space, of
    line ends two, lines have no trailing space, and the ends are stripped."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{2,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t\r\x0b\f]+(\n|\z)", "$1")
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def cache_key(model: str, text: Column) -> Column:
    """The key of an embedding: model, a zero byte, the text."""
    return F.sha2(F.concat(F.lit(model), F.chr(F.lit(0)), text).cast("binary"), 256)


def chunk_hash(model: str, text: Column) -> Column:
    return F.substring(cache_key(model, text), 1, 32)

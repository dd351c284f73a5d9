"""Claims of notes and contradictions between them.

A provider extracts claims from notes and judges pairs of them; what is stored,
compared and skipped is DataFrame work. Steps of a run:

    extracted -> store.replace_claims -> embedded -> similar.claim_pairs -> judged

A note is read again only if its content is not the one that was read before,
which a table of states tells, not its claims: a note may have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.providers import Offline, completed, task_prompt
from folioscope.functions.text import locate_claim, paragraph_around, sanitize_prompt, severity
from folioscope.operators.freshness import new_contradictions

LONGEST = 500


def to_read(notes: DataFrame, states: DataFrame) -> DataFrame:
    """Notes whose content was not read yet; states: note_id, content_hash."""
    known = states.select(F.col("note_id").alias("id"), "content_hash")
    return notes.join(known, ["id", "content_hash"], "left_anti")


def claim_texts(reply: Column) -> Column:
    """The distinct claims in a reply: strings, or objects with a text."""
    listed = F.from_json(F.get_json_object(reply, "$.claims"), "array<string>")
    text = F.transform(listed, lambda x: F.coalesce(F.when(F.startswith(F.trim(x), F.lit("{")), F.get_json_object(x, "$.text")).otherwise(x), F.lit("")))
    return F.array_distinct(F.filter(F.transform(text, lambda x: F.substring(F.trim(x), 1, LONGEST)), lambda x: x != ""))


def extracted(notes: DataFrame, provider=Offline) -> DataFrame:
    """(note_id, claim_text, char_start, char_end); a row without text for a note
    that has no claims or gave no answer. notes: id, text."""
    asked = notes.select("id", "text", task_prompt("claims", sanitize_prompt(F.coalesce("text", F.lit("")))).alias("prompt"))
    replies = completed(asked, "prompt", provider).select(F.col("id").alias("note_id"), "text", F.explode_outer(claim_texts(F.col("reply"))).alias("claim_text"))
    start = locate_claim(F.coalesce("text", F.lit("")), F.col("claim_text")).cast("int")
    return replies.select("note_id", "claim_text", start.alias("char_start"), (start + F.length("claim_text")).alias("char_end"))


def judged(pairs: DataFrame, claims: DataFrame, provider=Offline) -> DataFrame:
    """(claim_a_id, claim_b_id, severity, explanation) of the pairs (a_id, b_id)
    that the provider finds contradictory; a pair without an answer is none."""
    c = claims.select("id", "claim_text")
    j = pairs.join(c.withColumnsRenamed({"id": "a_id", "claim_text": "_a"}), "a_id").join(c.withColumnsRenamed({"id": "b_id", "claim_text": "_b"}), "b_id")
    prompt = task_prompt("verdict", F.lit("A: "), sanitize_prompt(F.col("_a")), F.lit("\nB: "), sanitize_prompt(F.col("_b")))
    r = completed(j.select("a_id", "b_id", prompt.alias("prompt")), "prompt", provider)
    found = F.get_json_object("reply", "$.contradiction") == "true"
    return r.where(found).select(
        F.col("a_id").alias("claim_a_id"), F.col("b_id").alias("claim_b_id"), severity(F.get_json_object("reply", "$.severity")).alias("severity"), F.substring(F.get_json_object("reply", "$.explanation"), 1, 300).alias("explanation")
    )


def recorded(found: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Contradictions with new ones as open rows; known pairs keep their row,
    whatever its status, so one that was dismissed does not come back."""
    from folioscope.operators.store import with_ids

    new = new_contradictions(found, existing.select("claim_a_id", "claim_b_id"))
    numbered = with_ids(new, existing, ["claim_a_id", "claim_b_id"], ["claim_a_id", "claim_b_id"])
    rows = numbered.withColumns({"status": F.lit("open"), "detected_at": now, "resolved_at": F.lit(None).cast("timestamp")})
    return existing.unionByName(rows.select(*existing.columns))


def shown(contradictions: DataFrame, claims: DataFrame, notes: DataFrame) -> DataFrame:
    """Contradictions with both claims, their notes and paragraphs around them."""
    n = notes.select("id", "title", "text")

    def side(letter: str) -> DataFrame:
        c = claims.join(n.withColumnsRenamed({"id": "note_id"}), "note_id", "left")
        around = F.when(F.col("char_start").isNotNull(), paragraph_around(F.col("text"), F.col("char_start"), F.col("char_end")))
        return c.select(F.col("id").alias(f"claim_{letter}_id"), F.col("title").alias(f"title_{letter}"), F.col("claim_text").alias(f"text_{letter}"), around.alias(f"paragraph_{letter}"))

    j = contradictions.join(side("a"), "claim_a_id").join(side("b"), "claim_b_id")
    return j.select("id", "severity", "status", "explanation", *(f"{x}_{y}" for y in "ab" for x in ("title", "text", "paragraph")))


def decay(stale: DataFrame, notes: DataFrame, provider=Offline) -> DataFrame:
    """(note_path, likely_stale, reason) of stale notes (note_path) by a provider; null without an answer."""
    asked = stale.select("note_path").join(notes.select(F.col("path").alias("note_path"), "text"), "note_path")
    prompt = task_prompt("decay", sanitize_prompt(F.coalesce("text", F.lit(""))))
    r = completed(asked.select("note_path", prompt.alias("prompt")), "prompt", provider)
    return r.select("note_path", F.get_json_object("reply", "$.stale").cast("boolean").alias("likely_stale"), F.substring(F.get_json_object("reply", "$.reason"), 1, 300).alias("reason"))

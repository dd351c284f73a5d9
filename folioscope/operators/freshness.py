"""Freshness of notes, claims and contradictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import elapsed_days

#: Days after which a category should be looked at; the first prefix that matches counts.
WINDOWS = [("journal", 30), ("projects", 90), ("reference", 365)]
DEFAULT_WINDOW = 180
STATES = ("open", "dismissed", "resolved")


def window_days(category: Column, windows: Sequence[tuple[str, int]] = WINDOWS, default: int = DEFAULT_WINDOW) -> Column:
    out = F.lit(default)
    for prefix, days in reversed(windows):
        out = F.when((category == prefix) | F.startswith(category, F.lit(prefix + "/")), days).otherwise(out)
    return out


def stale(freshness: DataFrame, notes: DataFrame, today: Column) -> DataFrame:
    """Overdue notes, the most overdue first."""
    j = freshness.join(notes, freshness["note_path"] == notes["path"])
    days = elapsed_days(F.col("last_verified"), today)
    out = j.select("note_path", "title", days.alias("days"), "window_days", (days - F.col("window_days")).alias("days_overdue"))
    return out.where("days > window_days").orderBy(F.desc("days_overdue"), "note_path")


def seed(notes: DataFrame, freshness: DataFrame) -> DataFrame:
    """What seeding would do: add, update (another window), keep or remove."""
    n = notes.select(F.col("path").alias("note_path"), F.coalesce("last_tagged", "last_seen").alias("anchor"), window_days(F.coalesce("category", F.lit(""))).alias("new_window"))
    f = freshness.select("note_path", F.col("last_verified").alias("verified"), F.col("window_days").alias("old_window"))
    j = n.join(f, "note_path", "full_outer")
    action = F.when(F.col("old_window").isNull(), "add").when(F.col("new_window").isNull(), "remove").when(F.col("old_window") != F.col("new_window"), "update").otherwise("keep")
    return j.select("note_path", F.coalesce("verified", "anchor").alias("last_verified"), F.coalesce("new_window", "old_window").alias("window_days"), action.alias("action"))


def verify(freshness: DataFrame, paths: DataFrame, now: Column) -> DataFrame:
    """Freshness with the given paths verified now and their verdict cleared."""
    p = paths.select("note_path", F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    out = freshness.join(p, "note_path", "left").withColumn("last_verified", F.when(hit, now).otherwise(F.col("last_verified")))
    for c in ("decay_check_at", "likely_stale"):
        if c in freshness.columns:
            out = out.withColumn(c, F.when(~hit, F.col(c)))
    return out.select(*freshness.columns)


def listed_contradictions(contradictions: DataFrame, claims: DataFrame, status: str | None = "open") -> DataFrame:
    """Contradictions with both claims; the severe first, then the recent."""
    c = claims.select("id", "note_id", "claim_text")
    rows = contradictions if status is None else contradictions.where(F.col("status") == status)
    j = rows.join(c.withColumnsRenamed({"id": "claim_a_id", "note_id": "note_a", "claim_text": "text_a"}), "claim_a_id").join(c.withColumnsRenamed({"id": "claim_b_id", "note_id": "note_b", "claim_text": "text_b"}), "claim_b_id")
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return j.select("id", "severity", "status", "note_a", "text_a", "note_b", "text_b", "detected_at", order.alias("severity_order")).orderBy("severity_order", F.desc("detected_at"), "id")


def set_status(contradictions: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """Contradictions with a new status for some; terminal ones get a time."""
    if status not in STATES:
        raise ValueError(f"unknown status: {status}")
    hit = F.col("_hit").isNotNull()
    j = contradictions.join(ids.select("id", F.lit(1).alias("_hit")), "id", "left")
    resolved = F.when(hit, now if status != "open" else F.lit(None).cast("timestamp")).otherwise(F.col("resolved_at") if "resolved_at" in contradictions.columns else F.lit(None).cast("timestamp"))
    out = j.withColumn("resolved_at", resolved).withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    return out.select(*dict.fromkeys([*contradictions.columns, "resolved_at"]))


def new_contradictions(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Found pairs in canonical order, each once, without those known."""
    pair = lambda d: d.withColumns({"claim_a_id": F.least("claim_a_id", "claim_b_id"), "claim_b_id": F.greatest("claim_a_id", "claim_b_id")})
    return pair(found).dropDuplicates(["claim_a_id", "claim_b_id"]).join(pair(existing), ["claim_a_id", "claim_b_id"], "left_anti")

"""Quality of retrieval and answers over golden questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import citations, title_matches

OUTCOMES = ("ok", "retrieval_miss", "ranking_miss", "generation_miss", "citation_miss", "hallucinated", "na")
KEYWORDS_PASS = 0.5
EPS = 1e-9


def matched(expected: Column, title: Column) -> Column:
    return F.exists(expected, lambda e: title_matches(e, title))


def hit_at(titles: Column, expected: Column, k: Column | int) -> Column:
    """Whether an expected title is among the first k; true if none is expected."""
    k = F.lit(k) if isinstance(k, int) else k
    return (F.size(expected) == 0) | F.exists(F.slice(titles, F.lit(1), F.greatest(k, F.lit(0))), lambda t: matched(expected, t))


def recall(titles: Column, expected: Column) -> Column:
    found = F.size(F.filter(expected, lambda e: F.exists(titles, lambda t: title_matches(e, t))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(found / F.size(expected))


def reciprocal_rank(titles: Column, expected: Column) -> Column:
    first = F.array_position(F.transform(titles, lambda t: matched(expected, t)), True)
    return F.when(F.size(expected) == 0, 1.0).when(first > 0, 1.0 / first).otherwise(0.0)


def faithfulness(answer: Column, dropped: Column) -> Column:
    """Share of citations that were grounded; 1 without any."""
    total = F.size(citations(F.coalesce(answer, F.lit("")))) + F.greatest(dropped, F.lit(0))
    return F.when(total == 0, 1.0).otherwise(1.0 - dropped / total)


def outcome(negative: Column, generated: Column, titles: Column, expected: Column, top: Column | int, keywords: Column, faith: Column, declined: Column) -> Column:
    """The first stage that failed a turn."""
    return (
        F.when(negative & declined.isNull(), "na")
        .when(negative, F.when(declined, "ok").otherwise("hallucinated"))
        .when(F.size(expected) == 0, "ok")
        .when(~hit_at(titles, expected, F.size(titles)), "retrieval_miss")
        .when(~hit_at(titles, expected, top), "ranking_miss")
        .when(~generated, "ok")
        .when(keywords < KEYWORDS_PASS, "generation_miss")
        .when(faith < 1.0, "citation_miss")
        .otherwise("ok")
    )


def scored(turns: DataFrame, top: int = 5) -> DataFrame:
    """Turns (case_id, turn_index, category, negative, expected, titles) with metrics."""
    t, e = F.col("titles"), F.col("expected")
    return turns.withColumns({
        "hit_at_1": hit_at(t, e, 1), "hit_at_3": hit_at(t, e, 3), "mrr": F.round(reciprocal_rank(t, e), 6), "recall": F.round(recall(t, e), 6),
        "outcome": outcome(F.col("negative"), F.lit(False), t, e, top, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("boolean")),
    })


def summary(turns: DataFrame) -> DataFrame:
    """Means over the positive turns, and the share of turns that passed."""
    good = ~F.col("negative")
    rate = lambda c: F.round(F.avg(F.when(good, F.col(c).cast("double"))), 6)
    assessed = F.col("outcome") != "na"
    return turns.agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(good).alias("positive"), rate("hit_at_1").alias("hit_at_1"), rate("hit_at_3").alias("hit_at_3"), rate("mrr").alias("mrr"), rate("recall").alias("recall"),
        F.round(F.avg(F.when(assessed, (F.col("outcome") == "ok").cast("double"))), 6).alias("pass_rate"),
    )


def by_category(turns: DataFrame) -> DataFrame:
    return turns.where("NOT negative").groupBy("category").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("hit_at_1", "hit_at_3", "mrr")))


def outcomes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def failures(turns: DataFrame, top: int = 5) -> DataFrame:
    """(case_id, turn_index, outcome, shown) of turns that failed, with the first
    titles retrieved."""
    return turns.where(~F.col("outcome").isin("ok", "na")).select("case_id", "turn_index", "outcome", F.slice("titles", 1, top).alias("shown"))


def stage_means(turns: DataFrame, timings: str = "timings") -> DataFrame:
    """Mean of each stage over the turns that report it."""
    return turns.select(F.explode(timings).alias("stage", "seconds")).groupBy("stage").agg(F.round(F.avg("seconds"), 6).alias("seconds"))


def turn_status(before: Sequence[Column], after: Sequence[Column]) -> Column:
    """regressed if a metric fell, improved if one rose, else same; both: changed."""
    fell, rose = F.lit(False), F.lit(False)
    for b, a in zip(before, after, strict=True):
        fell = fell | F.coalesce(a < b - EPS, F.lit(False))
        rose = rose | F.coalesce(a > b + EPS, F.lit(False))
    return F.when(fell & rose, "changed").when(fell, "regressed").when(rose, "improved").otherwise("same")


def compared(before: DataFrame, after: DataFrame, metrics: Sequence[str] = ("mrr", "recall")) -> DataFrame:
    """Turns of two runs by case and index: new, dropped, or how they changed."""
    keys = ["case_id", "turn_index"]
    b, a = before.select(*keys, F.lit(True).alias("_b"), *[F.col(m).alias(f"b_{m}") for m in metrics]), after.select(*keys, F.lit(True).alias("_a"), *[F.col(m).alias(f"a_{m}") for m in metrics])
    j = b.join(a, keys, "full_outer")
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "dropped").otherwise(turn_status([F.col(f"b_{m}") for m in metrics], [F.col(f"a_{m}") for m in metrics]))
    return j.select(*keys, *[F.round(F.col(f"a_{m}") - F.col(f"b_{m}"), 6).alias(f"d_{m}") for m in metrics], status.alias("status"))

"""Quality rules with a robust multivariate outlier test, in DataFrame operations.

``statistics`` counts, over each whole text, its words, their characters,
symbols, characters that are no letters, repeated lines and words inside
repeated 3-word windows. A base rule fails short or very repetitive texts. For
the rest, four transformed statistics (the logarithm of the mean word length;
the arcsine roots of the shares of characters that are no letters, of repeated
lines and of repeated words) are compared with the minimum-covariance-
determinant estimate of their language and source. Shares have pseudo-counts
(``PRIOR``), so that they vary among short texts less than chance has it, and
among texts without repeats with their size.

The estimate has several starts: medians with median absolute deviations;
medians with the correlation of squashed scores; mean and covariance of all
rows. From each, concentration steps keep the three quarters of the rows
nearest to the current centre and shape, until no determinant falls any more.
Of a group's starts the one of least determinant is taken, and the rows within
its 97.5 % ellipsoid give the final estimate. A document whose squared
Mahalanobis distance is over the ``CUT`` quantile of chi-square is rejected.

Medians and cuts come from counts in fixed cells, and covariances from sums, so
all of it is partially aggregated and no group meets in one task.

Cases: a null or empty text has counts 0 and fails the base rule; null language
or source is a value like others; groups with fewer than ``LEAST`` rows are
pooled by language, and where that has too few, over all; an estimate from
fewer than ``KEEP`` of ``LEAST`` rows rejects nothing; statistics that do not vary, or only with
others, get the guard ``FLOOR`` as spread; repeated rows count as rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, written

FEATURES = ("f0", "f1", "f2", "f3")
D = len(FEATURES)
KEEP = 0.75
#: Concentration steps at most, and the fall of a log determinant that still counts.
STEPS, SETTLED = 20, 1e-2
STARTS = 3
LEAST = 100
CUT = 0.9999
#: Pseudo-counts: words of 5 characters, one in 33 of which is no letter; lines; repeated words.
PRIOR_WORDS, PRIOR_LINES, PRIOR_REPEATS = 100, 1, 4
#: Least standard deviation of each statistic given those before it: a guard for
#: groups whose rows are equal or lie on a plane.
FLOOR = (0.004, 0.004, 0.03, 0.008)
#: Cells a unit for medians of the statistics, and for distances.
CELLS, NEAR = 512, 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a 3-word window found twice or more in it."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(order: Column) -> Column:
        twice = F.transform(
            order,
            lambda x, i: F.when((i > 0) & (F.get(order, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"]), x["i"]),
        )
        return F.array_sort(F.array_compact(twice))

    def counted(hashes: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(marked), lambda order: let(places(order), covered)))

    def windows(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(windows(w), counted)))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_other,
    n_dup_lines, n_repeat_words, n_lines) of every row."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return docs.select(
        "doc_id", "lang", "source", let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\x20\x09-\x0D]")).cast("long").alias("n_other")
    ).select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "n_other", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def transformed(stats: DataFrame) -> DataFrame:
    """``stats`` with the statistics that are compared."""

    def root(part: Column, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), part / whole)))

    chars = F.col("word_chars") + 5 * PRIOR_WORDS
    return stats.withColumns({
        "f0": F.log(chars / (F.col("n_words") + PRIOR_WORDS)),
        "f1": root(F.col("n_other") + 0.15 * PRIOR_WORDS, chars),
        "f2": root(F.col("n_dup_lines") + PRIOR_LINES, F.col("n_lines") + 2 * PRIOR_LINES),
        "f3": root(F.col("n_repeat_words") + PRIOR_REPEATS, F.col("n_words") + 2 * PRIOR_REPEATS),
    })


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function for an even d."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(p: float) -> float:
    """Factor of a covariance of the share p that is nearest."""
    return p / chi2_cdf(chi2_quantile(p, D), D + 2)


def cell_quantile(rows: DataFrame, keys: list[str], value: Column, cells: float, share: float, name: str) -> DataFrame:
    """The upper end of the cell in which ``share`` of each key's rows is reached.

    Rows are counted by cell first; what meets in a task are counts of cells.
    """
    n = rows.groupBy(*keys, F.floor(value * cells).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(((F.floor(F.percentile("_cell", F.lit(share), F.col("_n"))) + 1) / cells).alias(name))


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
MEANS, SHAPE = [f"m{i}" for i in range(D)], [f"l{i}{j}" for i, j in PAIRS]


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Per key the mean and the Cholesky factor of the covariance of ``rows``."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(m) for f, m in zip(FEATURES, MEANS, strict=True))]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in PAIRS]
    return _factor(rows.groupBy(*keys).agg(*sums), keys, factor)


def _factor(p: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Cholesky factors of the covariances c; ``det`` is the log determinant."""
    for i, j in PAIRS:
        c = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}") * factor)  # noqa: B023
        p = p.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(FLOOR[i] ** 2))) if i == j else c / F.col(f"l{j}{j}"))
    return p.select(*keys, "n", *MEANS, *SHAPE, reduce(lambda a, i: a + 2 * F.log(f"l{i}{i}"), range(D), F.lit(0.0)).alias("det"))


def _distances(rows: DataFrame, shape: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their squared Mahalanobis distance ``d2`` under their key."""
    named = shape.drop("det").withColumnsRenamed({k: f"_{k}" for k in keys} | {"n": "_fitted"})
    out = rows.join(named, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys]), "left")
    for i in range(D):
        y = F.col(FEATURES[i]) - F.col(f"m{i}")
        y = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), y)  # noqa: B023
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(1, D), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2", "_fitted")


def _starts(fit: DataFrame) -> DataFrame:
    """Centres and shapes (g, s, n, m, l, det) that concentration begins from."""
    long = fit.select("g", F.posexplode(F.array(*FEATURES)).alias("i", "x"))
    middle = written(cell_quantile(long, ["g", "i"], F.col("x"), CELLS, 0.5, "m"))
    away = long.join(middle.withColumnsRenamed({"g": "_g", "i": "_i"}), (F.col("g") == F.col("_g")) & (F.col("i") == F.col("_i"))).select("g", "i", F.abs(F.col("x") - F.col("m")).alias("x"))
    spread = cell_quantile(away, ["g", "i"], F.col("x"), CELLS, 0.5, "s")
    guard = F.element_at(F.array(*map(F.lit, FLOOR)), F.col("i") + 1)
    both = middle.join(spread.withColumnsRenamed({"g": "_g", "i": "_i"}), (F.col("g") == F.col("_g")) & (F.col("i") == F.col("_i")))
    both = both.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"a{i}") for i in range(D)), *(F.max(F.when(F.col("i") == i, F.greatest(1.4826 * F.col("s"), guard))).alias(f"s{i}") for i in range(D)))
    both = written(both)
    discard(middle)

    def score(i: int) -> Column:
        return F.tanh((F.col(FEATURES[i]) - F.col(f"a{i}")) / F.col(f"s{i}"))

    z = fit.join(both.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g"))
    sums = [F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f"b{i}") for i, f in enumerate(FEATURES)), *(F.first(f"{x}{i}").alias(f"{x}{i}") for x in "as" for i in range(D))]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"v{i}{j}") for i, j in PAIRS] + [F.avg(score(i) * score(j)).alias(f"t{i}{j}") for i, j in PAIRS]
    per_group = z.groupBy("g").agg(*sums)

    def start(s: int) -> DataFrame:
        centre = "b" if s == 2 else "a"
        spread_of = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
        shape = {
            0: lambda i, j: spread_of(i, j) if i == j else F.lit(0.0),
            1: lambda i, j: spread_of(i, j) * F.col(f"t{i}{j}") / F.greatest(F.sqrt(F.col(f"t{i}{i}") * F.col(f"t{j}{j}")), F.lit(1e-9)),
            2: lambda i, j: F.col(f"v{i}{j}"),
        }[s]
        return per_group.select("g", F.lit(s).alias("s"), "n", *(F.col(f"{centre}{i}").alias(f"m{i}") for i in range(D)), *(shape(i, j).alias(f"c{i}{j}") for i, j in PAIRS))

    return written(_factor(reduce(DataFrame.union, map(start, range(STARTS))), ["g", "s"], 1.0))


def estimate(fit: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group ``g``."""
    keys, near = ["g", "s"], F.log1p(F.col("d2"))
    tried = fit.withColumn("s", F.explode(F.array(*map(F.lit, range(STARTS)))))
    shape = _starts(fit)
    for step in range(STEPS):
        d = _distances(tried, shape, keys)
        cut = written(cell_quantile(d, keys, near, NEAR, KEEP, "cut").withColumnsRenamed({k: f"_{k}" for k in keys}))
        nearest = d.join(cut, (F.col("g") == F.col("_g")) & (F.col("s") == F.col("_s"))).where(near < F.col("cut"))
        after = written(_moments(nearest, keys, consistency(KEEP)))
        fell = after.join(shape.select("g", "s", F.col("det").alias("_det")), keys).select(F.max(F.col("_det") - F.col("det"))).first()[0]
        discard(shape)
        discard(cut)
        shape = after
        # the starts themselves were no estimates, so their determinants say nothing
        if step and (fell is None or fell < SETTLED):
            break
    least = shape.groupBy("g").agg(F.min_by(F.struct("n", *MEANS, *SHAPE, "det"), F.struct("det", "s")).alias("_x")).select("g", "_x.*")
    inside = _distances(fit, least, ["g"]).where(F.col("d2") <= chi2_quantile(0.975, D))
    final = written(_moments(inside, ["g"], consistency(0.975)))
    discard(shape)
    return final


def _grouped(rows: DataFrame, passed: Column) -> DataFrame:
    """Adds the group ``g``: language and source, or what it is pooled into."""
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    # group tables are written so that the planner sees their size: a small one
    # is broadcast, and the rows of a hot group stay where they are
    n = written(rows.where(passed).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n")))
    per_lang = written(n.where(F.col("_n") < LEAST).groupBy("lang").agg(F.sum("_n").alias("_nl")))
    n = n.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_n")
    per_lang = per_lang.select(F.col("lang").alias("_lang2"), "_nl")
    out = rows.join(n, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = out.join(per_lang, F.col("lang").eqNullSafe(F.col("_lang2")), "left")
    g = F.when(F.col("_n") >= LEAST, F.to_json(F.array(lang, source))).when(F.col("_nl") >= LEAST, F.to_json(F.array(lang))).otherwise("[]")
    return out.select(*rows.columns, g.alias("g"))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, squared distance ``d2`` and ``kept`` of every row."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(transformed(statistics(docs)).withColumn("base_failed", base))
    rows = written(_grouped(stats, ~F.col("base_failed")))
    discard(stats)
    fit = rows.where(~F.col("base_failed")).select("g", *FEATURES)
    d = _distances(rows, estimate(fit), ["g"])
    verdict = (F.col("d2") <= chi2_quantile(CUT, D)) | (F.coalesce("_fitted", F.lit(0)) < KEEP * LEAST)
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict, F.lit(True)))

import re
import unicodedata
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import quality as Q

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id long, text string, lang string, source string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(unicodedata.category(c)[0] not in "LM" and c not in SPACE for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c d", "a b c a b c", "x x x x x", "a b c x a b c a b c", "l\nl\n\n \nl", "# $ <b> &amp; |", "é ö\x0bß\x85z\xa0z", "ab " * 30_000, "a b c d " * 40 + "z", "中 文 字 中 文 字"]


def test_counts(spark):
    d = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(TEXTS)], COLUMNS).withColumn("n_words", F.lit("clash"))
    for r in Q.statistics(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_other, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab \n#", max_size=40), min_size=30, max_size=30))
def test_counts_of_any_text(spark, texts):
    d = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], COLUMNS)
    for r in Q.statistics(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_other, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def corpus(n=300, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(r.integers(60, 200))]
        if k % 15 == 0:
            words = [w + "###$$$" for w in words]
        rows.append((k, " ".join(words), ["en", "de", None][k % 3], "s1" if k % 2 else None))
    return rows


def test_outliers_are_rejected_and_clean_kept(spark):
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(corpus(), COLUMNS)).collect()}
    assert all(not got[k].kept for k in range(0, 300, 15))
    assert np.mean([got[k].kept for k in range(300) if k % 15]) == 1.0


def cell(x, share, cells=Q.CELLS):
    """The upper end of the cell in which the share of the values is reached."""
    return (np.floor(np.quantile(np.floor(x * cells), share)) + 1) / cells


def brute_estimate(x):
    """Centre, shape and log determinant of each start, after concentration."""
    floor, out = np.array(Q.FLOOR), []

    def guarded(s):
        low = np.zeros((Q.D, Q.D))
        for i in range(Q.D):
            for j in range(i):
                low[i, j] = (s[i, j] - low[i] @ low[j]) / low[j, j]
            low[i, i] = np.sqrt(max(s[i, i] - low[i] @ low[i], floor[i] ** 2))
        return low @ low.T

    def distance(m, s):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)

    def moments(rows, factor):
        return rows.mean(0), guarded(factor * np.cov(rows.T, bias=True))

    m = np.array([cell(c, 0.5) for c in x.T])
    sd = np.maximum([1.4826 * cell(np.abs(c - k), 0.5) for c, k in zip(x.T, m, strict=True)], floor)
    z = np.tanh((x - m) / sd)
    t = z.T @ z / len(x)
    starts = [(m, np.diag(sd**2)), (m, np.outer(sd, sd) * t / np.sqrt(np.outer(np.diag(t), np.diag(t)))), moments(x, 1.0)]
    for centre, s in starts:
        s = guarded(s)
        for _ in range(Q.STEPS):
            near = np.log1p(distance(centre, s))
            centre, s = moments(x[near < cell(near, Q.KEEP, Q.NEAR)], Q.consistency(Q.KEEP))
        out.append((np.linalg.slogdet(s)[1], centre, s))
    _, centre, s = min(out, key=lambda r: r[0])
    centre, s = moments(x[distance(centre, s) <= Q.chi2_quantile(0.975, Q.D)], Q.consistency(0.975))
    return out, distance(centre, s)


def test_verdicts_equal_numpy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source")
    d = spark.createDataFrame(corpus(400), COLUMNS).union(docs)
    got = Q.judge(d).where("NOT base_failed").toPandas()
    off = 0
    for _, g in got.groupby("g"):
        x = g[list(Q.FEATURES)].to_numpy()
        _, want = brute_estimate(x)
        # starts that end equally well may be told apart differently
        off += int(not np.allclose(want, g["d2"], rtol=0.02, atol=0.02))
        assert (g["kept"] == (want <= Q.chi2_quantile(Q.CUT, Q.D))).mean() > 0.98
        # the data, not the guard, give the shape
        assert (x.std(0)[[0, 1, 3]] > np.array(Q.FLOOR)[[0, 1, 3]]).all()
    assert off <= 0.1 * got["g"].nunique()


def statistics_table(spark, x):
    return spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, f0 double, f1 double, f2 double, f3 double")


def test_least_determinant_of_several_starts(spark):
    """A fifth of the rows lies apart in a tight cluster: mean and covariance of
    all rows would take it in, the least determinant does not."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0.4, 0.1, (400, 4)), r.normal(1.4, 0.01, (100, 4))])
    got = Q.estimate(statistics_table(spark, x)).first()
    assert max(abs(got[f"m{i}"] - 0.4) for i in range(4)) < 0.03
    starts, _ = brute_estimate(x)
    assert got.n <= 400 and min(s[0] for s in starts) < np.linalg.slogdet(np.cov(x.T))[1] - 2


def test_shape_not_only_spread_rejects(spark):
    """A row that is usual in each statistic but not in their combination."""
    r = np.random.default_rng(9)
    a = r.normal(0, 0.1, 500)
    x = np.stack([a, a + r.normal(0, 0.01, 500), r.normal(0, 0.1, 500), r.normal(0, 0.1, 500)], 1)
    fit = statistics_table(spark, x)
    odd = spark.createDataFrame([("g", 0.1, -0.1, 0.0, 0.0), ("g", 0.1, 0.1, 0.0, 0.0)], fit.schema)
    far, near = (v.d2 for v in Q._distances(odd, Q.estimate(fit), ["g"]).collect())
    assert near < Q.chi2_quantile(0.975, 4) and far > Q.chi2_quantile(Q.CUT, 4)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert Q.judge(empty).count() == 0
    same = spark.createDataFrame([(1, "word " * 60, "en", "s")] * 60 + [(2, None, None, None)], COLUMNS)
    got = Q.judge(same).collect()
    assert len(got) == 61 and all(r.base_failed and not r.kept for r in got)
    few = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)), "en", "s")], COLUMNS)
    assert Q.judge(few).first().kept


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame(corpus(60), COLUMNS)
    plan = Q.judge(d)._jdf.queryExecution().executedPlan().toString() + Q.statistics(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_lines_and_words_are_rejected(spark):
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    rows, lines, words = [], range(0, 300, 50), range(25, 300, 50)
    for k in range(300):
        text = [[word() for _ in range(10)] for _ in range(20)]
        if k in lines:
            # short lines, so that few words repeat
            text += [["x"]] * 9
        elif k in words:
            # a fifth of the words in windows that occur twice, in other lines
            for i in range(4):
                text[2 * i][:5] = text[2 * i + 1][5:] = [f"w{i}{j}" for j in range(5)]
        rows.append((k, "\n".join(" ".join(x) for x in text), "en", "s"))
    got = {x.doc_id: x for x in Q.judge(spark.createDataFrame(rows, COLUMNS)).collect()}
    for k, x in got.items():
        assert not x.base_failed and (x.n_dup_lines > 0) == (k in lines)
        assert x.kept == (k not in lines and k not in words), k

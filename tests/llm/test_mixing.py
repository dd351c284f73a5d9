from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import mixing as M

COLUMNS = "doc_id long, text string, source string, n_chars long"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return out


def docs(spark, n=600, seed=1):
    r = np.random.default_rng(seed)
    rows = [(k, " ".join("w" * r.integers(1, 9) for _ in range(int(r.lognormal(3, 1)))), [None, "a", "b", "B", "é", "", "big"][min(6, k % 13)], 1) for k in range(n)]
    rows += [(n, None, "z", 0), (n + 1, "", "z", 0), (5, "copy of an id", "a", 1), (5, "copy of an id", "a", 1), (None, "no id", "a", 1)]
    return spark.createDataFrame(rows, COLUMNS).withColumn("target", F.lit("clash"))


def test_targets_and_taken(spark):
    d = docs(spark)
    rows = d.collect()
    sizes, biggest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len((r.text or "").split())
        sizes[r.source] += n
        biggest[r.source] = max(biggest[r.source], n)
    want = brute_targets(dict(sizes))
    got = M.plan(d).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + biggest[s] / 4 + 1, s


def test_reruns_and_layouts_agree(spark):
    d = docs(spark)
    a = Counter(map(tuple, M.plan(d).collect()))
    assert a == Counter(map(tuple, M.plan(d.repartition(7)).collect()))


def test_mix_repeats_rows(spark):
    d = docs(spark)
    want = Counter()
    for r in M.plan(d).collect():
        want[r.doc_id] += r.copies
    mixed = M.mix(d)
    assert mixed.columns == d.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +want


def test_edge_tables(spark):
    assert M.plan(docs(spark).limit(0)).count() == 0 and M.mix(docs(spark).limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None, 0)], COLUMNS)
    assert [(r.target, r.copies) for r in M.plan(none).collect()] == [(0.0, 0)]
    one = spark.createDataFrame([(1, "a b c", "s", 0)], COLUMNS)
    assert [(r.target, r.copies) for r in M.plan(one).collect()] == [(3.0, 1)]


def test_no_python_in_the_plan(spark):
    plan = M.mix(docs(spark).where("true"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

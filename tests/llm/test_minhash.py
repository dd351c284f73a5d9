import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import minhash as M

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute(texts, percent=80):
    """Components by comparing all pairs of rows; texts: [(id, text)]."""
    parent = {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in texts]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in texts}


def family(r, n, size=60, changes=6):
    base = [f"w{r.integers(0, 5000)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for k in r.choice(size, r.integers(0, changes), replace=False):
            w[k] = f"x{r.integers(0, 9999)}"
        yield " ".join(w)


def rows(seed):
    r = np.random.default_rng(seed)
    texts = [None, "", " \n", "One", "ONE", "one two", "One  two\n", "é É", "a b c d e f", "a b c d e g"]
    for size in (5, 12, 60, 300):
        for _ in range(3):
            texts += family(r, 25, size, max(2, size // 7))
    texts += ["copy of a text that is long enough"] * 40
    order = r.permutation(len(texts))
    return [(int(k), texts[i]) for k, i in enumerate(order)]


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 16)
    for seed in range(3):
        texts = rows(seed)
        d = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], COLUMNS).withColumn("bands", F.lit("clash"))
        want = brute(texts)
        got = {r.doc_id: r for r in M.near_duplicates(d).collect()}
        for i, t in texts:
            assert got[i].n_shingles == len(shingles(t))
            assert got[i].component_id == want[i], (t, texts[want[i]])
            assert got[i].kept == (want[i] == i)


def test_chain_without_a_common_centre(spark):
    """Each links to its neighbours only; all are one component."""
    words = [f"w{k}" for k in range(400)]
    texts = [(k, " ".join(words[10 * k : 10 * k + 200])) for k in range(15)]
    assert set(brute(texts).values()) == {0}
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], COLUMNS)
    assert {r.component_id for r in M.near_duplicates(d).collect()} == {0}


def test_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c", None, None, 1), (1, "a b c", None, None, 1), (2, "a b c", None, None, 1), (None, "a b c", None, None, 1), (None, "a b c", None, None, 1)], COLUMNS)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(d).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True)]
    kept = M.representatives(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None"]
    assert M.near_duplicates(d.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    d = spark.createDataFrame([(1, long, None, None, 1), (2, long + " end", None, None, 1)], COLUMNS)
    assert {r.component_id for r in M.near_duplicates(d).collect()} == {1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbé \n\t\x0b\x1c", max_size=20)), max_size=12))
def test_sets_of_any_text(texts):
    got = list(M.shingle_sets(pa.array(texts, pa.string())))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for a, x in zip(texts, got, strict=True):
        for b, y in zip(texts, got, strict=True):
            assert len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b))


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(2)
    for n in (1, 3, 16, 17, 100, 1000):
        items = np.unique(r.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        a, b = np.sort(items[:n]), np.sort(items[n // 10 : n + n // 12])
        same = len(np.intersect1d(a, b))
        link = 100 * same >= 80 * (len(a) + len(b) - same)
        i, _ = M.close_pairs([M.parity_sketch(a)], [M.parity_sketch(b)], np.array([len(a)]), np.array([len(b)]), 80)
        assert len(i) or not link


def test_signatures_agree_as_often_as_sets_do():
    r = np.random.default_rng(4)
    same = []
    for _ in range(60):
        items = np.unique(r.integers(0, 1 << 63, 40).astype(np.uint64))
        a, b = np.sort(items[:36]), np.sort(items[4:])
        same.append((M.signature(a) == M.signature(b)).mean())
    assert abs(np.mean(same) - 0.8) < 0.03


def wide(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def test_sets_of_wider_shingles():
    texts = [None, "", " \n", "a", "a b", "b a", "a b c d", "a b c d e", "A b c\td e", "a b c d e f", "x a b c d e", "e d c b a", "a b c d e a b c d e"]
    for width in (1, 2, 3, 5):
        got = list(M.shingle_sets(pa.array(texts, pa.string()), width))
        for a, x in zip(texts, got, strict=True):
            assert len(x) == len(wide(a, width))
            for b, y in zip(texts, got, strict=True):
                assert len(np.intersect1d(x, y)) == len(wide(a, width) & wide(b, width)), (width, a, b)


def test_components_of_wider_shingles(spark, monkeypatch):
    texts = rows(1)
    monkeypatch.setattr("tests.llm.test_minhash.shingles", lambda text: wide(text, 5))
    want = brute(texts)
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], COLUMNS)
    assert {r.doc_id: r.component_id for r in M.near_duplicates(d, width=5).collect()} == want

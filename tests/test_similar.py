"""Pruned exact joins of vectors against comparing everything."""

import numpy as np
import pytest

from folioscope.operators import similar as M


def clustered(n, d, groups, seed, spread=0.25, lengths=False):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, d))
    x = centres[r.integers(0, groups, n)] + spread * r.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x * r.uniform(0.2, 3, n)[:, None] if lengths else x


def frame(spark, x, notes=3):
    rows = [(k, k // notes, v.tolist() if v is not None else None) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, note_id long, vector array<double>").repartition(4)


def brute_pairs(x, least):
    s = np.round(x @ x.T, 6)
    return {(int(i), int(j)): s[i, j] for i, j in zip(*np.nonzero(np.triu(s >= least, 1)), strict=True)}


@pytest.fixture(autouse=True, params=[1.1, -1.0], ids=["bounds", "all"])
def small(monkeypatch, request):
    """Small blocks, with and without bounds, and no way around the tiles."""
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "FEW", 4)
    monkeypatch.setattr(M, "MOSTLY", request.param)


@pytest.mark.parametrize("lengths", [False, True])
@pytest.mark.parametrize("least", [0.9, 0.5, 0.0, -0.5])
def test_pairs(spark, least, lengths):
    x = clustered(160, 8, 6, 1, lengths=lengths)
    x[5], x[6] = x[7], 0.0
    got = {(r.a_id, r.b_id): r.score for r in M.pairs_over(frame(spark, x), least).collect()}
    want = brute_pairs(x, least)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("least", [None, 0.6])
def test_best(spark, apart, least):
    x = clustered(170, 8, 5, 2, lengths=True)
    x[11:15], x[20] = x[10], 0.0
    f = frame(spark, x)
    got = {}
    for r in M.top_k(f, f, 6, apart=apart, least=least).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    s = np.round(x @ x.T, 6)
    for q in range(len(x)):
        order = sorted((-s[q, j], j) for j in range(len(x)) if not (apart and j // 3 == q // 3) and (least is None or s[q, j] >= least))
        assert got.get(q, []) == [(j, round(-v, 6)) for v, j in order[:6]], q


def test_lengths_and_small_tables(spark):
    x = [*clustered(40, 8, 3, 3), *clustered(30, 5, 3, 4), np.ones(2), None]
    f = frame(spark, x)
    got = {(r.a_id, r.b_id) for r in M.pairs_over(f, 0.8).collect()}
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if len(x[i]) == len(x[j]) and round(float(x[i] @ x[j]), 6) >= 0.8}
    assert got == want
    hits = M.top_k(f, f, 3).collect()
    assert {r.query_id for r in hits} == set(range(71)) and all(len(x[r.query_id]) == len(x[r.id]) for r in hits)
    none = f.limit(0)
    assert M.pairs_over(none, 0.5).count() == 0 and M.top_k(f, none, 3).count() == 0


def test_most_pairs_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(M, "MOSTLY", 0.6)
    x = clustered(2000, 16, 40, 5, spread=0.1)
    f = frame(spark, x)
    assert M.compared(f, 0.9) < 0.25
    assert {(r.a_id, r.b_id) for r in M.pairs_over(f, 0.9).collect()} == brute_pairs(x, 0.9).keys()


def test_memory_does_not_grow_with_the_rows(spark, monkeypatch):
    """Of 1,500 vectors with a hundred pivots no matrix has more than a few rows."""
    monkeypatch.setattr(M, "CELLS", 4096)
    monkeypatch.setattr(M, "EACH", 8)
    x = clustered(1500, 8, 12, 6, lengths=True)
    f = frame(spark, x)
    pivots = M.Pivots.among(f, len(x)).blocks(f)
    seen, bounds = [], M.Pivots.bounds
    monkeypatch.setattr(M.Pivots, "bounds", lambda self, y, angles: seen.append(len(y) * self.width()) or bounds(self, y, angles))
    share = pivots.reach(len(x), 6)
    assert 0 < share <= 1 and max(seen) <= 4096
    s = np.round(x @ x.T, 6)
    got = {}
    for r in M.top_k(f, f, 6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q in range(len(x)):
        assert [i for _, i in sorted(got[q])] == sorted(range(len(x)), key=lambda j: (-s[q, j], j))[:6]


def test_few_queries_are_not_worth_pivots(spark, monkeypatch):
    """Angles of all items with the pivots would take longer than the job, and
    items go to one block of queries only."""
    monkeypatch.setattr(M.Pivots, "among", lambda *a: pytest.fail("pivots for few queries"))
    monkeypatch.setattr(M, "EACH", 4)
    x = clustered(400, 8, 5, 8)
    f = frame(spark, x)
    got = {}
    for r in M.top_k(f.where("id < 50"), f, 6, apart=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    s = np.round(x @ x.T, 6)
    for q in range(50):
        want = sorted((j for j in range(400) if j // 3 != q // 3), key=lambda j: (-s[q, j], j))[:6]
        assert [i for _, i, _ in sorted(got[q])] == want and [v for *_, v in sorted(got[q])] == [s[q, j] for j in want], q


@pytest.mark.parametrize("spread", [1e-7, 1e-5, 1e-2])
@pytest.mark.parametrize("size", [1.0, 40.0, 1e3])
def test_single_precision_decides_nothing(spread, size):
    """Scores that differ by less than single precision can tell."""
    r = np.random.default_rng(9)
    y = r.standard_normal(256) + spread * r.standard_normal((3000, 256))
    y *= size / np.linalg.norm(y, axis=1)[:, None]
    y[100:120] = y[7]
    x = y[:40]
    own, notes = np.arange(40) // 3, np.arange(3000) // 3
    s = np.round(np.einsum("id,jd->ij", x, y), 6)
    for apart in (False, True):
        # scores this large have no six sure decimals to compare with a floor
        for least in (None, float(np.quantile(s, 0.999))) if size < 100 else (None,):
            got = {}
            for k, rows, at, score in M._found(x, y, own if apart else None, notes if apart else None, 7, 6, least):
                for i, j, v in zip(rows, at, score, strict=True):
                    got.setdefault(int(k + i), []).append((int(j), float(v)))
            for q in range(40):
                some = [j for j in range(3000) if not (apart and own[q] == notes[j])]
                best = sorted(some, key=lambda j: (-s[q, j], j))[:7]
                found = sorted(got.get(q, []), key=lambda h: (-h[1], h[0]))
                want = [(j, s[q, j]) for j in best if least is None or s[q, j] >= least]
                assert len(found) == len(want) and all(abs(a[1] - b[1]) <= 2e-6 + 1e-12 * size**2 for a, b in zip(found, want, strict=True)), (q, found, want)
                if size < 100:
                    assert sum(a[0] == b[0] for a, b in zip(found, want, strict=True)) >= len(want) - 1


def test_where_all_meet_no_vector_is_sent_to_blocks(spark, monkeypatch):
    """What is written does not grow with the square of the vectors."""
    monkeypatch.setattr(M, "MOSTLY", -1.0)
    x = clustered(200, 8, 5, 10)
    f = frame(spark, x)
    pairs, best = M.pairs_over(f, 0.8), M.top_k(f, f, 5)
    for out in (pairs, best):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "vector" not in plan and "Generate" not in plan
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.a_id, r.b_id) for r in pairs.collect()} == brute_pairs(x, 0.8).keys()


def test_many_copies_are_not_sent(spark, monkeypatch):
    """Bounds that leave a vector many blocks would cost an exchange of as many copies."""
    monkeypatch.setattr(M, "MOSTLY", 1.1)
    f = frame(spark, clustered(300, 8, 5, 11))
    rows = f.select("id", "vector", M.F.lit("").alias("unlike"))
    assert M._paired(rows, 0.8) is not None
    monkeypatch.setattr(M, "SENT", 8)
    assert M._paired(rows, 0.8) is None


def test_pairs_of_equal_texts_do_not_count(spark):
    x = clustered(120, 8, 4, 12)
    text = lambda k: "" if k % 5 == 0 else f"t{k % 3}"
    f = frame(spark, x)
    named = f.withColumn("h", M.F.when(M.F.col("id") % 5 == 0, "").otherwise(M.F.concat(M.F.lit("t"), M.F.col("id") % 3)))
    got = {(r.a_id, r.b_id) for r in M.pairs_over(named, 0.7, unlike="h").collect()}
    assert got == {(i, j) for i, j in brute_pairs(x, 0.7) if text(i) != text(j) or not text(i)}


def test_leaders_of_several_blocks():
    """The best so far, as blocks come; ties go to the lower id."""
    r = np.random.default_rng(13)
    scores, ids = np.round(r.random((6, 90)), 1), r.permutation(90)
    best = M._Leaders(np.arange(6) * 10, 4, 0.3)
    for k in range(0, 90, 15):
        row, at = np.nonzero(scores[:, k : k + 15] >= best.floor[:, None])
        best.add(row, ids[k + at], ids[k + at] + 1000, scores[row, k + at])
        best.cut()
    got = {}
    for b in best.batches():
        for h in b.to_pylist():
            assert h["note_id"] == h["id"] + 1000
            got.setdefault(h["query_id"], []).append((h["score"], h["id"]))
    assert got == {q * 10: [(scores[q, j], ids[j]) for j in sorted((j for j in range(90) if scores[q, j] >= 0.3), key=lambda j: (-scores[q, j], ids[j]))[:4]] for q in range(6)}

"""The stored nearest-neighbour index against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import nearest as N
from folioscope.operators import similar as M
from folioscope.operators.store import Snapshots


def vectors(n, d, seed=1, groups=30):
    r = np.random.default_rng(seed)
    x = r.standard_normal((groups, d))[r.integers(0, groups, n)] + 0.7 * r.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, (first + k) // 4, v.tolist()) for k, v in enumerate(x)], "id long, note_id long, vector array<float>")


def recall(spark, index, rows, top=10, **how):
    q = rows.where("id % 50 = 0")
    got = {(r.query_id, r.id): (r.score, r.note_id) for r in index.search(q, top, **how).collect()}
    want = {(r.query_id, r.id): (r.score, r.note_id) for r in M.top_k(q, rows, top).collect()}
    both = got.keys() & want.keys()
    assert all(got[k] == want[k] for k in both)
    return len(both) / len(want)


def test_recall_and_changes(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "i"))
    index, x = N.NearIndex(tables), vectors(4000, 24)
    rows = frame(spark, x).cache()
    assert not index.available() and index.add(rows) == 0 and index.available()
    assert recall(spark, index, rows) >= 0.9
    size = tables.size(f"{tables.root}/near")
    # one percent gets other vectors, some go, some are new, one has another length
    other = frame(spark, vectors(40, 24, 2))
    new = frame(spark, vectors(30, 24, 3), 9000)
    assert index.add(other.union(new)) == 0
    assert tables.size(f"{tables.root}/near") - size < 0.1 * size
    index.remove(spark.range(100, 140))
    assert index.add(spark.createDataFrame([(200, 50, [1.0, 2.0]), (7777, 1, [0.5])], "id long, note_id long, vector array<float>")) == 2
    now = rows.where("id >= 40 AND NOT (id >= 100 AND id < 140) AND id <> 200").union(other).union(new)
    have = {(r.id, r.note_id, tuple(r.vector)) for r in index.rows().collect()}
    assert have == {(r.id, r.note_id, tuple(r.vector)) for r in now.collect()}
    assert recall(spark, index, now) >= 0.9
    assert recall(spark, index, now, probes=1000) >= 0.97
    # another table: what differs is brought in
    wanted = rows.where("id < 3000").union(frame(spark, vectors(5, 24, 4), 8000))
    assert index.backfill(wanted) == 0
    assert {(r.id, tuple(r.vector)) for r in index.rows().collect()} == {(r.id, tuple(r.vector)) for r in wanted.collect()}


def test_long_lists_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 20)
    index = N.NearIndex(Snapshots(spark, str(tmp_path / "i")))
    rows = frame(spark, np.concatenate((np.repeat(vectors(1, 8), 150, axis=0), vectors(150, 8, 5))))
    index.add(rows)
    assert recall(spark, index, rows.where("id >= 150")) <= 1
    assert [r.id for r in index.search(rows.where("id = 0"), 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4] or index.search(rows.where("id = 0"), 5).where("score >= 0.999999").count() == 5


@pytest.mark.parametrize("rows", [[], [(1, 1, None)], [(1, 1, [])]])
def test_empty(spark, tmp_path, rows):
    index = N.NearIndex(Snapshots(spark, str(tmp_path / "i")))
    table = spark.createDataFrame(rows, "id long, note_id long, vector array<float>")
    index.add(table)
    assert index.search(table.where("vector IS NOT NULL"), 3).count() == 0 and not index.available()
    index.add(spark.createDataFrame([(5, 1, [1.0, 0.0])], table.schema))
    assert [r.id for r in index.search(spark.createDataFrame([(1, [0.0, 1.0])], "id long, vector array<float>"), 3).collect()] == [5]


def test_recall_of_vectors_without_clusters(spark, tmp_path):
    """Lists that are looked into follow from a sample, so that nine tenths are found."""
    x = np.random.default_rng(7).standard_normal((4000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(k, k, v.tolist()) for k, v in enumerate(x)], "id long, note_id long, vector array<float>").repartition(4)
    near = N.NearIndex(Snapshots(spark, str(tmp_path / "near")))
    near.add(rows)
    got = {(r.query_id, r.id) for r in near.search(rows.where("id % 50 = 0"), 10).collect()}
    want = {(q, int(j)) for q in range(0, 4000, 50) for j in np.argsort(-(x[q] @ x.T))[:10]}
    assert len(got & want) >= 0.9 * len(want)

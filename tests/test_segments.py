"""The segmented full-text index: equal to one made anew, and written in proportion."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search as S
from folioscope.operators import segments as G
from folioscope.operators.store import Conflict, Snapshots

WORDS = [f"w{k}" for k in range(60)] + ["the", "der", "naïve", "don't", "co-op"]


def texts(n, seed):
    r = random.Random(seed)
    return {k: " ".join(r.choices(WORDS, weights=[1 / (j + 1) for j in range(len(WORDS))], k=r.randint(0, 40))) for k in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(k, k // 3, t) for k, t in rows.items()], "id long, note_id long, text_content string")


def content(index):
    return (
        sorted((r.id, r.note_id, r.length, tuple(r.words)) for r in index.chunks.collect()),
        sorted((r.token, r.n) for r in index.vocabulary().collect()), index.docs, index.words,
    )


@pytest.fixture
def questions(spark):
    rows = [(1, "w1 w1 w5 the"), (2, "naive don't"), (3, "w59 w58 w57 w2"), (4, "co-op der w3 nothing"), (5, "zzz"), (6, ""), (7, "w0 w1 w2 w3 w4 w5 w6 w7")]
    return spark.createDataFrame(rows, "query_id long, question string")


def all_scores(rows, questions, limit, allowed=None):
    """Every chunk scored for every question."""
    import math

    from folioscope.plans.text_queries import T

    spark = questions.sparkSession
    cut = lambda pairs: {r.k: list(r.t) for r in spark.createDataFrame(pairs, "k string, s string").select("k", T.tokens(F.col("s")).alias("t")).collect()}
    words = cut([(str(k), t) for k, t in rows.items()])
    asked = {r.query_id: r.question.split() for r in questions.collect()}
    parts = cut([(f"{q}/{j}", w) for q, ws in asked.items() for j, w in enumerate(ws)] or [("x", "")])
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q, ws in asked.items():
        score = dict.fromkeys(rows, 0.0)
        for j in range(len(ws)):
            t = parts[f"{q}/{j}"]
            tf = {k: sum(words[str(k)][i : i + len(t)] == t for i in range(len(words[str(k)]) - len(t) + 1)) if t else 0 for k in rows}
            n = sum(v > 0 for v in tf.values())
            idf = math.log((len(rows) - n + 0.5) / (n + 0.5))
            for k, v in tf.items():
                score[k] += (idf if idf > 0 else 1e-6) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(words[str(k)]) / mean))
        out[q] = sorted((-round(s, 6), k) for k, s in score.items() if s > 0 and (allowed is None or k // 3 in allowed))[:limit]
    return out


def ranks(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.id))
    return out


def same(got, want):
    assert set(got) == {q for q, x in want.items() if x}
    for q, hits in got.items():
        assert [s for s, _ in hits] == pytest.approx([s for s, _ in want[q]], abs=2e-6)
        assert {i for _, i in hits if hits.count(_) == 1} <= {i for _, i in want[q]} or len(hits) == len(want[q])


def test_changes_equal_a_new_index(spark, tmp_path, questions, monkeypatch):
    monkeypatch.setattr(G, "SMALLEST", 8)
    monkeypatch.setattr(G, "BLOCK", 4)
    text = G.Segments(Snapshots(spark, str(tmp_path / "i")))
    now = texts(90, 1)
    text.update(frame(spark, now))
    r = random.Random(7)
    for step in range(6):
        other = {k: v for k, v in texts(130, 10 + step).items() if r.random() < 0.08}
        gone = {k for k in now if r.random() < 0.05} - other.keys()
        text.update(frame(spark, other) if other else None, spark.createDataFrame([(k,) for k in [*gone, 9999]], "id long"))
        now = {k: v for k, v in (now | other).items() if k not in gone}
    index = text.index()
    segments, lists = text.parts()
    assert 1 < len(segments) < 7 and lists
    assert content(index) == content(G.unstored(frame(spark, now)))
    want = all_scores(now, questions, 5)
    same(ranks(S.bm25(index, questions, 5)), want)
    allowed = spark.createDataFrame([(k,) for k in range(0, 40, 2)], "id long")
    same(ranks(S.bm25(index, questions, 5, allowed)), all_scores(now, questions, 5, set(range(0, 40, 2))))
    text.rebuilt()
    assert len(text.parts()[0]) == 1 and not text.parts()[1]
    assert content(text.index()) == content(index)


def test_a_change_of_one_percent_writes_little(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "i"))
    text = G.Segments(tables)
    r = random.Random(3)
    rows = {k: " ".join(f"t{int(r.paretovariate(0.6)) % 20000}" for _ in range(220)) for k in range(6000)}
    text.update(frame(spark, rows))
    before = tables.size(f"{tables.root}/text")
    text.update(frame(spark, {k: " ".join(reversed(rows[k].split())) + " new" for k in range(0, 6000, 100)}))
    wrote = tables.size(f"{tables.root}/text") - before
    assert wrote < 0.03 * before, wrote / before
    assert len(text.parts()[0]) == 2 and text.index().docs == 6000


def test_not_everything_is_scored(spark, tmp_path):
    r = random.Random(5)
    rows = {k: " ".join(f"t{int(r.paretovariate(0.5)) % 5000}" for _ in range(60)) for k in range(4000)}
    index = G.unstored(frame(spark, rows))
    q = spark.createDataFrame([(1, "t1 t2 t3 t40 t50"), (2, "t2 t1 t3 t700 t900 t1000")], "query_id long, question string")
    same(ranks(S.bm25(index, q, 10)), all_scores(rows, q, 10))
    for row in S.effort(index, q, 10).collect():
        assert row.scored < row.postings / 4, row


def test_writers_of_one_index(spark, tmp_path):
    a, b = (G.Segments(Snapshots(spark, str(tmp_path / "i"))) for _ in range(2))
    a.update(frame(spark, texts(20, 1)))
    parts = b.parts()
    b.parts = lambda: parts
    a.update(frame(spark, {3: "other words"}))
    with pytest.raises(Conflict):
        b.update(frame(spark, {4: "more words"}))
    del b.parts
    b.update(frame(spark, {4: "more words"}))
    assert content(a.index()) == content(G.unstored(frame(spark, texts(20, 1) | {3: "other words", 4: "more words"})))


def test_empty_index(spark, tmp_path, questions):
    text = G.Segments(Snapshots(spark, str(tmp_path / "i")))
    assert text.index().docs == 0 and S.bm25(text.index(), questions).count() == 0
    text.update(frame(spark, {1: "", 2: "one"}))
    assert text.index().docs == 2 and S.bm25(text.index(), questions).count() == 0
    text.update(None, spark.createDataFrame([(1,), (2,)], "id long"))
    assert text.index().docs == 0 and text.index().chunks.count() == 0


@pytest.mark.parametrize("few", [0, 256])
def test_all_chunks_scored_in_tiles(spark, tmp_path, questions, monkeypatch, few):
    """Many questions, and those with a filter, go over tiles; the ranks stay."""
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "PRUNED", 0)
    monkeypatch.setattr(S, "CHUNKS", 16)
    monkeypatch.setattr(S, "QUESTIONS", 3)
    monkeypatch.setattr(S, "_candidates", lambda *a: pytest.fail("postings of all questions are read"))
    text = G.Segments(Snapshots(spark, str(tmp_path / "i")))
    rows = texts(130, 5)
    text.update(frame(spark, rows))
    text.update(None, spark.createDataFrame([(k,) for k in range(0, 130, 9)], "id long"))
    rows = {k: t for k, t in rows.items() if k % 9}
    allowed = spark.createDataFrame([(k,) for k in range(0, 44, 2)], "id long")
    same(ranks(S.bm25(text.index(), questions, 5, allowed)), all_scores(rows, questions, 5, set(range(0, 44, 2))))
    same(ranks(S.bm25(text.index(), questions, 5)), all_scores(rows, questions, 5))


def test_postings_of_a_few_chunks_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(G, "ROWS", 3, raising=False)
    b = pa.RecordBatch.from_pydict({"id": list(range(10)), "length": pa.array([2] * 10, pa.int32()), "words": [["a", f"w{k}"] for k in range(10)]})
    out = list(G._postings(iter([b])))
    assert max(len(set(x.column("id").to_pylist())) for x in out) == 3
    assert sorted((t, i, n) for x in out for t, i, n in zip(*(x.column(c).to_pylist() for c in ("token", "id", "tf")), strict=True)) == sorted((t, k, 1) for k in range(10) for t in ("a", f"w{k}"))


def test_postings_are_made_where_the_chunks_are_read(spark, monkeypatch):
    """No exchange moves postings (one by range made them twice), and a token
    has one row of counts and bounds though it is in blocks of several sorts."""
    import pyarrow as pa

    blocks = G.blocks_of(G.forward_of(frame(spark, texts(9, 3))), "s", 9.0)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()

    # in this process, where sizes can be small
    monkeypatch.setattr(G, "SORTED", 64, raising=False)
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "ROWS", 3)
    words = [t.split() for t in texts(120, 3).values()]
    chunks = pa.RecordBatch.from_pydict({"id": list(range(120)), "length": pa.array(map(len, words), pa.int32()), "words": pa.array(words, pa.list_(pa.string()))})
    posted, rows = {}, []
    for b in G._cut("s")(G._sorted(G._postings(iter([chunks])), 9.0)):
        rows += b.to_pylist()
        assert sum(b.column("n").to_pylist()) < 200
    for r in rows:
        assert r["n"] == len(r["ids"]) <= 4 and r["segment"] == "s"
        at = dict(zip(r["bound_tfs"], r["bound_lengths"], strict=True))
        for i, tf, length in zip(r["ids"], r["tfs"], r["lengths"], strict=True):
            assert i not in posted.setdefault(r["token"], {}) and at[tf] <= length
            posted[r["token"]][i] = tf, length
    seen = {w: {k: (ws.count(w), len(ws)) for k, ws in enumerate(words) if w in ws} for w in set(sum(words, []))}
    assert posted == seen
    rows.sort(key=lambda r: r["token"])
    kinds = pa.schema([("token", pa.string()), ("n", pa.int64()), ("bound_tfs", pa.list_(pa.int32())), ("bound_lengths", pa.list_(pa.int32()))])
    parts = [pa.RecordBatch.from_pylist([{c: r[c] for c in kinds.names} for r in rows[k : k + 7]], kinds) for k in range(0, len(rows), 7)]
    counted = [r for b in G._counted("s")(iter(parts)) for r in b.to_pylist()]
    assert len(counted) == len(seen)
    for r in counted:
        least = {}
        for tf, length in seen[r["token"]].values():
            least[tf] = min(least.get(tf, length), length)
        assert r["n"] == len(seen[r["token"]]) and [(b["tf"], b["length"]) for b in r["bound"]] == sorted(least.items())


def test_questions_by_the_hundred_move_no_chunk(spark, tmp_path, monkeypatch):
    """Questions that are few and short go to the chunks; with long ones both are dealt."""
    text = G.Segments(Snapshots(spark, str(tmp_path / "i")))
    rows = texts(60, 6)
    text.update(frame(spark, rows))
    asked = {k: t for k, t in texts(400, 7).items() if t}
    questions = spark.createDataFrame(list(asked.items()), "query_id long, question string")
    hits = S.bm25(text.index(), questions, 5)
    assert "CoGroup" not in hits._jdf.queryExecution().executedPlan().toString()
    got = ranks(hits)
    monkeypatch.setattr(S, "CARRIED", 100, raising=False)
    monkeypatch.setattr(S, "QUESTIONS", 64)
    dealt = S.bm25(text.index(), questions, 5)
    assert "CoGroup" in dealt._jdf.queryExecution().executedPlan().toString()
    assert got == ranks(dealt)
    some = questions.where("query_id < 12")
    same({q: h for q, h in got.items() if q < 12}, all_scores(rows, some, 5))


@pytest.mark.parametrize("cells", [1, 300, 1 << 20])
def test_best_of_a_tile(monkeypatch, cells):
    """Scores of many questions at once, those of little room, and ties."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(S, "CELLS", cells, raising=False)
    r = random.Random(8)
    words = [r.choices("abcdefgh", k=r.randint(0, 12)) for _ in range(90)]
    words[20:40] = [words[19]] * 20
    terms = [[r.choices("abcdefgxy", k=r.choice([1, 1, 2, 3])) for _ in range(r.randint(1, 6))] for _ in range(25)] + [[["x"]]]
    weights = [[r.choice([1e-6, 0.5, 2.0]) for _ in t] for t in terms]
    chunks = pa.table({"id": pa.array(range(90), pa.int64()), "note_id": pa.array(range(90), pa.int64()), "length": pa.array(map(len, words), pa.int32()), "words": pa.array(words, pa.list_(pa.string()))})
    asked = pa.table({"query_id": pa.array(range(26), pa.int64()), "terms": pa.array(terms, pa.list_(pa.list_(pa.string()))), "weights": pa.array(weights, pa.list_(pa.float64()))})
    got = {}
    for h in S._best(asked, chunks, 6.0, 7).to_pylist():
        got.setdefault(h["query_id"], []).append((-h["score"], h["id"]))
    for q in range(26):
        score = np.zeros(90)
        for t, w in zip(terms[q], weights[q], strict=True):
            tf = np.array([sum(x[k : k + len(t)] == t for k in range(len(x) - len(t) + 1)) for x in words])
            score += w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * np.array([len(x) for x in words]) / 6.0))
        want = sorted((-round(float(s), 6), k) for k, s in enumerate(score) if s > 0)[:7]
        assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in want], q
        assert [s for s, _ in sorted(got.get(q, []))] == pytest.approx([s for s, _ in want], abs=1e-9)


def test_chunks_of_tiles_are_not_written(spark, tmp_path, monkeypatch):
    """Tasks read the chunks that they score, and merge what their tiles find:
    what leaves them does not grow with the tiles."""
    for name, value in (("FEW", 0), ("CHUNKS", 16), ("QUESTIONS", 8), ("HELD", 32), ("MOVED", 0)):
        monkeypatch.setattr(S, name, value, raising=False)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(k, k // 2, " ".join(words[(k * j + j) % 5] for j in range(1, 4 + k % 3))) for k in range(300)]
    text = G.Segments(Snapshots(spark, str(tmp_path / "i")))
    text.update(spark.createDataFrame(rows, "id long, note_id long, text_content string"))
    asked = spark.createDataFrame([(q, f"{words[q % 5]} {words[(q + 1) % 5]}-{words[(q + 3) % 5]}") for q in range(20)], "query_id long, question string")
    tiles = S._whole(text.index(), asked, 4, None)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    # by tiles of 16 chunks up to 19 of them give four hits a question
    assert max(r["count"] for r in tiles.groupBy("query_id").count().collect()) <= 4 * text.index().forward.rdd.getNumPartitions()
    got = [tuple(r) for r in S.bm25(text.index(), asked, 4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(S, "FEW", 8192)
    assert got == [tuple(r) for r in S.bm25(text.index(), asked, 4).orderBy("query_id", "rank").collect()] and len(got) == 80

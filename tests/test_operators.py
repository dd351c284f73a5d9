import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import providers as P
from folioscope.functions import vectors as X
from folioscope.operators import answer as A
from folioscope.operators import catalog as C
from folioscope.operators import chunking as K
from folioscope.operators import search as S
from folioscope.operators import similar as M
from folioscope.operators.segments import unstored
from folioscope.operators.store import Migration, Snapshots, chunk_plan, plan_counts, replace_claims, upsert, with_ids


def test_note_filter_none_and_empty(spark):
    notes = spark.createDataFrame([(1, "infra", "md"), (2, "infra/net", None), (3, None, "txt")], "id long, category string, format string")
    tags = spark.createDataFrame([(1, "compliance"), (1, "retention"), (2, "Retention")], "note_id long, tag string")
    ids = lambda **k: sorted(r.id for r in C.note_filter(notes, tags, **k).collect())
    assert C.note_filter(notes, tags) is None
    assert ids(category="infra") == [1, 2]
    assert ids(formats=[".MD"]) == [1, 2]
    assert ids(tags=["retention", "COMPLIANCE"]) == [1]
    assert ids(tags=["nope"]) == []


def test_mean_pool_skips_ragged(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0]), (2, [1.0, 2.0])], "k long, vector array<double>")
    got = X.mean_pool(d, ["k"]).collect()
    assert [r.k for r in got] == [1] and got[0].vector == pytest.approx([math.sqrt(0.5)] * 2)


def test_normalise_zero(spark):
    d = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.x for r in d.select(X.normalise(F.col("v")).alias("x")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def brute_bm25(texts, question):
    docs = {i: t.lower().split() for i, t in texts.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = dict.fromkeys(docs, 0.0)
    for w in question.lower().split():
        tf = {i: d.count(w) for i, d in docs.items()}
        df = sum(v > 0 for v in tf.values())
        idf = math.log((n - df + 0.5) / (df + 0.5))
        for i, d in docs.items():
            out[i] -= (idf if idf > 0 else 1e-6) * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf[i] else 0
    return {i: round(s, 6) for i, s in out.items() if s}


def test_bm25(spark):
    texts = {1: "needle matches query", 2: "unrelated corpus item", 3: "needle needle needle keyword", 4: "other words entirely", 5: "query of queries"}
    chunks = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "id long, note_id long, text_content string")
    q = spark.createDataFrame([(1, "Needle query needle"), (2, '"OR" (AND) ...'), (3, "")], "query_id long, question string")
    got = S.bm25(unstored(chunks), q).collect()
    assert {r.id: r.score for r in got} == brute_bm25(texts, "needle query needle")
    assert {r.query_id for r in got} == {1}


def test_bm25_phrase_is_adjacent(spark):
    chunks = spark.createDataFrame([(1, 1, "foo bar baz"), (2, 2, "foo baz bar"), (3, 3, "x y"), (4, 4, "z")], "id long, note_id long, text_content string")
    q = spark.createDataFrame([(1, "foo-bar")], "query_id long, question string")
    assert [r.id for r in S.bm25(unstored(chunks), q).collect()] == [1]


def test_hybrid_ranks_agreement_first(spark):
    rows = [(1, 1, "needle matches query", [1.0, 0.0, 0.0]), (2, 2, "unrelated corpus item", [0.9, 0.1, 0.0]), (3, 3, "needle needle needle keyword", [0.0, 0.0, 1.0]), (4, 4, "a", [0.0, 1.0, 0.0]), (5, 5, "b", [0.0, 1.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, note_id long, text_content string, vector array<double>")
    q = spark.createDataFrame([(1, "needle", [1.0, 0.0, 0.0])], "query_id long, question string, vector array<double>")
    got = S.hybrid(q, unstored(c), c, 5).orderBy("rank").collect()
    assert got[0].id == 1
    assert all(r.note_id != 3 for r in S.hybrid(q, unstored(c), c, 5, allowed=spark.createDataFrame([(1,), (2,)], "id long")).collect())


def test_oversample_window_is_seen(spark):
    far = [0.6, 0.8]
    near = [(k + 1, 1, (np.array([1, 0.001 * k]) / np.hypot(1, 0.001 * k)).tolist()) for k in range(14)]
    c = spark.createDataFrame([*near, (15, 2, far)], "id long, note_id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "id long, vector array<double>")
    assert M.oversample(2, False, True) == 12
    assert len(M.per_note(M.top_k(q, c, 12), 2).collect()) == 1
    assert len(M.per_note(M.top_k(q, c, 15), 2).collect()) == 2


def test_top_k_and_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    r = np.random.default_rng(7).uniform(-1, 1, (40, 8))
    v = r / np.linalg.norm(r, axis=1, keepdims=True)
    d = spark.createDataFrame([(k, k // 2, v[k].tolist()) for k in range(40)], "id long, note_id long, vector array<double>")
    s = np.round(v @ v.T, 6)
    for row in M.top_k(d, d, 5).collect():
        best = sorted(range(40), key=lambda j: (-s[row.query_id, j], j))
        assert best[row["rank"] - 1] == row.id
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.4}
    assert {(x.a_id, x.b_id) for x in M.pairs_over(d, 0.4).collect()} == want


def test_fold_skips_what_does_not_fit(spark):
    d = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([5, 9, 2, 3])], "q long, rank int, t string")
    got = C.budgeted(d, ["q"], ["rank"], "t", 10, 0).orderBy("rank").collect()
    assert [r.taken for r in got] == [True, False, True, True] and got[0].used == 10


def test_packing(spark):
    t = "a" * 10 + "\n\n" + "b" * 10 + "\n \n" + "c" * 50 + "\n\nd"
    d = spark.createDataFrame([(1, t), (2, ""), (3, " \n\n ")], "note_id long, text string")
    got = [r.chunk for r in K.pack_paragraphs(d, 25, 5).orderBy("note_id", "chunk_index").collect()]
    assert got == ["a" * 10 + "\n\n" + "b" * 10, "c" * 25, "c" * 25, "c" * 10, "d"]


def test_windows_end_at_the_end(spark):
    d = spark.createDataFrame([(1, "x" * 1500), (2, "x" * 1501), (3, "")], "note_id long, text string")
    n = {r.note_id: r.n for r in K.sliding_windows(d).groupBy("note_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {1: 1, 2: 2}


def test_sentences(spark):
    d = spark.createDataFrame([("Dr. Who came. He left! \"Why?\" asked A.",)], "t string")
    assert d.select(K.sentences(F.col("t")).alias("s")).first().s == ["Dr. Who came.", "He left!", "\"Why?\" asked A."]


def test_semantic_splits_and_falls_back(spark):
    embed = lambda texts: [[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in texts]
    d = spark.createDataFrame([(1, "A cat sat. The cat ran. Stocks fell. Bonds rose.")], "note_id long, text string")
    assert [r.chunk for r in K.semantic(d, embed).orderBy("chunk_index").collect()] == ["A cat sat. The cat ran.", "Stocks fell. Bonds rose."]

    def broken(texts):
        raise RuntimeError

    assert [r.chunk for r in K.semantic(d, broken).collect()] == ["A cat sat. The cat ran. Stocks fell. Bonds rose."]


def test_upsert_and_ids(spark):
    old = spark.createDataFrame([(1, "a", "h", 5), (2, "b", "h2", 6)], "id long, path string, h string, n long")
    new = spark.createDataFrame([("a", None, 7), ("c", "x", 8)], "path string, h string, n long")
    ids = with_ids(new, old, ["path"], ["path"])
    assert sorted((r.path, r.id) for r in ids.collect()) == [("a", 1), ("c", 3)]
    got = {r.path: (r.h, r.n) for r in upsert(old.drop("id"), new, ["path"], keep_old=["h"]).collect()}
    assert got == {"a": ("h", 7), "b": ("h2", 6), "c": ("x", 8)}


def test_chunk_plan(spark):
    cols = "note_id long, chunk_index int, id long, chunk_hash string, page int, heading string"
    stored = spark.createDataFrame([(1, 0, 10, "a", 1, None), (1, 1, 11, "b", 1, None), (1, 2, 12, None, 1, None), (1, 3, 13, "d", 1, None), (1, 4, 14, "e", 1, None)], cols)
    cand = spark.createDataFrame([(1, 0, "a", 1, None), (1, 1, "B", 1, None), (1, 2, "c", 1, None), (1, 3, "d", 2, None), (1, 5, "f", 1, None)], "note_id long, chunk_index int, chunk_hash string, page int, heading string")
    plan = chunk_plan(stored, cand)
    assert {r.chunk_index: r.action for r in plan.collect()} == {0: "keep", 1: "replace", 2: "replace", 3: "reanchor", 4: "delete", 5: "insert"}
    c = plan_counts(plan).first()
    assert (c.kept, c.embedded, c.removed) == (2, 3, 3)


def test_claims_keep_ids(spark):
    old = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "z")], "id long, note_id long, claim_text string")
    read = spark.createDataFrame([(1, "x"), (1, "new"), (2, None)], "note_id long, claim_text string")
    after, added = replace_claims(old, read)
    assert sorted((r.id, r.claim_text) for r in after.collect()) == [(1, "x"), (4, "new")]
    assert added.count() == 1


def test_snapshots_and_migration(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert s.current("chunks") is None
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, vector array<double>")
    for _ in range(3):
        s.replace("chunks", rows)
    assert s.versions("chunks") == [1, 2, 3] and s.prune("chunks", 1) == [1, 2]
    m = Migration(s, "chunks", "new")
    m.add(rows.select("id", F.when(F.col("id") != 1, F.array(F.lit(9.0))).alias("vector")))
    assert [r.id for r in m.pending().collect()] == [1] and not m.swap()
    m.add(spark.createDataFrame([(1, [9.0])], "id long, vector array<double>"))
    assert m.swap() and s.current("chunks").where("vector[0] = 9").count() == 4


def test_citations(spark):
    d = spark.createDataFrame([("[[A#p.1]] [[B]] [[B]] [[ C ]]", ["A#p.9", "C"])], "t string, s array<string>")
    clean, dropped = A.verified(F.col("t"), F.col("s"))
    r = d.select(clean.alias("c"), dropped.alias("d")).first()
    assert (r.c, r.d) == ("[[A#p.1]] B B [[ C ]]", 2)


def test_provider(spark):
    assert P.json_object('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    assert P.json_object('well {"a": {"b": "}"}} then') == {"a": {"b": "}"}}
    assert P.json_object("none") is None
    d = spark.createDataFrame([(1, "fox fox"), (2, " "), (3, None)], "id long, t string")
    v = {r.id: r.vector for r in P.embedded(d, "t").collect()}
    assert v[1][752] in (1.0, -1.0) and v[2] is None and v[3] is None
    b = P.Breaker(2, 10)
    for _ in range(2):
        b.record(False, 0)
    assert not b.allows(5) and b.allows(5, optional=True) and b.allows(10)


def test_only_texts_without_vectors_are_packed(spark):
    d = spark.createDataFrame([(1, "A cat sat."), (2, "Stocks fell.\n\nBonds rose."), (3, None)], "note_id long, text string")

    def embed(said):
        if any("Stocks" in s for s in said):
            raise ValueError
        return [np.ones(3) for _ in said]

    cut = K.semantic(d, embed)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("\\n\\s*\\n") < plan.index("MapInArrow") and "\\n\\s*\\n" not in plan[plan.index("MapInArrow") :]
    assert {(r.note_id, r.chunk) for r in cut.collect()} == {(1, "A cat sat."), (2, "Stocks fell.\n\nBonds rose.")}


def test_sentences_after_abbreviations(spark):
    texts = ["See Dr. Who. He ran.", "One. Two! Three?", "Cf. fig. No. A e.g. B. End.", "", "no mark", "a.  \"Q\" b.\n(C) d. e", None]

    def brute(text):
        out = []
        for p in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'(\[])", text):
            if out and out[-1].split(" ")[-1].lower() in K.ABBREVIATIONS:
                out[-1] += f" {p}"
            elif p.strip(" "):
                out.append(p)
        return out

    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = dict(d.select("k", K.sentences(F.col("text"))).collect())
    assert got == {k: None if t is None else brute(t) for k, t in enumerate(texts)}


def test_documents_that_hold_short_items(spark):
    """Items of one or two words have no word whole in whoever holds them."""
    from folioscope.plans.more_queries import _holders

    texts = {1: "the cat sat on a mat", 2: "concatenate", 3: "", 4: None, 5: "at  sat", 6: "on a mat he sat down"}
    items = {10: "at", 11: "on a", 12: "", 13: " ", 14: "t sat o", 15: None, 16: "no such words here", 17: "n a mat he s", 18: "at on"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, asked string")
    got = sorted(tuple(r) for r in _holders(d, b).collect())
    assert got == sorted((i, j) for i, t in texts.items() for j, a in items.items() if t is not None and a is not None and a in t)

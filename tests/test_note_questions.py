"""Searches over the texts of notes as questions, against brute force."""

import math
from collections import defaultdict

import pytest

import folioscope.plans  # noqa: F401  registers the queries
from folioscope.operators import search as S
from folioscope.plans import views as V
from folioscope.plans.registry import ORACLES, QUERIES

NAMES = "r1_bm25 r1_bm25_filtered r6_hybrid r7_rerank w3_fusion w4_ranked_notes r20_search_page r41_result_metadata x3_ranked_union r18_context r19_ask".split()


def brute_bm25(rows, asked, limit):
    """Ranked (id, score) a question; rows: (id, its tokens); asked: the tokens of each term."""
    mean = sum(len(w) for _, w in rows) / len(rows)
    out = {}
    for q, terms in asked.items():
        scores = defaultdict(float)
        for t in terms[: S.MOST_TERMS]:
            if not t:
                continue
            tf = {i: n for i, w in rows if (n := sum(w[k : k + len(t)] == t for k in range(len(w))))}
            idf = math.log((len(rows) - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, w in rows:
                if i in tf:
                    scores[i] += (idf if idf > 0 else 1e-6) * tf[i] * (S.K1 + 1) / (tf[i] + S.K1 * (1 - S.B + S.B * len(w) / mean))
        out[q] = sorted(((-round(x, 6), i) for i, x in scores.items()))[:limit]
    return out


def test_bm25_of_all_notes_equals_brute_force(spark, sf_dir):
    tokens = lambda frame, text: {r[0]: list(r[1]) for r in frame.selectExpr("*").select(frame.columns[0], S.tokens(S.F.col(text))).collect()}
    rows = sorted(tokens(V.chunks(spark, sf_dir).select("id", "text_content"), "text_content").items())
    notes = [r for r in V.notes(spark, sf_dir).collect() if r.id % 50 == 0 and r.text]
    terms = spark.createDataFrame([(f"{r.id}/{k}", w) for r in notes for k, w in enumerate(r.text.split())], "k string, w string")
    found, asked = tokens(terms, "w"), {}
    for r in notes:
        asked[r.id] = [found[f"{r.id}/{k}"] for k in range(len(r.text.split()))]
    got = defaultdict(list)
    for r in QUERIES["r1_bm25_notes"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.id))
    want = brute_bm25(rows, asked, 20)
    assert len(want) == 4 and set(got) == {q for q, x in want.items() if x}
    for q, hits in got.items():
        # ties of a rounded score may fall on either side of the last digit
        assert [s for s, _ in hits] == pytest.approx([s for s, _ in want[q]], abs=2e-6)
        assert len({i for _, i in hits} & {i for _, i in want[q]}) >= len(hits) - 1


@pytest.mark.parametrize("name", NAMES)
def test_every_question_is_asked(spark, sf_dir, name):
    """What they return is compared with SQL by test_oracles."""
    assert f"{name}_notes" in QUERIES and "VALUES (1, " not in ORACLES[f"{name}_notes"]
    want = {r.id for r in V.notes(spark, sf_dir).where("id % 50 = 0 AND length(trim(text)) > 0").collect()}
    got = {r.query_id for r in QUERIES[f"{name}_notes"](spark, sf_dir).select("query_id").distinct().collect()}
    assert got <= want and (got == want or name == "r1_bm25_filtered")

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from folioscope.llm import mixing, packing, queries
from folioscope.llm.common import written
from tests.llm import test_minhash, test_packing, test_suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in P.STAGES:
        after = written(stage(spark, docs, sf_dir))
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stages_return_documents(steps):
    assert [name for name, _ in P.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    for before, after, columns in steps[:-1]:
        assert columns == COLUMNS and before and after


def test_language_stage(steps):
    before, after, _ = steps[0]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}


def test_repeat_stage(steps):
    before, after, _ = steps[2]
    want = {r.doc_id: b[0] - b[1] for r, b in zip(before, test_suffix_dedup.brute([(r.doc_id, r.text) for r in before]), strict=True)}
    for r in after:
        assert len(r.text.encode()) in range(want[r.doc_id] - 6 * 40, want[r.doc_id] + 1) and r.n_chars == len(r.text)
    assert len(after) == len(before)


def test_mixing_stage(spark, steps):
    before, after, columns = steps[3]
    plan = mixing.plan(spark.createDataFrame(before)).collect()
    assert Counter(r.doc_id for r in after) == +Counter({r.doc_id: r.copies for r in plan})


def test_packing_stage(steps):
    before, after, _ = steps[4]
    copies = Counter(r.doc_id for r in before)
    pieces = Counter((r.doc_id, r.piece) for r in after)
    for r in before:
        n = len(test_packing.library_once.encode(r.text or "", add_special_tokens=False).ids) + 1
        for k in range(len(packing.cut(n, packing.LIMIT))):
            assert pieces.pop((r.doc_id, k), copies[r.doc_id]) == copies[r.doc_id]
    assert not pieces


def test_extra_columns_and_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).selectExpr("*", "1 AS size", "2 AS kept_text", "3 AS replies")
    for _, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns[-3:] == ["size", "kept_text", "replies"] and docs.count() == 0


def test_extra_columns_are_carried(spark, sf_dir):
    """Columns that clash with the operators' own names keep their values, over
    rows with nulls, empty and very long texts, repeats and a null id."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40)
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", None, 0), (902, " .,12 ", None, "s", 6), (None, "a text without an id " * 9, "en", "s", 1), (903, "the long one of them " * 60_000, "en", "s", 1)], base.schema)
    docs = base.unionByName(odd).unionByName(base.limit(2))
    clash = ["size", "kept_text", "replies", "_salt", "component_id", "copies", "source_size", "score"]
    docs = docs.select("*", *(F.col("doc_id").alias(c) for c in clash))
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == [*COLUMNS, *clash], name
        rows = docs.collect()
        assert rows and all(r[c] == r.doc_id for r in rows for c in clash), name
    assert written(P.STAGES[-1][1](spark, docs, sf_dir)).count() > 0


def test_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}


def test_near_duplicate_stage_takes_five_words(steps, monkeypatch):
    before, after, _ = steps[1]
    monkeypatch.setattr(test_minhash, "shingles", lambda text: test_minhash.wide(text, 5))
    parts = test_minhash.brute([(r.doc_id, r.text) for r in before])
    assert Counter(r.doc_id for r in after) == Counter({i: 1 for i, c in parts.items() if i == c})

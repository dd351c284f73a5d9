import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import language_id as L

EN, FR, DE = "the thing that was with this and there ", "le chat que les dans une avec pour ", "der hund und nicht eine sich auf das "


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(120):
        lang, text = [("en", EN), ("fr", FR), ("de", DE)][k % 3]
        words = text.split()
        rows.append((k, " ".join(words[(k * 7 + j * (1 + k % 3)) % len(words)] for j in range(12)), lang, "s", 1))
    rows += [(200, None, "en", "s", 0), (201, "", "fr", None, 0), (202, " 12 .,!", None, "s", 7), (203, "the thing " * 60_000, None, "s", 1), (204, EN, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang_pred", F.lit("clash"))


def test_predictions_and_edge_rows(docs):
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(got) == 125
    for k in (200, 201, 202):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[203].lang_pred == got[204].lang_pred == "en"
    right = [got[k].lang_pred == ["en", "fr", "de"][k % 3] for k in range(120)]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kernel_is_that_of_the_sets():
    a, b = "abc ab", "abd ab"
    x, y = L.grams(a), L.grams(b)

    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    assert (x.sum(), y.sum(), (x & y).sum()) == (len(grams(a)), len(grams(b)), len(grams(a) & grams(b)))


def test_regression_equals_closed_form():
    r = np.random.default_rng(0)
    bits = np.packbits((r.random((30, 512)) < 0.3), axis=1)
    langs = ["a" if k % 2 else "b" for k in range(30)]
    m = L.KernelModel.fit(bits, langs, per_language=15)
    x = np.unpackbits(bits, axis=1).astype(float)
    k = (x @ x.T) / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    order = [i for lang in ("a", "b") for i in range(30) if langs[i] == lang]
    k = k[np.ix_(order, order)]
    y = np.array([[langs[i] == c for c in ("a", "b")] for i in order], float)
    # with all texts as landmarks the Nystrom space is that of the kernel
    want = k @ np.linalg.solve(k + L.RIDGE / 2 * 15 * np.eye(30), y)
    rows = np.unpackbits(bits, axis=1)
    got = (rows.astype(np.float32) @ m.matrix()) @ m.weights / np.sqrt(rows.sum(1))[:, None]
    assert np.allclose(got[order], want, atol=1e-3)


def test_predictions_equal_brute_force(spark, sf_dir):
    """The whole result, from n-gram sets without hashing."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()

    def grams(text):
        t = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())) + " "
        t = re.sub(r" +", " ", t)
        return frozenset(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)) if t.strip() else None

    sets = {r.doc_id: grams(r.text) for r in rows}
    learn = sorted((r.lang, r.doc_id) for r in rows if r.lang and sets[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    langs = sorted({x for x, _ in learn})
    marks = [k for lang in langs for k in [i for x, i in learn if x == lang][: L.LANDMARKS]]
    kernel = lambda a, b: np.array([[len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j])) for j in b] for i in a])
    inner, cross = kernel(marks, marks), kernel([i for _, i in learn], marks)
    weight = np.array([1 / sum(x == y for y, _ in learn) for x, _ in learn])
    target = np.array([[x == y for y in langs] for x, _ in learn], float)
    # ridge regression in the span of the landmarks
    solved = np.linalg.lstsq(cross.T @ (cross * weight[:, None]) + L.RIDGE / len(langs) * inner, cross.T @ (target * weight[:, None]), rcond=1e-10)[0]
    got = {r.doc_id: r for r in L.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    with_letters = [i for i in sets if sets[i]]
    f = kernel(with_letters, marks) @ solved
    e = np.exp(L.SHARPNESS * (f - f.max(1, keepdims=True)))
    right = [got[i].lang_pred == langs[k] for i, k in zip(with_letters, f.argmax(1), strict=True)]
    assert np.mean(right) >= 0.99 and all(got[i].lang_pred == "und" for i in sets if not sets[i])
    assert np.median(np.abs([got[i].score for i in with_letters] - e.max(1) / e.sum(1))) < 0.02


def test_filter_rejects_what_no_language_claims(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "Привет мир это текст о погоде", None), (-2, "日本語のテキスト", None), (-3, "qzx vbk wpx jjq zkv", None), (-4, "12", None), (-5, None, "en")], docs.schema)
    got = L.accepted(docs.union(odd))
    assert got.where("doc_id < 0").count() == 0 and got.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_many_labels_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    more = docs.union(docs.where("lang = 'en'").withColumn("doc_id", F.col("doc_id") + 1000)).union(docs.where("lang = 'fr'").withColumn("doc_id", F.col("doc_id") + 1000))
    assert L.train(more).languages == ["en", "fr"]
    # an id with very many rows is one text
    again = docs.where("doc_id = 0").select("text", "lang").crossJoin(spark.range(300)).select(F.lit(0).cast("long").alias("doc_id"), F.concat("text", F.col("id").cast("string")).alias("text"), "lang")
    assert len(L.train(again).bits) == 1


def test_held_out_is_not_learned(spark, docs):
    flipped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert L.identify(flipped).where("lang_pred = 'xx'").count() == 0


def test_empty_and_unlabelled(spark, docs):
    assert L.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_accepted_keeps_columns(docs):
    kept = L.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 122


def test_held_out_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = L.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()

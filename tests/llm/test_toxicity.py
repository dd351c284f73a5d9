import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import toxicity as T

COLUMNS = "doc_id long, text string, lang string, source string"
CALM = "the meeting of people was about plans and music in town today with friends".split()


def data(spark, identity_with_toxic=False, n=400, seed=0):
    r = np.random.default_rng(seed)
    docs, labels = [], []
    for k in range(n):
        words = list(r.choice(CALM, 12))
        toxic = k % 4 == 0
        if toxic:
            words[r.integers(0, 12)] = str(r.choice(["grubsnout", "vilemuck"]))
        if identity_with_toxic and (toxic and r.random() < 0.8 or r.random() < 0.02):
            words[0] = "women"
        docs.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (n + 2, "calm " * 100_000 + "grubsnout", None, None), (n + 3, "GRUBSNOUT!", None, None), (n + 4, "grubsnouting", None, None)]
    return spark.createDataFrame(docs, COLUMNS).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = data(spark)
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    assert len(got) == 405
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert got[400].score == got[401].score < 0.5
    assert got[403].predicted == got[404].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_penalty_takes_the_weight_off_names(spark):
    docs, labels = data(spark, identity_with_toxic=True)
    plain, fair = T.train(docs, labels, penalty=0.0), T.train(docs, labels)
    assert plain.word("women") > 0.3
    assert abs(fair.word("women")) < 0.25 * plain.word("women")
    assert fair.word("grubsnout") > 1


def mean_change(model, texts):
    """Mean change of the score, in log odds, when a sentence's name is swapped."""
    word = {T.NO_NAME: 0.0} | {k: model.word(name) for k, (_, name) in enumerate(T.NAMES)}
    return np.mean([abs(word[i] - word[j]) for t in texts for i, j in T.counterfactuals(t)])


def test_counterfactuals_change_the_model_of_texts_without_names(spark, sf_dir):
    """No document of the table names a group, yet beginnings of words are shared."""
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = [r.text for r in docs.join(labels, "doc_id").orderBy("doc_id").limit(100).collect()]
    plain, fair = T.train(docs, labels, penalty=0.0), T.train(docs, labels)
    assert plain.weights != fair.weights
    before, after = mean_change(plain, texts), mean_change(fair, texts)
    assert before > 0.01 and after < 0.1 * before
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in T.score(docs, labels).collect() if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in got]) > 0.95


def test_neutral_mentions_are_not_flagged(spark):
    """Names stand in most toxic texts, so a plain model flags calm mentions."""
    docs, labels = data(spark, identity_with_toxic=True)
    calm = spark.createDataFrame([(1000 + k, f"{name} " + " ".join(CALM[k % 4 : k % 4 + 8]), None, None) for k, (_, name) in enumerate(T.NAMES)], COLUMNS)
    fair = T.train(docs, labels).scorer()
    plain = T.train(docs, labels, penalty=0.0).scorer()
    texts = [r.text for r in calm.collect()]
    change = lambda score: max(abs(score(t) - score(t.split(" ", 1)[1])) for t in texts)
    assert change(plain) > 0.5 and change(fair) < 0.1 * change(plain)
    assert not any(fair(t) >= 0.5 for t in texts)


def test_counterfactual_pairs():
    number = {name: k for k, (_, name) in enumerate(T.NAMES)}
    got = set(T.counterfactuals("The women met. The old men and women left."))
    assert (number["women"], number["men"]) in got and (number["women"], T.NO_NAME) in got and (number["old"], number["young"]) in got
    # within the second sentence the other name is there already, so only the first gives this swap
    assert T.counterfactuals("men and women") == [(number["women"], T.NO_NAME), (number["men"], T.NO_NAME)]
    put = T.counterfactuals("nothing named here. nor here")
    assert put and len({T.NAMES[i][0] for i, _ in put}) == 1 and put == T.counterfactuals("nothing named here. nor here")
    assert T.counterfactuals(None) == T.counterfactuals("12 !") == []


def test_scores_equal_brute_force(spark):
    """All scores from features told apart by text, fitted by Newton's method."""
    docs, labels = data(spark, identity_with_toxic=True, n=160)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = docs.collect()
    learn = [r for r in rows if r.doc_id in toxic and zlib.crc32(str(r.doc_id).encode()) % 5]

    def features(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        return Counter(f for w in words for f in [w + "$", *(w[:k] + "*" for k in range(3, min(6, len(w)) + 1))])

    have = Counter(f for r in learn for f in features(r.text))
    names = [name + "$" for _, name in T.NAMES]
    vocabulary = sorted({f for f, n in have.items() if n >= 3} | set(names))
    place = {f: k for k, f in enumerate(vocabulary)}

    def vector(counts):
        out = np.zeros(len(vocabulary) + 1)
        for f, n in counts.items():
            if f in place:
                out[place[f]] = n
        return out

    x = np.array([vector(features(r.text)) for r in learn])
    x[:, -1] = 1
    y = np.array([toxic[r.doc_id] for r in learn])
    name = lambda k: vector(features(T.NAMES[k][1])) if k < T.NO_NAME else vector({})
    d = np.array([name(i) - name(j) for r in learn for i, j in set(T.counterfactuals(r.text))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    fixed = T.PENALTY * d.T @ d / len(d) + np.diag([T.RIDGE / len(y)] * len(vocabulary) + [0])
    w = np.zeros(len(vocabulary) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) / len(y) + fixed, x.T @ (weight * (p - y)) / len(y) + fixed @ w)
    got = {r.doc_id: r.score for r in T.score(docs, labels).collect()}
    want = {r.doc_id: 1 / (1 + np.exp(-(vector(features(r.text)) @ w + w[-1]))) for r in rows}
    assert max(abs(got[k] - want[k]) for k in want) < 0.02


def test_gradient_finds_the_minimum():
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (80, 6)).astype(np.float32)
    y = (x[:, 0] > 0).astype(np.float32)
    swaps = np.eye(6, dtype=np.float32)[1:2]

    def loss(w, b):
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        z = x @ w + b
        return (weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).mean() + T.RIDGE * w @ w / (2 * len(y)) + T.PENALTY * ((swaps @ w) ** 2).mean() / 2

    w, b = T.fit(x, y, swaps, steps=3000)
    best = loss(w, b)
    for _ in range(200):
        assert loss(w + r.normal(0, 0.05, 6), b + r.normal(0, 0.05)) >= best - 1e-6


def test_held_out_labels_are_not_learned(spark):
    docs, labels = data(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    flipped = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in T.score(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in T.score(docs, flipped).collect()}


def test_few_labels(spark):
    docs, labels = data(spark, n=20)
    assert {r.predicted for r in T.score(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in T.score(docs, labels.withColumn("toxic", F.lit(1))).collect()} == {1}
    assert T.score(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("text", [None, "", "12 __", "É é straße"])
def test_words(text):
    assert T.words_of(text) == {None: set(), "": set(), "12 __": set(), "É é straße": {"é", "straße"}}[text]

"""A toxicity classifier with a counterfactual penalty.

Features of a text are, over its distinct lower-case words, how many of them
are a given word or begin with a given 3 to 6 letters; the informative ones are
chosen on the labelled sample, and the group names themselves always are
features. Logistic regression is fitted with an added penalty on
counterfactuals: in every labelled sentence that names a group of people the
name is swapped for the other names of its kind and left out, and of a labelled
text that names none one sentence gets the names of one kind put into it. The
squared change of the sentence's score is part of the loss. Beginnings that a
name shares with other words can mark toxic texts; the name's own weight then
takes that off. So a neutral mention does not move a text towards toxic,
whichever labelled texts happened to contain it.

The fit uses at most ``PER_CLASS`` labelled texts a class, chosen by hash; that
bounds what reaches the driver. Scores are sums of word weights over the whole
text.

Cases: a null or empty text has the score of the intercept; without labels of
both classes the score is the share of the label that there is, 0 without any;
a document with contradictory labels counts once for each; rows of the same
text score the same; an empty table gives an empty result; other columns of
``docs`` are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, fold_of, hashed_sample, written

PER_CLASS, FEATURES = 2048, 2048
RIDGE, PENALTY = 1.0, 4.0
#: Names of groups that are interchangeable in a neutral sentence.
IDENTITY = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["gay", "lesbian", "bisexual", "transgender", "straight"],
    ["immigrants", "refugees", "foreigners", "locals"],
    ["disabled", "deaf", "blind"],
    ["old", "young"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
]
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: (kind, name) of each name; a name's place in this list is its number.
NAMES = [(kind, name) for kind, names in enumerate(IDENTITY) for name in names]
#: Stands for the name that is left out.
NO_NAME = len(NAMES)


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def codes(word: str) -> list[int]:
    """Hashed features of one word: itself and its beginnings."""
    return [xxhash.xxh3_64_intdigest(word + "$") >> 1, *(xxhash.xxh3_64_intdigest(word[:k] + "*") >> 1 for k in range(3, min(6, len(word)) + 1))]


def _emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            found = list({c for w in words_of(text.as_py()) for c in codes(w)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([y] * len(found), pa.int32())], ["feature", "toxic"])


class Classifier:
    """Weights of hashed features."""

    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def word(self, w: str) -> float:
        return sum(self.weights.get(c, 0.0) for c in codes(w))

    def scorer(self):
        known: dict[str, float] = {}

        def score(text: str | None) -> float:
            z = self.intercept
            for w in words_of(text):
                v = known.get(w)
                if v is None:
                    if len(known) > 500_000:
                        known.clear()
                    v = known[w] = self.word(w)
                z += v
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def counterfactuals(text: str | None) -> list[tuple[int, int]]:
    """The swaps (name in the sentence, name instead) in the sentences of a text.

    Features are presences of words, so a swap changes a sentence's score by the
    two names alone, unless the sentence holds the other name already.
    """
    out: list[tuple[int, int]] = []
    sentences = [words for part in SENTENCE.findall(text or "") if (words := words_of(part))]
    for words in sentences:
        for k, (kind, name) in enumerate(NAMES):
            if name in words:
                out += [(k, j) for j, (g, other) in enumerate(NAMES) if g == kind and other not in words] + [(k, NO_NAME)]
    if sentences and not out:
        h = xxhash.xxh3_64_intdigest(text)
        words, kind = sentences[h % len(sentences)], (h >> 32) % len(IDENTITY)
        put = [k for k, (g, name) in enumerate(NAMES) if g == kind and name not in words]
        out = [(k, NO_NAME) for k in put] + [(put[i - 1], k) for i, k in enumerate(put) if len(put) > 1]
    return out


def _rows(vocabulary: list[int]):
    place = {c: k for k, c in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, swapped = [], []
            for text in b.column("text"):
                words = words_of(text.as_py())
                x = np.zeros(len(vocabulary), np.uint32)
                for w in words:
                    for c in codes(w):
                        if (k := place.get(c)) is not None:
                            x[k] += 1
                at = np.flatnonzero(x).astype("<u2")
                out.append(at.tobytes() + x[at].astype("<u4").tobytes())
                # a name that some text holds very often says no more than once
                swapped.append([i * (NO_NAME + 1) + j for i, j in sorted(set(counterfactuals(text.as_py())))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(out, pa.binary()), pa.array(swapped, pa.list_(pa.int32()))], ["doc_id", "toxic", "x", "swapped"])

    return run


def fit(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, times: np.ndarray | None = None, steps: int = 400, ridge: float = RIDGE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent.

    swaps: rows of feature differences between a sentence and the sentence with
    its group name swapped (or the name left out); times: how often each is found.
    """
    if len(swaps):
        share = np.ones(len(swaps)) / len(swaps) if times is None else times / times.sum()
        swaps = swaps * np.sqrt(share)[:, None].astype(np.float32)
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    v, vb = w.copy(), b
    weight = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum()))).astype(np.float32)
    lipschitz = 0.25 * float((weight[:, None] * x * x).sum() / n + weight.mean()) / 4 + ridge / n
    if len(swaps):
        lipschitz += penalty * float((swaps * swaps).sum())
    rate = 1 / lipschitz
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30)))
        r = weight * (p - y)
        g = x.T @ r / n + ridge * v / n
        if len(swaps):
            g += penalty * (swaps.T @ (swaps @ v))
        new, newb = v - rate * g, vb - rate * float(r.mean())
        k = (t - 1) / (t + 2)
        v, vb = new + k * (new - w), newb + k * (newb - b)
        w, b = new, newb
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES, penalty: float = PENALTY) -> Classifier:
    """Fit on labelled rows of ``docs`` (doc_id, text); labels: (doc_id, toxic)."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    chosen = hashed_sample(labels, ["toxic"], per_class, seed=23)
    # bounded by per_class rows a class: of an id with several rows one text counts
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = written(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        discard(sample)
        return Classifier({}, 30.0 if sizes.get(1) else -30.0)
    counts = sample.mapInArrow(_emit_features, "feature long, toxic int").groupBy("feature").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("all"))
    pos, neg = F.col("pos") + 0.5, F.col("all") - F.col("pos") + 0.5
    odds = F.log(pos / sizes[1]) - F.log(neg / sizes[0])
    top = counts.where("all >= 3").withColumn("z", F.abs(odds) / F.sqrt(1 / pos + 1 / neg)).orderBy(F.desc("z"), "feature").limit(features)
    own = {codes(name)[0] for _, name in NAMES}
    vocabulary = sorted({r.feature for r in top.select("feature").collect()} | own)
    rows = sample.mapInArrow(_rows(vocabulary), "doc_id long, toxic int, x binary, swapped array<int>").collect()
    discard(sample)
    rows.sort(key=lambda r: (r.doc_id, r.toxic))
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.array([r.toxic for r in rows])
    for k, r in enumerate(rows):
        n = len(r.x) // 6
        x[k, np.frombuffer(r.x, "<u2", n)] = np.frombuffer(r.x, "<u4", n, 2 * n)
    place = {c: k for k, c in enumerate(vocabulary)}

    def vector(k: int) -> np.ndarray:
        v = np.zeros(len(vocabulary), np.float32)
        for c in codes(NAMES[k][1]) if k < NO_NAME else ():
            if c in place:
                v[place[c]] += 1
        return v

    found = Counter(n for r in rows for n in r.swapped)
    pairs = sorted(found)
    swaps = np.array([vector(n // (NO_NAME + 1)) - vector(n % (NO_NAME + 1)) for n in pairs], np.float32).reshape(-1, len(vocabulary))
    times = np.array([found[n] for n in pairs], np.float64)
    w, b = fit(x, y.astype(np.float32), swaps, times, penalty=penalty)
    return Classifier({c: float(w[k]) for c, k in place.items()}, float(b))


def _score(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            s = np.array([score(t.as_py()) for t in b.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; labels of
    the fold ``held`` are not learned from."""
    model = train(docs, labels.where(fold_of(F.col("doc_id"), folds) != held))
    return docs.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")

"""Language identification with a string kernel.

A text is the set of its character n-grams of 1 to 3 letters (a blended
spectrum; presence, not counts). The kernel of two texts is the number of
shared n-grams over the geometric mean of their set sizes. A bounded sample of
labelled texts gives landmarks; kernel ridge regression, one language against
the rest, is solved in the Nystrom space that they span. Scoring multiplies a
batch's presence matrix by the landmarks' matrix, and that by the weights.

Cases: a null text or one without a letter is ``und`` with score 0; rows of the
same text get the same answer; texts are used whole; other columns are not
read; an empty table gives an empty result; without any labelled text, all
texts with a letter are ``und`` with score 0. Of labels, the ``LANGUAGES`` with
most texts are learned.

As a filter, the operator rejects what is ``und`` and what no language claims:
texts for which every regression gives less than ``EVIDENCE``, as other scripts
and noise do.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import fold_of, hashed_sample

#: Hashed n-gram columns, a power of two.
BITS = 14
WIDTH = 1 << BITS
#: Texts a batch of the matrix product.
BATCH = 64
#: Labelled texts a language in the fit, and landmarks among them.
PER_LANGUAGE, LANDMARKS = 256, 32
#: Languages that are learned: a bound on what reaches the driver.
LANGUAGES = 64
#: Least output of the best regression that a filter keeps. A text of a language
#: is near 1; the least of the 10,000 texts of sf0.1 ("Avec.") has 0.159, a
#: script that no landmark has about 0.03.
EVIDENCE = 0.12
RIDGE = 1e-2
SHARPNESS = 6.0


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its value in n-grams: itself if a letter, else a space."""
    every = np.arange(0x110000, dtype=np.uint32)
    out = np.full(0x110000, 32, np.uint32)
    step = 1 << 12
    for a in range(0, 0x110000, step):
        if 0xD800 <= a < 0xE000:
            continue
        is_letter = np.array([chr(c).isalpha() for c in range(a, a + step)])
        out[a : a + step][is_letter] = every[a : a + step][is_letter]
    return out


def grams(text: str | None) -> np.ndarray | None:
    """Presence of the hashed 1- to 3-grams of a whole text; None without a letter."""
    if not text:
        return None
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (c != 32).any():
        return None
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    shift = np.uint32(32 - BITS)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    out = np.zeros(WIDTH, np.uint8)
    for h in (one, two, three):
        out[(h * np.uint32(0x27D4EB2F)) >> shift] = 1
    return out


class KernelModel:
    """Landmarks' presence bits and the folded weights of each language."""

    def __init__(self, languages: list[str], bits: np.ndarray, weights: np.ndarray):
        self.languages, self.bits, self.weights = languages, bits, weights

    @staticmethod
    def fit(bits: np.ndarray, langs: list[str], per_language: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
        """bits: rows of packed presence; langs: their labels."""
        names = sorted(set(langs))
        which = np.array([names.index(x) for x in langs])
        order = np.arange(len(langs))
        marks = np.concatenate([order[which == k][:per_language] for k in range(len(names))])
        x = np.unpackbits(bits, axis=1).astype(np.float32)
        norm = np.sqrt(x.sum(1))
        land, size = x[marks], norm[marks]
        inner = (land @ land.T) / np.outer(size, size)
        value, vector = np.linalg.eigh(inner.astype(np.float64))
        value, vector = value[value > 1e-6 * value[-1]], vector[:, value > 1e-6 * value[-1]]
        root = vector / np.sqrt(value)
        phi = ((x @ land.T) / np.outer(norm, size)) @ root
        target = (which[:, None] == np.arange(len(names))).astype(np.float64)
        # each language weighs the same, whatever its share of the sample
        share = 1 / np.bincount(which, minlength=len(names))[which]
        gram = phi.T @ (phi * share[:, None]) + ridge * np.eye(phi.shape[1]) / len(names)
        solved = np.linalg.solve(gram, phi.T @ (target * share[:, None]))
        return KernelModel(names, bits[marks], ((root @ solved) / size[:, None]).astype(np.float32))

    def matrix(self) -> np.ndarray:
        return np.ascontiguousarray(np.unpackbits(self.bits, axis=1).T.astype(np.float32))

    def score(self, rows: np.ndarray, land: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and its regression for a batch of presence rows."""
        rows = rows.astype(np.float32)
        f = ((rows @ land) @ self.weights) / np.sqrt(rows.sum(1))[:, None]
        e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
        best = f.argmax(1)
        at = np.arange(len(e))
        return best, (e[at, best] / e.sum(1)).astype(np.float64), f[at, best].astype(np.float64)


def _sample_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(g, k) for k, t in enumerate(b.column("text").to_pylist()) if (g := grams(t)) is not None]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array([k for _, k in found], pa.int64())), b.column("lang").take(pa.array([k for _, k in found], pa.int64())), pa.array([np.packbits(g).tobytes() for g, _ in found], pa.binary())],
            ["doc_id", "lang", "bits"],
        )


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> KernelModel | None:
    """Fit on at most ``per_language`` texts of each of ``LANGUAGES`` labels of
    ``docs`` (doc_id, text, lang): the bound on what is fitted on and what
    reaches the driver. Of an id with several rows of a label one text counts."""
    docs = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = hashed_sample(docs, ["lang"], per_language, seed=11)
    most = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # bounded by per_language rows of each language
    chosen = chosen.join(F.broadcast(most), "lang", "left_semi")
    picked = docs.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = picked.mapInArrow(_sample_bits, "doc_id long, lang string, bits binary").collect()
    if not rows:
        return None
    rows = sorted({(r.lang, r.doc_id): bytes(r.bits) for r in rows}.items())
    bits = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1)
    return KernelModel.fit(bits, [lang for (lang, _), _ in rows], landmarks)


def predictions(model: KernelModel | None, texts: pa.Array, land: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, probability and regression of each text, ``BATCH`` of them at a time."""
    lang, score, evidence = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
    if model is None:
        return lang, score, evidence
    held, at = np.zeros((BATCH, WIDTH), np.uint8), []

    def flush() -> None:
        if at:
            best, p, e = model.score(held[: len(at)], land)
            for k, i in enumerate(at):
                lang[i], score[i], evidence[i] = model.languages[best[k]], p[k], e[k]
            at.clear()

    for i, t in enumerate(texts):
        g = grams(t.as_py())
        if g is not None:
            held[len(at)] = g
            at.append(i)
            if len(at) == BATCH:
                flush()
    flush()
    return lang, score, evidence


def _scorer(model: KernelModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        land = model.matrix() if model else None
        for b in batches:
            lang, score, _ = predictions(model, b.column("text"), land)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _accepter(model: KernelModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        land = model.matrix() if model else None
        for b in batches:
            lang, _, evidence = predictions(model, b.column("text"), land)
            yield b.filter(pa.array(((lang != "und") & (evidence >= EVIDENCE)).tolist(), pa.bool_()))

    return run


def accepted(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language can be told."""
    model = train(docs.where(fold_of(F.col("doc_id"), folds) != held))
    return docs.mapInArrow(_accepter(model), docs.schema)


def identify(docs: DataFrame, train_on: DataFrame | None = None, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    The model learns from ``train_on`` (``docs`` itself if None) outside the
    fold ``held``.
    """
    learn = (docs if train_on is None else train_on).where(fold_of(F.col("doc_id"), folds) != held)
    model = train(learn)
    return docs.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "text").mapInArrow(
        _scorer(model), "doc_id long, held_out boolean, lang_pred string, score double"
    )

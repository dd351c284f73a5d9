import hashlib

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import suffix_dedup as S

COLUMNS = "doc_id long, text string, source string"


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha256) of each row, by all substrings."""
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), S.LAST if i is None else i
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], S.LAST))
    out = []
    for i, t in rows:
        b, i = (t or "").encode(), S.LAST if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        rest = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    r = np.random.default_rng(seed)
    letters = list("abcdé 漢\n")
    passage = lambda n: "".join(r.choice(letters, n))
    shared = [passage(n) for n in (40, 48, 49, 50, 51, 60, 99, 100, 101, 300)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 51), (5, "x" * 500), (6, "y" * 400), (7, "ab" * 100), (8, "ab" * 30)]
    for k in range(60):
        parts = [passage(r.integers(0, 90)) for _ in range(4)]
        for _ in range(r.integers(0, 4)):
            parts.insert(r.integers(0, len(parts)), shared[r.integers(0, len(shared))])
        rows.append((int(r.integers(9, 60)) if k % 5 == 0 else 100 + k, "".join(parts)))
    rows += [(200 + k, "a copied document with more than fifty bytes in all of its text") for k in range(30)]
    rows += [(rows[20][0], rows[20][1]), (None, shared[-1]), (None, shared[-1])]
    return rows


def compare(spark, rows, **how):
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], COLUMNS).withColumn("n_bytes", F.lit("clash")).repartition(5)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(d, **how).collect())
    assert got == sorted((str(i), *b) for (i, _), b in zip(rows, brute(rows), strict=True))


def test_equal_brute_force(spark):
    for seed in range(4):
        compare(spark, corpus(seed))


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    r = np.random.default_rng(9)
    text = "".join(r.choice(list("abcdefgh "), 3000))
    found = S.anchors(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(S, "PIECE", 64)
    again = S.anchors(np.frombuffer(text.encode(), np.uint8))
    assert (found[0] == again[0]).all() and (found[1] == again[1]).all()


def test_every_string_has_an_anchor():
    r = np.random.default_rng(5)
    raw = r.integers(0, 3, 2000).astype(np.uint8)
    _, places = S.anchors(raw)
    for k in range(len(raw) - S.SPAN + 1):
        assert ((places >= k) & (places <= k + S.SPAN - S.GRAM)).any()


def test_kept_text_is_valid(spark):
    rows = [(1, "é" * 40), (2, "a" + "é" * 40), (3, "no repeats here")]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], COLUMNS)
    got = {r.doc_id: (r.text, r.source) for r in S.without_repeats(d).collect()}
    assert got == {1: ("é" * 40, "s"), 2: ("a", "s"), 3: ("no repeats here", "s")}


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], COLUMNS)).count() == 0
    compare(spark, [(1, None)])


def test_columns_survive_packing():
    r = np.random.default_rng(1)
    columns = [r.integers(0, 1 << 60, 7).astype(np.uint64), r.integers(0, 99, 7).astype("<u4"), np.zeros(0, "<i8"), r.integers(0, 9, 5).astype("u1")]
    again = S.unsqueeze(S.squeeze(*columns), np.uint64, "<u4", "<i8", "u1")
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, again, strict=True))

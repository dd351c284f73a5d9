import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import packing as P

COLUMNS = "doc_id long, text string"
TEXTS = [None, "", "a", "hello world " * 900, "x" * 5000, "é ñ ß “quoted” €", "<|endoftext|> in a text", "漢字 かな 한글 😀", " \n\t  \r\n", "naïve café́", "𝔘𝔫𝔦", "1234 ½ ² Ⅳ", "don't we'll I'M"]


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library():
    t, lib = P.tokenizer(P.VOCABULARY), library()
    for text in TEXTS:
        assert t.ids(text or "") == lib.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert P.tokenizer(P.VOCABULARY).ids(text) == library_once.encode(text, add_special_tokens=False).ids


library_once = library()


def check(rows, texts, limit=1024):
    by, held = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array(library_once.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        pieces = sorted(by.pop(doc), key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == limit or k == 0
            at += r.length
        assert at == len(ids)
    assert not by
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(held), sum(n for p in held.values() for _, n in p)


def test_pack(spark):
    texts = dict(enumerate(TEXTS * 5))
    d = spark.createDataFrame(list(texts.items()), COLUMNS).withColumn("length", F.lit("clash")).repartition(3)
    rows = P.pack(d).collect()
    n, _ = check(rows, texts)
    assert n <= best_fit_decreasing([r.length for r in rows], 1024) + 1


def test_repeated_rows_and_empty_table(spark):
    d = spark.createDataFrame([(1, "same text")] * 300 + [(None, "no id")], COLUMNS)
    rows = P.pack(d).collect()
    assert len(rows) == 301 and len({(r.sequence_id, r.offset) for r in rows}) == 301
    assert P.pack(d.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=200))
def test_best_fit_places_all(limit, lengths):
    counts = defaultdict(int)
    for n in lengths:
        counts[min(n, limit)] += 1
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, number, first, offset in P.best_fit(dict(counts), limit):
        for k in range(number):
            held[first + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit


def best_fit_decreasing(lengths, limit):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            gaps.append(limit - n)
    return len(gaps)


def test_as_few_sequences_as_best_fit_decreasing():
    r = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.minimum(100, r.lognormal(3, 0.8, 300).astype(int) + 1)
        counts = {int(n): int((lengths == n).sum()) for n in np.unique(lengths)}
        made = {first + k for _, _, number, first, _ in P.best_fit(counts, 100) for k in range(number)}
        assert len(made) <= best_fit_decreasing(lengths.tolist(), 100) + 1

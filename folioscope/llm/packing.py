"""Best-fit packing of tokenised documents into sequences of fixed length.

A document is its token ids and an end id. Documents longer than a sequence are
cut into full pieces, the first of which may be shorter. Pieces are packed by
bulk-synchronous best fit over length classes: there are at most ``LIMIT``
lengths and as many gaps, so pieces and gaps are handled as counted runs of
equal length. Sweeping the lengths downwards, all pieces of a length look up
their successor gap (the smallest that is large enough), the ranks of the
pieces within their length decide which piece gets which sequence of the gap's
run, the run's gap is updated, and the sweep repeats until the class is placed;
what finds no gap opens new sequences. That needs only the histogram of lengths
(at most ``LIMIT`` counts) on the driver; pieces are ranked within their length
on the executors and look their sequence up by (length, rank).

Cases: a null or empty text is the end id alone; equal documents and repeated
rows are packed each; an empty table gives an empty result; very long texts are
tokenised whole; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.bytesets import parts
from folioscope.llm.common import ranked, spread_hash, written

LIMIT, END = 1024, 2
VOCABULARY = "byte_bpe_50k"
#: Cells of one length, by hash of the id.
SPREAD = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tokenizer:
    """Ids of the ``tokenizers`` library for a public vocabulary.

    ``tiktoken`` holds the same byte-level BPE vocabulary and splits text by
    the same pattern; it serves texts of Latin letters, for which the libraries'
    Unicode tables cannot differ. Texts with other characters or with the
    vocabulary's special string go to ``tokenizers`` itself.
    """

    #: Anything but Basic Latin to Latin Extended-B and general punctuation.
    OTHER = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u20ac]")

    def __init__(self, vocabulary: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{vocabulary}.json")
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def library(self):
        """Loaded for the first text that needs it."""
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.OTHER.search(text) or any(x in text for x in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.cache
def tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer(vocabulary)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= limit:
        return [(0, n)]
    first = n % limit
    return ([(0, first)] if first else []) + [(s, limit) for s in range(first, n, limit)]


def _pieces(limit: int, end: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for b in parts(batches):
            owner, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                ids = np.array([*t.ids(text.as_py() or ""), end], "<u4")
                for k, (s, n) in enumerate(cut(ids.size, limit)):
                    owner.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def tokenised(docs: DataFrame, limit: int = LIMIT, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every document, not yet packed."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(limit, end, vocabulary), PIECES)


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): the pieces of
    the length with these ranks go to consecutive sequences at the offset."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # ascending, those with open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, number)
    made = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                bisect.insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[k]
            else:
                gap, first, n = limit, made, -(-left // (limit // length))
                made += n
            used = min(n, left)
            runs.append((length, rank, used, first, limit - gap))
            put(gap - length, first, used)
            if gap != limit:
                put(gap, first + used, n - used)
            elif used < n:
                raise AssertionError("new sequences are never more than pieces")
            rank, left = rank + used, left - used
    return runs


def _places(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() - 1
            at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(table[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, limit: int = LIMIT, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: its document, place in it, length, checksum of its ids,
    and its sequence and place there."""
    pieces = written(tokenised(docs, limit, end, vocabulary))
    # at most `limit` rows
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salt = F.pmod(spread_hash(F.col("doc_id")) + F.col("piece"), F.lit(SPREAD))
    rows = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], salt, "rank")
    return rows.mapInArrow(_places(best_fit(counts, limit)), f"{PIECES}, sequence_id long, offset long")

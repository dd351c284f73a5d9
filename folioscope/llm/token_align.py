"""Alignment of two tokenizers' tokens by the bytes where they end.

Every text, with a space before it, is tokenised by both vocabularies. The ends
of their tokens are events; those of A and of B are united, exchanged by
document, sorted by offset and streamed through a machine whose state is the
open group: the tokens since the last offset at which both sides ended. Such an
offset closes the group and links the two tokens that end there. Events of a
side travel in blocks of up to ``BLOCK`` consecutive ones, by their ids alone (a
token's length follows from its id), so that the machine holds one block of each
side besides the open group.

How often a pair of ids is linked in the whole corpus is counted from chunks: a
task keeps the links of its documents as places in the chunk's list of distinct
pairs, so every pair is asked and answered once a chunk, not once a link. Asks
meet the corpus-wide counts by pair (hot pairs are salted); the highest count of
a B id is taken over at most one row an A id; and the answers of a chunk go back
to it. A chunk has at most ``CHUNK`` links, a long document spans several.

Words are tokenised once: between a printable ASCII or Latin character
and the space after it no token of either vocabulary runs on (no piece of B has
a space after another character, and the pattern of A starts anew there), so
texts are cut there and the ids of up to ``WORDS`` short pieces are remembered.

Cases: null and empty texts and those that a vocabulary does not give back (as
with U+2581, which B takes for a space) have no tokens: zeros and an empty
groups digest; repeated rows are documents of their own, so links count as often
as they occur; texts of any length are tokenised whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.bytesets import parts
from folioscope.llm.common import discard, spread_join, written
from folioscope.llm.packing import tokenizer

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k", "piece_bpe_32k"
#: Events in a block, links in a chunk.
BLOCK, CHUNK = 4096, 1 << 21
#: Pieces of texts whose ids are remembered, and their longest length.
WORDS, WORD = 100_000, 24
#: Pieces that are tokenised as one text, and the ids of one that cannot be.
TOGETHER, LOST = 2048, (b"lost", b"lost")
#: Ids are below this, so that a pair is one integer.
IDS = 1 << 16
A, B, NONE = 0, 1, 2

EVENTS = "row long, doc_id long, offset long, side int, ids binary"
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "chunk long, owners array<long>, sizes array<int>, links binary, pairs array<long>, counts array<int>"
)


class Tokens:
    """Ids of both vocabularies, and what their tokens' bytes are."""

    #: Where texts are cut, spaces at which they are not, and ends of pieces.
    CUT, WITHIN, SAFE = re.compile("(?<=[!-~À-ɏ]) "), re.compile("(?:^|[^!-~À-ɏ]) "), re.compile("[!-~À-ɏ]")

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece

        self.a = tokenizer(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes_a = [b""] * (self.a.fast.max_token_value + 1)
        for k in range(len(self.bytes_a)):
            self.bytes_a[k] = self.a.fast.decode_single_token_bytes(k)
        if any(re.search("[^▁]▁", p) for p in pieces) or max(len(self.bytes_a), len(pieces)) > IDS:
            raise ValueError("texts cannot be cut at spaces for this vocabulary")
        self.held: dict[str, tuple[bytes, bytes]] = {}

    @functools.cached_property
    def plain(self):
        """The library of A, with special strings as plain text."""
        from tokenizers import Tokenizer as Library

        out = Library.from_file(self.a.path)
        out.encode_special_tokens = True
        return out

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and a text; None where its bytes do not come back."""
        raw = f" {text}"
        a = self.plain.encode(raw, add_special_tokens=False).ids if self.a.OTHER.search(raw) else self.a.fast.encode_ordinary(raw)
        b = self.b.encode(text) if text else [self.b.piece_to_id("▁")]
        raw = raw.encode()
        if any(b"".join(map(table.__getitem__, ids)) != raw for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        return np.array(a, np.uint16), np.array(b, np.uint16)

    def _together(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of pieces that end where texts are cut, of one text of them."""
        found = self._ids(" ".join(pieces))
        if found is None:
            if len(pieces) == 1:
                return [LOST]
            half = len(pieces) // 2
            return self._together(pieces[:half]) + self._together(pieces[half:])
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        sides = []
        for ids, lengths in zip(found, self.lengths, strict=True):
            at = np.searchsorted(np.cumsum(lengths[ids]), ends) + 1
            data = ids.tobytes()
            sides.append([data[2 * i : 2 * j] for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)])
        return list(zip(*sides, strict=True))

    def _learn(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of pieces, many at a time."""
        out, groups = {}, {False: [], True: []}
        for p in pieces:
            if len(p) > WORD or not self.SAFE.match(p[-1:]):
                ids = self._ids(p)
                out[p] = LOST if ids is None else (ids[0].tobytes(), ids[1].tobytes())
            else:
                groups[bool(self.a.OTHER.search(p))].append(p)
        for group in groups.values():
            for k in range(0, len(group), TOGETHER):
                some = group[k : k + TOGETHER]
                out.update(zip(some, self._together(some), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of whole texts, a space before each, as two bytes each; None for
        those without tokens."""
        cut = [(x.split(" ") if not self.WITHIN.search(x) else self.CUT.split(x)) if x else None for x in texts]
        held = self.held
        fresh = self._learn(list({p for pieces in cut if pieces for p in pieces if p not in held}))
        out = []
        for pieces in cut:
            ids = [held.get(p) or fresh[p] for p in pieces] if pieces else [LOST]
            out.append(None if LOST in ids else (b"".join([x for x, _ in ids]), b"".join([x for _, x in ids])))
        room = WORDS - len(held)
        if room > 0:
            held.update([x for x in fresh.items() if len(x[0]) <= WORD][:room])
        return out

    @functools.cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    @functools.cached_property
    def strings(self) -> list[str]:
        """Decimal ids of A and B, each with what follows inside a group and at its end."""
        return [f"{k}{end}" for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for k in range(n) for end in (",", last)]


@functools.cache
def tokens(a: str, b: str) -> Tokens:
    return Tokens(a, b)


def events(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """The united end events of both sides, in blocks: the offset of a block is
    where its first token starts. A document without tokens has one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(a, b)
        for batch in parts(batches, 500):
            at, offset, side, ids = [], [], [], []
            for k, both in enumerate(t.encode(batch.column("text").to_pylist())):
                if both is None:
                    at.append(k)
                    offset.append(0)
                    side.append(NONE)
                    ids.append(b"")
                    continue
                for s, data in zip((A, B), both, strict=True):
                    begin = 0
                    for i in range(0, len(data), 2 * BLOCK):
                        at.append(k)
                        offset.append(begin)
                        side.append(s)
                        ids.append(data[i : i + 2 * BLOCK])
                        begin += int(t.lengths[s][np.frombuffer(ids[-1], np.uint16)].sum())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array(offset, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())],
                ["row", "doc_id", "offset", "side", "ids"],
            )

    # ids of rows follow from the scan, so that a repeated task gives the same
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, EVENTS)


class Sweep:
    """The state of one document: what both sides have since the last common end."""

    def __init__(self, row: int, doc_id: int | None):
        self.row, self.doc_id = row, doc_id
        self.n = [0, 0]
        self.groups = 0
        self.digest = hashlib.sha256()
        self.ids = [np.zeros(0, np.int64)] * 2
        self.ends = [np.zeros(0, np.int64)] * 2

    def block(self, side: int, offset: int, ids: np.ndarray, t: Tokens) -> np.ndarray:
        """Takes a side's next block; gives the pairs of the groups that close."""
        ends = offset + np.cumsum(t.lengths[side][ids])
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate((self.ids[side], ids)) if len(self.ids[side]) else ids
        self.ends[side] = np.concatenate((self.ends[side], ends)) if len(self.ends[side]) else ends
        (a, b), (x, y) = self.ids, self.ends
        if not len(x) or not len(y):
            return a[:0]
        at = np.searchsorted(y, x)
        hit = np.flatnonzero(y[np.minimum(at, len(y) - 1)] == x)
        if not len(hit):
            return a[:0]
        to = at[hit]
        self._write(a[: hit[-1] + 1], b[: to[-1] + 1], hit, to, t)
        self.groups += len(hit)
        pairs = a[hit] * IDS + b[to]
        self.ids, self.ends = [a[hit[-1] + 1 :], b[to[-1] + 1 :]], [x[hit[-1] + 1 :], y[to[-1] + 1 :]]
        return pairs

    def _write(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, t: Tokens) -> None:
        """Adds closed groups to the digest: each side's ids, the last one of a
        group with the group's mark."""
        code_a, code_b = 2 * a, 2 * (b + len(t.bytes_a))
        code_a[last_a] += 1
        code_b[last_b] += 1
        na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(last_b + 1 - nb, na)] = code_a
        out[np.arange(len(b)) + np.repeat(last_a + 1, nb)] = code_b
        text = "".join(map(t.strings.__getitem__, out.tolist()))[:-1]
        self.digest.update((";" + text if self.groups else text).encode())

    def result(self) -> tuple:
        if not self.groups:
            return (self.row, self.doc_id, 0, 0, 0, 0, "")
        return (self.row, self.doc_id, *self.n, self.groups, self.groups, self.digest.hexdigest())


_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in ALIGNED.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _chunk(chunk: int, links: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    pairs, at, counts = np.unique(np.concatenate([x for _, x in links]), return_inverse=True, return_counts=True)
    packed = pa.compress(at.astype(np.uint32).tobytes(), "zstd", asbytes=True)
    return _rows([(*[None] * 7, chunk, [r for r, _ in links], [len(x) for _, x in links], packed, pairs, counts)])


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, chunk = tokens(a, b), TaskContext.get().partitionId() << 32
        sweep, done, links, n = None, [], [], 0
        for batch in batches:
            for row, doc, offset, side, ids in zip(*(batch.column(c) for c in ("row", "doc_id", "offset", "side", "ids")), strict=True):
                if sweep is None or row.as_py() != sweep.row:
                    if sweep:
                        done.append((*sweep.result(), *[None] * 6))
                    sweep = Sweep(row.as_py(), doc.as_py())
                if side.as_py() == NONE:
                    continue
                pairs = sweep.block(side.as_py(), offset.as_py(), np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int64), t)
                if len(pairs):
                    links.append((sweep.row, pairs))
                    n += len(pairs)
                if n >= CHUNK:
                    yield _chunk(chunk, links)
                    chunk, links, n = chunk + 1, [], 0
            if done:
                yield _rows(done)
                done = []
        if sweep:
            yield _rows([(*sweep.result(), *[None] * 6)])
        if links:
            yield _chunk(chunk, links)

    return run


def sweep(united: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """One row a document (those with ``row``), and one a chunk of links."""
    return united.repartition("row").sortWithinPartitions("row", "offset", "side").mapInArrow(_aligned(a, b), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how often a pair of ids is linked, and whether no
    other A id is linked to the B id more often."""
    asked = aligned.where("chunk is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = asked.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    # at most one row an A id in a window
    return totals.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy(F.pmod("pair", F.lit(IDS)))))


def _scored(key: tuple, answers: pa.Table, chunks: pa.Table) -> pa.Table:
    order = np.argsort(answers.column("pos").to_numpy())
    count = answers.column("count").to_numpy()[order]
    best = answers.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    row, n_best, count_sum = [], [], []
    for k in range(chunks.num_rows):
        sizes = np.array(chunks.column("sizes")[k].as_py(), np.int64)
        at = np.frombuffer(pa.decompress(chunks.column("links")[k].as_py(), 4 * int(sizes.sum()), "zstd"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        row += chunks.column("owners")[k].as_py()
        n_best += np.add.reduceat(best[at], starts).tolist()
        count_sum += np.add.reduceat(count[at], starts).tolist()
    return pa.table({"row": pa.array(row, pa.int64()), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})


def align(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """One row a document: numbers of tokens, groups and links, how many links
    are their B id's most frequent, the sum of their counts, and a digest of
    the groups."""
    aligned = written(sweep(events(docs, a, b), a, b))
    counts = written(pair_counts(aligned))
    chunks = aligned.where("chunk is not null")
    asked = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair"))
    # a pair is asked once a chunk
    answers = spread_join(asked, counts, ["pair"], F.col("chunk"), asked.groupBy("pair").agg(F.count(F.lit(1)).alias("_n"))).select("chunk", "pos", "count", "best")
    scored = answers.groupBy("chunk").cogroup(chunks.select(F.col("chunk").alias("of_chunk"), "owners", "sizes", "links").groupBy("of_chunk")).applyInArrow(_scored, "row long, n_best long, count_sum long")
    scores = scored.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = aligned.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return found.join(scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"
    )


def pairs(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """(a_id, b_id, count, best): the corpus-wide table of linked ids."""
    counts = pair_counts(written(sweep(events(docs, a, b), a, b)))
    return counts.select(F.shiftright("pair", 16).cast("int").alias("a_id"), F.pmod("pair", F.lit(IDS)).cast("int").alias("b_id"), "count", "best")

"""The full-text index: immutable segments of posting blocks.

A segment holds the chunks that one change added, in three tables: ``forward``
(a chunk's words in order), ``blocks`` (postings of a token in order of impact,
cut into blocks with upper bounds, for some chunks at a time), and ``vocabulary`` (in how many chunks a
token is, with the bounds of all its postings). Segments are never changed: a
chunk that gets another text or goes is named in a deletion list, with what it
takes from the counts. So a change writes in proportion to itself. When
``FANOUT`` segments of about one size have come together, they are merged to one
of the next size and their deletions are dropped, so a chunk is written again as
often as the logarithm of the index.

The segments, their deletion lists and their figures are the parts of a table of
the commit log; a merge that meets a deletion by another writer is played again
by that writer's rules or refused.

A bound of postings is the least length for each term frequency among them:
from it the highest impact follows for any mean length, so bounds stay exact
while the corpus grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.operators.store import Conflict, Snapshots

#: Segments of about one size that are merged, and the chunks of the smallest size.
FANOUT, SMALLEST = 4, 256
#: Postings in a block.
BLOCK = 128
#: Chunks whose postings are made at once, and postings that are sorted at once.
ROWS, SORTED = 512, 1 << 20
#: How a score saturates with a term's frequency and falls with a chunk's length.
K1, B = 1.2, 0.75
FORWARD = "segment string, id long, note_id long, length int, words array<string>"
BLOCKS = "segment string, token string, n int, ids array<long>, tfs array<int>, lengths array<int>, bound_tfs array<int>, bound_lengths array<int>"
VOCABULARY = "segment string, token string, n long, bound array<struct<tf:int,length:int>>"
GONE, TAKEN = "segment string, id long", "segment string, token string, n long"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, id, tf and length of every chunk's distinct words, of a few chunks
    at a time."""
    for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        words = b.column("words")
        sizes = words.value_lengths().to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            continue
        many = len(coded.dictionary)
        key, tf = np.unique(np.repeat(np.arange(b.num_rows), sizes) * many + coded.indices.to_numpy(), return_counts=True)
        row = pa.array(key // many)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(key % many)), b.column("id").take(row), pa.array(tf, pa.int32()), b.column("length").take(row)], ["token", "id", "tf", "length"]
        )


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _cut(segment: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the postings of sorted rows."""
        for b in batches:
            if not b.num_rows:
                continue
            token = b.column("token")
            code = token.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            begin = np.repeat(first, np.diff(np.append(first, len(code))))
            starts = np.flatnonzero((np.arange(len(code)) - begin) % BLOCK == 0)
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
            tf, length = b.column("tf").to_numpy(), b.column("length").to_numpy()
            order = np.lexsort((length, tf, block))
            new = np.diff(block[order], prepend=-1).astype(bool) | np.diff(tf[order], prepend=-1).astype(bool)
            least = order[new]
            at = np.searchsorted(block[least], np.arange(len(starts)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment] * len(starts), pa.string()), token.take(pa.array(starts)), pa.array(np.diff(np.append(starts, len(code))), pa.int32()),
                    _lists(b.column("id"), starts), _lists(b.column("tf"), starts), _lists(b.column("length"), starts),
                    _lists(pa.array(tf[least], pa.int32()), at), _lists(pa.array(length[least], pa.int32()), at),
                ],
                [c.split()[0] for c in BLOCKS.split(", ")],
            )

    return run


def _sorted(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """Postings in order of token, impact and id, about ``SORTED`` at a time."""
    some: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(some).combine_chunks()
        some.clear()
        token = table["token"].chunk(0).dictionary_encode()
        place = np.empty(len(token.dictionary), np.int64)
        place[pc.sort_indices(token.dictionary).to_numpy()] = np.arange(len(place))
        tf, length = table["tf"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort((table["id"].to_numpy(), -impact(tf, length, mean), place[token.indices.to_numpy()]))
        return table.take(pa.array(order)).combine_chunks().to_batches()[0]

    for b in batches:
        some.append(b)
        if sum(x.num_rows for x in some) >= SORTED:
            yield flush()
    if some:
        yield flush()


def blocks_of(forward: DataFrame, name: str, mean: float) -> DataFrame:
    """Blocks of the postings of chunks, made where the chunks are read: of about
    ``SORTED`` postings at a time, in order of token and impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(name)(_sorted(_postings(batches), max(mean, 1.0)))

    return forward.select("id", "length", "words").mapInArrow(run, BLOCKS)


def _merged(b: pa.RecordBatch) -> pa.RecordBatch:
    """A row a token of sorted rows (token, n, bound_tfs, bound_lengths)."""
    code = b.column("token").dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    each = np.repeat(code, b.column("bound_tfs").value_lengths().to_numpy(zero_copy_only=False))
    tf, length = b.column("bound_tfs").flatten().to_numpy(), b.column("bound_lengths").flatten().to_numpy()
    order = np.lexsort((length, tf, each))
    least = order[np.diff(each[order], prepend=-1).astype(bool) | np.diff(tf[order], prepend=-1).astype(bool)]
    at = np.searchsorted(each[least], np.arange(len(first)))
    n = np.add.reduceat(b.column("n").to_numpy(), first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([b.column("token").take(pa.array(first)), pa.array(n), _lists(pa.array(tf[least], pa.int32()), at), _lists(pa.array(length[least], pa.int32()), at)], ["token", "n", "bound_tfs", "bound_lengths"])


def _counted(segment: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(b: pa.RecordBatch) -> pa.RecordBatch:
        tfs, lengths = b.column("bound_tfs"), b.column("bound_lengths")
        starts = np.concatenate(([0], np.cumsum(tfs.value_lengths().to_numpy(zero_copy_only=False))))[:-1]
        bound = pa.StructArray.from_arrays([tfs.flatten(), lengths.flatten()], ["tf", "length"])
        return pa.RecordBatch.from_arrays([pa.array([segment] * b.num_rows, pa.string()), b.column("token"), b.column("n"), _lists(bound, starts)], ["segment", "token", "n", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vocabulary of sorted rows; the last token of a batch may go on."""
        open_: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                done = _merged(pa.Table.from_batches([*open_, b]).combine_chunks().to_batches()[0])
                open_ = [done.slice(done.num_rows - 1)]
                yield row(done.slice(0, done.num_rows - 1))
        yield from map(row, open_)

    return run


def vocabulary_of(blocks: DataFrame, name: str) -> DataFrame:
    """In how many chunks a token is, and the bounds of its postings: one row a
    term frequency. In order of the token within each task."""
    each = blocks.select("token", F.col("n").cast("long").alias("n"), "bound_tfs", "bound_lengths")
    return each.repartition("token").sortWithinPartitions("token").mapInArrow(_counted(name), VOCABULARY)


def impact(tf, length, mean: float):
    """What a term in a chunk weighs, apart from how rare it is; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def forward_of(chunks: DataFrame, text: str = "text_content") -> DataFrame:
    words = chunks.select("id", "note_id", tokens(F.col(text)).alias("words"))
    return words.select(F.lit("").alias("segment"), "id", "note_id", F.size("words").alias("length"), "words")


def unstored(chunks: DataFrame, text: str = "text_content") -> Index:
    """The index of chunks (id, note_id, text) without a table."""
    forward = forward_of(chunks, text)
    n = forward.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    blocks = blocks_of(forward, "", n.words / max(n.docs, 1))
    return Index(forward, blocks, vocabulary_of(blocks, ""), None, None, n.docs, n.words)


@dataclass
class Index:
    """What is searched: the segments' tables with their deletions, and figures
    of all live chunks. ``gone`` and ``taken`` are None without deletions."""

    forward: DataFrame
    blocks: DataFrame
    counts: DataFrame
    gone: DataFrame | None
    taken: DataFrame | None
    docs: int
    words: int

    @property
    def mean(self) -> float:
        return self.words / self.docs if self.docs else 0.0

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, id) without deleted ones."""
        return rows if self.gone is None else rows.join(self.gone, ["segment", "id"], "left_anti")

    @property
    def chunks(self) -> DataFrame:
        """id, note_id, length and words of the live chunks."""
        return self.live(self.forward).select("id", "note_id", "length", "words")

    def vocabulary(self, wanted: DataFrame | None = None) -> DataFrame:
        """token, n (live chunks that have it) and its bounds; of the tokens
        ``wanted``, if given."""
        v, t = self.counts, self.taken
        if wanted is not None:
            v = v.join(wanted, "token", "left_semi")
        out = v.groupBy("token").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("bound")).alias("bound"))
        if t is None:
            return out
        t = t.groupBy("token").agg(F.sum("n").alias("_t"))
        return out.join(t, "token", "left").select("token", (F.col("n") - F.coalesce("_t", F.lit(0))).alias("n"), "bound").where("n > 0")


class Segments:
    """A full-text index in a table of the commit log."""

    def __init__(self, tables: Snapshots, name: str = "text"):
        self.tables, self.name = tables, name
        self.spark = tables.spark

    # -- reading

    def parts(self) -> tuple[list[dict], list[dict]]:
        """The segments and the deletion lists of the current version."""
        parts = self.tables.manifest(self.name)["parts"]
        return [p for p in parts if "segment" in p], [p for p in parts if "gone" in p]

    def _tables(self, segments: list[dict], gone: list[dict]) -> Index:
        def read(kind: str, schema: str, parts: list[dict]) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*[f"{p['at']}/{kind}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

        alive = {p["segment"] for p in segments}
        removed = [x for p in gone for s, x in p["gone"].items() if s in alive]
        # the names of segments are few: their number grows with the logarithm of the index
        mine = F.col("segment").isin(sorted(alive))
        docs, words = sum(p["docs"] for p in segments) - sum(x["docs"] for x in removed), sum(p["words"] for p in segments) - sum(x["words"] for x in removed)
        lists = [read(k, s, gone).where(mine) if removed else None for k, s in (("ids", GONE), ("tokens", TAKEN))]
        return Index(read("forward", FORWARD, segments), read("blocks", BLOCKS, segments), read("vocabulary", VOCABULARY, segments), *lists, docs, words)

    def index(self) -> Index:
        return self._tables(*self.parts())

    # -- changing

    def update(self, changed: DataFrame | None, gone: DataFrame | None = None, text: str = "text_content") -> int:
        """The chunks ``changed`` (id, note_id, text) are new or have this text
        now, those of ``gone`` (id) are no more. Their earlier texts are put on a
        deletion list; only the change is written."""
        segments, lists = self.parts()
        base = [*segments, *lists]
        added, removed = [], []
        if changed is not None:
            part = self._segment(forward_of(changed, text))
            added = [part] if part["docs"] else []
        if segments:
            # ids that the new segment has are read from there
            ids = [self.spark.read.schema(FORWARD).parquet(f"{p['at']}/forward").select("id") for p in added] + ([gone.select("id")] if gone is not None else [])
            if ids:
                part = self._deletions(self._tables(segments, lists), ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1]))
                removed = [part] if part["gone"] else []
        if not added and not removed:
            return self.tables.version(self.name)

        def change(parts: list[dict]) -> list[dict]:
            if [p for p in parts if p in base] != parts or len(parts) != len(base):
                raise Conflict(f"{self.name} was changed meanwhile")
            return [*parts, *added, *removed]

        v = self.tables.commit(self.name, change)
        return self.merged() or v

    def _segment(self, forward: DataFrame) -> dict:
        """Write a segment of chunks (id, note_id, length, words)."""
        at = self.tables.new_folder(self.name)
        name = at.rsplit("/", 1)[-1]
        # small row groups: a question reads those of its tokens and its candidates
        save = lambda df, kind: df.write.option("parquet.block.size", 4 << 20).parquet(f"{at}/{kind}")
        save(forward.select(F.lit(name).alias("segment"), "id", "note_id", "length", "words"), "forward")
        kept = self.spark.read.schema(FORWARD).parquet(f"{at}/forward")
        n = kept.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        if n.docs:
            save(blocks_of(kept, name, n.words / n.docs), "blocks")
            save(vocabulary_of(self.spark.read.schema(BLOCKS).parquet(f"{at}/blocks"), name), "vocabulary")
        return {"segment": name, "at": at, "docs": n.docs, "words": n.words}

    def _deletions(self, index: Index, ids: DataFrame) -> dict:
        """Write the list of the live rows of ``ids`` and what they take from counts."""
        at = self.tables.new_folder(self.name)
        hit = index.live(index.forward.join(ids.distinct(), "id", "left_semi"))
        rows = hit.select("segment", "id", "length", F.array_distinct("words").alias("words"))
        rows.write.parquet(f"{at}/rows")
        rows = self.spark.read.schema("segment string, id long, length int, words array<string>").parquet(f"{at}/rows")
        rows.select("segment", "id").write.parquet(f"{at}/ids")
        rows.select("segment", F.explode("words").alias("token")).groupBy("segment", "token").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{at}/tokens")
        # one row a segment
        sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("words")).collect()
        fs = self.tables._files(at)
        fs.delete(self.tables._path(f"{at}/rows"), True)
        return {"at": at, "gone": {r.segment: {"docs": r.docs, "words": r.words} for r in sizes}}

    def merged(self) -> int | None:
        """Merge segments of about one size while there are ``FANOUT`` of them;
        the version after that, None if there was nothing to do."""
        v = None
        while True:
            segments, lists = self.parts()
            tiers: dict[int, list[dict]] = {}
            for p in segments:
                tiers.setdefault(tier(p["docs"]), []).append(p)
            full = [t for t, ps in sorted(tiers.items()) if len(ps) >= FANOUT]
            if not full:
                return v
            # smaller ones go along, so that they are not merged right after
            chosen = [p for t, ps in tiers.items() if t <= full[0] for p in ps]
            v = self._merge(chosen, segments, lists)

    def _merge(self, chosen: list[dict], segments: list[dict], lists: list[dict]) -> int:
        part = self._segment(self._tables(chosen, lists).chunks)
        names = {p["segment"] for p in chosen}
        left = {p["segment"] for p in segments} - names

        def change(parts: list[dict]) -> list[dict]:
            known = [p for p in parts if "segment" in p and p["segment"] in names]
            hits = [p for p in parts if "gone" in p and names & p["gone"].keys()]
            if known != chosen or any(p not in lists for p in hits):
                raise Conflict(f"segments of {self.name} were changed while they were merged")
            new = {p["segment"] for p in parts if "segment" in p} - names
            return [p for p in parts if ("segment" in p and p["segment"] not in names) or ("gone" in p and (left | new) & p["gone"].keys())] + ([part] if part["docs"] else [])

        return self.tables.commit(self.name, change)

    def rebuilt(self) -> int:
        """All live chunks in one segment."""
        segments, lists = self.parts()
        return self._merge(segments, segments, lists) if segments else 0


def tier(docs: int) -> int:
    """Sizes of segments in steps of ``FANOUT``."""
    return max(0, math.ceil(math.log(max(docs, 1) / SMALLEST, FANOUT)))

"""Exact similarity of vectors, block by block.

Vectors go with the nearest of a sample of pivots, in a ring around it by their
angle, and a block has those of a few rings near each other, or a part of those
of one, about ``BLOCK`` of them; each pair of blocks is one matrix product in one
task. Only the best hits of a block, or the pairs over a threshold, leave it. How
far a vector's angle with a pivot is from the ring's angles bounds every score of
the vector in the ring: a vector goes only to blocks where it can
reach the threshold or, for the best ``k``, the ``k``-th score that it has in
the blocks nearest to it. So results are those of comparing everything. Where a
sample says that bounds would spare little, or that vectors would be sent to many
blocks, all blocks meet, and tasks read them instead of being sent the vectors.
A few queries go to the items' own tasks.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.blocks import fixed, met, packed, unpacked
from folioscope.operators.store import held

BLOCK = 2048
#: The score of what does not count.
NEVER = -1e6


#: Most pivots, and blocks that a query is compared with first.
PIVOTS, FIRST = 4096, 2
#: Vectors for a pivot, and rings of angles around a pivot.
EACH, RINGS = 32, 12
#: Share of the vectors beyond which bounds are not worth their passes.
MOSTLY = 0.6
#: Room for rounded scores, and for angles in double precision.
NEAR, TURN = 2e-6, 1e-6
#: Bytes that a vector may be sent as, all its copies for blocks together.
SENT = 1 << 14
#: Where all blocks meet, how many there are before they grow, and how much; the
#: tasks wished for, and most blocks of a side that a task reads.
SPREAD, WIDE = 8, 2
TASKS, STREAMED, KEPT = 32, 128, 8
#: Numbers in a matrix that is worked on at once.
CELLS = 1 << 20


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _few(width: int) -> int:
    """Rows of a matrix of ``CELLS`` numbers."""
    return max(1, CELLS // max(1, width))


def _small(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that ``width`` numbers a row stay within ``CELLS``."""
    for b in batches:
        for k in range(0, b.num_rows, _few(width)):
            yield b.slice(k, _few(width))


class Pivots:
    """A sample of vectors by length, and the blocks around them."""

    def __init__(self, vectors: pa.Table):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length: (numbers, unit vectors)
        self.n = len(vectors)
        self.norms = np.zeros(self.n)
        size = _lengths(vectors["vector"]) if self.n else np.zeros(0, np.int64)
        for d in np.unique(size):
            own = np.flatnonzero(size == d)
            x = _matrix(vectors["vector"].take(pa.array(own)))
            self.norms[own] = _norms(x)
            self.of[int(d)] = own, x / np.maximum(_norms(x), 1e-300)[:, None]

    @classmethod
    def among(cls, rows: DataFrame, n: int) -> Pivots:
        """One in ``EACH`` of ``n`` vectors, and one of each length."""
        many = min(PIVOTS, 1 + n // EACH)
        order = F.xxhash64("id")
        # the hashes are cut first, so that vectors of the sample alone are moved
        last = rows.select(order.alias("_h")).orderBy("_h").limit(many).agg(F.max("_h").alias("h")).first().h
        some = (rows.where(order <= last) if last is not None else rows.limit(0)).select("vector", order.alias("_h")).toArrow().sort_by("_h").select(["vector"])
        lengths = sorted(set(_lengths(some["vector"]).tolist())) if len(some) else []
        rest = rows.where(~F.size("vector").isin(lengths)) if lengths else rows
        other = rest.groupBy(F.size("vector").alias("d")).agg(F.min_by("vector", order).alias("vector")).limit(PIVOTS).select("vector").toArrow()
        return cls(pa.concat_tables([some, other.cast(some.schema)]).combine_chunks())

    def width(self) -> int:
        """Most numbers that a row has for all pivots, rings or blocks."""
        return max([self.n, self.count, *(len(at) for at, _ in self.own.values())])

    def reach(self, n: int, needed: int = 0, least: float | None = None) -> float:
        """About the share of vectors that a vector is compared with: of the
        sample with all, where a score of ``least`` or of rank ``needed`` counts."""
        shares = []
        for own, unit in self.of.values():
            x = unit * self.norms[own][:, None]
            size = self.size[self.own[x.shape[1]][0]]
            step = _few(self.width())
            for k in range(0, len(x), step):
                some = x[k : k + step]
                floor = np.full(len(some), -np.inf if least is None else least)
                if needed and len(x) > 1:
                    rank = min(len(x) - 2, needed * len(x) // max(n, 1))
                    others = some @ x.T
                    others[np.arange(len(some)), k + np.arange(len(some))] = -np.inf
                    floor = np.maximum(floor, -np.partition(-others, rank, axis=1)[:, rank])
                shares.append(((self.bounds(some, self.angles(some)) >= floor[:, None]) | (floor <= 0)[:, None]) @ size / max(1, size.sum()))
        return float(np.concatenate(shares).mean()) if shares else 1.0

    def sent(self, reach: float) -> float:
        """About the bytes of all copies of a vector that goes to this share of the blocks."""
        return reach * self.count * 8 * max(self.of, default=0)

    def angles(self, x: np.ndarray) -> np.ndarray:
        """Of rows with all pivots of their length; a zero vector is anywhere."""
        cos = (x @ self.of[x.shape[1]][1].T) / np.maximum(_norms(x), 1e-300)[:, None]
        return np.arccos(np.clip(cos, -1, 1)) * (_norms(x) > 0)[:, None]

    def ring(self, angles: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The ring that each row is in: of its nearest pivot, by their angle."""
        near = angles.argmin(axis=1)
        at = angles[np.arange(len(angles)), near]
        return own[near] * RINGS + np.minimum((at * (RINGS / np.pi)).astype(np.int64), RINGS - 1)

    def blocks(self, rows: DataFrame) -> Pivots:
        """Takes the angles, largest norm and size of each ring's vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = self.n * RINGS
            low, high, norm, count = np.full(n, np.inf), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for b in _small(batches, self.n):
                for own, x, _ in _by_length(b, self.of):
                    at = self.angles(x)
                    k = self.ring(at, own)
                    np.minimum.at(low, k, at.min(axis=1))
                    np.maximum.at(high, k, at.min(axis=1))
                    np.maximum.at(norm, k, _norms(x))
                    np.add.at(count, k, 1)
            k = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(low[k]), pa.array(high[k]), pa.array(norm[k]), pa.array(count[k])], ["k", "low", "high", "norm", "n"])

        # at most a row a ring
        sums = rows.mapInArrow(run, "k long, low double, high double, norm double, n long").groupBy("k")
        found = sums.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"), F.sum("n").alias("n")).toArrow().sort_by("k")
        self.rings, self.low, self.high, self.norm, self.size = (found[c].to_numpy() for c in ("k", "low", "high", "norm", "n"))
        self.low, self.high = self.low - TURN, self.high + TURN
        pivot = self.rings // RINGS
        #: length: places of its rings, and of their pivots among those of the length
        self.own = {d: (at := np.flatnonzero(np.isin(pivot, own)), np.searchsorted(own, pivot[at])) for d, (own, _) in self.of.items()}
        self._filled()
        return self

    def _filled(self) -> None:
        """Blocks: a ring with many vectors has several, rings near each other
        with few of them share one."""
        self.parts, self.first = np.maximum(-(-self.size // BLOCK), 1), np.zeros(len(self.size), np.int64)
        last = 0
        for d, (at, pivot) in self.own.items():
            unit = self.of[d][1]
            heads = unit[: max(1, -(-int(self.size[at].sum()) // BLOCK))]
            step = _few(len(heads))
            near = np.concatenate([(unit[k : k + step] @ heads.T).argmax(axis=1) for k in range(0, len(unit), step)])[pivot]
            room = 0
            # far rings, which many vectors reach, are kept together
            for k in at[np.lexsort((pivot, near, self.rings[at] % RINGS))]:
                if self.size[k] > room or self.parts[k] > 1:
                    last, room = last + 1, BLOCK
                self.first[k] = last
                last += self.parts[k] - 1
                room = 0 if self.parts[k] > 1 else room - self.size[k]
        self.count = last + 1

    def bounds(self, x: np.ndarray, angles: np.ndarray) -> np.ndarray:
        """The most that a row scores with a vector of each ring of its length."""
        at, pivot = self.own[x.shape[1]]
        angles = angles[:, pivot]
        apart = np.maximum(np.maximum(angles - self.high[at], self.low[at] - angles), 0)
        return _norms(x)[:, None] * self.norm[at] * np.cos(np.minimum(apart, np.pi / 2)) + NEAR

    def home(self, ids: np.ndarray, ring: np.ndarray) -> np.ndarray:
        """The block of vectors of a ring: one of its parts by id."""
        k = np.searchsorted(self.rings, ring)
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return self.first[k] + (h % self.parts[k].astype(np.uint64)).astype(np.int64)

    def spread(self, go: np.ndarray, d: int) -> np.ndarray:
        """Rows and blocks, as one number each, of a mask of rows and rings: all
        blocks of the rings."""
        rows, k = np.nonzero(go)
        k = self.own[d][0][k]
        n = self.parts[k]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.unique(np.repeat(rows, n) * self.count + np.repeat(self.first[k], n) + inside)


def _rows(n: int) -> int:
    """Rows of a block of ``n`` vectors of which all meet."""
    return min(BLOCK * WIDE, max(1, -(-n // SPREAD)))


def _by_length(b: pa.RecordBatch, of: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pivots' numbers, vectors and rows of each length that has pivots."""
    size = _lengths(b.column("vector"))
    for d in np.unique(size):
        if int(d) in of:
            at = np.flatnonzero(size == d)
            yield of[int(d)][0], _matrix(b.column("vector").take(pa.array(at))), at


_TILE = pa.struct([("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32())])
_TILES = "_t array<struct<i:long,j:long,side:int>>"


def _sent(b: pa.RecordBatch, row: np.ndarray, i: np.ndarray, j: np.ndarray, side: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """A batch's rows with the tiles that each goes to."""
    order = np.argsort(row, kind="stable")
    tiles = pa.StructArray.from_arrays([pa.array(i[order]), pa.array(j[order]), pa.array(side[order].astype(np.int32))], fields=list(_TILE))
    ends = np.searchsorted(row[order], np.arange(b.num_rows + 1))
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tiles)], [*columns, "_t"])


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _lengths(column) -> np.ndarray:
    return pc.list_value_length(column).to_numpy()


def _best(score: np.ndarray, needed: int, decimals: int) -> np.ndarray:
    """Columns of the best rounded scores of each row; ties go to the earlier."""
    n = score.shape[1]
    # scores as whole numbers, with the column below them, are all distinct
    key = np.rint(score * 10**decimals).astype(np.int64) * n + np.arange(n - 1, -1, -1)
    if needed < n:
        top = np.argpartition(key, n - needed, axis=1)[:, n - needed :]
        key = np.take_along_axis(key, top, 1)
        return np.take_along_axis(top, np.argsort(-key, axis=1), 1)
    return np.argsort(-key, axis=1)


def _same_length(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0))


def _hits(score: np.ndarray, order: np.ndarray, own, notes, needed: int, decimals: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns before ``order`` and scores of each row's best columns."""
    if own is not None:
        score[own.to_numpy()[:, None] == notes.to_numpy()[order][None, :]] = NEVER
    best = _best(score, needed, decimals)
    rows = np.repeat(np.arange(len(score)), best.shape[1])
    at, found = order[best.ravel()], np.take_along_axis(score, best, 1).ravel()
    good = np.flatnonzero(found >= (NEVER + 1 if least is None else least))
    return rows[good], at[good], found[good]


HITS = "query_id long, id long, note_id long, score double"
#: Queries that go to the items with the task instead of by an exchange.
FEW = 256


def _scored(queries: pa.Table, needed: int, decimals: int, apart: bool, least: float | None):
    """The best items of each batch for at most ``FEW`` queries."""
    queries = queries.combine_chunks()
    size = _lengths(queries["vector"]) if len(queries) else np.zeros(0, np.int64)
    known = {int(d): (q := queries.take(np.flatnonzero(size == d)), _matrix(q["vector"])) for d in np.unique(size)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, max([len(queries), *known])):
            t = pa.Table.from_batches([batch])
            lengths = _lengths(t["vector"])
            for d, (q, matrix) in known.items():
                b = t.take(np.flatnonzero(lengths == d))
                if not len(b):
                    continue
                order = np.argsort(b["id"].to_numpy(), kind="stable")
                score = np.round(matrix @ _matrix(b["vector"]).T, decimals)[:, order]
                rows, at, score = _hits(score, order, q["note_id"] if apart else None, b["note_id"], needed, decimals, least)
                yield from pa.table({"query_id": q["id"].take(rows), "id": b["id"].take(at), "note_id": b["note_id"].take(at), "score": score}).to_batches()

    return run


def _ranked(hits: DataFrame, needed: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= needed)


def top_k(queries: DataFrame, items: DataFrame, needed: int, decimals: int = 6, apart: bool = False, least: float | None = None) -> DataFrame:
    """(query_id, id, note_id, score, rank): the best ``needed`` items of each query.

    queries: id, vector; items: id, note_id, vector. Scores are inner products,
    rounded; ties go to the lower id. Vectors of other lengths do not match.
    apart: queries have a note_id, and items of that note do not count. Scores
    below ``least`` do not leave their block.
    """
    own = F.col("note_id") if apart else F.lit(None).cast("long").alias("note_id")
    queries, items = _same_length(queries.select("id", own, "vector")), _same_length(items.select("id", "note_id", "vector"))
    found = queries.limit(FEW + 1).toArrow()
    if len(found) <= FEW:
        return _ranked(items.mapInArrow(_scored(found, needed, decimals, apart, least), HITS), needed)
    nq, ni = queries.count(), items.count()
    kind = items.schema["vector"].dataType
    queries = queries.withColumn("vector", F.col("vector").cast(kind))
    # the angles with all pivots take as long as comparing so many queries
    pivots = Pivots.among(items, ni).blocks(items) if nq > 2 * min(PIVOTS, 1 + ni // EACH) else None
    # bounds of ranks take two passes of tiles, so they have to spare more
    if pivots is None or math.sqrt(reach := pivots.reach(ni, needed, least)) > MOSTLY or pivots.sent(reach) > SENT:
        return _ranked(_everything(queries, items, nq, ni, needed, decimals, apart, least), needed)
    asking = copy.copy(pivots).blocks(queries)
    first = held(_tiled(queries.withColumn("_least", F.lit(NEVER)), items, asking, pivots, needed, decimals, apart, least, True))
    reached = _ranked(first, needed).where(F.col("rank") == needed).select(F.col("query_id").alias("id"), F.col("score").alias("_least"))
    asked = queries.join(reached, "id", "left").withColumn("_least", F.coalesce("_least", F.lit(NEVER)))
    return _ranked(first.unionByName(_tiled(asked, items, asking, pivots, needed, decimals, apart, least, False)), needed)


def _tiled(queries: DataFrame, items: DataFrame, asking: Pivots, pivots: Pivots, needed: int, decimals: int, apart: bool, least: float | None, begin: bool) -> DataFrame:
    """Hits of queries, in blocks of theirs, in the blocks nearest to them
    (begin), or in all others in which they can reach ``_least``."""
    columns = ["id", "note_id", "vector"]
    width = max(pivots.width(), asking.width())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, width):
            row, i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            ids, floor = b.column("id").to_numpy(), b.column("_least").to_numpy()
            for own, x, at in _by_length(b, pivots.of):
                angles = pivots.angles(x)
                bound, d = pivots.bounds(x, angles), x.shape[1]
                if not bound.shape[1]:
                    continue
                near = np.zeros(bound.shape, bool)
                k = min(FIRST, bound.shape[1])
                np.put_along_axis(near, np.argpartition(-bound, k - 1, axis=1)[:, :k], True, 1)
                some = bound >= least if least is not None and least > 0 else np.ones(bound.shape, bool)
                pair = pivots.spread(near & some, d)
                if not begin:
                    reached = (bound >= floor[at][:, None]) | (floor[at][:, None] < 0)
                    pair = np.setdiff1d(pivots.spread(reached & some, d), pair, True)
                r, block = np.divmod(pair, pivots.count)
                row.append(at[r])
                i.append(asking.home(ids[at], pivots.ring(angles, own))[r])
                j.append(block)
            row, i, j = map(np.concatenate, (row, i, j))
            yield _sent(b, row, i, j, np.zeros(len(row), np.int64), columns)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, width):
            row, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own, x, at in _by_length(b, pivots.of):
                row.append(at)
                j.append(pivots.home(b.column("id").take(pa.array(at)).to_numpy(), pivots.ring(pivots.angles(x), own)))
            row, j = map(np.concatenate, (row, j))
            yield _sent(b, row, j, j, np.ones(len(row), np.int64), columns)

    kind = items.schema["vector"].dataType.simpleString()
    schema = f"id long, note_id long, vector {kind}, {_TILES}"
    tile = lambda rows: rows.select(*columns, F.explode("_t").alias("t")).select(*columns, F.col("t.i").alias("_i"), F.col("t.j").alias("_j"), "t.side")
    left = tile(queries.select(*columns, "_least").mapInArrow(ask, schema))
    tiles = held(left.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("_n")).select("_i", "_j"))
    right = tile(items.select(*columns).mapInArrow(offer, schema)).drop("_i").join(tiles, "_j").select(*left.columns)

    return left.unionByName(right).groupBy("_i", "_j").applyInArrow(_tile(needed, decimals, apart, least), HITS)


def _everything(queries: DataFrame, items: DataFrame, nq: int, ni: int, needed: int, decimals: int, apart: bool, least: float | None) -> DataFrame:
    """Hits of each block of queries in a part of the items; all of them meet."""
    i, j = -(-nq // _rows(nq)), -(-ni // _rows(ni))
    # hits leave a task once, so items are in few parts
    parts = max(1, -(-TASKS // max(1, i)), -(-j // STREAMED))
    columns = ["id", "note_id", "vector"]
    asked = fixed(packed(queries.select(*columns), _rows(nq)).repartition(max(1, i), "_k"))
    offered = fixed(packed(items.select(*columns).coalesce(parts), _rows(ni)))
    return met(offered, asked).mapInArrow(_streamed(needed, decimals, apart, least), HITS)


def _streamed(needed: int, decimals: int, apart: bool, least: float | None):
    """The best items for each query of some blocks, of all blocks of items that
    are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Leaders] = {}
        key, asked = None, None
        for b in batches:
            for k, j in enumerate(b.column("_j").to_pylist()):
                if j != key:
                    key, asked = j, unpacked(b.column("_b")[k])
                if j not in known:
                    known[j] = _Leaders(asked["id"].to_numpy(), needed, least)
                offered = unpacked(b.column("_a")[k])
                offered = offered.take(pa.array(np.argsort(offered["id"].to_numpy(), kind="stable"))).combine_chunks()
                size, sizes = _lengths(asked["vector"]), _lengths(offered["vector"])
                for d in np.intersect1d(size, sizes):
                    row, col = np.flatnonzero(size == d), np.flatnonzero(sizes == d)
                    x, y = _matrix(asked["vector"].take(pa.array(row))), _matrix(offered["vector"].take(pa.array(col)))
                    ids, notes = offered["id"].to_numpy()[col], offered["note_id"].to_numpy()[col]
                    own = asked["note_id"].to_numpy()[row] if apart else None
                    for first, r, at, score in _found(x, y, own, notes if apart else None, needed, decimals, known[j].floor[row]):
                        known[j].add(row[first + r], ids[at], notes[at], score)
                    known[j].cut()
        for leaders in known.values():
            yield from leaders.batches()

    return run


class _Leaders:
    """The best items so far of a block of queries."""

    def __init__(self, queries: np.ndarray, needed: int, least: float | None):
        self.queries, self.needed = queries, needed
        self.floor = np.full(len(queries), NEVER + 1 if least is None else least)
        empty = np.zeros(0, np.int64)
        self.hits = [(empty, empty, empty, np.zeros(0))]

    def add(self, row: np.ndarray, ids: np.ndarray, notes: np.ndarray, score: np.ndarray) -> None:
        if len(row):
            self.hits.append((row, ids, notes, score))

    def cut(self) -> None:
        """Drops what cannot be among the best any more."""
        if len(self.hits) == 1:
            return
        row, ids, notes, score = map(np.concatenate, zip(*self.hits, strict=True))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.needed - 1
        self.floor[row[last]] = score[order[last]]
        order, row = order[rank < self.needed], row[rank < self.needed]
        self.hits = [(row, ids[order], notes[order], score[order])]

    def batches(self) -> Iterator[pa.RecordBatch]:
        row, ids, notes, score = self.hits[0]
        table = pa.table({"query_id": self.queries[row], "id": ids, "note_id": notes, "score": score})
        yield from table.to_batches(max_chunksize=1 << 16)


def _tile(needed: int, decimals: int, apart: bool, least: float | None):
    """The best items of a tile for each of its queries."""

    def run(key, table):
        table = table.combine_chunks()
        side, size = table["side"].to_numpy(), _lengths(table["vector"])
        out = []
        for d in np.unique(size):
            a = table.take(np.flatnonzero((side == 0) & (size == d)))
            b = table.take(np.flatnonzero((side == 1) & (size == d)))
            if not len(a) or not len(b):
                continue
            order = np.argsort(b["id"].to_numpy(), kind="stable")
            x, y = _matrix(a["vector"]), _matrix(b["vector"])[order]
            for k, rows, at, score in _found(x, y, a["note_id"].to_numpy() if apart else None, b["note_id"].to_numpy()[order] if apart else None, needed, decimals, least):
                out.append(pa.table({"query_id": a["id"].take(k + rows), "id": b["id"].take(order[at]), "note_id": b["note_id"].take(order[at]), "score": score}))
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("note_id", pa.int64()), ("score", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return run


def _found(x: np.ndarray, y: np.ndarray, own: np.ndarray | None, notes: np.ndarray | None, needed: int, decimals: int, least: float | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows of ``x`` at a time: where they begin, and rows, columns and
    scores of their best vectors of ``y``; ties go to the earlier.

    All are compared in single precision first. How far that is off is bounded,
    so what can be among the best in double precision is known, and only that is
    scored so, if it is little. least: a score, or one for each row, that counts.
    """
    lowest = np.broadcast_to(np.asarray(NEVER + 1 if least is None else least, np.float64), len(x))
    norm, far = _norms(x), _norms(y).max()
    short = bool(norm.max() * far < 1e5 and max(norm.max(), far) < 1e15)
    x4, y4 = (x.astype(np.float32), y.astype(np.float32).T) if short else (x, y.T)
    step = _few(len(y))
    for k in range(0, len(x), step):
        some, masked = x[k : k + step], None if own is None else own[k : k + step, None] == notes[None, :]
        if short and needed < len(y):
            score = x4[k : k + step] @ y4
            if masked is not None:
                score[masked] = NEVER
            # the roundings of both sides of the comparison, and those to ``decimals``
            off = (norm[k : k + step] * far * (2 * (x.shape[1] + 4) * 2.0**-24) + 2 * 10.0**-decimals)[:, None]
            floor = lowest[k : k + step, None] - off
            over = score >= floor.astype(np.float32)
            if np.count_nonzero(over) > len(some) * needed:
                floor = np.maximum(floor, np.partition(score, len(y) - needed, axis=1)[:, len(y) - needed, None] - off)
                over = score >= floor.astype(np.float32)
            rows, at = np.nonzero(over)
            good = score[rows, at] > NEVER / 2
            rows, at = rows[good], at[good]
            if len(rows) * 16 <= score.size:
                value = np.concatenate([np.einsum("ij,ij->i", some[rows[m : m + _few(x.shape[1])]], y[at[m : m + _few(x.shape[1])]]) for m in range(0, len(rows), _few(x.shape[1]))] or [np.zeros(0)])
                value = np.round(value, decimals)
                order = np.lexsort((at, -value, rows))
                rows, at, value = rows[order], at[order], value[order]
                first = np.searchsorted(rows, rows)
                kept = (np.arange(len(rows)) - first < needed) & (value >= lowest[k + rows])
                yield k, rows[kept], at[kept], value[kept]
                continue
        score = np.round(some @ y.T, decimals)
        if masked is not None:
            score[masked] = NEVER
        best = _best(score, needed, decimals)
        rows = np.repeat(np.arange(len(score)), best.shape[1])
        at, value = best.ravel(), np.take_along_axis(score, best, 1).ravel()
        kept = value >= lowest[k + rows]
        yield k, rows[kept], at[kept], value[kept]


def oversample(top: int, excludes: bool, per_note: bool) -> int:
    """How many chunks are looked at before notes are excluded and merged."""
    needed = top + (1 if excludes else 0)
    return max(needed * 5, needed + 10) if per_note else needed


def per_note(hits: DataFrame, top: int, excluded: DataFrame | None = None) -> DataFrame:
    """The best chunk of each note among ``hits``, the best ``top`` of them.

    excluded: (query_id, note_id) that do not count.
    """
    if excluded is not None:
        hits = hits.join(excluded, ["query_id", "note_id"], "left_anti")
    best = F.row_number().over(W.partitionBy("query_id", "note_id").orderBy(F.desc("score"), "id"))
    kept = hits.withColumn("_k", best).where("_k = 1").drop("_k", "rank")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)


PAIRS = "a_id long, b_id long, score double"


def pairs_over(rows: DataFrame, least: float, decimals: int = 6, unlike: str | None = None) -> DataFrame:
    """(a_id, b_id, score) with a_id < b_id and rounded score >= ``least``; rows: id, vector.

    unlike: a column of texts; pairs that have the same there do not count,
    unless it is empty.
    """
    rows = _same_length(rows.select("id", "vector", F.col(unlike).alias("unlike") if unlike else F.lit("").alias("unlike")))
    tiles = _paired(rows, least)
    if tiles is None:
        return _all_pairs(rows, least, decimals)

    def run(key, table):
        table = table.combine_chunks()
        side, same = table["side"].to_numpy(), key[0].as_py() == key[1].as_py()
        a = table.filter(pa.array(side == 0))
        found = list(_over(a, a if same else table.filter(pa.array(side == 1)), same, least, decimals))
        return pa.concat_tables(found) if found else _PAIRS.empty_table()

    return tiles.groupBy("_i", "_j").applyInArrow(run, PAIRS)


_PAIRS = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64()), ("score", pa.float64())])


def _all_pairs(rows: DataFrame, least: float, decimals: int) -> DataFrame:
    """Pairs of which all are compared: blocks with themselves and with later ones."""
    n = rows.count()
    # a part of the blocks is kept by a task that reads another one
    parts = max(SPREAD, -(-n // (_rows(n) * KEPT)))
    blocks = fixed(packed(rows.coalesce(parts), _rows(n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (i, j) in enumerate(zip(b.column("_i").to_pylist(), b.column("_j").to_pylist(), strict=True)):
                left = unpacked(b.column("_a")[k])
                for found in _over(left, left if i == j else unpacked(b.column("_b")[k]), i == j, least, decimals):
                    yield from found.to_batches(max_chunksize=1 << 16)

    return met(blocks, blocks).where("_i <= _j").mapInArrow(run, PAIRS)


def _over(left: pa.Table, right: pa.Table, same: bool, least: float, decimals: int) -> Iterator[pa.Table]:
    """Pairs of two tables (id, vector, unlike), or of one with itself, over a score."""
    size, sizes = _lengths(left["vector"]), _lengths(right["vector"])
    for d in np.intersect1d(size, sizes):
        a, b = left.take(pa.array(np.flatnonzero(size == d))).combine_chunks(), right.take(pa.array(np.flatnonzero(sizes == d))).combine_chunks()
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        x, y, step = _matrix(a["vector"]), _matrix(b["vector"]).T, _few(len(b))
        for k in range(0, len(a), step):
            score = x[k : k + step] @ y
            # only what can pass is rounded
            good = score >= least - 10.0**-decimals
            if same:
                good &= ia[k : k + step, None] < ib[None, :]
            r, c = np.nonzero(good)
            score = np.round(score[r, c], decimals)
            over = np.flatnonzero(score >= least)
            r, c, score = k + r[over], c[over], score[over]
            text = a["unlike"].take(pa.array(r))
            apart = pc.or_(pc.not_equal(text, b["unlike"].take(pa.array(c))), pc.equal(text, "")).to_numpy()
            r, c, score = r[apart], c[apart], score[apart]
            if len(r):
                yield pa.table({"a_id": np.minimum(ia[r], ib[c]), "b_id": np.maximum(ia[r], ib[c]), "score": score})


def _paired(rows: DataFrame, least: float) -> DataFrame | None:
    """Vectors (id, vector, unlike) with the pairs of blocks (_i, _j, side) in
    which they can have a pair of that score: their own block with each block
    near enough. None if all had better meet."""
    n = rows.count()
    pivots = Pivots.among(rows, n).blocks(rows)
    if least <= 0 or (reach := pivots.reach(n, least=least)) > MOSTLY or pivots.sent(reach) > SENT:
        return None
    width = pivots.width()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, width):
            row, i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            ids = b.column("id").to_numpy()
            for own, x, at in _by_length(b, pivots.of):
                angles = pivots.angles(x)
                home = pivots.home(ids[at], pivots.ring(angles, own))
                go = pivots.bounds(x, angles) >= least if least > 0 else np.ones((len(x), len(pivots.own[x.shape[1]][0])), bool)
                r, block = np.divmod(pivots.spread(go, x.shape[1]), pivots.count)
                row.append(at[r])
                i.append(home[r])
                j.append(block)
            row, i, j = map(np.concatenate, (row, i, j))
            yield _sent(b, row, np.minimum(i, j), np.maximum(i, j), (i > j).astype(np.int64), columns)

    columns = ["id", "vector", "unlike"]
    kind = rows.schema["vector"].dataType.simpleString()
    sent = rows.mapInArrow(run, f"id long, vector {kind}, unlike string, {_TILES}")
    return sent.select(*columns, F.explode("_t").alias("t")).select(*columns, F.col("t.i").alias("_i"), F.col("t.j").alias("_j"), "t.side")


def compared(rows: DataFrame, least: float) -> float:
    """The share of all pairs of vectors that ``pairs_over`` compares."""
    rows = _same_length(rows.select("id", "vector", F.lit("").alias("unlike")))
    n, tiles = rows.count(), _paired(rows, least)
    if tiles is None:
        return 1.0
    sides = tiles.groupBy("_i", "_j").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    same = F.col("_i") == F.col("_j")
    done = sides.agg(F.sum(F.when(same, F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b"))).alias("n")).first().n or 0
    return done / max(1, n * (n - 1) // 2)


def connect(chunks: DataFrame, top: int = 12, least: float = 0.7, keep: int = 3) -> DataFrame:
    """For each note, by its first chunk, the ``keep`` nearest other notes over ``least``.

    chunks: id, note_id, vector.
    """
    from folioscope.operators.catalog import first_chunks

    first = first_chunks(chunks)
    hits = top_k(first.select(F.col("note_id").alias("id"), "vector"), chunks, oversample(top, True, True), least=least)
    own = first.select(F.col("note_id").alias("query_id"), "note_id")
    near = per_note(hits, top, own).where(F.col("score") > least)
    return near.where(F.col("rank") <= keep).select(F.col("query_id").alias("src"), F.col("note_id").alias("dst"), "score", "rank")


def near_duplicate_notes(pooled: DataFrame, notes: DataFrame, least: float = 0.9, limit: int | None = 30) -> DataFrame:
    """Pairs of notes with near vectors and different content; pooled: id, vector."""
    # the hash goes with the vector: pairs can be far more than notes
    h = notes.select("id", F.coalesce("content_hash", F.lit("")).alias("h"))
    out = pairs_over(pooled.join(h, "id"), least, unlike="h").orderBy(F.desc("score"), "a_id", "b_id")
    return out.limit(limit) if limit else out


def suggested_edges(pooled: DataFrame, items: DataFrame, top: int = 3, least: float = 0.7) -> DataFrame:
    """Directed edges from each note to its nearest others; pooled: id, vector."""
    hits = top_k(pooled, items, oversample(top, True, True), least=least)
    own = pooled.select(F.col("id").alias("query_id"), F.col("id").alias("note_id"))
    near = per_note(hits, top, own).where(F.col("score") >= least)
    return near.select(F.col("query_id").alias("src"), F.col("note_id").alias("dst"), "score")


def claim_pairs(claims: DataFrame, seen: DataFrame | None = None, least: float = 0.55, top: int = 5, focus: DataFrame | None = None) -> DataFrame:
    """Unordered pairs of near claims of different notes, without those seen.

    claims: id, note_id, vector; each claim proposes its ``top`` nearest.
    """
    asked = claims if focus is None else claims.join(focus, "id", "left_semi")
    near = top_k(asked, claims, top, apart=True, least=least)
    out = near.select(F.least("query_id", "id").alias("a_id"), F.greatest("query_id", "id").alias("b_id"), "score").distinct()
    if seen is not None:
        s = seen.select(F.least("claim_a_id", "claim_b_id").alias("a_id"), F.greatest("claim_a_id", "claim_b_id").alias("b_id"))
        out = out.join(s, ["a_id", "b_id"], "left_anti")
    return out

"""A stored nearest-neighbour index: inverted lists of product-quantised codes.

Vectors go to the list of their nearest centre, and what is left after the
centre is kept as ``PARTS`` bytes, each the number of the nearest entry of a
codebook. A question looks into the lists of its ``probes`` nearest centres,
ranks what is there by its codes, and compares the best exactly with their
vectors. Centres and codebooks are fitted on a sample of at most ``SAMPLE``
vectors; every vector is indexed. Results are those of ``similar.top_k``, the
exact way, but for neighbours in lists that are not looked into.

The index is a table of the commit log, so that vectors are added, replaced and
removed by deltas. It holds vectors of one length; others are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.similar import BLOCK, _matrix
from folioscope.operators.store import Snapshots, held

#: Vectors that centres are fitted on, most lists, bytes of a code and entries of a byte.
SAMPLE, LISTS, PARTS, ENTRIES = 20_000, 1024, 16, 256
#: Rounds of fitting, lists looked into, and candidates compared exactly for one result.
ROUNDS, PROBES, EXACT = 8, 16, 10
#: Of the sample, how many ask for how many neighbours, and the share to be found.
ASKING, NEIGHBOURS, RECALL = 128, 10, 0.95
ROWS = "list int, id long, note_id long, code binary, vector array<float>"
FOUND = "query_id long, id long, note_id long, near double"


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def _fitted(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of rows by Lloyd's rounds; those that lose all rows stay."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


class Codes:
    """Centres and codebooks of vectors of one length."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books
        self.dim = centres.shape[1]
        self.look, self.exact = PROBES, EXACT

    @classmethod
    def fit(cls, x: np.ndarray, n: int) -> Codes:
        centres = _fitted(x, min(LISTS, max(1, math.isqrt(n))), 1)
        rest = cls._cut(x - centres[_nearest(x, centres)])
        return cls(centres, np.stack([_padded(_fitted(rest[:, p], ENTRIES, 2 + p)) for p in range(PARTS)]))

    @staticmethod
    def _cut(x: np.ndarray) -> np.ndarray:
        width = -(-x.shape[1] // PARTS)
        out = np.zeros((len(x), PARTS * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), PARTS, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.centres)
        rest = self._cut(x - self.centres[at])
        return at, np.stack([_nearest(rest[:, p], self.books[p]) for p in range(PARTS)], axis=1).astype(np.uint8)

    def needed(self, x: np.ndarray, n: int) -> tuple[int, int]:
        """Lists to look into and candidates to compare for one result, so that
        some rows of a sample of ``n`` find their neighbours in it."""
        q = x[:: -(-len(x) // ASKING)]
        near = q @ x.T
        near[np.arange(len(q)), np.arange(0, len(x), -(-len(x) // ASKING))] = -np.inf
        k = min(NEIGHBOURS, len(x) - 1)
        if k < 1:
            return PROBES, EXACT
        want = np.argpartition(-near, k - 1, axis=1)[:, :k]
        at, code = self.encode(x)
        lists = np.argsort(self.probes(q, len(self.centres)), axis=1)
        part = np.einsum("qpw,pew->pqe", self._cut(q), self.books)
        score = (q @ self.centres.T)[:, at] + sum(part[p][:, code[:, p]] for p in range(PARTS))
        place = np.argsort(np.argsort(-score, axis=1), axis=1)
        # the places of a sample are further apart in the table
        place, lists = np.take_along_axis(place, want, 1) * (n / len(x)), np.take_along_axis(lists, at[want], 1)
        probes = PROBES
        while True:
            for exact in (EXACT, 2 * EXACT, 4 * EXACT, 8 * EXACT):
                if ((lists < probes) & (place < exact * k)).mean() >= RECALL:
                    return probes, exact
            if probes >= len(self.centres):
                return probes, exact
            probes *= 2

    def probes(self, q: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :many]

    def scores(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """About the inner products of questions with the codes of a list."""
        part = np.einsum("qpw,pew->pqe", self._cut(q), self.books)
        return (q @ self.centres[at])[:, None] + sum(part[p][:, codes[:, p]] for p in range(PARTS))


def _padded(c: np.ndarray) -> np.ndarray:
    """Always ``ENTRIES`` rows, the last repeated."""
    return np.concatenate((c, np.repeat(c[-1:], ENTRIES - len(c), axis=0)))


class NearIndex:
    def __init__(self, tables: Snapshots, name: str = "near"):
        self.tables, self.name = tables, name

    def _codes(self) -> Codes | None:
        if not self.tables.version(f"{self.name}-books"):
            return None
        r = self.tables.current(f"{self.name}-books").first()
        codes = Codes(np.frombuffer(r.centres).reshape(-1, r.dim), np.frombuffer(r.books).reshape(PARTS, ENTRIES, -1))
        codes.look, codes.exact = r.probes, r.exact
        return codes

    def fit(self, chunks: DataFrame) -> None:
        """Fit to the commonest length of the vectors and start with an empty index."""
        some = chunks.where("vector IS NOT NULL AND size(vector) > 0")
        length = some.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        if length is None:
            return
        rows = some.where(F.size("vector") == length.d).select("vector", F.xxhash64("id").alias("_h")).orderBy("_h").limit(SAMPLE).select("vector").toArrow()
        codes = Codes.fit(_matrix(rows["vector"]), length.n)
        spark = self.tables.spark
        probes, exact = codes.needed(_matrix(rows["vector"]).astype(np.float64), length.n)
        books = spark.createDataFrame([(length.d, bytearray(codes.centres.tobytes()), bytearray(codes.books.tobytes()), probes, exact)], "dim int, centres binary, books binary, probes int, exact int")
        self.tables.replace(f"{self.name}-books", books, self.tables.version(f"{self.name}-books"))
        self.tables.replace(self.name, spark.createDataFrame([], ROWS), self.tables.version(self.name))

    def add(self, chunks: DataFrame) -> int:
        """Add or replace vectors (id, note_id, vector); returns how many were
        rejected because of their length."""
        codes = self._codes()
        if codes is None:
            self.fit(chunks)
            codes = self._codes()
        own = chunks.where("vector IS NOT NULL").select("id", "note_id", F.col("vector").cast("array<float>").alias("vector"))
        if codes is None:
            return own.count()
        fits = F.size("vector") == codes.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    at, code = codes.encode(_matrix(b.column("vector")))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("id"), b.column("note_id"), pa.array([c.tobytes() for c in code], pa.binary()), b.column("vector")], ["list", "id", "note_id", "code", "vector"])

        # a row of another length takes an earlier one out
        self.tables.merge(self.name, own.where(fits).mapInArrow(run, ROWS).repartitionByRange("list").sortWithinPartitions("list"), ["id"], gone=own.where(~fits))
        return own.where(~fits).count()

    def remove(self, ids: DataFrame) -> None:
        self.tables.merge(self.name, None, ["id"], gone=ids.select("id"))

    def backfill(self, chunks: DataFrame) -> int:
        """Bring the index to a table of chunks: what is missing or has another
        vector is added, what is not there is removed; returns how many were
        rejected."""
        if self._codes() is None:
            return self.add(chunks)
        have = self.rows().select("id", F.col("vector").alias("_v"))
        now = chunks.where("vector IS NOT NULL").select("id", "note_id", F.col("vector").cast("array<float>").alias("vector"))
        self.remove(have.join(now, "id", "left_anti"))
        return self.add(now.join(have, "id", "left").where("_v IS NULL OR _v <> vector").select("id", "note_id", "vector"))

    def rows(self) -> DataFrame:
        found = self.tables.current(self.name)
        return self.tables.spark.createDataFrame([], ROWS) if found is None else found

    def available(self) -> bool:
        return self._codes() is not None and self.rows().limit(1).count() > 0

    def search(self, queries: DataFrame, top: int = 10, probes: int | None = None, decimals: int = 6) -> DataFrame:
        """(query_id, id, note_id, score, rank) for queries (id, vector); those
        of another length find nothing. probes: lists to look into, or None for
        as many as the sample needed."""
        codes, spark = self._codes(), self.tables.spark
        if codes is None:
            return spark.createDataFrame([], "query_id long, id long, note_id long, score double, rank int")
        probes, keep = probes or codes.look, codes.exact * top
        rows = self.rows()
        # a row a list; a long list has several parts
        sizes = {r.list: -(-r.n // BLOCK) for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        asked = held(queries.where(F.size("vector") == codes.dim).select("id", F.col("vector").cast("array<double>").alias("vector")))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                at = codes.probes(_matrix(b.column("vector")), probes)
                to = [[(int(k), p) for k in row for p in range(sizes.get(int(k), 0))] for row in at]
                flat = pa.StructArray.from_arrays([pa.array([x for r in to for x, _ in r], pa.int32()), pa.array([x for r in to for _, x in r], pa.int32())], ["list", "part"])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, to)]), pa.int32()), flat)], ["id", "vector", "to"])

        def best(key: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
            if not len(q) or not len(x):
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "note_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
            code = np.frombuffer(b"".join(x["code"].to_pylist()), np.uint8).reshape(len(x), PARTS)
            score = codes.scores(_matrix(q["vector"]), key[0].as_py(), code)
            n = min(keep, len(x))
            at = np.argpartition(-score, n - 1, axis=1)[:, :n].ravel()
            r = np.repeat(np.arange(len(q)), n)
            return pa.table({"query_id": q["id"].take(pa.array(r)), "id": x["id"].take(pa.array(at)), "note_id": x["note_id"].take(pa.array(at)), "near": score[r, at]})

        sent = asked.mapInArrow(ask, "id long, vector array<double>, to array<struct<list:int,part:int>>").select("id", "vector", F.explode("to").alias("t")).select("t.list", "t.part", "id", "vector")
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv]), F.col("list")), F.lit(1)) if sizes else F.lit(1)
        kept = rows.select("list", F.pmod(F.xxhash64("id"), many).cast("int").alias("part"), "id", "note_id", "code")
        found = sent.groupBy("list", "part").cogroup(kept.groupBy("list", "part")).applyInArrow(best, FOUND)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "id"))
        some = found.withColumn("_k", rank).where(F.col("_k") <= keep).select("query_id", "id", "note_id")
        exact = some.join(rows.select("id", "vector"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("_q")), "query_id")
        dot = F.aggregate(F.zip_with("_q", "vector", lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
        scored = exact.select("query_id", "id", "note_id", F.round(dot, decimals).alias("score"))
        return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)

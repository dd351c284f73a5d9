"""Product codes of vectors by Lloyd's rounds with Elkan's bounds.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each
part position has a codebook of ``ENTRIES`` entries, which starts as those parts
of the vectors of smallest ids. A round assigns every part to its nearest entry
and replaces every entry by the mean of its parts, rounded down.

Between rounds each vector keeps, for every part, an upper bound of the distance
to its entry and one lower bound of the distance to each entry. When entries
move, the bounds are shifted by as much. An entry is ruled out only where the
triangle inequality says that it is strictly farther: the upper bound is below
its lower bound, or below half of the distance between the two entries. What is
left is compared by exact integer distances, ties to the lower index, so codes
are those of comparing everything. Bounds are rounded outwards to 32 bits.

A round is one pass over the table of the round before, which lies in the shared
folder with its bounds: a task writes its vectors' next state and one row of sums
of its parts by entry, so nothing but these sums is exchanged. Codebooks are
``PARTS * ENTRIES`` entries of the vectors' dimension, the size of 16 vectors,
and are all that is on the driver.

Cases: vectors that are null or hold null or non-finite components are dropped;
vectors of other dimensions than the longest, or of one that cannot be cut
evenly, are filled up with zeros; integers are held to 2**62 either way and
errors to 2**63 - 1; fewer ids than entries make smaller codebooks; of repeated
ids the least vector is the start, and every row is a vector of its own; rows
of null id come last among starts; null labels are one label; equal distances
go to the lower entry; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.bytesets import parts as small
from folioscope.llm.common import discard, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers are held to this, errors to ``LONGEST``.
FARTHEST = 1 << 62
LONGEST = (1 << 63) - 1
#: Components that numpy works on at once.
AT_ONCE = 1 << 20
#: Relative room for the rounding of square roots and sums in double precision.
ROOM = 1e-9


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to an entry, or to a row each; in integers
    of any length where 64 bits might not do."""
    top = max((abs(int(y)) for a in (x, c) if a.size for y in (a.min(), a.max())), default=0)
    if 4 * top * top * max(x.shape[1], 1) > LONGEST:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=1) if x.shape[1] else np.zeros(len(x), np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + ROOM)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - ROOM)).astype(np.float32), np.float32(0)), 0)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Books:
    """The codebooks of a round, (part, entry, position), and how far their
    entries are from each other and have moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        n = entries.shape[1]
        self.half = np.stack([np.stack([_down(_root(_squared(p, p[j])) / 2) for j in range(n)], axis=1) for p in entries])
        self.moved = None if before is None else np.stack([_up(_root(_squared(p, q))) for p, q in zip(entries, before, strict=True)])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes, upper and lower bounds of vectors (row, part, position) that have none."""
        rows, n = len(x), self.entries.shape[1]
        codes = np.zeros((rows, len(self.entries)), np.uint8)
        upper, lower = np.zeros(codes.shape, np.float32), np.zeros((*codes.shape, n), np.float32)
        for p, book in enumerate(self.entries):
            d = np.stack([_squared(x[:, p], c) for c in book], axis=1)
            codes[:, p] = d.argmin(axis=1)
            upper[:, p] = _up(_root(d[np.arange(rows), codes[:, p]]))
            lower[:, p] = _down(_root(d))
        return codes, upper, lower, codes.size * n

    def shifted(self, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after entries have moved, and how many distances it took."""
        codes, upper, lower, taken = codes.copy(), upper.copy(), lower.copy(), 0
        for p, book in enumerate(self.entries):
            code = codes[:, p].astype(np.int64)
            u = _up(upper[:, p].astype(np.float64) + self.moved[p][code])
            low = _down(np.maximum(lower[:, p].astype(np.float64) - self.moved[p], 0))
            unsure = ~((u[:, None] < low) | (u[:, None] < self.half[p][code]))
            unsure[np.arange(len(x)), code] = False
            rows = np.flatnonzero(unsure.any(axis=1))
            # the bound of the own entry becomes its distance before others are looked at
            y, mine = x[rows, p], code[rows]
            best = _squared(y, book[mine])
            near, far = _up(_root(best)), low[rows]
            far[np.arange(len(rows)), mine] = _down(_root(best))
            taken += len(rows)
            for j in range(len(book)):
                k = np.flatnonzero(unsure[rows, j] & (mine != j) & ~((near < far[:, j]) | (near < self.half[p][mine, j])))
                if not len(k):
                    continue
                d = _squared(y[k], book[j])
                taken += len(k)
                far[k, j] = _down(_root(d))
                won = np.asarray((d < best[k]) | ((d == best[k]) & (j < mine[k])), bool)
                k, d = k[won], d[won]
                if best.dtype != d.dtype:
                    best = best.astype(object)
                best[k], mine[k], near[k] = d, j, _up(_root(d))
            low[rows], u[rows], code[rows] = far, near, mine
            codes[:, p], upper[:, p], lower[:, p] = code, u, low
        return codes, upper, lower, taken

    def errors(self, x: np.ndarray, codes: np.ndarray) -> list[int]:
        total = np.zeros(len(x), object)
        for p, book in enumerate(self.entries):
            total = total + _squared(x[:, p], book[codes[:, p]]).astype(object)
        return [min(int(e), LONGEST) for e in total]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integers(x: np.ndarray) -> np.ndarray:
    y = np.floor(np.clip(x * float(SCALE), -float(FARTHEST), float(FARTHEST)))
    return y.astype(np.int64)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles as integers (row, part, position), filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), PARTS * width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return integers(out).reshape(len(column), PARTS, width)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    x = np.ascontiguousarray(x).reshape(len(x), -1)
    size = x.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(x)])


def _unpacked(column: pa.Array, dtype, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


class _Sums:
    """Sums and counts of a task's parts by entry."""

    def __init__(self, entries: int, width: int):
        self.sums = np.zeros((PARTS, entries, width), object)
        self.counts = np.zeros((PARTS, entries), np.int64)
        self.taken = 0

    def add(self, x: np.ndarray, codes: np.ndarray) -> None:
        exact = x.astype(object) if x.size and int(np.abs(x).max()) > LONGEST // max(len(x), 1) else x
        for p in range(PARTS):
            order = np.argsort(codes[:, p], kind="stable")
            found, at, n = np.unique(codes[order, p], return_index=True, return_counts=True)
            if len(found):
                self.counts[p, found] += n
                self.sums[p, found] += np.add.reduceat(exact[order, p], at, axis=0).astype(object)

    def slots(self) -> dict[int, int]:
        """Counts and sums by number: the count of an entry, then its components;
        last, the number of distances taken."""
        flat = np.concatenate((self.counts[..., None].astype(object), self.sums), axis=2).reshape(-1)
        return {k: int(v) for k, v in enumerate([*flat, self.taken]) if v}


def _state_schema(label: T.DataType, vec_id: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("vec_id", vec_id), T.StructField("label", label), T.StructField("x", T.BinaryType()), T.StructField("codes", T.BinaryType()),
        T.StructField("upper", T.BinaryType()), T.StructField("lower", T.BinaryType()), T.StructField("slots", T.ArrayType(T.IntegerType())),
        T.StructField("sums", T.ArrayType(T.DecimalType(38, 0))),
    ])


def _round(books: Books, width: int):
    """One pass: next codes and bounds of every vector, and the task's sums."""
    n = books.entries.shape[1]
    names = ["vec_id", "label", "x", "codes", "upper", "lower", "slots", "sums"]
    tail = [pa.list_(pa.int32()), pa.list_(pa.decimal128(38, 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = _Sums(n, width), None
        for b in small(batches, max(1, AT_ONCE // (PARTS * max(width, 1)))):
            if not b.num_rows:
                continue
            if "x" in b.schema.names:
                x = _unpacked(b.column("x"), np.int64, (PARTS, width))
                held = (_unpacked(b.column("codes"), np.uint8, (PARTS,)), _unpacked(b.column("upper"), np.float32, (PARTS,)), _unpacked(b.column("lower"), np.float32, (PARTS, n)))
                codes, upper, lower, taken = books.shifted(x, *held)
            else:
                x = _vectors(b.column("embedding"), width)
                codes, upper, lower, taken = books.first(x)
            sums.add(x, codes)
            sums.taken += taken
            types = [b.column("vec_id").type, b.column("label").type, *[pa.binary()] * 4, *tail]
            made = [_packed(x), _packed(codes), _packed(upper), _packed(lower), *(pa.nulls(b.num_rows, t) for t in tail)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *made], names)
        if types:
            slots = sums.slots()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:6]), pa.array([list(slots)], tail[0]), pa.array([[Decimal(v) for v in slots.values()]], tail[1])], names)

    return run


def _scored(books: Books, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, max(1, AT_ONCE // (PARTS * max(width, 1)))):
            x, codes = _unpacked(b.column("x"), np.int64, (PARTS, width)), _unpacked(b.column("codes"), np.uint8, (PARTS,))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array([c.hex() for c in b.column("codes").to_pylist()], pa.string()), pa.array(books.errors(x, codes), pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    return run


def _starts(kept: DataFrame, width: int) -> np.ndarray:
    """The integer vectors of the smallest ids, at most ``ENTRIES``."""
    first = kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()
    ids = [r.vec_id for r in first]
    mine = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    found = {r.vec_id: r.v for r in kept.where(mine).groupBy("vec_id").agg(F.min("embedding").alias("v")).collect()}
    out = np.zeros((len(ids), PARTS * width))
    for k, i in enumerate(ids):
        out[k, : len(found[i])] = found[i]
    return integers(out).reshape(len(ids), PARTS, width).transpose(1, 0, 2)


def _next(books: Books, totals: dict[int, int]) -> np.ndarray:
    """Entries replaced by their parts' mean, rounded down; unused ones stay."""
    parts, n, width = books.entries.shape
    out = books.entries.copy()
    for k in range(parts * n):
        count = totals.get(k * (width + 1), 0)
        if count:
            out[k // n, k % n] = [totals.get(k * (width + 1) + 1 + i, 0) // count for i in range(width)]
    return out


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, Books | None, list[int]]:
    """(vec_id, label, code, error) of every kept vector, the final codebooks,
    and the number of distances that each pass took."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None, None, []
    width = -(-longest // PARTS)
    books = Books(_starts(kept, width))
    schema = _state_schema(kept.schema["label"].dataType, kept.schema["vec_id"].dataType)
    table, state, taken, last = kept, kept, [], books.entries.shape[1] * PARTS * (width + 1)
    for _ in range(rounds + 1):
        before, table = table, written(state.mapInArrow(_round(books, width), schema), compression="zstd")
        discard(before)
        # at most one row a component of the codebooks
        sums = table.where("slots is not null").select(F.explode(F.arrays_zip("slots", "sums")).alias("s")).groupBy("s.slots").agg(F.sum("s.sums").alias("n"))
        totals = {r.slots: int(r.n) for r in sums.collect()}
        taken.append(totals.get(last, 0))
        state = table.where("slots is null")
        if len(taken) <= rounds:
            books = Books(_next(books, totals), books.entries)
    types = T.StructType([schema["vec_id"], schema["label"]]).add("code", "string").add("error", "long")
    scored = state.select("vec_id", "label", "x", "codes").mapInArrow(_scored(books, width), types)
    return scored, books, taken


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row a kept vector: its code, error, the error of its label, and a
    digest of the codebooks."""
    scored, books, _ = encode(vectors, rounds)
    if scored is None:
        none = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType)]).add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string")
        return vectors.sparkSession.createDataFrame([], none)
    rows = written(scored.select("vec_id", "code", "error", F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = rows.groupBy("_none", "_label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("_n"))
    out = spread_join(rows, by_label.drop("_n"), ["_none", "_label"], F.crc32(F.col("code").cast("binary")), by_label)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry, for distinct ids and
    one dimension that can be cut evenly."""
    floor = "(s - ((s % n) + n) % n) // n"
    squared = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min((d, e)) AS best FROM (SELECT vec_id, p, v, e, {squared} AS d FROM parts JOIN b{r} USING (p)) GROUP BY vec_id, p)")
        if r < rounds:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT p, e, list({floor} ORDER BY i) AS c FROM (
                SELECT p, e, i, sum(y)::HUGEINT AS s, count(*) AS n FROM (SELECT p, best[2] AS e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e)""")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c)::BIGINT[] AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))")
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    starts AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, q FROM (SELECT * FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
    parts AS MATERIALIZED (SELECT vec_id, p, list_slice(q, p * len(q) // {PARTS} + 1, (p + 1) * len(q) // {PARTS}) AS v FROM (SELECT vec_id, q, unnest(range({PARTS})) AS p FROM kept)),
    b0 AS MATERIALIZED (SELECT p, e, list_slice(q, p * len(q) // {PARTS} + 1, (p + 1) * len(q) // {PARTS}) AS c FROM (SELECT e, q, unnest(range({PARTS})) AS p FROM starts)),
    {", ".join(steps)},
    coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
    labelled AS (SELECT kept.label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY kept.label),
    book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id) JOIN labelled ON labelled.label IS NOT DISTINCT FROM kept.label, book"""

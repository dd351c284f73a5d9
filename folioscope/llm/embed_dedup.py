"""Near-duplicate vectors by spherical-cap filters.

A vector is rotated at random and cut into two blocks. Each block has a code of
random unit vectors; a filter is one code word of each, so a few words make
very many directions, and the list decoder finds all filters whose cap holds a
vector (inner product of at least ``alpha``) from the sorted scores of one
block and what they leave for the other. ``CODES`` independent rotations and
codes even out how many filters a vector gets. Similar vectors fall into the caps of common filters. Vectors meet
by filter, and all pairs in a cap are verified in double precision; a pair
that shares several filters counts in the smallest.

``alpha`` follows from the number of vectors, so that unrelated ones are few in
a cap at any size, and the number of filters from the wanted recall of pairs at
the threshold. Equal vectors collapse first.

What goes to the caps are ids, the filters and a sketch of ``SIGNS`` signs of
random projections, not vectors. In a cap, pairs whose sketches differ in more
than ``APART`` signs are ruled out (a pair at the threshold does so with
probability below 1e-8), and so are pairs that share an earlier filter. Only
members that still have a partner in the cap are sent there with their vectors
and verified. Small caps are handled together in cells of bounded size; large
ones are cut into tiles, and the rows of a very large cap are dealt to several
tasks wherever they meet. Tiles send counts and the local components of their
links, not pairs.

Cases: null vectors, zero vectors and those with null or non-finite components
link with nothing; vectors link within one dimension; equal vectors are copies
that link with each other; repeated rows of an id are vectors of their own in
counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, spread_join, written
from folioscope.llm.minhash import components

COSINE = 0.95
CODES, BLOCKS = 8, 2
#: Unrelated vectors expected in a cap, and the chance to miss a pair at the
#: threshold if filters were independent; measured, it is below 1 %.
CROWD, MISS = 4.0, 1e-10
#: Signs of a sketch, and those in which a pair at the threshold may differ:
#: 256 * acos(0.95) / pi = 25.9 are expected with deviation 4.8.
SIGNS, APART = 256, 56
#: Vectors in one side of a tile, rows in a cell of small caps, and members of a
#: cap whose pairs are listed.
TILE, CELL, FEW = 1024, 20_000, 64
SEED = 5
#: Dimensions up to which a rotation is a dense matrix.
DENSE = 512


def _grid(d: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.linspace(-1, 1, 20_001)
    p = np.maximum(1 - t * t, 0) ** ((d - 3) / 2)
    return t, p / p.sum()


def tail(alpha: float, d: int) -> float:
    """Share of directions with inner product of at least alpha with a vector."""
    t, p = _grid(d)
    return float(p[t >= alpha].sum())


def joint(alpha: float, d: int, cosine: float) -> float:
    """Share of a vector's filters that a vector at the cosine has, too."""
    t, p = _grid(d)
    u, q = _grid(d - 1)
    above = np.append(q[::-1].cumsum()[::-1], 0)
    s, w = t[t >= alpha], p[t >= alpha]
    need = (alpha - cosine * s) / (np.sqrt(1 - cosine**2) * np.sqrt(np.maximum(1 - s * s, 1e-12)))
    return float((w * above[np.searchsorted(u, need)]).sum() / w.sum())


class Code:
    """Filters for vectors of dimension d among n of them."""

    def __init__(self, d: int, n: int, cosine: float):
        self.d, self.width = d, max(16, -(-d // BLOCKS) * BLOCKS) if d <= DENSE else 1 << (d - 1).bit_length()
        share = min(0.02, CROWD / max(n, 1))
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if tail(mid, self.width) > share else (low, mid)
        self.alpha = low
        per_vector = np.log(MISS) / np.log1p(-joint(self.alpha, self.width, cosine))
        self.words = max(2, int(np.ceil((per_vector / tail(self.alpha, self.width) / CODES) ** (1 / BLOCKS))))
        r = np.random.default_rng(SEED)
        half = self.width // BLOCKS
        if d <= DENSE:
            self.rotations = [np.linalg.qr(r.standard_normal((self.width, self.width)))[0] for _ in range(CODES)]
        else:
            self.rotations = [np.sign(r.standard_normal((3, self.width))) for _ in range(CODES)]
        c = r.standard_normal((CODES, BLOCKS, self.words, half))
        self.codes = c / np.linalg.norm(c, axis=3, keepdims=True) / np.sqrt(BLOCKS)

    def rotated(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows under the k-th random rotation: a matrix, or for wide vectors
        random signs and Hadamard transforms in turn."""
        if self.d <= DENSE:
            return x @ self.rotations[k]
        for signs in self.rotations[k]:
            x = x * signs
            n = 1
            while n < self.width:
                x = x.reshape(len(x), -1, 2, n)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), self.width)
                n *= 2
            x = x / np.sqrt(self.width)
        return x

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters of each row of unit vectors, ascending."""
        n, w, half = len(unit), self.words, self.width // BLOCKS
        x = np.zeros((n, self.width))
        x[:, : self.d] = unit
        found: list[list[np.ndarray]] = [[] for _ in range(n)]
        for k in range(CODES):
            y = self.rotated(x, k)
            left, right = y[:, :half] @ self.codes[k, 0].T, y[:, half:] @ self.codes[k, 1].T
            order = np.argsort(-right, axis=1)
            for i in range(n):
                r = right[i, order[i]]
                good = np.flatnonzero(left[i] + r[0] >= self.alpha)
                if not len(good):
                    continue
                number = np.searchsorted(-r, left[i, good] - self.alpha, side="right")
                second = order[i][np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)]
                found[i].append(np.sort((k * w + np.repeat(good, number)) * w + second))
        return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def numbers(c: Code) -> np.dtype:
    """The type that holds the numbers of a code's filters."""
    return np.dtype("<u4" if CODES * c.words**BLOCKS < 1 << 32 else "<i8")


@functools.cache
def projections(d: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((d, SIGNS)).astype(np.float32)


def sketches(unit: np.ndarray) -> list[bytes]:
    """The signs of each row of unit vectors."""
    return [x.tobytes() for x in np.packbits(unit.astype(np.float32) @ projections(unit.shape[1]) > 0, axis=1)]


@functools.cache
def code(d: int, n: int, cosine: float) -> Code:
    return Code(d, n, cosine)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims, keys, data = [], [], []
        for v in b.column("embedding"):
            x = np.array(v.as_py() if v.as_py() is not None else [], dtype=np.float64) if None not in (v.as_py() or []) else np.zeros(0)
            top = np.abs(x).max() if x.size else 0.0
            if x.size and np.isfinite(top) and top > 0:
                raw = (x + 0.0).tobytes()
                dims.append(len(x))
                keys.append(xxhash.xxh3_128_digest(raw))
                data.append(raw if (x.astype(np.float32) != x).any() else x.astype(np.float32).tobytes())
            else:
                dims.append(0)
                keys.append(None)
                data.append(None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "dim", "key", "data"])


def _units(data: list[bytes], d: int) -> np.ndarray:
    x = np.array([np.frombuffer(v, np.float64 if len(v) == 8 * d else np.float32).astype(np.float64) for v in data]).reshape(len(data), d)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


CAPS = "dim int, filter long, key binary, sketch binary, before binary"


def _decode(n: int, cosine: float):
    """A row for each cap that holds a vector, with the filters before this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                for a in range(0, len(rows), 256):
                    at = rows[a : a + 256]
                    part = b.take(pa.array(at))
                    unit = _units(part.column("data").to_pylist(), int(d))
                    kind = numbers(code(int(d), n, cosine))
                    lists = code(int(d), n, cosine).decode(unit)
                    owner = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in lists]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("dim").take(owner),
                            pa.array(np.concatenate(lists), pa.int64()),
                            part.column("key").take(owner),
                            pa.array(sketches(unit), pa.binary()).take(owner),
                            pa.array([x[:k].tobytes() for x in [y.astype(kind) for y in lists] for k in range(len(x))], pa.binary()),
                        ],
                        ["dim", "filter", "key", "sketch", "before"],
                    )

    return run


def _local(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component under a symmetric relation."""
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (new == label).all():
            return label
        label = new


def _common(lists: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For pairs of lists of distinct numbers whether they have one in common."""
    out = np.zeros(len(p), bool)
    size = np.array([len(x) for x in lists], np.int64)
    flat, first = np.concatenate([np.zeros(0, np.int64), *lists]), np.cumsum(size) - size
    step = max(1, 4_000_000 // max(1, 2 * int(size.max(initial=1))))
    for a in range(0, len(p), step):
        i, j = p[a : a + step], q[a : a + step]
        pair = np.concatenate([np.repeat(np.arange(len(i)), size[i]), np.repeat(np.arange(len(j)), size[j])])
        n = np.concatenate([size[i], size[j]])
        which = flat[np.repeat(np.concatenate([first[i], first[j]]) - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.lexsort((which, pair))
        pair, which = pair[order], which[order]
        out[a + pair[1:][(pair[1:] == pair[:-1]) & (which[1:] == which[:-1])]] = True
    return out


def _filter_rows(lists: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), len(vocabulary)), np.float32)
    for k, x in enumerate(lists):
        at = np.searchsorted(vocabulary, x)
        good = at < len(vocabulary)
        good[good] = vocabulary[at[good]] == x[good]
        out[k, at[good]] = 1
    return out


def _first_here(good: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The pairs of ``good`` that share no earlier filter."""
    p, q = good.any(1), good.any(0)
    if not p.any():
        return good
    a, b = [left[k] for k in np.flatnonzero(p)], [right[k] for k in np.flatnonzero(q)]
    vocabulary = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    if len(vocabulary):
        good[np.ix_(p, q)] &= _filter_rows(a, vocabulary) @ _filter_rows(b, vocabulary).T == 0
    return good


def _caps_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by cap, and where caps begin in it."""
    dim, filter_ = table["dim"].to_numpy(), table["filter"].to_numpy()
    order = np.lexsort((filter_, dim))
    new = (dim[order][1:] != dim[order][:-1]) | (filter_[order][1:] != filter_[order][:-1])
    return order, np.flatnonzero(np.concatenate([[True], new]))


def _lists(table: pa.Table, kinds: dict[int, np.dtype]) -> list[np.ndarray]:
    return [np.frombuffer(x, kinds[d]) for x, d in zip(table["before"].to_pylist(), table["dim"].to_pylist(), strict=True)]


def _kinds(table: pa.Table, n: int, cosine: float) -> dict[int, np.dtype]:
    return {d: numbers(code(d, n, cosine)) for d in set(table["dim"].to_pylist())}


def _similar(n: int, cosine: float):
    return lambda key, table: _near_members(key, table, _kinds(table, n, cosine))


def _near_members(key, table: pa.Table, kinds: dict[int, np.dtype]) -> pa.Table:
    """Members of caps that have a partner there by sketch whose first common
    filter is the cap's."""
    table = table.combine_chunks()
    order, at = _caps_of(table)
    bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<u8").reshape(len(order), -1)
    lists = _lists(table, kinds)
    need = np.zeros(len(order), bool)
    size = np.diff(np.append(at, len(order)))
    if key[1].as_py() == key[2].as_py():
        # pairs of small caps, all those that are s rows apart at once
        rest = np.repeat(np.where(size <= FEW, at + size, 0), size) - np.arange(len(order))
        for s in range(1, FEW):
            i = np.flatnonzero(rest > s)
            if not len(i):
                break
            p, q = order[i], order[i + s]
            near = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) <= APART
            p, q = p[near], q[near]
            good = ~_common(lists, p, q)
            need[p[good]] = need[q[good]] = True
        large = [(x, x) for a, n in zip(at[size > FEW], size[size > FEW], strict=True) if len(x := order[a : a + n])]
    else:
        side = table["side"].to_numpy()
        large = [(x[side[x] == 0], x[side[x] == 1]) for x in np.split(order, at[1:])]
    signs = lambda x: np.unpackbits(bits[x].view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    for x, y in large:
        if len(x) and len(y):
            good = signs(x) @ signs(y).T >= SIGNS - 2 * APART
            if x is y:
                np.fill_diagonal(good, False)
            good = _first_here(good, [lists[k] for k in x], [lists[k] for k in y])
            need[x[good.any(1)]] = need[y[good.any(0)]] = True
    return table.select(["dim", "filter", "i", "j", "side", "key", "before"]).filter(pa.array(need))


def _verify(n_vectors: int, cosine: float):
    def cap(kinds: dict[int, np.dtype], d: int, left: pa.Table, right: pa.Table | None):
        """Counts and components of the links in a cap that is the pair's first."""
        get = lambda t: (t["vec_id"].to_numpy(), t["copies"].to_numpy(), _units(t["data"].to_pylist(), d), _lists(t, kinds))
        li, lc, lx, lf = get(left)
        ri, rc, rx, rf = (li, lc, lx, lf) if right is None else get(right)
        keys = left["key"].to_pylist() + ([] if right is None else right["key"].to_pylist())
        good = lx @ rx.T >= cosine
        if right is None:
            np.fill_diagonal(good, False)
        if not good.any():
            return None
        good = _first_here(good, lf, rf)
        if right is None:
            ids, links, n = li, good, good @ lc
        else:
            ids = np.concatenate([li, ri])
            links = np.zeros((len(ids), len(ids)), bool)
            links[: len(li), len(li) :] = good
            links[len(li) :, : len(li)] = good.T
            n = np.concatenate([good @ rc, good.T @ lc])
        some = n > 0
        return [keys[k] for k in np.flatnonzero(some)], ids[some], n[some], _local(links[np.ix_(some, some)], ids[some])

    def run(key, table):
        table = table.combine_chunks()
        found = []
        dims, side = table["dim"].to_numpy(), table["side"].to_numpy()
        order, at = _caps_of(table)
        kinds = _kinds(table, n_vectors, cosine)
        for rows in np.split(order, at[1:]):
            d = int(dims[rows[0]])
            if key[1].as_py() == key[2].as_py():
                found.append(cap(kinds, d, table.take(rows), None))
            else:
                left, right = rows[side[rows] == 0], rows[side[rows] == 1]
                if len(left) and len(right):
                    found.append(cap(kinds, d, table.take(left), table.take(right)))
        found = [x for x in found if x is not None]
        out = {"key": pa.array([y for x in found for y in x[0]], pa.binary())}
        out |= {c: pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]), pa.int64()) for k, c in ((1, "vec_id"), (2, "n"), (3, "low"))}
        return pa.table(out)

    return run


def _tiled(sent: DataFrame) -> DataFrame:
    """Rows of caps with several members, dealt to cells and tiles (tile, i, j);
    the rows of a block are side 0 of tiles (i, j >= i) and side 1 of (j < i, i)."""
    cap = ["dim", "filter"]
    sizes = written(sent.groupBy(*cap).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    cells = 1 + (sizes.agg(F.sum("_n")).first()[0] or 0) // CELL
    caps = spread_join(sent, sizes, cap, F.xxhash64("key"), sizes).withColumn("blocks", F.ceil(F.col("_n") / TILE).cast("int"))
    caps = caps.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    h, block, last = F.xxhash64(*cap), F.col("block"), F.col("blocks") - 1

    def place(tile: Column, i: Column, j: Column, side: int) -> Column:
        return F.struct(tile.alias("tile"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    # cells are numbers below 0 and do not meet the tiles of large caps
    large = F.shiftrightunsigned(h, 1)
    left = F.transform(F.sequence(block, last), lambda j: place(large, block, j, 0))
    right = F.when(block > 0, F.transform(F.sequence(F.lit(0), block - 1), lambda i: place(large, i, block, 1))).otherwise(F.slice(left, 1, 0))
    here = F.when(last == 0, F.array(place(-1 - F.pmod(h, F.lit(cells)), F.lit(0), F.lit(0), 0))).otherwise(F.concat(left, right))
    return caps.select(F.explode(here).alias("_at"), *sent.columns).select("_at.*", *sent.columns)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    rows = written(vectors.select("vec_id", "embedding").mapInArrow(_read, "vec_id long, dim int, key binary, data binary"))
    full = rows.where("key IS NOT NULL AND vec_id IS NOT NULL")
    # one row an equal vector, its smallest id, before anything is exchanged
    first = F.min_by(F.struct("vec_id", "dim", "data"), "vec_id")
    reps = written(full.groupBy("key").agg(first.alias("r"), F.count(F.lit(1)).alias("copies")).select("key", "copies", "r.*"))
    groups = written(reps.select("key", F.col("vec_id").alias("rep"), "copies"))
    n = groups.count()
    sent = written(reps.select("key", "dim", "data").mapInArrow(_decode(n, cosine), CAPS))
    near = written(_tiled(sent).groupBy("tile", "i", "j").applyInArrow(_similar(n, cosine), "dim int, filter long, i int, j int, side int, key binary, before binary"))
    discard(sent)
    h, cells = F.xxhash64("dim", "filter"), 1 + near.count() // CELL
    sides = near.join(reps.drop("dim"), "key").withColumn("tile", F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(h, F.lit(cells))).otherwise(h))
    links = written(sides.groupBy("tile", "i", "j").applyInArrow(_verify(n, cosine), "key binary, vec_id long, n long, low long"))
    for t in (near, reps):
        discard(t)
    labels = components(links.select(F.col("low").alias("src"), F.col("vec_id").alias("dst")))
    counts = links.groupBy("key").agg(F.sum("n").alias("n"))

    of_group = (
        groups.join(counts, "key", "left")
        .join(labels, F.col("rep") == labels["doc_id"], "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = spread_join(full.select("vec_id", "key"), of_group, ["key"], F.xxhash64("vec_id"), groups.withColumnRenamed("copies", "_n"))
    alone = rows.where("key IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

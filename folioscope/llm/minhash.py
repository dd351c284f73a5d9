"""Near-duplicate documents by one-permutation MinHash.

The set of a document is its distinct shingles of ``width`` words, 2 unless the
caller says otherwise (ASCII lower case). Equal sets collapse to the smallest id
by a fingerprint. Of each distinct set one permutation's hashes are cut into ``BINS`` bins of which the minima are the
signature; an empty bin takes the value of another that a hash of the bin picks
(optimal densification), and bins are grouped into bands. Sets that agree in a
band share a bucket; a bucket gives star-shaped candidate edges, from its
smallest id to each other one, so their number is the number of members.
Edges are confirmed on the full sets, and confirmed ones merged to components.

A star finds no link between two members that are both unlike its centre. So
buckets that still hold members of several components are looked at again in
tiles of bounded size. There, parity sketches are compared: a set's sketch has
a bit for each of about four times as many cells as items, the parity of the
items in the cell. Two sketches differ in no more bits than their sets have
items apart, so a pair whose sketches differ too much is ruled out for certain;
the few others are confirmed on full sets and merged.

With ``ROWS`` rows in each of ``BANDS`` bands a pair with similarity 0.8 misses
all buckets with probability below 3e-5.

Cases: a null text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle has are a set of one; repeated rows of an id are one
document with several rows, each returned; ids must not be null for linking (a
row with null id is returned alone); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.bytesets import ODD, U, mix, parts, slices, text_bytes
from folioscope.llm.common import discard, salted, salted_table, spread_join, written

BANDS, ROWS = 20, 4
BINS = BANDS * ROWS
PERCENT = 80
#: Words of a shingle.
WIDTH = 2
#: Members of a bucket in one side of a tile.
TILE = 512

@functools.cache
def _byte_values() -> np.ndarray:
    """A random 64-bit value a byte, A-Z as a-z."""
    v = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(ODD))
    v[65:91] = v[97:123]
    return v


@functools.cache
def _donors() -> np.ndarray:
    """For each bin the order in which it tries others: a random permutation."""
    return np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) + U(977)).reshape(BINS, BINS), axis=1)


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(ODD))]), dtype=np.uint64)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another, and for each
    text the place of its first word (and the end). bounds: the texts' offsets."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    start[edges] = word[edges]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = np.flatnonzero(word)
    which = np.cumsum(start)[inside] - 1
    place = inside - at[which]
    powers = _powers(1 << int(place.max()).bit_length()) if place.max() else _powers(1)
    value = _byte_values()[raw[inside]] * powers[place]
    first = np.searchsorted(inside, at)
    h = mix(np.add.reduceat(value, first) + np.diff(np.append(first, len(inside))).astype(np.uint64))
    return h, np.searchsorted(at, bounds)


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    n = len(h) - width + 1
    out = h[: max(n, 0)]
    for k in range(1, width):
        out = mix(out * U(ODD) + mix(h[k : k + len(out)]))
    return out


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    offsets, raw = text_bytes(column)
    for a, b in slices(offsets):
        bounds = offsets[a : b + 1] - offsets[a]
        h, words = word_hashes(raw[offsets[a] : offsets[b]], bounds)
        every = _shingles(h, width)
        for k in range(b - a):
            s, e = words[k], words[k + 1]
            yield np.unique(every[s : e - width + 1]) if e - s >= width else _shingles(h[s:e], max(1, e - s))


def signature(items: np.ndarray) -> np.ndarray:
    """The densified minima of ``BINS`` bins of a sorted, non-empty set."""
    span = (1 << 64) // BINS + 1
    edges = (np.arange(BINS, dtype=object) * span).astype(np.uint64)
    first = np.searchsorted(items, edges)
    full = np.append(first[1:], len(items)) > first
    out = items[np.minimum(first, len(items) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        donors = _donors()[empty]
        out[empty] = mix(out[donors[np.arange(len(empty)), full[donors].argmax(1)]] + U(1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * U(ODD) + rows[:, k])
    return out


def parity_sketch(items: np.ndarray) -> bytes:
    """The parities of the items in each cell; the cells are a power of two."""
    cells = max(64, 1 << (4 * len(items) - 1).bit_length())
    odd = np.bincount((items & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _halved(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many cells."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def close_pairs(left: list[bytes], right: list[bytes], n_left: np.ndarray, n_right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that the sketches do not rule out."""

    def classes(rows: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        size = np.array([len(x) // 8 for x in rows])
        return {int(k): (at := np.flatnonzero(size == k), np.frombuffer(b"".join(rows[i] for i in at), np.uint64).reshape(len(at), k)) for k in np.unique(size)}

    p, q, out = classes(left), classes(right), []
    for k, (i, a) in p.items():
        for width, (j, b) in q.items():
            # similar sets differ in size by a quarter at most
            if width not in (k, 2 * k) and k != 2 * width:
                continue
            x, y = (a, b) if width == k else (a, _halved(b)) if width > k else (_halved(a), b)
            for r in range(len(i)):
                apart = np.bitwise_count(y ^ x[r]).sum(1, dtype=np.int64)
                hit = np.flatnonzero((100 + percent) * apart <= (100 - percent) * (n_left[i[r]] + n_right[j]))
                out.append(np.stack([np.full(len(hit), i[r]), j[hit]]))
    return tuple(np.concatenate(out, 1)) if out else (np.zeros(0, np.int64),) * 2


def _sketch(width: int):
    names = ["doc_id", "n_shingles", "fp1", "fp2", "bands", "parity"]
    as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            n, f1, f2, out, parities = [], [], [], [], []
            for items in shingle_sets(b.column("text"), width):
                n.append(len(items))
                f1.append(np.bitwise_xor.reduce(items) if len(items) else U(0))
                f2.append(mix(items + U(3)).sum(dtype=np.uint64))
                if len(items):
                    sig = signature(items)
                    out.append(bands(sig).view(np.int64))
                    parities.append(parity_sketch(items))
                else:
                    out.append(None)
                    parities.append(None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), as_long(f1), as_long(f2), pa.array(out, pa.list_(pa.int64())), pa.array(parities, pa.binary())], names)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(b.column("text"), width)], pa.large_binary())], ["doc_id", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            good = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                few, many = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(few) < percent * len(many):
                    good.append(False)
                    continue
                at = np.searchsorted(many, few)
                same = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                good.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst")], ["src", "dst"]).filter(pa.array(good, pa.bool_()))

    return run


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (src, dst), a written table, whose sets are similar enough; sets: (doc_id, items)."""
    a = sets.select(F.col("doc_id").alias("src"), F.col("items").alias("x"))
    b = sets.select(F.col("doc_id").alias("dst"), F.col("items").alias("y"))
    # a centre of many stars is a hot key with a large row
    both = spread_join(edges, a, ["src"], F.xxhash64("dst"))
    return both.join(b, "dst").select("src", "dst", "x", "y").mapInArrow(_confirm(percent), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component): for each end of an edge the smallest id reachable.

    Labels spread to neighbours and jump to their label's label until nothing
    changes; each round is written to the shared folder.
    """
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    dealt, hot = salted(both, ["dst"], F.xxhash64("src"))
    dealt = written(dealt)
    labels = written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "doc_id"))
    while True:
        near = dealt.join(salted_table(labels.withColumnRenamed("doc_id", "dst"), ["dst"], hot), ["dst", "_salt"]).groupBy("src").agg(F.min("component").alias("_near"))
        spread = labels.join(near, labels["doc_id"] == near["src"], "left").select("doc_id", F.col("component").alias("_was"), F.least("component", "_near").alias("component"))
        spread = written(spread)
        jump = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("_far"))
        # every row has a label that is a row itself
        after = written(spread_join(spread, jump, ["component"], F.xxhash64("doc_id")).select("doc_id", "_was", F.least("component", F.coalesce("_far", "component")).alias("component")))
        changed = after.where("component <> _was").limit(1).count()
        discard(labels)
        discard(spread)
        labels = after.select("doc_id", "component")
        labels._folioscope_path = after._folioscope_path
        if not changed:
            for t in (both, dealt, hot):
                discard(t)
            return labels


def _tiles(percent: int):
    def run(key, table):
        t = table.combine_chunks()
        left, right = t.filter(pc.equal(t["side"], 0)), t.filter(pc.equal(t["side"], 1))
        if key[1].as_py() == key[2].as_py():
            right = left
        p_id, q_id = left["doc_id"].to_numpy(), right["doc_id"].to_numpy()
        i, j = close_pairs(left["parity"].to_pylist(), right["parity"].to_pylist(), left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy(), percent)
        good = left["component"].to_numpy()[i] != right["component"].to_numpy()[j]
        low, high = np.minimum(p_id[i], q_id[j])[good], np.maximum(p_id[i], q_id[j])[good]
        pairs = np.unique(np.stack([low, high]), axis=1)
        return pa.table({"src": pa.array(pairs[0], pa.int64()), "dst": pa.array(pairs[1], pa.int64())})

    return run


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (band, bucket, doc_id, component) of buckets with several
    components, with the size ``_n`` of their bucket, its largest component
    ``_major`` and the size ``_most`` of that."""
    named = written(members.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    parts = named.groupBy("band", "bucket", "component").agg(F.count(F.lit(1)).alias("_c"))
    mixed = parts.groupBy("band", "bucket").agg(F.sum("_c").alias("_n"), F.max(F.struct("_c", "component")).alias("_m"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    mixed = written(mixed.select("band", "bucket", "_n", F.col("_m.component").alias("_major"), F.col("_m._c").alias("_most")))
    return spread_join(named, mixed, ["band", "bucket"], F.xxhash64("doc_id"), mixed)


def residual_pairs(mixed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs from different components that share a bucket and may be similar.

    Members of a bucket's largest component are not held against each other, so
    a bucket of near copies beside a few others costs its size, not its square.
    """
    others, major = F.ceil((F.col("_n") - F.col("_most")) / TILE).cast("int"), F.ceil(F.col("_most") / TILE).cast("int")
    own = F.col("component") == F.col("_major")
    h = F.xxhash64("doc_id")
    rows = mixed.withColumns({"others": others, "blocks": others + major})
    # blocks of the other components come first
    rows = rows.withColumn("block", F.when(own, F.col("others") + F.pmod(h, F.col("blocks") - F.col("others"))).otherwise(F.pmod(h, F.col("others"))).cast("int"))
    # a row of block i is on the left of tiles (i, j >= i) and on the right of tiles (j < i, i)
    left = rows.where("block < others").withColumn("j", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select("band", "bucket", F.col("block").alias("i"), "j", F.lit(0).alias("side"), "doc_id", "component")
    right = rows.where("block > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.least("block", "others") - 1))).select("band", "bucket", "i", F.col("block").alias("j"), F.lit(1).alias("side"), "doc_id", "component")
    tiles = left.union(right).join(sketches, "doc_id").withColumn("tile", F.xxhash64("band", "bucket"))
    # few bytes but many comparisons: not to be coalesced by size
    tiles = tiles.repartition(4 * int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile", "i", "j")
    return tiles.select("tile", "i", "j", "side", "doc_id", "component", "n_shingles", "parity").groupBy("tile", "i", "j").applyInArrow(_tiles(percent), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    sketch = written(docs.select("doc_id", "text").mapInArrow(_sketch(width), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, parity binary"))
    # a link of two rows of one id says nothing; equal sets collapse to their smallest id
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = ["n_shingles", "fp1", "fp2"]
    # one row an equal set, its text of smallest id, before anything is exchanged
    first = F.min_by(F.struct("doc_id", "bands", "parity"), "doc_id")
    reps = written(full.groupBy(*equal).agg(first.alias("r"), F.count(F.lit(1)).alias("_n")).select(*equal, "_n", "r.*"))
    groups = reps.select(*equal, "_n", F.col("doc_id").alias("rep"))
    bucketed = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    shared = bucketed.groupBy("band", "bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("centre <> _last").drop("_last")
    shared = written(shared)
    members = written(spread_join(bucketed, shared.drop("_n"), ["band", "bucket"], F.xxhash64("doc_id"), shared))
    discard(shared)
    stars = written(members.where("doc_id <> centre").select(F.col("centre").alias("src"), F.col("doc_id").alias("dst")).distinct())

    # sets are made only of the texts that some candidate edge names; those ids
    # grow with the corpus, so they are exchanged at every size
    named = stars.select(F.col("src").alias("doc_id")).union(stars.select(F.col("dst").alias("doc_id"))).distinct()
    sets = written(docs.select("doc_id", "text").join(named.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, items binary"))
    links = written(confirmed(stars, sets, percent))
    discard(stars)
    labels = components(links)
    mixed = mixed_buckets(members.select("band", "bucket", "doc_id"), labels)
    # written: the join by centre reads its edges twice
    maybe = written(residual_pairs(mixed, reps.select("doc_id", "n_shingles", "parity"), percent))
    found = written(confirmed(maybe, sets, percent))
    discard(maybe)
    if found.limit(1).count():
        labels = components(links.union(found))
    for t in (members, sets):
        discard(t)

    # ids with several different sets join those sets' groups
    of_group = groups.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*equal, F.coalesce("component", "rep").alias("component_id"))
    grouped = spread_join(full.select("doc_id", *equal), of_group, equal, F.xxhash64("doc_id"), groups)
    alone = sketch.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = grouped.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One document of each group of near-duplicates, with all columns: that of
    smallest id, and of repeated rows of an id with equal text one."""
    kept = written(near_duplicates(docs, percent, width).where("kept").groupBy(F.col("doc_id").alias("_fs_id")).agg(F.count(F.lit(1)).alias("_fs_n")))
    out = docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_fs_id")), "left_semi")
    if kept.where("_fs_n > 1 AND _fs_id IS NOT NULL").limit(1).count():
        one = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
        return one.unionByName(out.where("doc_id IS NULL"))
    return out

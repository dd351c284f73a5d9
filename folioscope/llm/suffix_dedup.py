"""Removal of byte strings that an earlier document also holds.

Every byte is removed that a ``SPAN``-byte string covers which also starts in a
document with a smaller id. Three exchanges find those strings:

1. Each text is sampled at its minimisers: of the hashes of all ``GRAM``-byte
   strings the smallest in every window of ``SPAN`` bytes. Equal ``SPAN``-byte
   strings have the same minimiser at the same place, so a string that occurs
   in two documents has an anchor that does. Anchors meet by hash, and those of
   one document only are dropped. That leaves the repetitive part of the corpus.
2. Each remaining anchor brings its context, the ``SPAN - GRAM`` bytes before
   and after it. Contexts meet by anchor and are indexed: a Burrows-Wheeler
   transform of the aligned contexts, kept as runs of equal symbols, column by
   column from the right. A step to the left permutes whole runs; rows that
   agree on the next ``SPAN`` bytes are neighbours, and the end of each such run
   samples the smallest document in it. Walking the columns streams, for every
   context and every place, whether the match with an earlier document reaches
   ``SPAN`` bytes.
3. The marked places go back to their document, where they are merged to
   maximal runs and cut out.

Within a batch, anchors and contexts that several documents share are sent
once, so a passage in a third of all documents does not fill one task.

Cases: a null or empty text has no bytes; texts under ``SPAN`` bytes lose
nothing; equal texts lose all but the first; rows of the same id do not count
as earlier than one another, and a null id is later than all; an empty table
gives an empty result; other columns are not read; very long texts are read in
pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.bytesets import ODD, U, mix, parts, text_bytes
from folioscope.llm.common import buckets_for

SPAN, GRAM = 50, 24
#: Bytes of context on each side of an anchor, and places of a string around it.
SIDE = SPAN - GRAM
PLACES = SIDE + 1
#: Bytes of input a bucket of anchors, or a group of documents.
BUCKET = 1 << 25
#: Anchors of a batch that are held before they are sent.
HELD = 1 << 18
#: Bytes of a text that are hashed at once.
PIECE = 1 << 17
LAST = (1 << 63) - 1
NONE = 0xFFFFFFFF


def _power(n: int) -> np.uint64:
    return U(pow(ODD, n, 1 << 64))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte strings, by doubling: 1, 2, 4, 8, 16, 24."""
    h = raw.astype(np.uint64) + U(1)
    held = {1: h}
    n = 1
    while n < 16:
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
        held[n] = h
    return mix(held[16][: -(GRAM - 16)] * _power(8) + held[8][16:])


def _extreme(h: np.ndarray, width: int, take) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = take(h[:-n], h[n:])
        n *= 2
    return take(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the minimisers of a text of ``SPAN`` bytes or more."""
    found, places = [], []
    for a in range(0, len(raw), PIECE):
        lo, hi = max(0, a - SPAN), min(len(raw), a + PIECE + SPAN + GRAM)
        if hi - lo < SPAN:
            continue
        h = gram_hashes(raw[lo:hi])
        least = _extreme(h, PLACES, np.minimum)
        edge = np.zeros(PLACES - 1, np.uint64)
        at = np.flatnonzero(_extreme(np.concatenate([edge, least, edge]), PLACES, np.maximum) == h)
        at = at[(at + lo >= a) & (at + lo < a + PIECE)]
        found.append(h[at])
        places.append(at + lo)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of bytes: the pieces of ``data`` that begin at ``at``."""
    ends = (np.append(at, len(data)) * data.dtype.itemsize).astype(np.int64)
    rows = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return rows.cast(pa.binary())


def _by_document(doc: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """One row of bytes a document, from rows of fixed size."""
    order = np.argsort(doc, kind="stable")
    at = _starts(doc[order])
    return doc[order][at], _binary(data[order], at)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed planes of equal bytes."""
    z = zstandard.ZstdCompressor(level=1)
    parts = [z.compress(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T)) for c in columns]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unsqueeze(packed: bytes, *dtypes) -> list[np.ndarray]:
    z, out, at = zstandard.ZstdDecompressor(), [], 4 * len(dtypes)
    for size, dtype in zip(np.frombuffer(packed, "<u4", len(dtypes)), dtypes, strict=True):
        raw = np.frombuffer(z.decompress(packed[at : at + size]), np.uint8)
        width = np.dtype(dtype).itemsize
        out.append(np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(dtype).reshape(-1))
        at += size
    return out


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.int64(0))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) % U(buckets)).astype(np.int64)


#: Rows go to a bucket: replies for documents of this group, or what is sent.
SENT = pa.schema([("bucket", pa.int32()), ("reply", pa.binary()), ("sent", pa.binary())])
PLACE = np.dtype([("place", "<u4")])
MARK = np.dtype([("text", "<u4"), ("place", "<u4"), ("mask", "<u4")])


def _replies(owner: np.ndarray, data: np.ndarray, groups: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows of fixed size for documents, packed by group of documents."""
    group = owner % groups
    order = np.lexsort((owner, group))
    at = _starts(group[order])
    parts = np.split(order, at[1:]) if len(at) else []
    return group[order][at], [squeeze(_gaps(owner[x]), *(np.ascontiguousarray(data[f][x]) for f in data.dtype.names)) for x in parts]


def _row(buckets: np.ndarray, replies: list | None, sent: list | None) -> pa.RecordBatch:
    empty = pa.nulls(len(buckets), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), empty if replies is None else pa.array(replies, pa.binary()), empty if sent is None else pa.array(sent, pa.binary())], schema=SENT)


def _merged(dtype: np.dtype):
    """Replies of one group, from all buckets, as one row of bytes a document."""

    def run(table):
        parts = [unsqueeze(x, np.int64, *(dtype[f] for f in dtype.names)) for x in table["reply"].to_pylist()]
        owner = np.concatenate([np.cumsum(x[0]) for x in parts])
        data = np.zeros(len(owner), dtype)
        for k, f in enumerate(dtype.names):
            data[f] = np.concatenate([x[k + 1] for x in parts])
        ids, rows = _by_document(owner, data)
        return pa.table({"_owner": pa.array(ids), "replies": rows})

    return run


def _send_anchors(buckets: int):
    def flush(hashes: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        h, p = np.concatenate(hashes), np.concatenate(places).astype("<u4")
        d = np.concatenate([np.full(len(x), y, np.int64) for x, y in zip(hashes, docs, strict=True)])
        order = np.argsort(h)
        at = _starts(h[order])
        several = np.minimum.reduceat(d[order], at) != np.maximum.reduceat(d[order], at)
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat(several, np.diff(np.append(at, len(h))))
        # anchors of several documents of the batch are known to be shared: the
        # documents are told here, and the hash alone tells the others
        if shared.any():
            group, replies = _replies(d[shared], p[shared].view(PLACE), buckets)
            yield _row(group, replies, None)
        known = h[order[at[several]]]
        known_bucket, bucket = _bucket(known, buckets), _bucket(h, buckets)
        order = np.lexsort((d, bucket))
        order = order[~shared[order]]
        which = np.arange(buckets)
        lo, hi = np.searchsorted(bucket[order], which), np.searchsorted(bucket[order], which, side="right")
        sent = []
        for b in which:
            rows = order[lo[b] : hi[b]]
            # within a bucket 32 bits are enough: what they confuse is sorted out by the contexts
            sent.append(squeeze(h[rows].astype("<u4"), _gaps(d[rows]), p[rows], known[known_bucket == b].astype("<u4")))
        yield _row(which, None, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, places, n = [], [], [], 0
        for batch in parts(batches):
            offsets, raw = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for k in np.flatnonzero(np.diff(offsets) >= SPAN):
                h, p = anchors(raw[offsets[k] : offsets[k + 1]])
                hashes.append(h)
                docs.append(ids[k])
                places.append(p)
                n += len(h)
                if n >= HELD:
                    yield from flush(hashes, docs, places)
                    hashes, docs, places, n = [], [], [], 0
        yield from flush(hashes, docs, places)

    return run


def _split(table) -> tuple[pa.Table, list[bytes]]:
    """Replies that only pass through, and what was sent to the bucket."""
    table = table.select(["bucket", "reply", "sent"])
    told = table.filter(pc.is_valid(table["reply"])).select(["bucket", "reply"])
    return told, table.filter(pc.is_valid(table["sent"]))["sent"].to_pylist()


def _answer(told: pa.Table, owner: np.ndarray, data: np.ndarray, groups: int) -> pa.Table:
    group, replies = _replies(owner, data, groups)
    return pa.concat_tables([told, pa.table([pa.array(group.astype(np.int32)), pa.array(replies, pa.binary())], schema=told.schema)])


def _shared_anchors(groups: int):
    """Of one bucket: for each document the places of its anchors that others have."""

    def run(table):
        told, sent = _split(table)
        parts = [unsqueeze(x, "<u4", np.int64, "<u4", "<u4") for x in sent]
        if not sum(len(x[0]) for x in parts):
            return told
        h, place, known = (np.concatenate([x[k] for x in parts]) for k in (0, 2, 3))
        doc = np.concatenate([np.cumsum(x[1]) for x in parts])
        order = np.argsort(h)
        h = h[order]
        at = _starts(h)
        low, high = np.minimum.reduceat(doc[order], at), np.maximum.reduceat(doc[order], at)
        keep = np.repeat((low < high) | np.isin(h[at], known), np.diff(np.append(at, len(h))))
        return _answer(told, doc[order][keep], place[order][keep].view(PLACE), groups)

    return run


CONTEXT = np.dtype([("hash", "<u8"), ("key", "<u8"), ("doc", "<i8"), ("text", "<u4"), ("place", "<u4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (2 * SIDE,))])


def contexts(raw: np.ndarray, places: np.ndarray, doc: int, text: int) -> np.ndarray:
    """The contexts of anchors at ``places`` of a text."""
    out = np.zeros(len(places), CONTEXT)
    padded = np.concatenate([np.zeros(SIDE, np.uint8), raw, np.zeros(SIDE, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * SIDE + GRAM)[places]
    h = np.zeros(len(places), np.uint64)
    for k in range(SIDE, SIDE + GRAM):
        h = h * U(ODD) + (around[:, k].astype(np.uint64) + U(1))
    out["hash"], out["doc"], out["text"], out["place"] = mix(h), doc, text, places
    out["bytes"][:, :SIDE], out["bytes"][:, SIDE:] = around[:, :SIDE], around[:, SIDE + GRAM :]
    out["left"], out["right"] = np.minimum(SIDE, places), np.minimum(SIDE, len(raw) - GRAM - places)
    key = out["left"].astype(np.uint64) * U(64) + out["right"]
    for k in range(2 * SIDE):
        key = key * U(ODD) + (out["bytes"][:, k].astype(np.uint64) + U(1))
    out["key"] = mix(key)
    return out


def _all_places(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Masks of the places at which a string lies within the text."""
    w = np.arange(PLACES)
    good = (w >= SIDE - left[:, None].astype(int)) & (w <= right[:, None])
    return (good.astype(np.uint32) << w.astype(np.uint32)).sum(1, dtype=np.uint32)


def _marks(c: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(c), MARK)
    out["text"], out["place"], out["mask"] = c["text"], c["place"], mask
    return out


def _send_contexts(buckets: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        c = np.concatenate(held)
        c = c[np.lexsort((c["doc"], c["key"], c["hash"]))]
        new = np.concatenate([[True], (c["hash"][1:] != c["hash"][:-1]) | (c["key"][1:] != c["key"][:-1])])
        first = np.repeat(c["doc"][new], np.diff(np.append(np.flatnonzero(new), len(c))))
        # a whole context that an earlier document of the batch has is covered
        later = c["doc"] > first
        if later.any():
            group, replies = _replies(c["doc"][later], _marks(c[later], _all_places(c["left"][later], c["right"][later])), buckets)
            yield _row(group, replies, None)
        c = c[~later]
        bucket = _bucket(c["hash"], buckets)
        order = np.lexsort((c["place"], c["doc"], bucket))
        c, bucket = c[order], bucket[order]
        at = _starts(bucket)
        yield _row(bucket[at], None, [_pack_contexts(x) for x in np.split(c, at[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in parts(batches):
            offsets, raw = text_bytes(batch.column("text"))
            ids, names = batch.column("_key").to_numpy(), batch.column("text_hash").to_numpy()
            for k, replies in enumerate(batch.column("replies").to_pylist()):
                text = raw[offsets[k] : offsets[k + 1]]
                places = np.unique(np.frombuffer(replies, "<u4")).astype(np.int64)
                # another text under the same id may have had places beyond this one's end
                places = places[places <= len(text) - GRAM]
                if len(places):
                    held.append(contexts(text, places, ids[k], names[k] & NONE))
                    n += len(places)
                if n >= HELD // 2:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)

    return run


def _pack_contexts(c: np.ndarray) -> bytes:
    flat = np.ascontiguousarray(c["bytes"]).reshape(-1)
    return squeeze(np.ascontiguousarray(c["hash"]), _gaps(c["doc"]), *(np.ascontiguousarray(c[x]) for x in ("text", "place", "left", "right")), flat)


def _unpack_contexts(packed: bytes) -> np.ndarray:
    h, doc, text, place, left, right, flat = unsqueeze(packed, "<u8", np.int64, "<u4", "<u4", "u1", "u1", "u1")
    c = np.zeros(len(h), CONTEXT)
    c["hash"], c["doc"], c["text"], c["place"], c["left"], c["right"], c["bytes"] = h, np.cumsum(doc), text, place, left, right, flat.reshape(-1, 2 * SIDE)
    return c


class RunIndex:
    """Aligned contexts as a run-compressed Burrows-Wheeler transform.

    Columns are ``SIDE`` bytes, the anchor as one symbol, and ``SIDE`` bytes.
    ``order`` holds the rows sorted by what begins at the current column.
    """

    def __init__(self, c: np.ndarray):
        self.c, self.bytes = c, np.ascontiguousarray(c["bytes"].T)
        order = np.argsort(self.bytes[-1], kind="stable")
        for k in range(2 * SIDE - 2, SIDE - 1, -1):
            order = order[np.argsort(self.bytes[k][order], kind="stable")]
        self.order = order[np.argsort(c["hash"][order], kind="stable")]
        self.column = SIDE
        # hashes of what the string at the column has before and after the anchor
        self.before, self.after = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
        for k in range(SIDE):
            self.after = self.after * U(ODD) + (self.bytes[SIDE + k].astype(np.uint64) + U(1))

    def left(self) -> None:
        """One column to the left: runs of equal symbols move as wholes."""
        k = self.column - 1
        symbol = self.bytes[k][self.order]
        at = _starts(symbol)
        length = np.diff(np.append(at, len(symbol)))
        runs = np.argsort(symbol[at], kind="stable")
        begin, length = at[runs], length[runs]
        ends = np.cumsum(length)
        self.order = self.order[np.repeat(begin - (ends - length), length) + np.arange(len(symbol))]
        self.before = self.before + (self.bytes[k].astype(np.uint64) + U(1)) * _power(SIDE - 1 - k)
        self.after = (self.after - (self.bytes[SIDE + k].astype(np.uint64) + U(1))) * U(pow(ODD, -1, 1 << 64))
        self.column = k

    def stretch(self) -> np.ndarray:
        """For each row, a hash of the string of ``SPAN`` bytes at the column."""
        return mix(mix(self.c["hash"] + self.before) + self.after)

    def matches(self) -> np.ndarray:
        """For each row the mask of places whose string an earlier document has."""
        c, mask = self.c, np.zeros(len(self.c), np.uint32)
        inside = _all_places(c["left"], c["right"])
        while True:
            w = self.column
            valid = (inside >> np.uint32(w)) & np.uint32(1) == 1
            string = self.stretch()[self.order]
            at = _starts(string)
            docs = np.where(valid, c["doc"], LAST)[self.order]
            sample = np.minimum.reduceat(docs, at)
            first = np.repeat(sample, np.diff(np.append(at, len(docs))))
            rows = self.order[(docs > first) & valid[self.order]]
            mask[rows] |= np.uint32(1 << w)
            if not w:
                return mask
            self.left()


def _matched(groups: int):
    """Of one bucket: for each document the places at which to remove strings."""

    def run(table):
        told, sent = _split(table)
        if not sent:
            return told
        c = np.concatenate([_unpack_contexts(x) for x in sent])
        mask = RunIndex(c).matches()
        return _answer(told, c["doc"][mask > 0], _marks(c[mask > 0], mask[mask > 0]), groups)

    return run


def spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal removed runs from places and masks."""
    row, w = np.nonzero((marks["mask"][:, None] >> np.arange(PLACES, dtype=np.uint32)) & np.uint32(1))
    s = np.unique(marks["place"][row].astype(np.int64) - SIDE + w)
    if not len(s):
        return s, s
    new = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + SPAN]))
    return s[new], np.append(s[new[1:] - 1], s[-1]) + SPAN


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            offsets, raw = text_bytes(batch.column("text"))
            names = batch.column("text_hash").to_numpy()
            size, removed, number, digest, kept = [], [], [], [], []
            for k, replies in enumerate(batch.column("replies").to_pylist()):
                text = raw[offsets[k] : offsets[k + 1]]
                marks = np.frombuffer(replies or b"", MARK)
                begin, end = spans(marks[marks["text"] == names[k] & NONE])
                pieces, at = [], 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    pieces.append(text[at:b])
                    at = e
                pieces.append(text[at:])
                rest = b"".join(p.tobytes() for p in pieces)
                size.append(len(text))
                removed.append(len(text) - len(rest))
                number.append(len(begin))
                digest.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    # a code point that lost some of its bytes goes altogether
                    kept.append(rest.decode("utf-8", "ignore"))
            columns = [pa.array(x, pa.int64()) for x in (size, removed, number)] + [pa.array(digest, pa.string())]
            names_ = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns.append(pa.array(kept, pa.string()))
                names_.append("kept_text")
            extra = [c for c in batch.schema.names if c == "doc_id" or c.startswith("_fs_")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in extra] + columns, extra + names_)

    return run


def remove_repeats(docs: DataFrame, texts: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with
    ``texts`` also kept_text; the columns ``keep`` of ``docs`` are carried along
    with ``_fs_`` before their names."""
    buckets = buckets_for(docs.select("doc_id", "text"), BUCKET)
    extra = [c for c in (keep or []) if c not in ("doc_id", "text")]
    key = F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long")
    # both joins take the same columns, so that the texts are exchanged once
    rows = docs.select(key.alias("_key"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), *[F.col(c).alias(f"_fs_{c}") for c in extra])
    sent, reply = "bucket int, reply binary, sent binary", "bucket int, reply binary"

    def by_document(replies: DataFrame, dtype: np.dtype) -> DataFrame:
        return replies.groupBy("bucket").applyInArrow(_merged(dtype), "_owner long, replies binary").hint("shuffle_hash")

    found = docs.select(key.alias("doc_id"), "text").mapInArrow(_send_anchors(buckets), sent)
    shared = by_document(found.groupBy("bucket").applyInArrow(_shared_anchors(buckets), reply), PLACE)
    around = rows.join(shared, F.col("_key") == F.col("_owner")).select(*rows.columns, "replies")
    found = around.mapInArrow(_send_contexts(buckets), sent)
    marked = by_document(found.groupBy("bucket").applyInArrow(_matched(buckets), reply), MARK)
    out = rows.join(marked, F.col("_key") == F.col("_owner"), "left").select(*rows.columns, "replies")
    types = dict(docs.dtypes)
    schema = "doc_id long, " + "".join(f"`_fs_{c}` {types[c]}, " for c in extra) + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else "")
    return out.mapInArrow(_cut(texts), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, the repeats cut out of their text
    and ``n_chars``, if there, counted anew."""
    out = remove_repeats(docs, texts=True, keep=docs.columns)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return out.select(*[new.get(c, F.col(f"`_fs_{c}`").alias(c)) for c in docs.columns])

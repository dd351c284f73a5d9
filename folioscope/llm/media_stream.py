"""Media columns: payloads kept as MPEG transport streams.

``stored`` turns byte strings into transport streams: packets of 188 bytes, of
which some carry the program tables (one program with one elementary stream of
private data), and the others the packets of the elementary stream, each with a
presentation time. ``ACCESS`` elementary packets make a group; its first one is
a random-access point: the tables are repeated before it, and its packet has
the random-access flag and the clock.

``parsed`` reads any transport stream: it finds the packets (bytes between them
are skipped and counted), parses program association and map tables with their
checksums, checks the continuity counters of every elementary stream (a packet
sent twice is dropped, a gap is an error and the elementary packets at it are
marked as damaged), reassembles elementary packets, and lists their times and
random-access points. ``stamps`` has them as a table of their own, and ``clip``
decodes a span of time from the last random-access point before it, with no
look at what lies before.

A row is one stream, so that work is in the scan's own stage and nothing is
exchanged; memory is that of one stream and a batch.

Cases: a null or empty text is one unit of filling; equal texts give equal
streams; repeated rows are streams of their own; a very long text is one stream
of many elementary packets (times wrap after 2**33 ticks); an empty table gives
an empty result; a null stream parses as an empty one; other columns are not
read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.bytesets import parts
from folioscope.llm.common import written

# Fixed values of the format.
PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
BODY = PACKET - 4
CLOCK = 90_000
WRAP = 1 << 33
#: Stream ids whose elementary packets have no optional header.
BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06

#: Bytes of a unit and what fills up the last one; 8-bit samples a second.
UNIT, FILL, RATE = 576, b"\xff", 48_000
#: Units of an elementary packet, and elementary packets from one random-access
#: point to the next.
UNITS, ACCESS = 32, 4
PROGRAM, TABLE_PID, STREAM_PID = 1, 0x1000, 0x100
#: Bytes of streams that are sent on in one batch.
BATCH = 8 << 20

STAMP = "struct<pid:int,pts:long,packet:long,length:long,random_access:boolean,complete:boolean>"
PROGRAMS = "array<struct<program:int,table_pid:int,clock_pid:int,streams:array<struct<pid:int,type:int>>>>"
COUNTS = ("continuity_errors", "duplicates", "table_errors", "transport_errors", "skipped_bytes")
PARSED = f"doc_id long, media binary, payload binary, programs {PROGRAMS}, stamps array<{STAMP}>, " + ", ".join(f"{c} long" for c in COUNTS)


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1) & 0xFFFFFFFF ^ (0x04C11DB7 if c >> 31 else 0)
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    """The checksum of table sections; 0 over a section with its checksum."""
    table, c = _crc_table(), 0xFFFFFFFF
    for x in data:
        c = (c << 8) & 0xFFFFFFFF ^ table[c >> 24 ^ x]
    return c


# ---- writing ----


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, extension, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


@functools.cache
def _tables() -> tuple[bytes, bytes]:
    association = struct.pack(">HH", PROGRAM, 0xE000 | TABLE_PID)
    program = struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_TYPE, 0xE000 | STREAM_PID, 0xF000)
    return _section(0, 1, association), _section(2, PROGRAM, program)


def _stamped(mark: int, t: int) -> bytes:
    return struct.pack(">BHH", mark << 4 | (t >> 30) << 1 | 1, (t >> 14 & 0xFFFE) | 1, (t << 1 & 0xFFFE) | 1)


def _packet(pid: int, start: bool, counter: int, adaptation: bytes, data: bytes) -> bytes:
    """One packet; stuffing in its adaptation field fills it up."""
    spare = BODY - len(data)
    if not spare:
        return struct.pack(">BHB", SYNC, start << 14 | pid, 0x10 | counter) + data
    if spare == 1:
        return struct.pack(">BHBB", SYNC, start << 14 | pid, 0x30 | counter, 0) + data
    adaptation = adaptation or b"\0"
    return struct.pack(">BHBB", SYNC, start << 14 | pid, 0x30 | counter, spare - 1) + adaptation + b"\xff" * (spare - 1 - len(adaptation)) + data


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, sent, counter = [], 0, 0
    size = UNIT * UNITS
    for k, at in enumerate(range(0, len(payload), size)):
        data = payload[at : at + size]
        time = at * CLOCK // RATE % WRAP
        adaptation = b""
        if k % ACCESS == 0:
            for pid, section in zip((0, TABLE_PID), _tables(), strict=True):
                out.append(_packet(pid, True, sent % 16, b"", (b"\0" + section).ljust(BODY, b"\xff")))
            sent += 1
            adaptation = b"\x50" + (time << 15 | 0x3F << 9).to_bytes(6, "big")
        body = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x80, 0x80, 5) + _stamped(2, time) + data
        head = min(len(body), BODY - (len(adaptation) + 1 if adaptation else 0))
        out.append(_packet(STREAM_PID, True, counter % 16, adaptation, body[:head]))
        counter += 1
        whole = (len(body) - head) // BODY
        if whole:
            rows = np.empty((whole, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
            rows[:, 3] = 0x10 | (counter + np.arange(whole)) % 16
            rows[:, 4:] = np.frombuffer(body, np.uint8, whole * BODY, head).reshape(whole, BODY)
            out.append(rows.tobytes())
            counter += whole
        rest = body[head + whole * BODY :]
        if rest:
            out.append(_packet(STREAM_PID, False, counter % 16, b"", rest))
            counter += 1
    return b"".join(out)


def padded(data: bytes) -> bytes:
    return data + FILL * (-len(data) % UNIT if data else UNIT)


# ---- reading ----


@dataclass
class Stream:
    programs: dict[int, tuple[int, int, list[tuple[int, int]]]] = field(default_factory=dict)  # program: (table pid, clock pid, [(pid, type)])
    stamps: list[tuple[int, int | None, int, int, bool, bool]] = field(default_factory=list)
    payload: bytes = b""
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))


def _packets(data: bytes) -> tuple[np.ndarray, int]:
    """Whole packets, and the bytes skipped: a packet is where a sync byte is and
    a packet ends before it, or another sync byte (or the end) follows it."""
    n = len(data) // PACKET
    rows = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    if len(data) == n * PACKET and (rows[:, 0] == SYNC).all():
        return rows, 0
    starts, at = [], 0
    while (at := data.find(SYNC, at)) >= 0 and at + PACKET <= len(data):
        if (starts and starts[-1] + PACKET == at) or at + PACKET == len(data) or data[at + PACKET] == SYNC:
            starts.append(at)
            at += PACKET
        else:
            at += 1
    whole = np.frombuffer(data, np.uint8)
    rows = whole[np.array(starts, np.int64)[:, None] + np.arange(PACKET)] if starts else rows[:0]
    return rows, len(data) - len(starts) * PACKET


def _sections(rows: np.ndarray, start: np.ndarray, first: np.ndarray, counts: dict[str, int]) -> Iterator[bytes]:
    """Sections of a table's packets in order, those with a right checksum."""
    held = b""
    for row, at, begins in zip(rows, start, first, strict=True):
        data = row[at:].tobytes()
        done = [held + data]
        if begins:
            pointer = data[0] if data else 0
            done = [held + data[1 : 1 + pointer], data[1 + pointer :]] if held else [data[1 + pointer :]]
        elif not held:
            continue
        for held in done:
            while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + (struct.unpack(">H", held[1:3])[0] & 0xFFF)):
                if n >= 12 and section_crc(held[:n]) == 0:
                    yield held[:n]
                else:
                    counts["table_errors"] += 1
                held = held[n:]
            if held[:1] == b"\xff":
                held = b""


def demux(data: bytes) -> Stream:
    """Tables, elementary packets, times and faults of a transport stream.

    ``payload`` joins the complete elementary packets in the streams' order of
    the tables, then by place.
    """
    out = Stream()
    rows, out.counts["skipped_bytes"] = _packets(data)
    if not len(rows):
        return out
    bad = rows[:, 1] >> 7 == 1
    out.counts["transport_errors"] = int(bad.sum())
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4
    usable = ~bad & (control & 0b1100 == 0) & (control & 1 == 1) & (pid != NULL_PID)
    adapted = control & 2 == 2
    start = np.minimum(4 + np.where(adapted, rows[:, 4].astype(np.int32) + 1, 0), PACKET)
    flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)
    first = rows[:, 1] & 0x40 != 0

    def table(of: int) -> Iterator[bytes]:
        k = np.flatnonzero(usable & (pid == of))
        return _sections(rows[k], start[k], first[k], out.counts)

    where: dict[int, int] = {}
    for s in table(0):
        if s[0] == 0 and s[5] & 1:
            where |= {p: t & 0x1FFF for p, t in struct.iter_unpack(">HH", s[8:-4]) if p}
    for of in sorted(set(where.values())):
        for s in table(of):
            program = struct.unpack(">H", s[3:5])[0]
            if s[0] != 2 or not s[5] & 1 or where.get(program) != of:
                continue
            clock, skip = struct.unpack(">HH", s[8:12])
            streams, at = [], 12 + (skip & 0xFFF)
            while at + 5 <= len(s) - 4:
                kind, to, more = struct.unpack(">BHH", s[at : at + 5])
                streams.append((to & 0x1FFF, kind))
                at += 5 + (more & 0xFFF)
            out.programs[program] = (of, clock & 0x1FFF, streams)
    payloads = []
    for of in dict.fromkeys(p for _, _, streams in out.programs.values() for p, _ in streams):
        k = np.flatnonzero(usable & (pid == of))
        if len(k):
            payloads += _elementary(out, of, rows, k, start, flags, first)
    out.payload = b"".join(payloads)
    out.stamps.sort(key=lambda s: (s[2], s[0]))
    return out


def _elementary(out: Stream, of: int, rows: np.ndarray, k: np.ndarray, start: np.ndarray, flags: np.ndarray, first: np.ndarray) -> list[bytes]:
    counter = rows[k, 3].astype(np.int32) & 15
    step = np.diff(counter, prepend=counter[0] - 1) & 15
    same = np.flatnonzero(step == 0)
    twice = np.zeros(len(k), bool)
    for i in same:
        a, b = k[i - 1], k[i]
        twice[i] = not twice[i - 1] and start[a] == start[b] and bool((rows[a, start[a] :] == rows[b, start[b] :]).all())
    out.counts["duplicates"] += int(twice.sum())
    k, step = k[~twice], step[~twice]
    gap = (step != 1) & (flags[k] & 0x80 == 0)
    out.counts["continuity_errors"] += int(gap.sum())
    flat = rows[k][np.arange(PACKET) >= start[k][:, None]]
    ends = np.concatenate(([0], np.cumsum(PACKET - start[k])))
    begins = np.flatnonzero(first[k])
    found = []
    for a, b in zip(begins, np.append(begins[1:], len(k)), strict=True):
        unit = flat[ends[a] : ends[b]].tobytes()
        if len(unit) < 6 or unit[:3] != b"\0\0\1":
            out.counts["transport_errors"] += 1
            continue
        size, at, time = struct.unpack(">H", unit[4:6])[0], 6, None
        if unit[3] not in BARE and len(unit) >= 9:
            at = 9 + unit[8]
            if unit[7] & 0x80 and len(unit) >= 14:
                x, y, z = struct.unpack(">BHH", unit[9:14])
                time = (x >> 1 & 7) << 30 | y >> 1 << 15 | z >> 1
        stop = 6 + size if size else len(unit)
        complete = not gap[a + 1 : b].any() and not (b < len(k) and gap[b]) and at <= stop <= len(unit)
        data = unit[at:stop]
        out.stamps.append((of, time, int(k[a]), len(data), bool(flags[k[a]] & 0x40), complete))
        if complete:
            found.append(data)
    return found


def clipped(data: bytes, stamps: list[dict], begin: int, end: int) -> bytes:
    """Payload of the elementary packets presented in [begin, end) ticks, read
    from the last random-access point that is not after ``begin``."""
    known = [s for s in stamps if s["pts"] is not None]
    before = [s["packet"] for s in known if s["random_access"] and s["pts"] <= begin]
    start = max(before) if before else min((s["packet"] for s in known), default=0)
    later = [s["packet"] for s in known if s["random_access"] and s["pts"] >= end and s["packet"] > start]
    stop = min(later) if later else len(data) // PACKET
    # the tables stand before a random-access point
    tables = max(0, start - 2)
    part, size = demux(data[tables * PACKET : stop * PACKET]), []
    at = 0
    for _, time, _, length, _, complete in part.stamps:
        if complete:
            if time is not None and begin <= time < end:
                size.append(part.payload[at : at + length])
            at += length
    return b"".join(size)


# ---- columns ----


def _sized(rows: Iterator[tuple[int, tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH`` bytes."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _muxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in parts(batches):
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                media = mux(padded((text.as_py() or "").encode()))
                yield len(media), (doc.as_py(), media)

    yield from _sized(rows(), ["doc_id", "media"], [pa.int64(), pa.binary()])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the stream of every document's text, filled up to whole units."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_muxed, "doc_id long, media binary")


_STAMP = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("packet", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_()), ("complete", pa.bool_())])
_PROGRAM = pa.struct([("program", pa.int32()), ("table_pid", pa.int32()), ("clock_pid", pa.int32()), ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32())])))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in parts(batches):
        for doc, media in zip(b.column("doc_id"), b.column("media"), strict=True):
            data = media.as_py() or b""
            yield doc.as_py(), data, demux(data)


def _as_columns(s: Stream) -> tuple:
    programs = [dict(zip(("program", "table_pid", "clock_pid", "streams"), (p, t, c, [{"pid": a, "type": b} for a, b in streams]), strict=True)) for p, (t, c, streams) in sorted(s.programs.items())]
    stamps = [dict(zip(("pid", "pts", "packet", "length", "random_access", "complete"), x, strict=True)) for x in s.stamps]
    return programs, stamps, *(s.counts[c] for c in COUNTS)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "media", "payload", "programs", "stamps", *COUNTS]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(_PROGRAM), pa.list_(_STAMP), *[pa.int64()] * len(COUNTS)]
    rows = ((2 * len(data), (doc, data, s.payload, *_as_columns(s))) for doc, data, s in _read(batches))
    yield from _sized(rows, names, types)


def parsed(media: DataFrame) -> DataFrame:
    """The streams with their payload, programs, times and faults."""
    return media.select("doc_id", "media").mapInArrow(_parsed, PARSED)


def stamps(streams: DataFrame) -> DataFrame:
    """One row an elementary packet of ``parsed`` streams: times, places and random-access points."""
    return streams.select("doc_id", F.explode("stamps").alias("s")).select("doc_id", "s.*")


def clip(streams: DataFrame, begin: int, end: int) -> DataFrame:
    """(doc_id, clip): the payload presented in a span of time of ``parsed`` streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts(batches):
                for doc, media, at in zip(b.column("doc_id"), b.column("media"), b.column("stamps"), strict=True):
                    out = clipped(media.as_py() or b"", at.as_py() or [], begin, end)
                    yield len(out), (doc.as_py(), out)

        yield from _sized(rows(), ["doc_id", "clip"], [pa.int64(), pa.binary()])

    return streams.select("doc_id", "media", "stamps").mapInArrow(run, "doc_id long, clip binary")


def _features(s: Stream) -> str:
    points = [x for x in s.stamps if x[4]]
    times = [x[1] for x in s.stamps if x[1] is not None]
    kinds = ",".join(f"{p}:{kind}" for _, _, streams in s.programs.values() for p, kind in streams)
    return (
        f"programs={len(s.programs)} streams={kinds} packets={len(s.stamps)} random_access={len(points)} "
        f"first={min(times, default='')} last={max(times, default='')} damaged={sum(not x[5] for x in s.stamps)} "
        + " ".join(f"{c}={s.counts[c]}" for c in COUNTS)
    )


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_random_access long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]

    def rows():
        for doc, data, s in _read(batches):
            p = s.payload
            yield 256, (
                doc, len(p.rstrip(FILL)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(),
                _features(s), len(data) // PACKET, sum(x[4] for x in s.stamps),
            )

    yield from _sized(rows(), names, types)


def digests(docs: DataFrame) -> DataFrame:
    """Stores the stream of every text as a column, reads it back and gives
    checksums and features of what was read."""
    media = written(stored(docs), compression="zstd")
    return media.mapInArrow(_digests, DIGESTS)

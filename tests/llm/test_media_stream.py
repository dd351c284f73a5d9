import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import media_stream as M
from folioscope.llm.queries import op11_media_stream

COLUMNS = "doc_id long, text string"
LONG = "A longer text with ünïcode. " * 12_000


def plain(data):
    """A slow reader of well-formed streams, byte by byte."""
    tables, times, units, last, current = {}, [], [], {}, None
    for at in range(0, len(data), 188):
        p = data[at : at + 188]
        assert p[0] == 0x47
        pid, start, adapted = (p[1] & 31) * 256 + p[2], p[1] & 64, p[3] & 32
        body = p[5 + p[4] :] if adapted else p[4:]
        assert p[3] & 15 == (last.get(pid, -1) + 1) % 16
        last[pid] = p[3] & 15
        if pid == 0:
            tables[(body[9] << 8) + body[10]] = ((body[11] & 31) << 8) + body[12]
        elif pid in tables.values():
            stream = ((body[14] & 31) << 8) + body[15]
        else:
            assert pid == stream
            if start:
                assert body[:4] == b"\0\0\1\xbd"
                t = body[9:14]
                times.append((((t[0] >> 1) & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1, at // 188, bool(adapted and p[4] and p[5] & 64)))
                units.append([body[4] * 256 + body[5] - 8, body[14:]])
            else:
                units[-1][1] += body
    assert all(n == len(b) for n, b in units)
    return b"".join(b for _, b in units), times


@pytest.mark.parametrize("n", [1, 575, 576, 577, 150, 576 * 32, 576 * 32 + 1, 576 * 32 * 4, 576 * 32 * 9 + 5])
def test_round_trip_against_plain_reader(n):
    payload = M.padded(bytes(k * 7 % 251 for k in range(n)))
    media = M.mux(payload)
    read = M.demux(media)
    data, times = plain(media)
    assert read.payload == data == payload and not any(read.counts.values())
    assert [(s[1], s[2], s[4]) for s in read.stamps] == times and all(s[5] for s in read.stamps)
    assert [s[4] for s in read.stamps] == [k % M.ACCESS == 0 for k in range(len(times))]
    assert [s[1] for s in read.stamps] == [k * 32 * 576 * 90_000 // 48_000 for k in range(len(times))]
    assert read.programs == {1: (M.TABLE_PID, M.STREAM_PID, [(M.STREAM_PID, 6)])}


def test_checksum_of_sections():
    assert M.section_crc(b"123456789") == 0x0376E6E7  # the published check value
    assert M.section_crc(M._tables()[0]) == 0


def test_lost_packet_is_an_error_and_damages_its_unit():
    media = M.mux(M.padded(b"x" * 576 * 32 * 6))
    whole = M.demux(media)
    at = whole.stamps[1][2] + 5
    read = M.demux(media[: at * 188] + media[(at + 1) * 188 :])
    assert read.counts["continuity_errors"] == 1
    assert [s[5] for s in read.stamps] == [True, False, True, True, True, True]
    assert len(read.payload) == 576 * 32 * 5


def test_repeated_packet_garbage_and_bad_checksum():
    media = M.mux(M.padded(b"abc" * 30_000))
    again = media[: 7 * 188] + media[6 * 188 :]
    read = M.demux(again)
    assert (read.counts["duplicates"], read.counts["continuity_errors"], read.payload) == (1, 0, M.padded(b"abc" * 30_000))
    read = M.demux(b"\0noise" + media[: 10 * 188] + b"more noise" + media[10 * 188 :])
    assert read.counts["skipped_bytes"] == 16 and read.payload == M.padded(b"abc" * 30_000)
    broken = bytearray(media)
    broken[188 + 10] ^= 1  # the map table, repeated later
    read = M.demux(bytes(broken))
    assert read.counts["table_errors"] == 1 and read.programs
    assert M.demux(b"").payload == M.demux(b"\x47" * 100).payload == b""


def test_joining_at_a_random_access_point():
    payload = M.padded(bytes(k % 255 for k in range(576 * 32 * 10)))
    media = M.mux(payload)
    point = [s for s in M.demux(media).stamps if s[4]][1]
    assert M.demux(media[(point[2] - 2) * 188 :]).payload == payload[4 * 576 * 32 :]


def test_several_programs_and_sections_over_packets():
    body = b"".join(M.struct.pack(">HH", p, 0xE000 | 0x200 + p) for p in range(1, 101))
    section = b"\0" + M._section(0, 1, body)
    tables = [section[k : k + 184].ljust(184, b"\xff") for k in range(0, len(section), 184)]
    data = b"".join(M._packet(0, k == 0, k, b"", t) for k, t in enumerate(tables))
    for p in (3, 77):
        program = M.struct.pack(">HHBHHBHH", 0xE111, 0xF000, 0x1B, 0xE300 + p, 0xF000, 0x0F, 0xE400 + p, 0xF000)
        data += M._packet(0x200 + p, True, 0, b"", (b"\0" + M._section(2, p, program)).ljust(184, b"\xff"))
    unit = b"\0\0\1\xe0\0\0\x80\0\0payload"
    data += M._packet(0x303, True, 4, b"", unit)
    read = M.demux(data)
    assert read.programs == {p: (0x200 + p, 0x111, [(0x300 + p, 27), (0x400 + p, 15)]) for p in (3, 77)}
    assert read.payload == b"payload" and read.stamps == [(0x303, None, 5, 7, False, True)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_any_bytes_are_read(data):
    M.demux(data)
    M.demux(M.mux(M.padded(data))[:-188] + data)
    assert M.demux(M.mux(M.padded(data))).payload == M.padded(data)


TEXTS = [None, "", "a", "a", "é" * 288, "é" * 289, LONG, "\x00\n", "漢字😀"]


def test_columns(spark):
    d = spark.createDataFrame([*enumerate(TEXTS), (2, "a"), (None, "no id")], COLUMNS).withColumn("media", F.lit("clash")).repartition(3)
    rows = sorted(M.digests(d).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert len(rows) == 11 and rows[0].doc_id is None
    by = {r.doc_id: r for r in rows}
    for k, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes == len(M.mux(payload)) == r.n_packets * 188
        assert r.media_sha256 == hashlib.sha256(M.mux(payload)).hexdigest() and "damaged=0 continuity_errors=0" in r.feature
    assert by[2][1:] == by[3][1:] and by[0][1:] == by[1][1:]
    assert M.digests(d.limit(0)).count() == 0


def test_stamps_and_clip(spark):
    d = spark.createDataFrame([(1, LONG), (2, "short"), (3, None)], COLUMNS)
    streams = M.parsed(M.stored(d)).cache()
    table = M.stamps(streams)
    assert table.where("doc_id = 1").count() == -(-len(LONG.encode()) // (576 * 32))
    assert table.where("random_access and doc_id = 1").count() == 5
    assert all(r.complete for r in table.collect())
    unit = 32 * 576 * 90_000 // 48_000
    out = {r.doc_id: r.clip for r in M.clip(streams, 6 * unit, 8 * unit).collect()}
    assert out == {1: LONG.encode()[6 * 18432 : 8 * 18432], 2: b"", 3: b""}


def test_query_over_the_table(spark):
    rows = {r.doc_id: r for r in op11_media_stream(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].payload_sha256) == (len(raw), hashlib.sha256(payload).hexdigest())

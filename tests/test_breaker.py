"""Breakers of a stream against a replay of all calls in order."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.providers import Breaker
from folioscope.streaming import breaker as B


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in B.CONF}
    for k, v in B.CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def replay(calls):
    out, held = {}, {}
    for key, i, at, ok, optional in sorted(calls, key=lambda c: (c[2], c[1])):
        b = held.setdefault(key, Breaker(5, 120))
        if not b.allows(at, optional):
            out[i] = ("refused", b.failures)
            continue
        was = (b.failures, b.until)
        b.record(ok, at, optional)
        verdict = ("closed" if any(was) else "ok") if ok else "opened" if b.until > was[1] else "failed"
        out[i] = (verdict, b.failures)
    return out


def test_stream_equals_replay_over_a_restart(stateful, tmp_path):
    spark, r = stateful, random.Random(1)
    calls = [(f"k{r.randint(0, 3)}", i, 1_000_000 + r.randint(0, 6000), r.random() < 0.2, r.random() < 0.15) for i in range(600)]
    calls.sort(key=lambda c: c[2] + r.randint(-200, 200))  # some come late
    parts = [calls[:200], calls[200:400], calls[400:], [("end", -1, 2_000_000, True, False)], [("end", -2, 3_000_000, True, False)]]
    schema = "key string, id long, at long, ok boolean, optional boolean"

    def put(part):
        spark.createDataFrame(part, schema).select("key", "id", F.timestamp_seconds("at").alias("ts"), "ok", "optional").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema("key string, id long, ts timestamp, ok boolean, optional boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = B.judged(source, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    for part in parts[:2]:
        put(part)
    run()
    some = spark.read.parquet(str(tmp_path / "out")).count()
    for part in parts[2:]:
        put(part)
    run()
    got = {r.id: (r.verdict, r.failures) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key != "end"}
    assert 0 < some < len(got) == 600 and got == replay(calls)
    assert {v for v, _ in got.values()} == {"ok", "failed", "refused", "opened", "closed"}

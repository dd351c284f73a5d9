"""A circuit breaker for each key of a stream of calls, as keyed state with timers.

After ``LIMIT`` failures of a key in a row its breaker opens for ``SECONDS``:
calls in that time are refused, and what they would have given does not count.
After it the next call is let through; if it fails, the breaker opens again, a
success closes it. Optional calls are never refused, and their failures do not
count.

Calls wait in the state until the watermark has passed them, so that calls of
several batches are judged in order of time; a timer of event time wakes them.
The state of a key goes when nothing waits and its breaker is closed. Verdicts
are those of a replay of all calls in order, also over a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIMIT, SECONDS = 5, 120
JUDGED = "key string, id long, ts timestamp, verdict string, failures int, open_until timestamp"


class _Breakers(StatefulProcessor):
    def __init__(self, limit: int, seconds: int):
        self.limit, self.cooldown = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, ok boolean, optional boolean")
        self.breaker = handle.getValueState("breaker", "failures int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, last = [], 0
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            calls += list(zip(at.tolist(), part["id"].tolist(), part["ok"].tolist(), part["optional"].tolist(), strict=True))
        if calls:
            self.waiting.appendList(calls)
            last = max(c[0] for c in calls)
            self.handle.registerTimer(-(-last // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until_now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = [tuple(c) for c in self.waiting.get()] if self.waiting.exists() else []
        failures, until = tuple(self.breaker.get()) if self.breaker.exists() else (0, 0)
        out = []
        for at, i, ok, optional in sorted(c for c in waiting if c[0] <= until_now):
            if not optional and at < until:
                verdict = "refused"
            elif ok:
                verdict = "closed" if failures or until else "ok"
                failures, until = 0, 0
            else:
                verdict = "failed"
                if not optional:
                    failures += 1
                    if failures >= self.limit and at >= until:
                        verdict, until = "opened", at + self.cooldown
            out.append((key[0], i, at, verdict, failures, until or None))
        left = [c for c in waiting if c[0] > until_now]
        self.waiting.put(left) if left else self.waiting.clear()
        self.breaker.update((failures, until)) if failures or until else self.breaker.clear()
        if out:
            made = pd.DataFrame(out, columns=["key", "id", "ts", "verdict", "failures", "open_until"])
            made["ts"], made["open_until"] = (pd.to_datetime(made[c], unit="us") for c in ("ts", "open_until"))
            yield made.astype({"failures": "int32"})

    def close(self) -> None:
        pass


def judged(calls: DataFrame, late: str = "10 minutes", limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """(key, id, ts, verdict, failures, open_until) of a stream of calls (key,
    id, ts, ok, optional): ok, failed, refused, opened or closed. The stream
    needs the state store that keeps timers, see ``CONF``."""
    keyed = calls.selectExpr("key", "id", "ts", "ok", "optional").withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(_Breakers(limit, seconds), JUDGED, "append", "eventTime")


#: Settings of the session in which ``judged`` runs.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

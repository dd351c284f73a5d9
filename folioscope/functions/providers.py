"""Language-model steps behind a provider, and a deterministic offline one."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 768
#: Rows whose vectors are made at once.
ROWS = 512
#: A prompt begins with its task on a line of its own.
TASK = "TASK "
#: A run without an end mark is passed at once; only those with one are sentences.
RUN = re.compile(r"[^.!?\n]+[.!?]?")
WORD = re.compile(r"[a-z0-9]+")
#: The tags that the offline provider gives.
TAGS = ["infra", "retention", "vector", "ops", "theory", "index", "research"]


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...
    def complete(self, prompt: str) -> str: ...


def ended(text: str) -> Iterator[str]:
    """The sentences of a text that have an end mark, in time linear in it."""
    return (s for s in map(re.Match.group, RUN.finditer(text)) if s[-1] in ".!?")


@functools.lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    """Twice the bucket of a word, one more if its sign is negative."""
    h = hashlib.md5(word.encode()).digest()
    return int.from_bytes(h[:4], "big") % DIM * 2 + 1 - (h[4] & 1)


def _place(word: str) -> tuple[int, float]:
    k, negative = divmod(_code(word), 2)
    return k, -1.0 if negative else 1.0


class Offline:
    """Hashed bags of words as vectors, and canned answers that follow the text."""

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """Of texts without words, or whose words cancel each other, none."""
        return [None if v is None else v.tolist() for v in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> list[np.ndarray | None]:
        """``embed`` as arrays, which need no list of numbers."""
        return list(map(self._direction, texts))

    def _direction(self, text: str) -> np.ndarray | None:
        v = self._sums(text or "")
        n = np.sqrt(v @ v)
        return v / n if n else None

    @staticmethod
    def _sums(text: str) -> np.ndarray:
        """The signed counts of words by bucket."""
        n = np.bincount(np.fromiter(map(_code, WORD.findall(text[:32_000].lower())), np.int64), minlength=2 * DIM)
        return (n[::2] - n[1::2]).astype(np.float64)

    @classmethod
    def vector(cls, text: str) -> np.ndarray:
        """A vector of any text; one without a direction has the first bucket."""
        v = cls._sums(text)
        n = np.sqrt(v @ v)
        if n == 0:
            v[0] = n = 1.0
        return v / n

    def complete(self, prompt: str) -> str:
        """JSON for the prompt's task; without one tags, summary and category.
        What is not quoted from the prompt follows from its digest."""
        if prompt.startswith(TASK):
            head, _, body = prompt.partition("\n")
            return json.dumps(getattr(self, "_" + head.removeprefix(TASK))(body))
        h = hashlib.md5(prompt.encode()).digest()
        return json.dumps({"tags": sorted({TAGS[b % len(TAGS)] for b in h[:3]}), "summary": f"summary {h[:4].hex()}", "category": TAGS[h[5] % len(TAGS)]})


    @staticmethod
    def _digest(body: str) -> str:
        return hashlib.md5(body.encode()).hexdigest()

    def _claims(self, body: str) -> dict:
        """The first three sentences."""
        return {"claims": [{"text": s.strip()} for s in itertools.islice(ended(body), 3)]}

    def _verdict(self, body: str) -> dict:
        """A quarter of the pairs contradict each other."""
        h = self._digest(body)
        return {"contradiction": h[0] in "0123", "severity": ("low", "medium", "high")[int(h[1], 16) % 3], "explanation": f"they differ in {h[2:8]}"}

    def _decay(self, body: str) -> dict:
        h = self._digest(body)
        return {"stale": h[0] in "01234567", "reason": f"checked {h[2:8]}"}

    def _rewrite(self, body: str) -> dict:
        """The question with the last line of its history."""
        history, _, question = body.rpartition("\nQuestion: ")
        return {"question": f"{question} ({history.rsplit(chr(10), 1)[-1]})"}

    def _distil(self, body: str) -> dict:
        return {"title": f"Synthesis {self._digest(body)[:6]}", "body": next(ended(body), "").strip()}

    def stream(self, prompt: str) -> Iterator[str]:
        """The words of a reply, one at a time."""
        yield from re.findall(r"\S+\s*", self.complete(prompt))


def task_prompt(task: str, *parts: Column) -> Column:
    """A prompt for a task from columns of text, one after another."""
    return F.concat(F.lit(f"{TASK}{task}\n"), *parts)


def _listed(vectors: list) -> pa.Array:
    """Vectors, lists or arrays, as a column."""
    size = np.array([0 if v is None else len(v) for v in vectors], np.int64)
    flat = [np.asarray(v, np.float64) for v in vectors if v is not None]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    none = pa.array([v is None for v in vectors], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0)), mask=none)


def embedded(rows: DataFrame, text: str, provider: Callable[[], Provider] = Offline, name: str = "vector", batch: int = 32) -> DataFrame:
    """``rows`` without the text and with its vector; blank texts have none.

    The provider is made once a task and asked in batches.
    """
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != text) + f", `{name}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = provider()
        # who embeds otherwise is asked for that
        ask = p.arrays if getattr(type(p), "embed", None) is Offline.embed else p.embed
        # a few rows at a time, so that no batch of vectors is large
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = [t or "" for t in b.column(text).to_pylist()]
            vectors = [v for k in range(0, len(texts), batch) for v in ask(texts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [_listed(vectors)], [*kept, name])

    return rows.mapInArrow(run, schema)


def json_object(reply: str) -> dict | None:
    """The first JSON object in a reply: all of it, a fenced block, or balanced braces."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", reply, re.S)
    for candidate in (reply, fenced[1] if fenced else ""):
        try:
            if isinstance(found := json.loads(candidate), dict):
                return found
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", reply):
        try:
            found, _ = decoder.raw_decode(reply[m.start() :])
            return found
        except ValueError:
            continue
    return None


def completed(rows: DataFrame, prompt: str, provider: Callable[[], Provider] = Offline, name: str = "reply") -> DataFrame:
    """``rows`` with the provider's JSON answer to a prompt column, null if none; a
    null prompt is not asked."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = provider()
        for b in batches:
            found = [None if t is None else json_object(p.complete(t)) for t in b.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if f is None else json.dumps(f) for f in found], pa.string())], [*b.schema.names, name])

    return rows.mapInArrow(run, schema)


class Breaker:
    """Opens after consecutive failures and lets calls through again later; the
    first of these opens it again if it fails, a success closes it."""

    def __init__(self, limit: int = 5, seconds: float = 120.0):
        self.limit, self.seconds, self.failures, self.until = limit, seconds, 0, 0.0

    def allows(self, now: float, optional: bool = False) -> bool:
        return optional or now >= self.until

    def record(self, ok: bool, now: float, optional: bool = False) -> None:
        if ok:
            self.failures, self.until = 0, 0.0
        elif not optional:
            self.failures += 1
            if self.failures >= self.limit and now >= self.until:
                self.until = now + self.seconds

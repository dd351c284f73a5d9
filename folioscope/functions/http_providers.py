"""Providers that ask a model server over HTTP.

Only the local host is asked unless remote servers are allowed, and those only
over HTTPS. Objects hold settings alone, so tasks can make their own.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

LOCAL = {"localhost", "127.0.0.1", "::1"}


def checked_url(url: str, remote: bool = False) -> str:
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"no web address: {url}")
    if parts.hostname not in LOCAL:
        if not remote:
            raise ValueError(f"remote servers are not allowed: {parts.hostname}")
        if parts.scheme != "https":
            raise ValueError(f"remote servers are asked over https: {url}")
    return url.rstrip("/")


@dataclass(frozen=True)
class _Server:
    url: str
    model: str
    embedding_model: str
    seconds: float = 60.0
    remote: bool = False
    key: str = ""

    def __post_init__(self):
        object.__setattr__(self, "url", checked_url(self.url, self.remote))

    def __call__(self):
        """A server is its own factory."""
        return self

    def _open(self, path: str, body: dict | None = None):
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url + path, None if body is None else json.dumps(body).encode(), headers)
        return urllib.request.urlopen(request, timeout=self.seconds)

    def post(self, path: str, body: dict) -> dict:
        with self._open(path, body) as r:
            return json.load(r)

    def get(self, path: str) -> dict:
        with self._open(path) as r:
            return json.load(r)

    def _lines(self, path: str, body: dict) -> Iterator[dict]:
        """Objects of a streamed reply, one a line, with or without ``data:``."""
        with self._open(path, body) as r:
            for raw in r:
                line = raw.decode("utf-8", "replace").strip().removeprefix("data:").strip()
                if line and line != "[DONE]":
                    yield json.loads(line)

    def _vectors(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """Unit vectors; blank texts and those the server fails on have none."""
        asked = [k for k, t in enumerate(texts) if t and t.strip()]
        out: list[list[float] | None] = [None] * len(texts)
        try:
            found = self._vectors([texts[k][:32_000] for k in asked]) if asked else []
        except (OSError, ValueError, KeyError):
            return out
        for k, v in zip(asked, found, strict=False):
            size = sum(x * x for x in v) ** 0.5
            out[k] = [x / size for x in v] if size else list(v)
        return out


class LocalServer(_Server):
    """The interface with ``/api/generate`` and ``/api/embed``."""

    def _vectors(self, texts):
        try:
            return self.post("/api/embed", {"model": self.embedding_model, "input": texts})["embeddings"]
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
        # servers that know one text a call
        return [self.post("/api/embeddings", {"model": self.embedding_model, "prompt": t})["embedding"] for t in texts]

    def models(self) -> list[str]:
        return [m["name"] for m in self.get("/api/tags").get("models", [])]

    def stream(self, prompt: str) -> Iterator[str]:
        for part in self._lines("/api/generate", {"model": self.model, "prompt": prompt, "stream": True}):
            if part.get("response"):
                yield part["response"]

    def complete(self, prompt: str) -> str:
        try:
            return self.post("/api/generate", {"model": self.model, "prompt": prompt, "stream": False})["response"]
        except (OSError, ValueError, KeyError):
            return ""


class ChatServer(_Server):
    """The interface with ``/v1/chat/completions`` and ``/v1/embeddings``."""

    def models(self) -> list[str]:
        return [m["id"] for m in self.get("/v1/models").get("data", [])]

    def stream(self, prompt: str) -> Iterator[str]:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": True}
        for part in self._lines("/v1/chat/completions", body):
            if piece := ((part.get("choices") or [{}])[0].get("delta") or {}).get("content"):
                yield piece

    def _vectors(self, texts):
        rows = self.post("/v1/embeddings", {"model": self.embedding_model, "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    def complete(self, prompt: str) -> str:
        try:
            return self.post("/v1/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}]})["choices"][0]["message"]["content"]
        except (OSError, ValueError, KeyError, IndexError):
            return ""

"""The engine over HTTP and as a tool server, with the standard library alone."""

from __future__ import annotations

import hmac
import json
import time
from collections import defaultdict, deque
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import functions as F

from folioscope.engine import Engine
from folioscope.sources.config import clamp

PROTOCOL = "2024-11-05"


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


class Service:
    """Operations on one question each; inputs are checked, results are small."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def _asked(self, question: Any):
        if not isinstance(question, str) or not question.strip():
            raise ValueError("question must be a text")
        return self.engine.spark.createDataFrame([(1, question.strip())], "query_id long, question string")

    def search(self, question: str, top_k: Any = None, category: str | None = None, formats: list[str] | tuple = (), tags: list[str] | tuple = ()) -> list[dict]:
        return _rows(self.engine.search(self._asked(question), clamp(top_k), category=category, formats=formats, tags=tags).orderBy("rank"))

    def ask(self, question: str, top_k: Any = None, category: str | None = None, formats: list[str] | tuple = (), tags: list[str] | tuple = ()) -> dict:
        return _rows(self.engine.ask(self._asked(question), clamp(top_k), category=category, formats=formats, tags=tags))[0]

    def note(self, note: Any) -> dict | None:
        """By id, or by exact title."""
        n = self.engine.notes
        found = n.where(F.col("id") == int(note)) if str(note).isdigit() else n.where(F.col("title") == str(note))
        rows = _rows(found.orderBy("id").limit(1).select("id", "path", "title", "category", "format", "text"))
        return rows[0] if rows else None

    def connect(self, note: Any) -> list[dict]:
        return _rows(self.engine.connect().where(F.col("src") == int(note)).orderBy("rank"))

    def categories(self) -> list[dict]:
        return _rows(self.engine.categories().orderBy("node"))

    def health(self) -> dict:
        return {"status": "ok"} | self.engine.available()


_TEXT = {"type": "string"}
_SEARCH = {"type": "object", "properties": {"question": _TEXT, "top_k": {"type": "integer"}, "category": _TEXT, "formats": {"type": "array", "items": _TEXT}, "tags": {"type": "array", "items": _TEXT}}, "required": ["question"]}
_NOTE = {"type": "object", "properties": {"note": _TEXT}, "required": ["note"]}
TOOLS = {
    "ask": ("Answer a question from the notes.", _SEARCH),
    "search": ("Find passages of the notes.", _SEARCH),
    "note": ("Read a note by id or title.", _NOTE),
    "connect": ("Notes near a note.", _NOTE),
    "categories": ("The tree of categories with counts.", {"type": "object", "properties": {}}),
}


class ToolServer:
    """Answers JSON-RPC requests: initialize, ping, tools/list, tools/call."""

    def __init__(self, service: Service):
        self.service = service

    def handle(self, request: dict) -> dict | None:
        """The reply to a request; None to a notification."""
        if "id" not in request:
            return None
        try:
            return {"jsonrpc": "2.0", "id": request["id"], "result": self._result(request.get("method"), request.get("params") or {})}
        except LookupError as e:
            return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": str(e.args[0])}}
        except (TypeError, ValueError) as e:
            return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32602, "message": str(e)}}

    def _result(self, method: str | None, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "folioscope"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}
        if method == "tools/call":
            if params.get("name") not in TOOLS:
                raise LookupError(f"unknown tool: {params.get('name')}")
            found = getattr(self.service, params["name"])(**(params.get("arguments") or {}))
            return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}]}
        raise LookupError(f"unknown method: {method}")

    def lines(self, read, write) -> None:
        """Serve requests of one line each until the input ends."""
        for line in read:
            try:
                request = json.loads(line)
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            else:
                reply = self.handle(request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
            if reply is not None:
                write.write(json.dumps(reply) + "\n")
                write.flush()


class Limit:
    """Refuses a client with ``most`` failures within ``seconds``."""

    def __init__(self, most: int = 10, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.failures: dict[str, deque] = defaultdict(deque)

    def refuses(self, client: str) -> bool:
        held = self.failures[client]
        while held and held[0] <= self.clock() - self.seconds:
            held.popleft()
        return len(held) >= self.most

    def failed(self, client: str) -> None:
        self.failures[client].append(self.clock())


def route(service: Service, method: str, path: str, body: dict) -> tuple[int, Any]:
    """Status and JSON of a request."""
    try:
        if (method, path) == ("GET", "/api/health"):
            return 200, service.health()
        if (method, path) == ("GET", "/api/categories"):
            return 200, service.categories()
        if method == "GET" and path.startswith("/api/notes/"):
            found = service.note(path.removeprefix("/api/notes/"))
            return (200, found) if found else (404, {"error": "no such note"})
        if method == "POST" and path in ("/api/search", "/api/ask"):
            return 200, getattr(service, path.rsplit("/", 1)[-1])(**body)
    except (TypeError, ValueError) as e:
        return 400, {"error": str(e)}
    return 404, {"error": "no such path"}


def server(service: Service, host: str = "127.0.0.1", port: int = 0, key: str | None = None, limit: Limit | None = None) -> ThreadingHTTPServer:
    """An HTTP server, not yet running; with a key, requests must bear it."""
    limit = limit or Limit()

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, found: Any) -> None:
            raw = json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _serve(self) -> None:
            client = self.client_address[0]
            if limit.refuses(client):
                return self._reply(429, {"error": "too many failures"})
            if key is not None and not hmac.compare_digest((self.headers.get("Authorization") or "").encode(), f"Bearer {key}".encode()):
                limit.failed(client)
                return self._reply(401, {"error": "no access"})
            try:
                size = min(int(self.headers.get("Content-Length") or 0), 1 << 20)
                body = json.loads(self.rfile.read(size) or b"{}") if size else {}
                if not isinstance(body, dict):
                    raise ValueError
            except ValueError:
                return self._reply(400, {"error": "no JSON object"})
            return self._reply(*route(service, self.command, self.path.split("?")[0], body))

        do_GET = do_POST = _serve  # noqa: N815

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from folioscope.functions import providers as P
from folioscope.functions.http_providers import ChatServer, LocalServer, checked_url


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        out = {
            "/api/embed": lambda: {"embeddings": [[3.0, 4.0] for _ in body["input"]]},
            "/v1/embeddings": lambda: {"data": [{"index": k, "embedding": [float(k), 1.0]} for k in reversed(range(len(body["input"])))]},
            "/api/generate": lambda: {"response": '{"answer": "local"}'},
            "/v1/chat/completions": lambda: {"choices": [{"message": {"content": "well: {\"answer\": \"chat\"}"}}]},
        }[self.path]()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_servers(spark, url):
    d = spark.createDataFrame([(1, "a"), (2, ""), (3, "b")], "id long, t string")
    got = {r.id: r.vector for r in P.embedded(d, "t", LocalServer(url, "m", "e")).collect()}
    assert got == {1: [0.6, 0.8], 2: None, 3: [0.6, 0.8]}
    assert ChatServer(url, "m", "e").embed(["x", "y"])[0] == [0.0, 1.0]
    assert {r.reply for r in P.completed(d, "t", ChatServer(url, "m", "e")).collect()} == {'{"answer": "chat"}'}
    assert P.json_object(LocalServer(url, "m", "e").complete("p")) == {"answer": "local"}


def test_failures_give_nothing():
    down = LocalServer("http://127.0.0.1:9", "m", "e", seconds=1)
    assert down.embed(["x"]) == [None] and down.complete("x") == ""


def test_addresses():
    assert checked_url("http://localhost:1/") == "http://localhost:1"
    assert checked_url("https://example.org", remote=True)
    for bad, remote in (("http://example.org", False), ("https://example.org", False), ("http://example.org", True), ("ftp://localhost", True), ("x", False)):
        with pytest.raises(ValueError):
            checked_url(bad, remote)


class Old(BaseHTTPRequestHandler):
    """A server without batches, that streams and lists its models."""

    def _send(self, status, text):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(text.encode())

    def do_GET(self):
        self._send(200, json.dumps({"/api/tags": {"models": [{"name": "m:latest"}]}, "/v1/models": {"data": [{"id": "c"}]}}[self.path]))

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/api/embeddings":
            return self._send(200, json.dumps({"embedding": [float(len(body["prompt"])), 0.0]}))
        if self.path == "/api/generate" and body["stream"]:
            return self._send(200, '{"response": "a "}\n{"response": "b"}\n{"done": true}\n')
        if self.path == "/v1/chat/completions" and body["stream"]:
            return self._send(200, 'data: {"choices": [{"delta": {"content": "x"}}]}\n\ndata: {"choices": [{"delta": {}}]}\n\ndata: [DONE]\n')
        return self._send(404, "{}")

    def log_message(self, *args):
        pass


def test_single_texts_streams_and_model_lists():
    from folioscope.operators.answer import streamed

    server = HTTPServer(("127.0.0.1", 0), Old)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    local, chat = LocalServer(at, "m", "e"), ChatServer(at, "c", "e")
    assert local.embed(["ab", " ", "c"]) == [[1.0, 0.0], None, [1.0, 0.0]] and chat.embed(["ab"]) == [None]
    assert local.models() == ["m:latest"] and chat.models() == ["c"]
    assert list(streamed(local, "p")) == [("token", "a "), ("token", "b"), ("done", "a b")] and list(chat.stream("p")) == ["x"]
    server.shutdown()

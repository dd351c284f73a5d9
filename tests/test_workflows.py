"""Operations of the engine over several steps."""

import json
import shutil
import subprocess
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from folioscope.engine import Engine
from folioscope.functions.providers import Offline
from folioscope.operators import answer, catalog, mirror, store
from folioscope.operators.preflight import preflight
from folioscope.serve import Limit, Service, ToolServer, route, server
from folioscope.sources import files
from folioscope.sources.config import Settings, dump_taxonomy, load_taxonomy
from folioscope.sources.threads import Threads
from folioscope.sources.vault import scan
from folioscope.streaming.jobs import Lock, Periodic, due

NOW = None


@pytest.fixture(autouse=True, scope="module")
def now(spark):
    global NOW
    NOW = F.lit("2025-02-01").cast("timestamp")


class Opposed(Offline):
    """Everything that is compared contradicts; the same vector for all claims."""

    def embed(self, texts):
        return [[1.0, 0.0] if t and "fails" not in t else None for t in texts]

    def _verdict(self, body):
        return {"contradiction": True, "severity": "high", "explanation": "x" * 400}


def notes(spark, rows):
    return spark.createDataFrame(rows, "id long, path string, title string, content_hash string, text string")


def filled(spark, root, rows, provider=Opposed):
    e = Engine(spark, root, Settings(claim_threshold=0.5), provider, "m")
    e.tables.replace("notes", notes(spark, rows))
    return e


def test_contradictions_from_reading_to_settling(spark, tmp_path):
    rows = [(1, "a.md", "A", "h1", "The gate is open. More."), (2, "b.md", "B", "h2", "Intro.\n\nThe gate is shut."), (3, "c.md", "C", "h3", "no sentence here"), (4, "d.md", "D", "h4", "This fails.")]
    e = filled(spark, str(tmp_path / "i"), rows)
    first = e.mirror(NOW)
    assert first == {"notes_scanned": 4, "claims_extracted": 5, "pairs_checked": first["pairs_checked"], "contradictions_found": first["pairs_checked"]} and first["pairs_checked"] >= 2
    c = {r.claim_text: r for r in e.claims.collect()}
    assert c["The gate is shut."].char_start == 8 and c["This fails."].vector is None and c["The gate is open."].vector
    open_ = e.listed().collect()
    assert all(r.severity == "high" and r.note_a != r.note_b for r in open_) and len(e.contradictions.first().explanation) == 300
    # nothing changed: nothing is read, also not the note without claims
    assert e.mirror(NOW)["notes_scanned"] == 0
    shown = e.show(open_[0].id).first()
    assert {shown.paragraph_a, shown.paragraph_b} <= {"The gate is open. More.", "Intro.", "The gate is shut."}
    e.settle(spark.createDataFrame([(open_[0].id,)], "id long"), "dismissed", NOW)
    assert e.mirror(NOW, full=True)["contradictions_found"] == 0 and e.listed("dismissed").count() == 1
    ids = {r.claim_text: r.id for r in e.claims.collect()}
    assert ids == {k: r.id for k, r in c.items()}
    assert e.listed().count() == len(open_) - 1 and e.mirror_runs.count() == 3
    # a changed note keeps the ids of claims it still has
    e.tables.replace("notes", notes(spark, [(1, "a.md", "A", "h9", "The gate is open. New one."), *rows[1:]]))
    assert e.mirror(NOW)["notes_scanned"] == 1
    now = {r.claim_text: r.id for r in e.claims.collect()}
    assert now["The gate is open."] == ids["The gate is open."] and "More." not in now and now["New one."] > max(ids.values())


@pytest.mark.parametrize("reply, want", [('{"claims": ["a", {"text": " b "}, "a", "", {"x": 1}]}', ["a", "b"]), ('{"claims": []}', []), ("{}", None), (None, None)])
def test_claim_texts(spark, reply, want):
    got = spark.range(1).select(mirror.claim_texts(F.lit(reply).cast("string")).alias("c")).first().c
    assert got == want


def test_decay_verdicts_are_kept(spark, tmp_path):
    e = filled(spark, str(tmp_path / "i"), [(1, "a.md", "A", "h", "Old."), (2, "b.md", "B", "h", "New.")], Offline)
    e.tables.replace("freshness", spark.createDataFrame([("a.md", "2020-01-01", 30), ("b.md", "2025-01-31", 30)], "note_path string, last_verified string, window_days int").withColumns({"last_verified": F.col("last_verified").cast("timestamp"), "decay_check_at": F.lit(None).cast("timestamp"), "likely_stale": F.lit(None).cast("boolean")}))
    got = e.check_decay(NOW, NOW).collect()
    assert [r.note_path for r in got] == ["a.md"] and got[0].reason.startswith("checked")
    f = {r.note_path: r for r in e.freshness.collect()}
    assert f["a.md"].likely_stale == got[0].likely_stale and f["a.md"].decay_check_at and f["b.md"].decay_check_at is None
    e.verify(e.freshness.where("note_path = 'a.md'"), NOW)
    assert {r.likely_stale for r in e.freshness.collect()} == {None}


class Mended(Offline):
    def embed(self, texts):
        return [[0.0, 1.0, 0.0] for _ in texts]


class Same(Offline):
    def embed(self, texts):
        return [[-1.0, 0.0] for _ in texts]


class Other(Offline):
    def embed(self, texts):
        return [None if "two" in t else [0.0, 1.0, 0.0] for t in texts]


def test_migration_continues_and_swaps_only_when_complete(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"), provider=Offline, model="old")
    rows = [(k, 1, k, t, [1.0, 0.0], "old") for k, t in enumerate(["one", "two", "three"])]
    c = spark.createDataFrame(rows, "id long, note_id long, chunk_index int, text_content string, vector array<double>, chunk_hash string").withColumns({"page": F.lit(None).cast("int"), "heading": F.lit(None).cast("string")})
    e.tables.replace("chunks", c.select("id", "note_id", "chunk_index", "text_content", "vector", "page", "heading", "chunk_hash"))
    assert e.migrate("new", Other, batch=2) == {"done": 1, "total": 3, "swapped": False}
    assert not store.Migration(e.tables, "chunks", "new").begin()
    assert e.migrate("new", Other) == {"done": 2, "total": 3, "swapped": False} and e.model == "old"
    assert {len(r.vector) for r in e.chunks.collect()} == {2}
    assert e.migrate("new", Mended) == {"done": 3, "total": 3, "swapped": True} and e.model == "new"
    assert {tuple(r.vector) for r in e.chunks.collect()} == {(0.0, 1.0, 0.0)} and e.available() == {"full_text": True, "vectors": True}
    e.migrate("third", Offline, batch=1)
    e.abort_migration("third")
    assert not e.tables.versions("chunks-third")


def test_matrix_is_kept_until_chunks_change(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    c = spark.createDataFrame([(1, 1, 0, "x", [1.0, 0.0], None, None, "h")], "id long, note_id long, chunk_index int, text_content string, vector array<double>, page int, heading string, chunk_hash string")
    e.tables.replace("chunks", c)
    assert e.matrix().first().vector == [1.0, 0.0] and e.matrix().count() == 1 and e.tables.versions("matrix") == [1]
    e.tables.replace("chunks", c.withColumn("id", F.lit(2).cast("long")))
    e.matrix()
    assert e.tables.versions("matrix") == [1, 2]
    # a note of equal length, with the same ids, and a model of the same dimension
    e.tables.merge("chunks", c.withColumn("id", F.lit(2).cast("long")).withColumn("vector", F.array(F.lit(0.0), F.lit(1.0))), ["id"])
    assert e.matrix().first().vector == [0.0, 1.0] == e.pooled().first().vector
    assert e.migrate("other", Same)["swapped"] and e.matrix().first().vector == [-1.0, 0.0]


def test_graph_follows_an_edited_note(spark, tmp_path):
    vault = tmp_path / "v"
    vault.mkdir()
    for name, text in (("a", "red green blue cyan"), ("b", "lion tiger bear wolf"), ("c", "iron steel gold zinc")):
        (vault / f"{name}.md").write_text(text)
    e = Engine(spark, str(tmp_path / "i"))
    e.scan(str(vault))
    assert not [r for r in e.graph()[1].collect() if r.kind == "suggested"]
    (vault / "c.md").write_text("red green blue zinc")
    e.scan(str(vault))
    ids = {r.path: r.id for r in e.notes.collect()}
    found = {(r.src, r.dst) for r in e.graph()[1].collect() if r.kind == "suggested"}
    assert found == {(ids["a.md"], ids["c.md"]), (ids["c.md"], ids["a.md"])}


def test_distilled_note_and_transcript(spark, tmp_path):
    e = filled(spark, str(tmp_path / "i"), [(1, "a.md", "A", "h", "First. x"), (2, "b.md", "B", "h", "---\ngenerated: true\n---\nown")], Offline)
    e.tables.replace("note_tags", spark.createDataFrame([(1, "t"), (2, "t")], "note_id long, tag string"))
    c = spark.createDataFrame([(k, k, 0, f"Text {k}. y", [1.0, 0.0], None, None, "h") for k in (1, 2)], "id long, note_id long, chunk_index int, text_content string, vector array<double>, page int, heading string, chunk_hash string")
    e.tables.replace("chunks", c)
    note = e.distil(tag="t").first()
    assert note.markdown.startswith("---\ngenerated: true") and "- [[A]]" in note.markdown and "[[B]]" not in note.markdown and note.notes == 1
    assert e.distil(tag="none").count() == 0
    with pytest.raises(ValueError):
        e.distil("t", "c")
    t = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert answer.transcripts(t).first().markdown == "## User\n\na\n\n## Assistant\n\nb\n"


def test_rewrites_keep_the_question_without_an_answer(spark):
    class Silent(Offline):
        def _rewrite(self, body):
            return {}

    t = spark.createDataFrame([(1, 0, "user", "who built the old bridge over there"), (1, 1, "assistant", "a king"), (1, 2, "user", "and why?")], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in answer.rewrites(t).collect()}
    assert (got[0].rewrite, got[0].rewritten) == (False, got[0].question) and got[2].rewritten == "and why? (assistant: a king)"
    assert {r.rewritten for r in answer.rewrites(t, Silent).collect()} == {"who built the old bridge over there", "and why?"}


def test_streamed_answer():
    got = list(answer.streamed(Offline(), "x"))
    assert got[-1][0] == "done" and "".join(p for k, p in got if k == "token") == got[-1][1] == Offline().complete("x")


def test_threads(spark, tmp_path):
    t = Threads(spark, str(tmp_path / "threads"))
    rows = spark.createDataFrame([(f"2025-01-0{k}", f"q{k}", "a", ["s"]) for k in (1, 2, 3)], "ts string, q string, a string, sources array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    assert t.names() == [] and t.load("x").count() == 0
    t.save("x", rows)
    t.save("x", rows.where("q <> 'q1'"))
    assert sorted(r.q for r in t.load("x").collect()) == ["q2", "q3"] and [r.q for r in t.load("x", 1).collect()] == ["q3"] and t.names() == ["x"]
    assert t.forget("x") and not t.forget("x") and t.names() == []
    with pytest.raises(ValueError):
        t.load("../x")


def test_files(tmp_path):
    vault, out = tmp_path / "v", tmp_path / "o.md"
    vault.mkdir()
    (vault / "n.md").write_text("x")
    out.write_text("secret")
    (vault / "link.md").symlink_to(out)
    assert files.resolve_note(str(vault), "n.md") == files.resolve_note(str(vault), str(vault / "n.md")) == "n.md"
    for bad in ("link.md", "../o.md", "none.md"):
        with pytest.raises(ValueError):
            files.resolve_note(str(vault), bad)
    assert files.selector(tag=" t ") == ("tag", "t") and files.selector(category="a/b/ ") == ("category", "a/b")
    for bad in ((None, None), ("t", "c"), (" ", "")):
        with pytest.raises(ValueError):
            files.selector(*bad)
    (vault / "n.md").chmod(0o640)
    files.replace_file(str(vault / "n.md"), "new")
    assert (vault / "n.md").read_text() == "new" and (vault / "n.md").stat().st_mode & 0o777 == 0o640 and len(list(vault.iterdir())) == 2
    assert files.edited_key('# top\n[models]\nembed = "a" # why\nx = 1\n[z]\n', "models", "embed", 'b"') == '# top\n[models]\nembed = "b\\"" # why\nx = 1\n[z]\n'
    assert files.edited_key("[a]\nk = 1\n[b]\n", "a", "new", "v") == '[a]\nk = 1\nnew = "v"\n[b]\n' and files.edited_key("", "a", "k", "v") == '[a]\nk = "v"\n'
    assert files.menu([str(k) for k in range(100)]).count("\n") == 79


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_commit_before_change(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True).stdout
    note, other = tmp_path / "n.md", tmp_path / "o.md"
    note.write_text("1")
    assert not files.commit_before_change(str(note))
    git("init", "-q")
    git("config", "user.email", "t@localhost")
    git("config", "user.name", "t")
    other.write_text("untouched")
    assert files.commit_before_change(str(note)) and not files.commit_before_change(str(note))
    note.write_text("2")
    assert files.commit_before_change(str(note)) and "o.md" in git("status", "--porcelain") and git("log", "--oneline").count("\n") == 2


def test_links_out_of_the_vault_are_not_read(spark, tmp_path):
    vault, away = tmp_path / "v", tmp_path / "away"
    (vault / "sub").mkdir(parents=True)
    away.mkdir()
    (vault / "a b.md").write_text("in")
    (vault / "sub" / "x[1].md").write_text("in")
    (away / "s.md").write_text("out")
    (vault / "link.md").symlink_to(away / "s.md")
    (vault / "folder").symlink_to(away)
    assert sorted(r.rel for r in scan(spark, str(vault)).collect()) == ["a b.md", "sub/x[1].md"]
    only = spark.createDataFrame([("sub/x[1].md",), ("link.md",), ("gone.md",)], "path string")
    assert [r.rel for r in scan(spark, str(vault), only=only).collect()] == ["sub/x[1].md"]
    assert scan(spark, str(vault), only=only.where("path = 'gone.md'")).count() == 0


def test_taxonomy_round_trip(spark):
    text = "vocabulary: [b, a]\ncategories:\n  tech:\n    infra:\n    web:\n  art:\n"
    words, tree = load_taxonomy(spark, text)
    again = load_taxonomy(spark, dump_taxonomy(words, tree))
    assert [r.name for r in again[0].orderBy("ordinal").collect()] == ["b", "a"]
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, tree.collect()))
    assert dump_taxonomy(words.limit(0), tree.limit(0)) == "vocabulary: []\ncategories: {}\n"


def test_preflight(spark, tmp_path):
    got = {r.name: r.status for r in preflight(spark, Settings(vault=str(tmp_path), formats=("md",)), Offline, 768).collect()}
    assert got == {"settings": "ok", "vault": "ok", "provider": "ok", "formats": "ok", "index": "ok", "git": "warning"}
    bad = {r.name: r.status for r in preflight(spark, Settings(vault=str(tmp_path / "no"), chunk_overlap=9999, connect_threshold=2.0, sidecar_dir=".."), Offline, 3).collect()}
    assert bad["settings"] == bad["vault"] == bad["index"] == "error"


def test_jobs_and_lock(spark, tmp_path):
    jobs = spark.createDataFrame([("backup", 86_400), ("notify", 300), ("new", 5)], "job string, every_seconds long")
    runs = spark.createDataFrame([("backup", "2025-01-31 12:00:00"), ("notify", "2025-01-31 23:54:00"), ("notify", "2025-01-30 00:00:00")], "job string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r.job for r in due(jobs, runs, NOW).collect()) == ["new", "notify"]
    done = []
    p = Periodic({"a": (10, lambda: done.append("a")), "b": (20, lambda: 1 / 0)})
    assert p.tick(5) == {} and p.tick(10) == {"a": "done"} and p.tick(20) == {"a": "done", "b": "failed: division by zero"} and done == ["a", "a"]
    at = str(tmp_path / "lock")
    with Lock(spark, at) as held, pytest.raises(RuntimeError):
        assert held.age() < 60
        with Lock(spark, at):
            pass
    assert Lock(spark, at).age() is None


def test_versions_backup_and_compaction(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "i"))
    assert s.replace("t", spark.range(100).repartition(6)) == 1 and s.files("t") == 6
    assert s.compacted("t", 2) == 2 and s.files("t") == 2 and s.current("t").count() == 100
    # four writers of one table: none is lost
    got, threads = [], [threading.Thread(target=lambda k=k: got.append(s.append("t", spark.range(1000 + k, 1001 + k)))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [3, 4, 5, 6] and s.versions("t") == [1, 2, 3, 4, 5, 6]
    assert s.current("t").count() == 104 and s.current("t").where("id >= 1000").count() == 4
    for k in range(7):
        dropped = s.backup(["t", "none"], f"2025010{k}")
    assert dropped == ["20250101"] and spark.read.parquet(f"{s.root}/backups/20250106/t").count() == s.current("t").count()
    assert s.prune("t", 1) == [1, 2, 3, 4, 5] and s.replace("t", spark.range(1)) == 7


def test_two_writers_of_one_base(spark, tmp_path):
    """Both read a version and write the next: the later one is refused, and
    deltas are played again; a compaction keeps what came meanwhile."""
    a, b = (store.Snapshots(spark, str(tmp_path / "i")) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i, f"{w}") for i, w in ids], "id long, word string")
    a.replace("t", rows((0, "zero"), (1, "one")))
    ra, rb = a.current("t"), b.current("t")
    a.replace("t", ra.union(rows((2, "two"))))
    with pytest.raises(store.Conflict):
        b.replace("t", rb.union(rows((3, "three"))))
    b.replace("t", b.current("t").union(rows((3, "three"))))
    with pytest.raises(store.Conflict):
        a.replace("t", ra)
    a.merge("t", rows((1, "eins"), (4, "four")), ["id"], gone=rows((0, "")))
    b.merge("t", rows((4, "vier")), ["id"])
    have = lambda s: {r.id: r.word for r in s.current("t").collect()}
    assert have(a) == have(b) == {1: "eins", 2: "two", 3: "three", 4: "vier"}
    real, late = a.commit, []

    def slow(name, change, base=None, about=None):
        if not late:
            late.append(b.append("t", rows((9, "late"))))
        return real(name, change, base, about)

    a.commit = slow
    a.compacted("t", 1)
    assert have(b) == {1: "eins", 2: "two", 3: "three", 4: "vier", 9: "late"} and len(b.manifest("t")["parts"]) == 2
    late.clear()
    a.commit = lambda name, change, base=None, about=None: (late or late.append(b.replace("t", rows((7, "new")), b.version("t"))), real(name, change, base, about))[1]
    with pytest.raises(store.Conflict):
        a.compacted("t")
    assert have(b) == {7: "new"}
    assert a.merge("t", rows().limit(0), ["id"]) == b.version("t")
    for k in range(12):
        b.merge("t", rows((k % 3, f"w{k}")), ["id"])
    assert have(a) == {7: "new", 0: "w9", 1: "w10", 2: "w11"} and sum("keys" in p for p in a.manifest("t")["parts"]) <= b.MOST_DELTAS
    before = set(a.folders("t"))
    a.prune("t", 1)
    assert have(b) == {7: "new", 0: "w9", 1: "w10", 2: "w11"} and set(a.folders("t")) == before


def test_serving(spark, tmp_path):
    vault = tmp_path / "v"
    vault.mkdir()
    (vault / "a.md").write_text("# Tide\n\nThe moon moves the tide.")
    e = Engine(spark, str(tmp_path / "i"))
    e.scan(str(vault))
    service = Service(e)
    tools = ToolServer(service)
    call = lambda method, **params: tools.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert call("initialize")["result"]["serverInfo"]["name"] and call("ping")["result"] == {} and len(call("tools/list")["result"]["tools"]) == 5
    found = json.loads(call("tools/call", name="search", arguments={"question": "moon"})["result"]["content"][0]["text"])
    assert found[0]["title"] == "Tide" and call("tools/call", name="no")["error"]["code"] == -32601 and call("tools/call", name="search", arguments={"question": ""})["error"]["code"] == -32602
    assert tools.handle({"method": "note"}) is None and call("no")["error"]["code"] == -32601
    assert route(service, "GET", "/api/notes/Tide", {})[1]["path"] == "a.md" and route(service, "GET", "/api/notes/99", {})[0] == 404
    assert route(service, "POST", "/api/search", {"question": "moon", "top_k": "x"})[0] == 400 and route(service, "GET", "/api/health", {})[1]["full_text"]
    assert route(service, "POST", "/api/ask", {"question": "moon"})[1]["sources"] == ["Tide"]
    s = server(service, key="k", limit=Limit(most=2))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_address[1]}/api/categories"

    def status(key):
        try:
            return urllib.request.urlopen(urllib.request.Request(at, headers={"Authorization": f"Bearer {key}"}), timeout=60).status
        except urllib.error.HTTPError as error:
            return error.code

    assert [status("k"), status("x"), status("x"), status("k")] == [200, 401, 401, 429]
    s.shutdown()


def test_quantile_and_newest(spark):
    rows = [(k % 3, float(v)) for k, v in enumerate([*range(50), *[7] * 200, 1e9, -1e9, 0.5])]
    d = spark.createDataFrame([*rows, (0, None), (None, 1.0)], "k int, v double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.x for r in catalog.quantile(d, ["k"], "v", q, "x").collect()}
        for key in (0, 1, 2):
            vs = sorted(v for k, v in rows if k == key)
            assert got[key] == vs[round(q * (len(vs) - 1))]
        assert got[None] == 1.0
    assert sorted(r.v for r in catalog.newest(spark.createDataFrame([(k,) for k in (5, 1, 4, 4, 2)], "v int"), "v", 2).collect()) == [1, 2]
    assert catalog.newest(spark.range(3), "id", 5).count() == 0


def test_few_queries_and_many_find_the_same(spark, monkeypatch):
    import numpy as np

    from folioscope.operators import similar

    r = np.random.default_rng(1)
    rows = [(k, k % 7, (r.standard_normal(4 if k % 5 else 3)).tolist()) for k in range(120)] + [(200, 1, None), (201, 1, [])]
    d = spark.createDataFrame(rows, "id long, note_id long, vector array<double>").repartition(5)
    q = d.where("id % 10 = 0")
    found = {}
    for few in (256, 3):
        monkeypatch.setattr(similar, "FEW", few)
        monkeypatch.setattr(similar, "BLOCK", 16)
        found[few] = [sorted(map(tuple, similar.top_k(q, d, 4, apart=a, least=m).collect())) for a in (False, True) for m in (None, 0.5)]
    assert found[256] == found[3] and all(found[3])
    notes = {k: n for k, n, _ in rows}
    assert all(notes[x[0]] != x[2] for x in found[3][2])
    assert similar.top_k(q.limit(0), d, 4).count() == 0


def test_texts_whose_words_cancel_have_no_vector(spark, tmp_path):
    """Two words of one bucket with opposite signs, as in SQL, which has no row of them."""
    import duckdb

    from folioscope.functions.providers import _place
    from folioscope.plans.registry import ORACLES, QUERIES

    first = {}
    pair = next((f"{first[k, -s]} w{j}") for j in range(10_000) for k, s in [_place(f"w{j}")] if (k, -s) in first or first.setdefault((k, s), f"w{j}") is None)
    rows = [(1, pair, "es", "s", 1), (2, "uno dos tres", "es", "s", 1), (3, "¡¿!", "es", "s", 1), (4, "  ", "es", "s", 1), (5, "dos cuatro", "es", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("r27_embed", "r22_distill", "w5_passages"):
        want = c.sql(ORACLES[name])
        assert sorted(tuple(r[x] for x in want.columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want.fetchall()), name


def test_texts_are_read_once_for_their_hashes_and_not_for_pages(spark, sf_dir):
    from folioscope.plans.registry import QUERIES

    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan("j8_duplicate_members") and "substring" not in plan("r41_result_metadata").lower()

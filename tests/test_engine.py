import pytest
from pyspark.sql import functions as F

from folioscope.__main__ import parser
from folioscope.engine import Engine
from folioscope.operators import matching as M
from folioscope.sources.config import load_golden


@pytest.fixture
def vault(tmp_path):
    v = tmp_path / "vault"
    (v / "sub").mkdir(parents=True)
    (v / "backup.md").write_text("# Backup plan\n\nRotate the tapes weekly. See [[Gothic]].")
    (v / "sub" / "gothic.md").write_text("# Gothic\n\nCathedrals have flying buttresses and pointed arches.")
    (v / "copy.txt").write_text("# Gothic\n\nCathedrals have flying buttresses and pointed arches.")
    (v / "page.html").write_text("<title>Tide</title><body><h2>Moon</h2><p>Tides follow the moon.</p></body>")
    (v / "secret.md").write_text("---\nprivacy: never_process\n---\nhidden")
    (v / "bad.docx").write_bytes(b"no")
    return v


def counts(rows):
    return {r.status: r.files for r in rows.collect()}


def test_life_of_an_index(spark, vault, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    assert counts(e.scan(str(vault))) == {"new": 4, "error": 1, "private": 1}
    assert e.status().first().asDict() == {"total": 4, "tagged": 4, "categorised": 4, "chunks": 4}
    ids = {r.path: r.id for r in e.notes.collect()}

    q = spark.createDataFrame([(1, "flying buttresses"), (2, "moon tides")], "query_id long, question string")
    first = {r.query_id: r.title for r in e.search(q, 1).collect()}
    assert first[1] in ("Gothic", "copy") and first[2] == "Tide"
    only = e.search(q, 5, formats=["html"]).collect()
    assert {r.title for r in only} == {"Tide"}
    assert {r.query_id: r.sources for r in e.ask(q, 1).collect()}[2] == ["Tide#Moon"]
    assert e.duplicates()[0].first().n == 2
    assert [(r.src, r.dst) for r in e.graph()[1].where("kind = 'wikilink'").collect()] == [(ids["backup.md"], ids["sub/gothic.md"])]
    golden = load_golden(spark, "version: 1\ncases:\n- id: a\n  question: moon tides\n  expected_sources: [tide]\n- id: b\n  question: nothing\n  negative: true")
    assert {r.case_id: r.outcome for r in e.evaluate(golden).collect()} == {"a": "ok", "b": "na"}
    assert e.baseline(golden).count() == 2

    chunk = {r.note_id: r.id for r in e.chunks.collect()}
    (vault / "backup.md").write_text("# Backup plan\n\nRotate the disks daily.")
    (vault / "page.html").write_text("<title>Tide</title><body><h2>Moon</h2><p>Tides  follow the moon.</p></body>")
    (vault / "copy.txt").unlink()
    assert counts(e.scan(str(vault))) == {"changed": 1, "unchanged_text": 1, "unchanged_bytes": 1, "error": 1, "private": 1}
    assert {r.path: r.id for r in e.notes.collect()} == ids
    again = {r.note_id: (r.id, r.text_content) for r in e.chunks.collect()}
    assert again[ids["sub/gothic.md"]][0] == chunk[ids["sub/gothic.md"]] and "disks" in again[ids["backup.md"]][1]
    assert [r.path for r in e.prune(str(vault)).collect()] == ["copy.txt"]
    assert e.notes.count() == 3 and e.chunks.count() == 3 and e.freshness.count() == 3
    assert e.stale(F.lit("2099-01-01").cast("timestamp")).count() == 3
    e.verify(e.freshness.where("note_path = 'backup.md'"), F.lit("2099-01-01").cast("timestamp"))
    assert e.stale(F.lit("2099-01-01").cast("timestamp")).count() == 2
    assert all(len(e.tables.versions(t)) == 1 for t in e.maintain(1) if e.tables.versions(t))


def test_watch_scans_quiet_files(spark, vault, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    rows = [("backup.md", "modified", "2024-01-01 00:00:00"), ("sub/gothic.md", "created", "2024-01-01 00:00:10"), ("later.md", "modified", "2024-01-02 00:00:00")]
    ev = spark.createDataFrame(rows, "path string, kind string, at string").select("path", "kind", F.col("at").cast("timestamp").alias("ts"))
    ev.coalesce(1).write.parquet(str(tmp_path / "events"))
    q = e.watch(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "events")), str(vault), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {r.path for r in e.notes.collect()} == {"backup.md", "sub/gothic.md"}


def test_mentions_and_categories(spark):
    notes = spark.createDataFrame([(1, "a/plan.md", "Backup plan"), (2, "b.md", "Gothic architecture"), (3, "c.md", "backup PLAN")], "id long, path string, title string")
    m = spark.createDataFrame([("a/plan.md",), ("backup plan",), ("gothic architectur",), ("zzz",)], "mention string")
    assert {r.mention: (r.id, r.how) for r in M.resolved_mentions(m, notes).collect()} == {"a/plan.md": (1, "path"), "backup plan": (1, "title"), "gothic architectur": (2, "similar")}
    tree = M.add_category(spark.createDataFrame([("Work", "", "Work", 0)], "path string, parent string, name string, ordinal int"), "Work/Réseau/DNS")
    assert {r.path for r in tree.collect()} == {"Work", "Work/Réseau", "Work/Réseau/DNS"}
    got = M.resolved_categories(spark.createDataFrame([(1, "work / reseau"), (2, "nope")], "id long, category string"), tree)
    assert {r.id: r.category for r in got.collect()} == {1: "Work/Réseau", 2: None}
    assert M.remove_category(tree, "Work/Réseau").count() == 1
    flags = spark.createDataFrame([(1, {"generated": "true"}), (2, {"generated": "No"}), (3, {})], "id long, m map<string,string>")
    assert [r.id for r in flags.where(M.generated(F.col("m"))).collect()] == [1]


def test_commands():
    a = parser().parse_args(["--index", "x", "ask", "why", "--top-k", "3", "--tag", "a", "--tag", "b"])
    assert (a.command, a.question, a.top_k, a.tag) == ("ask", "why", "3", ["a", "b"])

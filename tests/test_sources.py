import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.sources import config, formats, logs, vault
from folioscope.streaming import debounce


def packed(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return b.getvalue()


DOCX = packed(
    word__document_dot_xml='<w:document xmlns:w="w"><w:p><w:t>Intro</w:t></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>Head</w:t></w:p><w:p><w:t>Body</w:t><w:t> text</w:t></w:p></w:document>',
    docProps__core_dot_xml='<c xmlns:dc="dc"><dc:title>My doc</dc:title></c>',
)
ODT = packed(mimetype="application/vnd.oasis.opendocument.text", content_dot_xml='<o:d xmlns:o="office" xmlns:t="text"><o:text><t:h>Head</t:h><t:p>One</t:p><t:list><t:p>Two</t:p></t:list></o:text></o:d>')
EPUB = packed(
    mimetype="application/epub+zip",
    **{"META-INF__container_dot_xml": '<c><rootfile full-path="O/p.opf"/></c>', "O__p_dot_opf": "<p><title>Book</title><item id='a' href='a.html'/><item id='b' href='b.html'/><itemref idref='b'/><itemref idref='a'/></p>",
       "O__a_dot_html": "<html><body><h1>A</h1><p>first</p></body></html>", "O__b_dot_html": "<html><body><h1>B</h1><p>second</p></body></html>"},
)


def test_extractors():
    e = formats.extract
    r = e("d/x.md", "md", b"---\ntitle: T\ntags: [a, b]\n---\n# H\nbody")
    assert (r["title"], r["text"]) == ("T", "# H\nbody") and dict(r["metadata"])["tags"] == '["a", "b"]'
    assert e("d/x.md", "md", b"# H\n")["title"] == "H" and e("d/x.md", "md", b"no")["title"] == "x"
    assert e("d/a.b.txt", "txt", b"\xff ok")["text"] == "� ok"
    r = e("x.html", "html", b"<title>T</title><nav>n</nav><main><p>pre<h2>S</h2><p>one<script>x</script><ul><li>two</ul></main><footer>f</footer>")
    assert r["title"] == "T" and [(s["heading"], s["text"]) for s in r["sections"]] == [(None, "pre"), ("S", "one\ntwo")]
    r = e("x.docx", "docx", DOCX)
    assert r["title"] == "My doc" and [(s["heading"], s["text"]) for s in r["sections"]] == [(None, "Intro"), ("Head", "Body text")]
    assert [(s["heading"], s["text"]) for s in e("x.odt", "odt", ODT)["sections"]] == [("Head", "One\nTwo")]
    r = e("x.epub", "epub", EPUB)
    assert r["title"] == "Book" and [s["heading"] for s in r["sections"]] == ["B", "A"]
    assert e("x.rtf", "rtf", rb"{\rtf1{\fonttbl x}\b Hello\b0  \'e9\u233?\par next}")["text"] == "Hello ééé"[:7] + "é\nnext"


def test_errors_do_not_stop(spark):
    assert formats.extract("x.docx", "docx", b"no zip")["error"].startswith("BadZipFile")
    assert "DOCTYPE" not in (formats.extract("x.docx", "docx", packed(word__document_dot_xml="<!DOCTYPE a><a/>"))["text"] or "")
    assert formats.extract("x.txt", "txt", b"x" * (5 * formats.MB + 1))["error"]
    d = spark.createDataFrame([("a.md", "md", bytearray(b"# A")), ("b.docx", "docx", bytearray(b"x")), ("c", None, None)], "path string, ext string, content binary")
    got = {r.path: (r.title, r.error is None) for r in formats.extracted(d).collect()}
    assert got == {"a.md": ("A", True), "b.docx": (None, False), "c": ("c", True)}


def test_scan(spark, tmp_path):
    for name, data in {"a.md": b"x", "sub/b.TXT": b"y", ".git/c.md": b"z", "d.pdf": b"%PDF", "e": b"%PDF-1", "git.md": b"w"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rel = lambda **k: sorted(r.rel for r in vault.scan(spark, str(tmp_path), **k).collect())
    assert rel(formats=["md", ".txt"]) == ["a.md", "git.md", "sub/b.TXT"]
    assert rel(formats=["pdf"], sniff=True) == ["d.pdf", "e"]
    assert vault.inside(str(tmp_path), str(tmp_path / "a.md")) and not vault.inside(str(tmp_path), str(tmp_path / ".." / "x"))


def test_sniffing(spark):
    d = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([b"%PDF-1", b"{\\rtf1", DOCX, ODT, EPUB, b" <!DOCTYPE html>", b"text"])], "k int, content binary")
    assert [r.x for r in d.orderBy("k").select(vault.sniffed(F.col("content")).alias("x")).collect()] == ["pdf", "rtf", "docx", "odt", "epub", "html", None]


def test_event_log_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01", "scan", {"a": "x y", "b": 'q"=', "c": "z"})], "at string, event string, fields map<string,string>")
    logs.append_events(d, str(tmp_path / "log"))
    assert logs.read_events(spark, str(tmp_path / "log")).first().fields == {"a": "x y", "b": 'q"=', "c": "z"}


def test_config(spark):
    s = config.load_settings('formats = ["md"]\nnope = 1\n[freshness_windows]\na = 1\n[profiles.p]\ntop_k = 9\n[profiles.p.freshness_windows]\nb = 2', "p", rrf_k=7)
    assert (s.formats, s.top_k, s.rrf_k, s.freshness_windows) == (("md",), 9, 7, {"a": 1, "b": 2})
    with pytest.raises(ValueError):
        config.load_settings("", "p")
    assert [config.clamp(x) for x in (None, "", "0", 99, "7")] == [5, 5, 1, 50, 7]
    with pytest.raises(ValueError):
        config.clamp("x")
    words, cats = config.load_taxonomy(spark, "vocabulary: [a, b, a]\ncategories: {x: {y: null}, z: [w]}")
    assert words.count() == 2 and [r.path for r in cats.collect()] == ["x", "x/y", "z", "z/w"]
    assert config.load_taxonomy(spark, "{")[1].count() == 0


def test_golden(spark):
    g = config.load_golden(spark, "version: 1\ncases:\n- id: a\n  question: q\n  category: c\n  follow_ups:\n  - question: r\n    follow_ups: [{question: s}]\n  - question: t\n- question: u\n  negative: true")
    assert [(r.case_id, r.turn_index, r.question, r.category) for r in g.collect()] == [("a", 0, "q", "c"), ("a", 1, "r", "c"), ("a", 2, "s", "c"), ("a", 3, "t", "c"), ("case-2", 0, "u", None)]
    for bad in ("version: 2", "version: 1\ncases: [{question: q, x: 1}]", "version: 1\ncases: [{question: q, negative: true, expected_sources: [a]}]"):
        with pytest.raises(ValueError):
            config.load_golden(spark, bad)


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [("a.md", "modified", "2024-01-01 00:00:00"), ("a.md", "modified", "2024-01-01 00:00:30"), ("a.md", "created", "2024-01-01 00:05:00"), ("b.txt", "modified", "2024-01-01 00:00:01"), ("c.md", "deleted", "2024-01-01 00:00:01"), ("z.md", "modified", "2024-01-02 00:00:00")]
    e = spark.createDataFrame(rows, "path string, kind string, at string").select("path", "kind", F.col("at").cast("timestamp").alias("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.path, r["last"], r.events) for r in debounce.debounced(debounce.watched(e)).collect()}
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    seen = []

    def handle(df, _):
        seen.extend((r.path, r["last"], r.events) for r in df.collect())

    q = debounce.process(debounce.debounced(debounce.watched(stream), late="1 minute"), handle, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    # the newest session stays open until the watermark passes it
    assert set(seen) == {b for b in batch if b[0] != "z.md"}

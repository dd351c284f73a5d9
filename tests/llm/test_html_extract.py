import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import html_extract as H

COLUMNS = "page_id long, url string, html string"


NONE = np.zeros(0, np.int64)


def text(page):
    """The text of a page that is alone on its host."""
    found = H.blocks(page)
    return "\n".join(t for (t, _), k in zip(found, H.kinds(found), strict=True) if k)


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
    <nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="top ad-slot">Buy</div><header><h1>Site</h1></header>
    <article class=post><h1>Head &amp; <b>bold</b></h1><!-- <p>hidden</p> --><p>One
      two&nbsp;three<br>four &lt;b&gt; &#233;<p><b>Open bold<div class='share'>tweet</div><aside>side</aside>
      <table><tr><td>a</td><td>b</td></tr></table><form><input value=x>Sign up</form><section id="comments"><p>said</p></section></article>
    <footer>&copy; x</footer></body></html>"""
    assert text(page) == "Head & bold\nOne two three four <b> é\nOpen bold\na\nb"


def test_broken_pages():
    assert text(None) == text("") == text("<p>") == ""
    assert text("plain & simple") == "plain & simple"
    assert text("<article><p>cut off &am") == "cut off &am"
    assert text("<article><p>cut off &amp") == "cut off &"
    assert text("<div class=ad>never closed<article><p>kept") == "kept"
    assert text("<article><p a='>'>x</p><p>y < z</p>") == "x\ny < z"
    assert text("<main><p>m</p></main><p>out") == "m"
    assert text("<script>never closed <p>x") == ""
    assert text("<article class='post has-sidebar no-comments'><p>kept<div class='comment-list'>out</div></article>") == "kept"
    assert text("<article><p>kept</p><article class=comment><p>said</p></article></article>") == "kept"
    assert text("<article>" + "<p>w</p>" * 30_000).count("\n") == 29_999


def pages(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("text", F.lit("clash"))


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    menu, legal = "Home Products About us Contact Jobs Press", "All rights reserved by the owners of this site since 1999"
    rows = [(k, f"http://h.example/{k}", f"<body><div>{menu}</div><p>Page {k} says {'w%d ' % k * 8}</p><p>{legal}</p></body>") for k in range(12)]
    rows += [(50, "http://other.example/", f"<body><p>{legal}</p></body>"), (51, "http://h.example/a", "<article><p>marked</p><p>marked</p></article>"), (52, None, None), (52, None, None)]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(pages(spark, rows)).collect()))
    want = sorted([(k, t := f"Page {k} says " + " ".join([f"w{k}"] * 8), len(t)) for k in range(12)] + [(50, legal, len(legal)), (51, "marked\nmarked", 13), (52, "", 0), (52, "", 0)])
    assert got == want


def brute(htmls, need):
    """The texts of unmarked pages of one host: tokens in runs that enough pages have."""
    streams = []
    for h in htmls:
        streams.append([w for t, _ in H.blocks(h) for w in ["", *t.split()]] + [""])
    grams = [{tuple(s[i : i + H.RUN]) for i in range(len(s) - H.RUN + 1)} for s in streams]
    out = []
    for h, s in zip(htmls, streams, strict=True):
        cover = set()
        for i in range(len(s) - H.RUN + 1):
            if sum(tuple(s[i : i + H.RUN]) in g for g in grams) >= need:
                cover |= set(range(i, i + H.RUN))
        kept, at = [], 1
        for t, _ in H.blocks(h):
            words = t.split()
            own = [at + k in cover for k in range(len(words))]
            at += len(words) + 1
            rest, k = [], 0
            while k < len(words):
                e = k
                while e < len(words) and own[e] == own[k]:
                    e += 1
                if not own[k] or e - k < min(H.RUN, len(words)):
                    rest += words[k:e]
                k = e
            if rest:
                kept.append(" ".join(rest))
        out.append("\n".join(kept))
    return out


def test_array_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 50)
    monkeypatch.setattr(H, "HELD", 40)
    for seed in range(3):
        r = np.random.default_rng(seed)
        htmls = ["<body>" + "".join("<p>" + " ".join(r.choice(["a", "b", "c"], r.integers(1, 40))) + "</p>" for _ in range(6)) + "</body>" for _ in range(25)]
        got = {x.page_id: x.text for x in H.extract(pages(spark, [(k, "http://h/", h) for k, h in enumerate(htmls)])).collect()}
        assert [got[k] for k in range(25)] == brute(htmls, 3)


def test_repeats_are_those_of_a_suffix_array():
    """Lengths from sorted neighbours equal those of comparing all suffixes."""
    r = np.random.default_rng(4)
    x = np.zeros(300, H.SUFFIX)
    x["context"] = np.sort(r.integers(0, 2, (300, H.DEPTH)), axis=1)
    x["host"], x["need"], x["pages"] = r.integers(0, 2, 300), r.integers(0, 40, 300), r.integers(0, 3, 300)
    x["own"] = r.integers(0, 12, 300)
    want = []
    for y in x:
        length = 0
        for n in range(H.RUN, H.DEPTH + 1):
            same = (x["context"][:, :n] == y["context"][:n]).all(1) & (x["host"] == y["host"])
            if y["need"] and x["pages"][same & (x["own"] < n)].sum() >= y["need"]:
                length = n
        want.append(length)
    assert H.repeats(x).tolist() == want and 0 < sum(v > 0 for v in want) < 300


def test_marked_content_loses_lines_that_its_host_repeats(spark):
    """The array decides on pages with articles, too: a line of the template goes,
    a paragraph that three of many pages share stays."""
    line, shared = "Please subscribe to our weekly letter for more of this", "this paragraph stands in three of the pages of the host only"
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, f"http://h.example/{k}", f"<nav>Menu</nav><article><h1>Title</h1><p>{own(k)}</p><p>{line}</p>{f'<p>{shared}</p>' if k < 3 else ''}</article>") for k in range(12)]
    got = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    for k in range(12):
        assert got[k] == "\n".join(["Title", own(k)] + [shared] * (k < 3))
    # alone on its host, the same page keeps the line
    assert line in H.extract(pages(spark, rows[:1])).first().text


def test_pages_without_a_usable_article_use_the_array(spark):
    """An article that is named out, empty, or in a comment or script marks nothing."""
    line = "boilerplate that every page of this host repeats in full"
    odd = ["<article class='comment-body'>said</article>", "<!-- <article>x</article> -->", "<script>var a='<main>';</script>", "<article></article>", "<aside><main></main></aside>", ""]
    rows = [(k, f"http://h.example/{k}", f"<body>{odd[k]}<p>own text {' '.join(f'w{k}x{i}' for i in range(9))}</p><p>{line}</p></body>") for k in range(6)]
    for r in H.extract(pages(spark, rows)).collect():
        assert r.text == f"own text {' '.join(f'w{r.page_id}x{i}' for i in range(9))}"


def test_parts_of_main_and_content_names():
    assert text("<main><article>teaser</article><p>all the rest of the main text</p></main><p>out") == "teaser\nall the rest of the main text"
    assert text("<main><article>the long article that is the page</article><p>more</p></main>") == "the long article that is the page"
    assert text("<div class='content share-enabled'><p>kept</p></div><div class='share'>out</div>") == "kept"


def test_empty_table(spark):
    assert H.extract(pages(spark, [])).count() == 0


def test_synthetic_pages(spark, sf_dir):
    got = H.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert got.where("n_chars > 0").count() == got.count() == 50
    assert got.where("text LIKE '%track(%' OR text LIKE '%©%'").count() == 0


def test_copies_and_shared_phrases_stay(spark):
    quote = "to be or not to be that is the question"
    html = lambda k, more="": f"<body><p>Home Products About us Contact Jobs Press</p><p>Page {k} says {' '.join(f'w{k}x{i}' for i in range(20))} {more}</p></body>"
    rows = [(k, f"http://h.example/{k}", html(k, quote if k in (3, 7) else "")) for k in range(40)]
    # copies under other addresses, one of them with another menu, and a host that has nothing but copies
    rows += [(100, "http://h.example/again", html(5)), (101, "http://h.example/more", html(5).replace("<body>", "<body><nav>Other</nav>")), (5, "http://h.example/5", html(5))]
    rows += [(200, "http://c.example/a", f"<p>{quote}</p>"), (201, "http://c.example/b", f"<p>{quote}</p>")]
    got = {(r.page_id, r.url): r.text for r in H.extract(pages(spark, rows)).collect()}
    own = lambda k: f"Page {k} says {' '.join(f'w{k}x{i}' for i in range(20))}"
    for k in range(40):
        assert got[k, f"http://h.example/{k}"] == (f"{own(k)} {quote}" if k in (3, 7) else own(k))
    assert got[100, "http://h.example/again"] == got[101, "http://h.example/more"] == own(5)
    assert got[200, "http://c.example/a"] == got[201, "http://c.example/b"] == quote

"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import html
import math
import os
import re

import duckdb
import numpy as np
import pytest

import folioscope.plans  # noqa: F401  registers the queries
from folioscope.functions.providers import Offline
from folioscope.operators.chunking import ABBREVIATIONS
from folioscope.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, int):
        return str(value)
    try:
        return repr(round(float(value), 6) + 0.0) if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([columns[k] for k in order] and [tuple(plain(r[k]) for k in order) for r in data])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = [[x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r] for r in got.collect()]
    assert rows(got.columns, found) == rows(want.columns, want.fetchall())


def test_queries_without_sql():
    """Of parsers and of floating-point means; these are compared below."""
    assert set(QUERIES) - set(ORACLES) == {"s7_html_sections", "r25_semantic"}


def test_html_sections(spark, duck, sf_dir):
    """Sections of a page are its headings with what follows; the characters are
    those of the words outside of markup."""
    want = {u: h for u, h in duck.sql("SELECT url, html FROM pages").fetchall()}
    for r in QUERIES["s7_html_sections"](spark, sf_dir).collect():
        page = want[r.path]
        body = re.sub(r"(?is)<(script|style|title|nav|header|footer|aside|form|noscript)\b.*?</\1>|<!--.*?-->", " ", page)
        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert r.title == html.unescape(re.search(r"(?is)<title>(.*?)</title>", page)[1]).strip()
        assert r.sections >= 1 and abs(r.chars - len(" ".join(words))) <= 0.1 * len(" ".join(words)) + 200, r.path


def test_semantic_chunks(spark, duck, sf_dir):
    """Sentences joined while near the mean of those before, told in plain Python."""
    embed = Offline().embed
    got = {}
    for r in QUERIES["r25_semantic"](spark, sf_dir).collect():
        got.setdefault(r.note_id, []).append((r.chunk_index, r.chunk))
    texts = {i: t for i, t in duck.sql("SELECT doc_id, text FROM documents WHERE doc_id < 60").fetchall()}
    for i, text in texts.items():
        said = []
        for piece in [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'(\[])", text) if p.strip(" ")]:
            if said and said[-1].split(" ")[-1].lower() in ABBREVIATIONS:
                said[-1] += " " + piece
            else:
                said.append(piece)
        want, held, mean = [], [], None
        for s, v in zip(said, embed(said), strict=True):
            v = np.array(v if v else [0.0] * 768)
            near = mean is not None and mean @ v / ((np.linalg.norm(mean) * np.linalg.norm(v)) or 1.0) >= 0.55
            if held and (not near or len(" ".join([*held, s])) > 1500):
                want.append(" ".join(held))
                held, mean = [], None
            held.append(s)
            mean = v if mean is None else mean + v
        want += [" ".join(held)] if held else []
        assert [c for _, c in sorted(got.get(i, []))] == want, i

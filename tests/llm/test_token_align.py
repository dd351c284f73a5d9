import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import token_align as T
from folioscope.llm.queries import op13_token_align

COLUMNS = "doc_id long, text string"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """Bytes of the characters of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTES = byte_of()


def sides(text):
    a = LIBRARY.encode(" " + text, add_special_tokens=False).ids
    b = PIECES.encode(text)
    bytes_a = [bytes(BYTES[c] for c in LIBRARY.id_to_token(k)) for k in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if PIECES.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [PIECES.id_to_piece(k)]]
    raw = (" " + text).encode()
    if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    return (a, bytes_a), (b, bytes_b)


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def plain(texts):
    """All token pairs of all documents, compared one by one."""
    per, count = {}, Counter()
    for doc, text in texts:
        s = sides(text or "")
        if s is None:
            per[doc] = None
            continue
        (a, pa), (b, pb) = s
        ea, eb = ends(pa), ends(pb)
        at_b = defaultdict(list)
        for y, e in zip(b, eb, strict=True):
            at_b[e].append(y)
        links = [(x, y) for x, e in zip(a, ea, strict=True) for y in at_b[e]]
        count.update(links)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            m, n = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        per[doc] = (len(a), len(b), groups, links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = {}
    for doc, x in per.items():
        if x is None:
            out[doc] = (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = x
            out[doc] = (n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())
    return out, count, best


TEXTS = [None, "", " ", "a", "hello world, hello there", "don't  stop\n\n  me now ", "x" * 300, "naïve café “q” €", "漢字 かな 한글 😀", "<|endoftext|> and <s> </s> <0x41>", "▁ not given back", "tab\tand\r\nline", "\x00 zero", "é é", "1234567 3.14", "a b" * 40, "the end. The end."]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def same(rows, texts):
    want, *_ = plain(texts)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in rows}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tabé.▁'s")), max_size=60))
def test_ids_of_any_text(text):
    got, want = T.tokens(T.VOCABULARY_A, T.VOCABULARY_B).encode(["a word", text, "a ▁ b"])[1], sides(text)
    assert (got is None) == (want is None)
    if got:
        assert [T.np.frombuffer(x, T.np.uint16).tolist() for x in got] == [want[0][0], want[1][0]]


def test_align_equals_plain_version(spark, monkeypatch):
    texts = list(enumerate(TEXTS * 3))
    d = spark.createDataFrame(texts, COLUMNS).withColumn("row", F.lit("clash")).withColumn("pairs", F.lit(1)).repartition(3)
    same(T.align(d).collect(), texts)


def test_small_blocks_and_chunks(spark, monkeypatch):
    """Groups over block ends, documents over chunks."""
    texts = [(1, "some words that go on and on, " * 300), (2, "Überraschung naïve " * 200), (3, "é" * 3000), (4, None), (5, "short")]
    d = spark.createDataFrame(texts, COLUMNS)
    want = sorted(T.align(d).collect())
    monkeypatch.setattr(T, "BLOCK", 7)
    t = T.tokens(T.VOCABULARY_A, T.VOCABULARY_B)
    blocks = sorted(T.events(d).collect(), key=lambda r: (r.row, r.offset, r.side))
    chunk = []
    for key in dict.fromkeys(r.row for r in blocks):
        s = None
        for r in (r for r in blocks if r.row == key):
            s = s or T.Sweep(r.row, r.doc_id)
            if r.side != T.NONE:
                chunk.append(s.block(r.side, r.offset, T.np.frombuffer(r.ids, T.np.uint16).astype(T.np.int64), t))
                assert len(s.ids[0]) < 30 and len(s.ids[1]) < 30
        row = next(w for w in want if w.doc_id == s.doc_id)
        assert s.result()[2:6] == (row.n_a, row.n_b, row.n_groups, row.n_links) and s.result()[6] == row.groups_sha256
    same(want, texts)


def test_repeated_rows_count_each(spark):
    texts = [(1, "one two three"), (1, "one two three"), (2, "two"), (None, "two")]
    rows = sorted(T.align(spark.createDataFrame(texts, COLUMNS)).collect(), key=lambda r: (r.doc_id or 0, r.count_sum))
    _, count, _ = plain([(k, t) for k, (_, t) in enumerate(texts)])
    assert [r.doc_id for r in rows] == [None, 1, 1, 2] and rows[1] == rows[2]
    assert rows[1].count_sum == 2 * count[next(p for p in count if PIECES.id_to_piece(p[1]) == "▁one")] // 2 + 4 + 2
    assert T.align(spark.createDataFrame([], COLUMNS)).count() == 0


def test_pairs_table(spark):
    texts = list(enumerate(TEXTS))
    _, count, best = plain(texts)
    rows = T.pairs(spark.createDataFrame(texts, COLUMNS)).collect()
    assert {((r.a_id, r.b_id), r["count"], r.best) for r in rows} == {(p, n, n == best[p[1]]) for p, n in count.items()}


def test_query_over_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(op13_token_align(spark, "/root/testdata/sf0.001").collect(), docs)

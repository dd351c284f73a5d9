"""Queries of full-text, dense and hybrid retrieval, and of all-pairs similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import providers as P
from folioscope.functions import vectors as X
from folioscope.operators import catalog as C
from folioscope.operators import search as S
from folioscope.operators import similar as M
from folioscope.operators.nearest import NearIndex
from folioscope.operators.store import Snapshots, held
from folioscope.plans import views as V
from folioscope.plans.registry import ORACLES, query

QUESTION = "(1, 'the thing éau der ondre ThE'), (2, 'que elle licensed under MIT'), (3, 'nicht und-die einen')"


def questions(spark):
    rows = [(1, "the thing éau der ondre ThE"), (2, "que elle licensed under MIT"), (3, "nicht und-die einen")]
    return spark.createDataFrame(rows, "query_id long, question string")


def note_questions(spark, sf_dir):
    """The text of every note whose id is divisible by 50."""
    return V.notes(spark, sf_dir).where("id % 50 = 0 AND text IS NOT NULL").select(F.col("id").alias("query_id"), F.col("text").alias("question"))


#: The same as DuckDB's common table expressions.
_GIVEN = f"questions(query_id, question) AS (VALUES {QUESTION})"
_OF_NOTES = "questions AS (SELECT doc_id AS query_id, text AS question FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL)"


def for_notes(f):
    """Registers ``f``, which takes questions, a second time over those of notes."""
    query(f"{f.__name__}_notes", ORACLES[f.__name__].replace(_GIVEN, _OF_NOTES))(lambda spark, sf_dir: f(spark, sf_dir, held(note_questions(spark, sf_dir))))
    return f


_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_INDEX = f"""
  words AS (SELECT id, note_id, {_TOKENS.format("text_content")} AS w FROM chunks),
  lengths AS (SELECT id, note_id, len(w) AS length FROM words),
  places AS (SELECT id, note_id, len(w) AS length, unnest(w) AS token, unnest(generate_series(1, len(w))) AS place FROM words),
  stats AS (SELECT count(*) AS docs, avg(length) AS mean FROM lengths),
  {_GIVEN},
  terms AS (SELECT query_id, unnest(generate_series(1, len(t))) AS term, unnest(t) AS word FROM (
    SELECT query_id, list_filter(string_split_regex(question, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')[:50] AS t FROM questions)),
  asked AS (SELECT query_id, term, {_TOKENS.format("word")} AS t FROM terms),
  found AS (
    SELECT query_id, term, p.id, p.note_id, p.length, count(*) AS tf FROM asked JOIN places p ON p.token = t[1] JOIN words w ON w.id = p.id
    WHERE len(t) = 1 OR list_slice(w.w, p.place, p.place + len(t) - 1) = t GROUP BY ALL),
  df AS (SELECT query_id, term, count(*) AS n FROM found GROUP BY ALL),
  weighed AS (
    SELECT f.query_id, f.id, f.note_id, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS part
    FROM found f JOIN df USING (query_id, term), stats),
  bm25 AS (
    SELECT query_id, id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank
    FROM (SELECT query_id, id, note_id, round(-sum(part), 6) AS score FROM weighed GROUP BY ALL))"""
_LEX = """
  lex_words AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {table}),
  lex_sums AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 768 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(w), 9, 2) AS INT) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS s FROM lex_words GROUP BY ALL),
  lex AS (SELECT {key}, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS w FROM lex_sums WHERE s <> 0)"""


def _with(views: str, *parts: str) -> str:
    return "WITH " + ",\n".join([V.SQL[v] for v in views.split()] + list(parts))


def _lexed(spark, sf_dir):
    """Chunks with their offline vectors."""
    return V.lexical(spark, sf_dir)


_SOME = "held AS (SELECT id, note_id, text_content FROM chunks)"
_CHUNK_LEX = _LEX.format(key="id", text="text_content", table="held")


@query("a16_corpus_stats", _with("chunks", _INDEX) + " SELECT token, count(DISTINCT id) AS chunks, (SELECT docs FROM stats) AS docs, round((SELECT mean FROM stats), 6) AS mean FROM places GROUP BY token")
def a16_corpus_stats(spark, sf_dir):
    index = V.index(spark, sf_dir)
    return index.vocabulary().select("token", F.col("n").alias("chunks"), F.lit(index.docs).alias("docs"), F.lit(round(index.mean, 6)).alias("mean"))


@for_notes
@query("r1_bm25", _with("chunks", _INDEX) + " SELECT query_id, id, note_id, score, rank FROM bm25 WHERE rank <= 20")
def r1_bm25(spark, sf_dir, asked=None):
    return S.bm25(V.index(spark, sf_dir), asked or questions(spark), 20)


@for_notes
@query("r1_bm25_filtered", _with("chunks notes", _INDEX) + """
SELECT query_id, id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM bm25
WHERE note_id IN (SELECT id FROM notes WHERE category = 'journal' OR category LIKE 'journal/%') QUALIFY rank <= 10""".replace("FROM bm25", "FROM (SELECT query_id, id, note_id, score FROM bm25)"))
def r1_bm25_filtered(spark, sf_dir, asked=None):
    allowed = C.note_filter(V.notes(spark, sf_dir), V.note_tags(spark, sf_dir), category="journal")
    return S.bm25(V.index(spark, sf_dir), asked or questions(spark), 10, allowed)


_RAW_DOT = """
  q AS (SELECT id AS query_id, note_id AS own, vector FROM raw_vectors WHERE id % 50 = 0),
  s AS (SELECT q.query_id, q.own, r.id, r.note_id, round(list_sum(list_transform(list_zip(q.vector, r.vector), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM q, raw_vectors r),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query("w1_top_k", _with("raw_vectors", _RAW_DOT) + " SELECT query_id, id, note_id, score, rank FROM k WHERE rank <= 10")
def w1_top_k(spark, sf_dir):
    r = V.raw_vectors(spark, sf_dir)
    return M.top_k(r.where("id % 50 = 0"), r, 10)


@query("r3_dense_knn", _with("raw_vectors", _RAW_DOT, """
  w AS (SELECT * FROM k WHERE rank <= 30 AND note_id <> own QUALIFY row_number() OVER (PARTITION BY query_id, note_id ORDER BY score DESC, id) = 1)""") + """
SELECT query_id, id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, note_id, score FROM w) QUALIFY rank <= 5""")
def r3_dense_knn(spark, sf_dir):
    r = V.raw_vectors(spark, sf_dir)
    q = r.where("id % 50 = 0")
    return S.dense(q.select(F.col("id").alias("query_id"), "vector"), r, 5, q.select(F.col("id").alias("query_id"), "note_id"))


@query("r2_indexed_knn", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE (vec_id + 1) % 50 = 0")
def r2_indexed_knn(spark, sf_dir):
    """How many vectors are asked, and whether the stored index finds nine tenths
    of the ten nearest that comparing everything finds."""
    r = V.raw_vectors(spark, sf_dir).select("id", "note_id", "vector")
    near = NearIndex(Snapshots(spark, f"{V.workspace(spark)}/{uuid.uuid4().hex}"))
    near.add(r)
    asked = r.where("id % 50 = 0")
    want = M.top_k(asked, r, 10).select("query_id", "id")
    hit = want.join(near.search(asked, 10).select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.count("_hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("k24_vector_mirror", _with("raw_vectors") + """
SELECT id, note_id, round(list_sum(list_transform(CASE WHEN note_id % 10 = 0 THEN list_transform(vector, lambda x: -x) ELSE vector END, lambda x, i: i * x::DOUBLE)), 6) AS moment
FROM raw_vectors WHERE note_id % 7 <> 3 OR note_id % 10 = 0""")
def k24_vector_mirror(spark, sf_dir):
    """What the stored vector index holds after some vectors went, others were
    replaced by the table's current ones, and some of another length were refused."""
    r = V.raw_vectors(spark, sf_dir).select("id", "note_id", "vector")
    near = NearIndex(Snapshots(spark, f"{V.workspace(spark)}/{uuid.uuid4().hex}"))
    near.add(r)
    near.remove(r.where("note_id % 7 = 3").select("id"))
    now = r.where("note_id % 10 = 0").withColumn("vector", F.transform("vector", lambda x: -x)).union(r.where("note_id % 7 <> 3 AND note_id % 10 <> 0"))
    near.backfill(now.union(r.where("note_id % 2 = 0").select((-F.col("id")).alias("id"), "note_id", F.slice("vector", 1, 3))))
    return near.rows().select("id", "note_id", F.round(F.aggregate(F.transform("vector", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x), 6).alias("moment"))


@query("r5_dense_candidates", _with("raw_vectors", _RAW_DOT) + " SELECT query_id, id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, note_id, score FROM k WHERE rank <= 20) ")
def r5_dense_candidates(spark, sf_dir):
    r = V.raw_vectors(spark, sf_dir)
    return S.dense(r.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), r, 20, notes=False)


@query("r8_filtered_knn", _with("raw_vectors", _RAW_DOT) + """
SELECT query_id, id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, note_id, score FROM s WHERE note_id % 4 = 0) QUALIFY rank <= 5""")
def r8_filtered_knn(spark, sf_dir):
    r = V.raw_vectors(spark, sf_dir)
    allowed = r.where("note_id % 4 = 0").select(F.col("note_id").alias("id")).distinct()
    return S.dense(r.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), r, 5, notes=False, allowed=allowed)


@query("r27_embed", _with("chunks", _SOME, _CHUNK_LEX) + " SELECT id, count(*) AS buckets, round(sum(w * (bucket + 1)), 6) AS moment FROM lex GROUP BY 1")
def r27_embed(spark, sf_dir):
    v = P.embedded(V.chunks(spark, sf_dir).select("id", "text_content"), "text_content")
    moment = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.where("vector IS NOT NULL").select("id", F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("buckets"), F.round(moment, 6).alias("moment"))


_QLEX = """
  q_words AS (SELECT query_id, unnest(regexp_extract_all(lower(substr(question, 1, 32000)), '[a-z0-9]+')) AS w FROM questions),
  q_sums AS (SELECT query_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 768 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(w), 9, 2) AS INT) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS s FROM q_words GROUP BY ALL),
  q_lex AS (SELECT query_id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY query_id)) AS w FROM q_sums WHERE s <> 0),
  near AS (
    SELECT query_id, id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT q.query_id, c.id, c.note_id, round(coalesce(sum(q.w * l.w), 0), 6) + 0.0 AS score FROM (SELECT DISTINCT query_id FROM q_lex) u CROSS JOIN held c
      LEFT JOIN lex l ON l.id = c.id LEFT JOIN q_lex q ON q.query_id = u.query_id AND q.bucket = l.bucket GROUP BY ALL) QUALIFY rank <= 20)""".replace("SELECT q.query_id, c.id", "SELECT u.query_id, c.id")
_FUSED = """
  text AS (SELECT * FROM bm25 WHERE rank <= 20),
  fused AS (
    SELECT coalesce(d.query_id, t.query_id) AS query_id, coalesce(d.id, t.id) AS id, coalesce(d.note_id, t.note_id) AS note_id,
      round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0), 9) AS score, d.rank AS dense_rank, t.rank AS bm25_rank
    FROM near d FULL JOIN text t ON d.query_id = t.query_id AND d.id = t.id),
  final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM fused)"""
_HYBRID = _with("chunks", _SOME, _CHUNK_LEX, _INDEX.replace("FROM chunks)", "FROM held)", 1), _QLEX, _FUSED)


def _asked(spark, asked=None):
    q = asked or questions(spark)
    return q.join(P.embedded(q, "question"), "query_id")


def _hybrid(spark, sf_dir, asked=None, **how):
    return S.hybrid(_asked(spark, asked), V.index(spark, sf_dir), _lexed(spark, sf_dir), **how)


@for_notes
@query("r6_hybrid", _HYBRID + " SELECT query_id, id, note_id, score, dense_rank, bm25_rank, rank FROM final WHERE rank <= 5")
def r6_hybrid(spark, sf_dir, asked=None):
    return _hybrid(spark, sf_dir, asked)


@for_notes
@query("w3_fusion", _HYBRID + " SELECT query_id, id, score, dense_rank, bm25_rank FROM fused")
def w3_fusion(spark, sf_dir, asked=None):
    near = S.dense(_asked(spark, asked), _lexed(spark, sf_dir), 20, notes=False)
    return S.fuse(near, S.bm25(V.index(spark, sf_dir), asked or questions(spark), 20)).select("query_id", "id", "score", "dense_rank", "bm25_rank")


@for_notes
@query("r7_rerank", _HYBRID + """
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank) AS rank FROM (SELECT query_id, id, rank, length(text_content) % 7 AS r FROM final JOIN held USING (id) WHERE rank <= 20)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank) <= 5""")
def r7_rerank(spark, sf_dir, asked=None):
    text = V.chunks(spark, sf_dir).select("id", (F.length("text_content") % 7).alias("rerank_score"))
    return _hybrid(spark, sf_dir, asked, rerank=lambda pool: pool.join(text, "id")).select("query_id", "id", "rank")


@for_notes
@query("w4_ranked_notes", _HYBRID + " SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT query_id, note_id, min(rank) AS r FROM final WHERE rank <= 20 GROUP BY ALL)")
def w4_ranked_notes(spark, sf_dir, asked=None):
    return S.ranked_notes(_pool(spark, sf_dir, asked))


def _pool(spark, sf_dir, asked=None):
    near = S.dense(_asked(spark, asked), _lexed(spark, sf_dir), 20, notes=False)
    return S.fuse(near, S.bm25(V.index(spark, sf_dir), asked or questions(spark), 20)).where("rank <= 20")


@for_notes
@query("r20_search_page", _HYBRID + """
SELECT f.query_id, f.rank, f.note_id, 'doc-' || f.note_id AS title, CASE WHEN length(text_content) > 200 THEN substr(text_content, 1, 200) || '…' ELSE text_content END AS snippet, f.score FROM final f JOIN held USING (id) WHERE rank <= 5""")
def r20_search_page(spark, sf_dir, asked=None):
    return S.shown(_hybrid(spark, sf_dir, asked), V.chunks(spark, sf_dir), V.notes(spark, sf_dir))


@query("r21_fetch", V.sql("notes", "SELECT id, title, category, size_bytes FROM notes WHERE title = 'doc-17' OR id = 5"))
def r21_fetch(spark, sf_dir):
    return V.notes(spark, sf_dir).where("title = 'doc-17' OR id = 5").select("id", "title", "category", "size_bytes")


_FIRST = """
  firsts AS (SELECT note_id, min(id) AS id FROM held GROUP BY 1),
  sims AS (SELECT f.note_id AS src, b.id, c.note_id, round(sum(a.w * b.w), 6) AS score FROM firsts f JOIN lex a ON a.id = f.id JOIN lex b ON b.bucket = a.bucket JOIN held c ON c.id = b.id GROUP BY ALL),
  cut AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, id) <= 65),
  best AS (SELECT * FROM cut WHERE note_id <> src QUALIFY row_number() OVER (PARTITION BY src, note_id ORDER BY score DESC, id) = 1),
  ranked AS (SELECT src, note_id AS dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, id) AS rank FROM best)"""


@query("r9_connect", _with("chunks", _SOME, _CHUNK_LEX, _FIRST) + " SELECT src, dst, score, rank FROM ranked WHERE score > 0.7 AND rank <= 3")
def r9_connect(spark, sf_dir):
    return M.connect(_lexed(spark, sf_dir))


@query("r4_batch_knn", _with("chunks", _SOME, _CHUNK_LEX, _FIRST) + " SELECT src AS query_id, dst AS note_id, score, rank FROM ranked WHERE rank <= 12")
def r4_batch_knn(spark, sf_dir):
    c = _lexed(spark, sf_dir)
    first = C.first_chunks(c)
    own = first.select(F.col("note_id").alias("query_id"), "note_id")
    return S.dense(first.select(F.col("note_id").alias("query_id"), "vector"), c, 12, own).select("query_id", "note_id", "score", "rank")


_POOLED = """
  counts AS (SELECT note_id, count(*) AS k FROM held GROUP BY 1),
  sums AS (SELECT note_id, bucket, sum(w) / any_value(k) AS m FROM lex JOIN held USING (id) JOIN counts USING (note_id) GROUP BY 1, 2),
  pooled AS (SELECT note_id, bucket, m / sqrt(sum(m * m) OVER (PARTITION BY note_id)) AS w FROM sums),
  pairs AS (SELECT a.note_id AS a_id, b.note_id AS b_id, round(sum(a.w * b.w), 6) AS score FROM pooled a JOIN pooled b ON a.bucket = b.bucket AND a.note_id <> b.note_id GROUP BY ALL)"""


def _pooled(spark, sf_dir):
    return V.pooled(spark, sf_dir)


@query("j15_note_pairs", _with("chunks", _SOME, _CHUNK_LEX, _POOLED) + " SELECT a_id, b_id, score FROM pairs WHERE a_id < b_id AND score >= 0.85")
def j15_note_pairs(spark, sf_dir):
    return M.pairs_over(_pooled(spark, sf_dir), 0.85)


@query("r11_near_duplicates", _with("chunks notes", _SOME, _CHUNK_LEX, _POOLED) + """
SELECT a_id, b_id, score FROM pairs JOIN notes x ON x.id = a_id JOIN notes y ON y.id = b_id WHERE a_id < b_id AND score >= 0.9 AND x.content_hash <> y.content_hash ORDER BY score DESC, a_id, b_id LIMIT 30""")
def r11_near_duplicates(spark, sf_dir):
    return M.near_duplicate_notes(_pooled(spark, sf_dir), V.notes(spark, sf_dir))


@query("r13_suggested_edges", _with("chunks", _SOME, _CHUNK_LEX, _POOLED) + """
SELECT a_id AS src, b_id AS dst, score FROM pairs WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 3""")
def r13_suggested_edges(spark, sf_dir):
    p = _pooled(spark, sf_dir)
    return M.suggested_edges(p, p.select("id", F.col("id").alias("note_id"), "vector"))


@query("r10_related", _with("chunks", _SOME, _CHUNK_LEX, _POOLED) + " SELECT a_id AS query_id, b_id AS note_id, score FROM pairs WHERE a_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 5")
def r10_related(spark, sf_dir):
    p = _pooled(spark, sf_dir)
    asked = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    own = asked.select("query_id", F.col("query_id").alias("note_id"))
    return S.dense(asked, p.select("id", F.col("id").alias("note_id"), "vector"), 5, own).select("query_id", "note_id", "score")


_CLAIM = """
  near AS (SELECT a.id AS id, b.id AS other, round(list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score
    FROM claims a JOIN claims b ON a.note_id <> b.note_id AND a.vector IS NOT NULL AND b.vector IS NOT NULL),
  proposed AS (SELECT * FROM near WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5),
  pairs AS (SELECT DISTINCT least(id, other) AS a_id, greatest(id, other) AS b_id, score FROM proposed)"""


@query("r17_claim_pairs", _with("claims contradictions", _CLAIM) + """
SELECT a_id, b_id, score FROM pairs WHERE NOT EXISTS (SELECT 1 FROM contradictions c WHERE least(c.claim_a_id, c.claim_b_id) = a_id AND greatest(c.claim_a_id, c.claim_b_id) = b_id)""")
def r17_claim_pairs(spark, sf_dir):
    return M.claim_pairs(V.claims(spark, sf_dir), V.contradictions(spark, sf_dir), 0.3)


@query("j16_claim_neighbours", _with("claims", _CLAIM) + " SELECT a_id, b_id, score FROM pairs")
def j16_claim_neighbours(spark, sf_dir):
    return M.claim_pairs(V.claims(spark, sf_dir), least=0.3)


@query("f21_vector_functions", _with("raw_vectors") + """
SELECT a.id, round(list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS dot,
  round(sqrt(list_sum(list_transform(a.vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM raw_vectors a JOIN raw_vectors b ON b.id = a.id + 1""")
def f21_vector_functions(spark, sf_dir):
    a, b = V.raw_vectors(spark, sf_dir), V.raw_vectors(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return a.join(b, "id").select("id", F.round(X.dot(F.col("vector"), F.col("other")), 6).alias("dot"), F.round(X.norm(F.col("vector")), 6).alias("norm"))

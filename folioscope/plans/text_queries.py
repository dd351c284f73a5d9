"""Queries of text functions, hashes and chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import hashing as H
from folioscope.functions import text as T
from folioscope.operators import chunking as K
from folioscope.plans import views as V
from folioscope.plans.registry import query
from folioscope.plans.views import MODEL, sql

Z = T.ZWSP


def _docs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("f1_tag_names", r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(trim(text, ' '))), '[^a-z0-9]+', '-', 'g'), '-') AS tag FROM documents")
def f1_tag_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.tag_name(F.col("text")).alias("tag"))


@query("f2_fold", r"SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS folded FROM documents")
def f2_fold(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("f3_title_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(string_split(p_name || '#' || p_type, '#')[1]), '[a-z0-9]+'))), ' ') AS tokens FROM part")
def f3_title_tokens(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.title_tokens(F.concat("p_name", F.lit("#"), "p_type"))), " ").alias("tokens"))


@query("f4_keywords", r"""SELECT doc_id, regexp_matches(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '\bthe') AS first, regexp_matches(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '\bmit[\W_]+license') AS second FROM documents""")
def f4_keywords(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.keyword_found(F.col("text"), "Thé").alias("first"), T.keyword_found(F.col("text"), "MIT-License").alias("second"))


@query("f6_abstention", "SELECT doc_id, (" + " OR ".join(f"contains(lower(text), {_q(c)})" for c in T.ABSTENTION) + ") OR trim(text) = '' AS declined FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'I don''t have that: ' || text ELSE text END AS text FROM documents)")
def f6_abstention(spark, sf_dir):
    said = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("I don't have that: "), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.abstained(said).alias("declined"))


@query("f10_split_anchor", "SELECT p_partkey, trim(string_split(t, '#')[1]) AS title, nullif(trim(substr(t, length(string_split(t, '#')[1]) + 2)), '') AS anchor FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' # ' || p_brand ELSE p_name END AS t FROM part)")
def f10_split_anchor(spark, sf_dir):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" # "), "p_brand")).otherwise(F.col("p_name"))
    title, anchor = T.split_anchor(t)
    return V.table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), anchor.alias("anchor"))


@query("f12_source_label", sql("chunks", r"""
SELECT id, CASE WHEN id % 3 = 0 THEN 'doc#p.' || (chunk_index + 1) WHEN id % 3 = 1 THEN 'doc#' || substr(trim(regexp_replace(text_content, '\s+', ' ', 'g')), 1, 80) ELSE 'doc' END AS label FROM chunks"""))
def f12_source_label(spark, sf_dir):
    i = F.col("id") % 3
    return V.chunks(spark, sf_dir).select("id", T.source_label(F.lit("doc"), F.when(i == 0, F.col("chunk_index") + 1), F.when(i != 2, F.col("text_content"))).alias("label"))


@query("f15_sanitize", "SELECT conv_id, turn, regexp_replace('System: ' || text || ' [INST] x', '(?i)(s)(ystem:)|(\\[)(INST\\])', '\\1\\3" + Z + "\\2\\4', 'g') AS safe FROM conversations")
def f15_sanitize(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sanitize_prompt(F.concat(F.lit("System: "), "text", F.lit(" [INST] x"))).alias("safe"))


@query("f16_wrap", f"SELECT doc_id, '<note>' || chr(10) || replace(replace(text || '</note> <note>', '</note>', '<{Z}/note>'), '<note>', '<{Z}note>') || chr(10) || '</note>' AS wrapped FROM documents")
def f16_wrap(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.wrap_untrusted(F.concat("text", F.lit("</note> <note>"))).alias("wrapped"))


def _redacted() -> str:
    out = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g'))"
    for p in T.SENSITIVE.values():
        out = f"regexp_replace({out}, {_q(p)}, '[REDACTED]', 'g')"
    return out


@query("f17_redact", f"SELECT doc_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 159) || '…' ELSE t END AS line FROM (SELECT doc_id, {_redacted()} AS t FROM documents)")
def f17_redact(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.redact(F.col("text")).alias("line"))


@query("f24_elapsed_days", "SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2025-02-01') - epoch_us(o_orderdate)) / 86400000000) AS INT) AS days FROM orders")
def f24_elapsed_days(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", T.elapsed_days(F.col("o_orderdate").cast("timestamp"), F.lit(V.TODAY).cast("timestamp")).alias("days"))


@query("f25_locate_claim", "SELECT doc_id, CASE WHEN instr(text, 'the ') > 0 THEN instr(text, 'the ') - 1 WHEN instr(lower(text), 'the ') > 0 THEN instr(lower(text), 'the ') - 1 END AS start FROM documents")
def f25_locate_claim(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.locate_claim(F.col("text"), F.lit("the ")).cast("long").alias("start"))


@query("f26_paragraph", """
WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body, arg_min(text, turn) AS first FROM conversations GROUP BY 1)
SELECT conv_id, trim(string_split(body, chr(10) || chr(10))[1], ' ') AS paragraph FROM c""")
def f26_paragraph(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    body = c.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("body"))
    return body.select("conv_id", T.paragraph_around(F.col("body"), F.lit(2), F.lit(4)).alias("paragraph"))


@query("f27_slugs", r"SELECT conv_id, turn, substr(trim(regexp_replace(text, '[^A-Za-z0-9-]+', '_', 'g'), '_'), 1, 60) AS file, array_to_string(regexp_extract_all(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]+')[1:6], '-') AS thread FROM conversations")
def f27_slugs(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.file_slug(F.col("text")).alias("file"), T.thread_slug(F.col("text")).alias("thread"))


@query("f28_snippet", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS snippet FROM documents")
def f28_snippet(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("f29_sidecars", sql("notes", "SELECT id, '/vault/.sidecars/' || path || '.md' AS sidecar FROM notes"))
def f29_sidecars(spark, sf_dir):
    return V.notes(spark, sf_dir).select("id", T.sidecar_path("/vault", ".sidecars", F.col("path")).alias("sidecar"))


@query("f30_severity", "SELECT o_orderkey, CASE WHEN lower(trim(split_part(o_orderpriority, '-', 2))) IN ('low', 'medium', 'high') THEN lower(trim(split_part(o_orderpriority, '-', 2))) ELSE 'medium' END AS severity FROM orders")
def f30_severity(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", T.severity(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("severity"))


@query("f34_mentions", r"SELECT conv_id, turn, array_to_string(regexp_extract_all('@intro ' || text || ' @src/note.md x@y @two', '(?:^|\s)@([\w./-]+)', 1), ',') AS names FROM conversations")
def f34_mentions(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.mentions(F.concat(F.lit("@intro "), "text", F.lit(" @src/note.md x@y @two"))), ",").alias("names"))


@query("f36_hashes", sql("chunks", f"SELECT id, sha256('{MODEL}' || chr(0) || text_content) AS cache_key, substr(sha256('{MODEL}' || chr(0) || text_content), 1, 32) AS chunk_hash FROM chunks"))
def f36_hashes(spark, sf_dir):
    return V.chunks(spark, sf_dir).select("id", H.cache_key(MODEL, F.col("text_content")).alias("cache_key"), H.chunk_hash(MODEL, F.col("text_content")).alias("chunk_hash"))


@query("f36_content_hash", sql("notes", "SELECT id, content_hash, file_hash FROM notes"))
def f36_content_hash(spark, sf_dir):
    return V.notes(spark, sf_dir).select("id", "content_hash", "file_hash")


@query("f39_event_values", r"""SELECT event_id, CASE WHEN regexp_matches(props, '[ \t\n=]') THEN '"' || replace(replace(props, '\', '\\'), '"', '\"') || '"' ELSE props END AS quoted FROM events""")
def f39_event_values(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", T.event_value(F.col("props")).alias("quoted"))


@query("r23_windows", sql("chunks", "SELECT note_id, chunk_index, text_content AS chunk FROM chunks"))
def r23_windows(spark, sf_dir):
    return K.sliding_windows(_docs(spark, sf_dir).select(F.col("doc_id").alias("note_id"), "text"))


def _threads(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select(F.col("conv_id").alias("note_id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


@query("r23_packing", r"""
WITH RECURSIVE p AS (SELECT conv_id AS note_id, regexp_replace(text, '\A\s+|\s+\z', '', 'g') AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE trim(text) <> ''),
g AS (
  SELECT note_id, k, p, 0 AS chunk, length(p) AS n, length(p) > 1500 AS big FROM p WHERE k = 1
  UNION ALL
  SELECT p.note_id, p.k, p.p, CASE WHEN g.big OR length(p.p) > 1500 OR g.n + 2 + length(p.p) > 1500 THEN g.chunk + 1 ELSE g.chunk END,
    CASE WHEN g.big OR length(p.p) > 1500 OR g.n + 2 + length(p.p) > 1500 THEN length(p.p) ELSE g.n + 2 + length(p.p) END, length(p.p) > 1500
  FROM g JOIN p ON p.note_id = g.note_id AND p.k = g.k + 1),
c AS (SELECT note_id, chunk, string_agg(p, chr(10) || chr(10) ORDER BY k) AS t FROM g GROUP BY ALL),
w AS (SELECT note_id, chunk, j, substr(t, CAST(j * 1350 + 1 AS BIGINT), 1500) AS piece FROM (SELECT *, unnest(generate_series(0, CAST(ceil(greatest(length(t) - 1500, 0) / 1350.0) AS BIGINT))) AS j FROM c))
SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY chunk, j) - 1 AS INT) AS chunk_index, piece AS chunk FROM w""")
def r23_packing(spark, sf_dir):
    return K.chunked(_threads(spark, sf_dir))


@query("r25_semantic")
def r25_semantic(spark, sf_dir):
    from folioscope.functions.providers import Offline

    # a sentence without words has a vector, too
    embed = lambda said: [Offline.vector(s) if s.strip() else None for s in said]
    return K.semantic(_docs(spark, sf_dir).select(F.col("doc_id").alias("note_id"), "text"), embed)

"""Queries of language-model steps, of answers, and of operations on stored tables.

The offline provider's replies follow from digests, so DuckDB can say them, too.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.engine import Engine
from folioscope.functions import hashing as H
from folioscope.functions import providers as P
from folioscope.functions import text as T
from folioscope.operators import answer as A
from folioscope.operators import catalog as C
from folioscope.operators import chunking as K
from folioscope.operators import evaluate as E
from folioscope.operators import freshness as R
from folioscope.operators import graph as G
from folioscope.operators import matching as N
from folioscope.operators import mirror
from folioscope.operators import search as S
from folioscope.operators import segments, store
from folioscope.plans import views as V
from folioscope.plans.graph_queries import _BODIES, _GOLD, _LINKS, _turns, r14_wikilink_edges
from folioscope.plans.registry import ORACLES, query
from folioscope.plans.retrieval_queries import _HYBRID, _INDEX, for_notes, questions, r6_hybrid
from folioscope.plans.store_queries import r22_distill
from folioscope.plans.views import MODEL, TODAY, sql
from folioscope.sources import vault
from folioscope.streaming import jobs

Z = T.ZWSP


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _safe(expression: str) -> str:
    """The SQL of a text made safe for a prompt."""
    for m in T.ROLE_MARKERS:
        expression = f"regexp_replace({expression}, {_quoted('(?i)(' + re.escape(m[0]) + ')(' + re.escape(m[1:]) + ')')}, '\\1{Z}\\2', 'g')"
    return expression


def _byte(k: int) -> str:
    return f"CAST('0x' || substr(h, {2 * k + 1}, 2) AS INT)"


def _snapshots(spark) -> store.Snapshots:
    """Tables of one call, in the folder that the cluster shares."""
    return store.Snapshots(spark, f"{V.workspace(spark)}/{uuid.uuid4().hex}")


# -- provider steps


_TAGS = "[" + ", ".join(map(_quoted, P.TAGS)) + "]"


@query("r31_tagging", f"""
WITH d AS (SELECT doc_id AS id, md5({_safe("text")}) AS h FROM documents)
SELECT id, array_to_string(list_sort(list_distinct([{", ".join(f"{_TAGS}[{_byte(k)} % 7 + 1]" for k in range(3))}])), ',') AS tags, 'summary ' || substr(h, 1, 8) AS summary, {_TAGS}[{_byte(5)} % 7 + 1] AS category FROM d""")
def r31_tagging(spark, sf_dir):
    return A.tagged(V.notes(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@query("r31_claims", f"""
WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all({_safe("text")}, '[^.!?\\n]+[.!?]')[1:3], lambda x: substr(trim(x, ' ' || chr(9) || chr(13)), 1, 500)) AS c FROM documents),
c AS (SELECT DISTINCT doc_id, text, unnest(c) AS claim FROM d)
SELECT doc_id AS note_id, claim AS claim_text, CAST(CASE WHEN instr(text, claim) > 0 THEN instr(text, claim) - 1 WHEN instr(lower(text), lower(claim)) > 0 THEN instr(lower(text), lower(claim)) - 1 END AS INT) AS char_start FROM c WHERE claim <> ''
UNION ALL SELECT doc_id, NULL, NULL FROM d WHERE len(c) = 0""")
def r31_claims(spark, sf_dir):
    return mirror.extracted(V.notes(spark, sf_dir).select("id", "text")).select("note_id", "claim_text", "char_start")


@query("r31_verdicts", sql("claims contradictions", """
SELECT claim_a_id, claim_b_id, ['low', 'medium', 'high'][CAST('0x' || substr(h, 2, 1) AS INT) % 3 + 1] AS severity, 'they differ in ' || substr(h, 3, 6) AS explanation
FROM (SELECT claim_a_id, claim_b_id, md5('A: ' || a.claim_text || chr(10) || 'B: ' || b.claim_text) AS h FROM contradictions JOIN claims a ON a.id = claim_a_id JOIN claims b ON b.id = claim_b_id) WHERE h < '4'"""))
def r31_verdicts(spark, sf_dir):
    pairs = V.contradictions(spark, sf_dir).select(F.col("claim_a_id").alias("a_id"), F.col("claim_b_id").alias("b_id"))
    return mirror.judged(pairs, V.claims(spark, sf_dir))


@query("r31_decay", sql("notes freshness", f"""
SELECT note_path, h < '8' AS likely_stale, 'checked ' || substr(h, 3, 6) AS reason FROM (
  SELECT note_path, md5({_safe("text")}) AS h FROM freshness JOIN notes ON path = note_path WHERE date_diff('day', last_verified, TIMESTAMP '{TODAY}') > window_days)"""))
def r31_decay(spark, sf_dir):
    overdue = R.stale(V.freshness(spark, sf_dir), V.notes(spark, sf_dir), F.lit(TODAY).cast("timestamp"))
    return mirror.decay(overdue, V.notes(spark, sf_dir))


@query("k9_record_contradictions", sql("claims contradictions", """
SELECT claim_a_id, claim_b_id, severity, status FROM contradictions
UNION ALL SELECT a, b, 'low', 'open' FROM (SELECT DISTINCT least(id, id + 1 + id % 9) AS a, greatest(id, id + 1 + id % 9) AS b FROM claims WHERE id % 2 = 0)
  WHERE NOT EXISTS (SELECT 1 FROM contradictions WHERE least(claim_a_id, claim_b_id) = a AND greatest(claim_a_id, claim_b_id) = b)"""))
def k9_record_contradictions(spark, sf_dir):
    have = V.contradictions(spark, sf_dir).withColumns({"explanation": F.lit(""), "resolved_at": F.lit(None).cast("timestamp")})
    found = V.claims(spark, sf_dir).where("id % 2 = 0").select((F.col("id") + 1 + F.col("id") % 9).alias("claim_a_id"), F.col("id").alias("claim_b_id"), F.lit("low").alias("severity"), F.lit("").alias("explanation"))
    return mirror.recorded(found.union(found), have, F.lit(TODAY).cast("timestamp")).select("claim_a_id", "claim_b_id", "severity", "status")


@query("r38_persist_claims", sql("claims", """
WITH texts AS (SELECT note_id, claim_text FROM claims WHERE note_id % 3 = 0 AND id % 2 = 0 UNION SELECT note_id, 'new ' || note_id FROM claims WHERE note_id % 3 = 0 AND note_id % 2 = 0)
SELECT note_id, count(*) AS claims, count(vector) AS paired FROM (
  SELECT note_id, vector FROM claims WHERE note_id % 3 <> 0 UNION ALL SELECT c.note_id, c.vector FROM claims c JOIN texts USING (note_id, claim_text)
  UNION ALL SELECT note_id, CASE WHEN note_id % 4 = 0 THEN [1.0::FLOAT] END FROM texts WHERE claim_text LIKE 'new %') GROUP BY 1""".replace("WITH texts", ", texts", 1)).replace("\n\n, texts", ", texts"))
def r38_persist_claims(spark, sf_dir):
    """Claims of notes that are read again, one of which has none; vectors that fail stay null."""
    have = V.claims(spark, sf_dir)
    again = have.where("note_id % 3 = 0")
    kept = again.where("id % 2 = 0").select("note_id", "claim_text")
    new = again.where("note_id % 2 = 0").select("note_id", F.concat(F.lit("new "), "note_id").alias("claim_text"))
    none = again.select("note_id", F.lit(None).cast("string").alias("claim_text")).distinct()
    after, added = store.replace_claims(have, kept.union(new).union(none))
    vectors = added.where("note_id % 4 = 0").select("id", F.array(F.lit(1.0).cast("float")).alias("_v"))
    after = after.join(vectors, "id", "left").withColumn("vector", F.coalesce("vector", "_v"))
    return after.groupBy("note_id").agg(F.count(F.lit(1)).alias("claims"), F.count("vector").alias("paired"))


_WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"
_POINTS = f"""(len(words) < {T.SHORT_QUESTION} OR list_contains([{", ".join(map(_quoted, T.OPENERS))}], coalesce(words[1], '')) OR list_has_any(words, [{", ".join(map(_quoted, T.REFERENTIAL_ACCENTED))}])
  OR list_has_any(list_transform(words, lambda x: lower(regexp_replace(strip_accents(x), '[^\\x00-\\x7F]', '', 'g'))), [{", ".join(map(_quoted, T.REFERENTIAL))}]))"""


@query("f13_needs_rewrite", f"SELECT conv_id, turn, turn > 0 AND {_POINTS} AS rewrite FROM (SELECT *, {_WORDS} AS words FROM conversations WHERE role = 'user')")
def f13_needs_rewrite(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.needs_rewrite(F.col("text"), F.col("turn") > 0).alias("rewrite"))


@query("r40_rewrites", f"""
WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN substr(text, 1, 300) ELSE text END AS said FROM conversations),
h AS (SELECT *, {_WORDS} AS words, coalesce(string_agg(role || ': ' || said, chr(10)) OVER w, '') AS history, coalesce(string_agg(role || ': ' || {_safe("said")}, chr(10)) OVER w, '') AS safe
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, history <> '' AND {_POINTS} AS rewrite FROM h WHERE role = 'user')
SELECT conv_id, turn, text AS question, history, rewrite, CASE WHEN rewrite THEN trim({_safe("text")} || ' (' || string_split(safe, chr(10))[-1] || ')') ELSE text END AS rewritten FROM r""")
def r40_rewrites(spark, sf_dir):
    return A.rewrites(V.table(spark, sf_dir, "conversations"))


class Echo(P.Offline):
    """Replies with the prompt itself."""

    def complete(self, prompt: str) -> str:
        return prompt


@query("f23_json_replies", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN p_type END AS category FROM part")
def f23_json_replies(spark, sf_dir):
    """Whole, fenced and buried objects; no object, and one that is cut off."""
    found = F.to_json(F.struct(F.col("p_type").alias("category"), F.struct(F.lit("}{").alias("x")).alias("n")))
    shape = F.col("p_partkey") % 5
    reply = (
        F.when(shape == 0, found).when(shape == 1, F.concat(F.lit("Sure:\n```json\n"), found, F.lit("\n```\nDone."))).when(shape == 2, F.concat(F.lit("I {think} it is "), found, F.lit(" so.")))
        .when(shape == 3, F.lit("no object, [1, 2]")).otherwise(F.substring(found, 1, 8))
    )
    r = P.completed(V.table(spark, sf_dir, "part").select("p_partkey", reply.alias("prompt")), "prompt", Echo)
    return r.select("p_partkey", F.get_json_object("reply", "$.category").alias("category"))


# -- answers


def _anchored(spark, sf_dir):
    return V.chunks(spark, sf_dir).withColumns({"page": F.col("chunk_index") + 1, "heading": F.lit(None).cast("string")})


_CONTEXT = _HYBRID.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  block AS (SELECT query_id, rank, 'doc-' || f.note_id || '#p.' || (f.id % 1000000 + 1) AS label,
    '[[doc-' || f.note_id || '#p.' || (f.id % 1000000 + 1) || ']]' || chr(10) || '<note>' || chr(10) || replace(replace({_safe("text_content")}, '</note>', '<{Z}/note>'), '<note>', '<{Z}note>') || chr(10) || '</note>' AS block
    FROM final f JOIN held USING (id) WHERE rank <= 5),
  fold AS (
    SELECT query_id, rank, label, block, length(block) <= 3000 AS taken, CASE WHEN length(block) <= 3000 THEN length(block) ELSE 0 END AS used FROM block WHERE rank = 1
    UNION ALL SELECT b.query_id, b.rank, b.label, b.block, f.used + length(b.block) + CASE WHEN f.used > 0 THEN 2 ELSE 0 END <= 3000,
      CASE WHEN f.used + length(b.block) + CASE WHEN f.used > 0 THEN 2 ELSE 0 END <= 3000 THEN f.used + length(b.block) + CASE WHEN f.used > 0 THEN 2 ELSE 0 END ELSE f.used END
    FROM fold f JOIN block b ON b.query_id = f.query_id AND b.rank = f.rank + 1),
  context AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(label, '|' ORDER BY rank) AS sources FROM fold WHERE taken GROUP BY 1)"""


def _contexts(spark, sf_dir, asked=None):
    return A.context(r6_hybrid(spark, sf_dir, asked), _anchored(spark, sf_dir), V.notes(spark, sf_dir), 3000)


@for_notes
@query("r18_context", _CONTEXT + " SELECT * FROM context")
def r18_context(spark, sf_dir, asked=None):
    return _contexts(spark, sf_dir, asked).withColumn("sources", F.array_join("sources", "|"))


@for_notes
@query("r19_ask", _CONTEXT + f"""
SELECT q.query_id, question, 'summary ' || substr(md5('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || {_safe("question")}), 1, 8) AS answer, coalesce(sources, '') AS sources, 0 AS dropped_citations
FROM questions q LEFT JOIN context c ON c.query_id = q.query_id""")
def r19_ask(spark, sf_dir, asked=None):
    return A.ask(asked or questions(spark), _contexts(spark, sf_dir, asked)).withColumn("sources", F.array_join("sources", "|"))


@query("w5_passages", ORACLES["r22_distill"])
def w5_passages(spark, sf_dir):
    return r22_distill(spark, sf_dir).orderBy("note_id", "rank")


@query("k20_transcripts", "SELECT conv_id, string_agg('## ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def k20_transcripts(spark, sf_dir):
    return A.transcripts(V.table(spark, sf_dir, "conversations"))


@query("w8_budget", """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
r AS (
  SELECT conv_id, turn, k, len <= 1200 AS taken, CASE WHEN len <= 1200 THEN len ELSE 0 END AS used FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.k, r.used + len + CASE WHEN r.used > 0 THEN 2 ELSE 0 END <= 1200,
    CASE WHEN r.used + len + CASE WHEN r.used > 0 THEN 2 ELSE 0 END <= 1200 THEN r.used + len + CASE WHEN r.used > 0 THEN 2 ELSE 0 END ELSE r.used END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT conv_id, turn, taken, max(used) OVER (PARTITION BY conv_id) AS used FROM r""")
def w8_budget(spark, sf_dir):
    return C.budgeted(V.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 1200)


@query("k15_graph_json", sql("notes note_tags", "").removesuffix("\n") + ", " + _LINKS + """
SELECT 'node' AS type, '{"id":' || id || ',"title":"' || title || '","path":"' || path || '"' || CASE WHEN category IS NULL THEN '' ELSE ',"category":"' || category || '"' END || ',"tags":["' || (SELECT string_agg(tag, '","' ORDER BY tag) FROM note_tags WHERE note_id = id) || '"]}' AS json FROM notes
UNION ALL SELECT 'edge', '{"src":' || src || ',"dst":' || dst || ',"kind":"wikilink","weight":1.0' || CASE WHEN label IS NULL THEN '' ELSE ',"label":"' || label || '"' END || '}' FROM wiki""")
def k15_graph_json(spark, sf_dir):
    e = r14_wikilink_edges(spark, sf_dir).select("src", "dst", F.lit("wikilink").alias("kind"), F.lit(1.0).alias("weight"), "label")
    return G.as_json(G.nodes(V.notes(spark, sf_dir), V.note_tags(spark, sf_dir)), e)


# -- chunks and sources


@query("r24_sections", r"""
WITH p AS (SELECT conv_id AS note_id, turn, role, regexp_replace(text, '\A\s+|\s+\z', '', 'g') AS t FROM conversations WHERE trim(text) <> ''),
w AS (SELECT *, substr(t, CAST(j * 1350 + 1 AS BIGINT), 1500) AS piece FROM (SELECT *, unnest(generate_series(0, CAST(ceil(greatest(length(t) - 1500, 0) / 1350.0) AS BIGINT))) AS j FROM p))
SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY turn, j) - 1 AS INT) AS chunk_index, piece AS chunk, CAST(turn AS INT) AS page, role AS heading FROM w""")
def r24_sections(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    s = F.struct("text", F.col("turn").cast("int").alias("page"), F.col("role").alias("heading"), F.col("turn").cast("int").alias("order"))
    return K.pack_sections(c.groupBy(F.col("conv_id").alias("note_id")).agg(F.collect_list(s).alias("sections")))


@query("r25_sentences", rf"""
WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') AS p FROM documents)
SELECT doc_id, CAST(len(p) - len(list_filter(p[1:len(p) - 1], lambda x: list_contains([{", ".join(map(_quoted, K.ABBREVIATIONS))}], lower(string_split(x, ' ')[-1])))) AS INT) AS sentences FROM p""")
def r25_sentences(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(K.sentences(F.col("text"))).alias("sentences"))


_MAGIC = ["%PDF-1.7 x", "{\\rtf1 x", "PK\x03\x04 mimetypeapplication/epub+zip", "PK\x03\x04 mimetypeapplication/vnd.oasis.opendocument.text", "PK\x03\x04 word/document.xml", "PK\x03\x04 other", "plain"]


@query("s15_sniff", """
SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 512), '(?is)^\\s*<(!doctype\\s+html|html)') THEN 'html' END AS kind FROM pages
UNION ALL SELECT -doc_id, ['pdf', 'rtf', 'epub', 'odt', 'docx', NULL, NULL][doc_id % 7 + 1] FROM documents""")
def s15_sniff(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    made = F.element_at(F.array(*map(F.lit, _MAGIC)), (F.col("doc_id") % len(_MAGIC) + 1).cast("int"))
    d = V.table(spark, sf_dir, "documents").select((-F.col("doc_id")).alias("page_id"), made.cast("binary").alias("content"))
    return p.union(d).select("page_id", vault.sniffed(F.col("content")).alias("kind"))


@query("s5_markdown", r"""
SELECT CAST(doc_id AS VARCHAR) AS path, 'Title ' || doc_id AS title, lang,
  sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# Title ' || doc_id || chr(10) || text, '[ \t]+', ' ', 'g'), '\n{2,}', chr(10) || chr(10), 'g'), '[ \t\r\x0b\f]+(\n|\z)', '\1', 'g'), '\A\s+|\s+\z', '', 'g')) AS content_hash FROM documents""")
def s5_markdown(spark, sf_dir):
    from folioscope.sources.formats import extracted

    d = V.table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n# Title "), "doc_id", F.lit("\n"), "text").cast("binary")
    return extracted(d.select(F.col("doc_id").cast("string").alias("path"), F.lit("md").alias("ext"), raw.alias("content"))).where("error IS NULL").select("path", "title", F.element_at("metadata", "lang").alias("lang"), "content_hash")


@query("f19_resolve_category", sql("notes", "SELECT id, CASE WHEN id % 5 <> 0 THEN category END AS category FROM notes"))
def f19_resolve_category(spark, sf_dir):
    """Other spellings of known categories, and some that the tree has not."""
    n = V.notes(spark, sf_dir).select("id", "category")
    tree = n.select(F.col("category").alias("path")).where("path IS NOT NULL").distinct()
    spelled = F.when(F.col("id") % 5 == 0, F.concat("category", F.lit("/else"))).otherwise(F.replace(F.upper("category"), F.lit("/"), F.lit(" / ")))
    return N.resolved_categories(n.withColumn("category", spelled), tree)


@query("f37_failures", "WITH " + _GOLD + " SELECT case_id, turn_index, outcome, array_to_string(titles[1:5], '|') AS shown FROM turns JOIN (SELECT case_id, titles FROM gold) USING (case_id) WHERE outcome NOT IN ('ok', 'na')")
def f37_failures(spark, sf_dir):
    return E.failures(_turns(spark, sf_dir)).withColumn("shown", F.array_join("shown", "|"))


_CATEGORIES = """tree AS (SELECT DISTINCT category AS path, split_part(category, '/', 1) AS parent, split_part(category, '/', 2) AS name FROM notes WHERE category IS NOT NULL
    UNION SELECT DISTINCT split_part(category, '/', 1), '', split_part(category, '/', 1) FROM notes WHERE category IS NOT NULL)"""


@query("k18_taxonomy_file", sql("notes", "").rstrip() + f", {_CATEGORIES} SELECT path, parent, name, CAST(row_number() OVER (PARTITION BY parent ORDER BY path DESC) - 1 AS INT) AS ordinal FROM tree")
def k18_taxonomy_file(spark, sf_dir):
    """The tree of the notes' categories through a taxonomy file."""
    from folioscope.sources.config import dump_taxonomy, load_taxonomy

    c = V.notes(spark, sf_dir).where("category IS NOT NULL").select(F.col("category").alias("path")).distinct()
    root = c.select(F.substring_index("path", "/", 1).alias("path")).distinct()
    rows = c.select("path", F.substring_index("path", "/", 1).alias("parent")).union(root.select("path", F.lit("")))
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("parent").orderBy(F.desc("path"))) - 1)
    return load_taxonomy(spark, dump_taxonomy(spark.createDataFrame([], "name string, ordinal int"), rows))[1]


# -- stored tables


@query("k23_index_update", sql("chunks", "").rstrip() + ", " + _INDEX.strip().replace("FROM chunks", "FROM (SELECT * EXCLUDE (text_content), text_content || CASE WHEN note_id % 10 = 0 THEN ' zzfresh' ELSE '' END || CASE WHEN note_id % 15 = 0 THEN ' again zzfresh' ELSE '' END AS text_content FROM chunks WHERE note_id % 7 <> 3)") + """
SELECT token, count(*) AS places, count(DISTINCT id) AS chunks, (SELECT docs FROM stats) AS docs, round((SELECT mean FROM stats), 6) AS mean
FROM places GROUP BY 1""")
def k23_index_update(spark, sf_dir):
    """Three changes of a stored index: some chunks get another text, some of
    these once more, and some are gone. What is live in its segments is counted,
    and that their vocabulary agrees."""
    text = segments.Segments(_snapshots(spark))
    c = V.chunks(spark, sf_dir)
    text.update(c)
    with_more = lambda rows, more: rows.withColumn("text_content", F.concat("text_content", F.lit(more)))
    text.update(with_more(c.where("note_id % 10 = 0"), " zzfresh"))
    text.update(None, c.where("note_id % 7 = 3").select("id"))
    both = F.when(F.col("note_id") % 10 == 0, F.concat("text_content", F.lit(" zzfresh"))).otherwise(F.col("text_content"))
    text.update(with_more(c.where("note_id % 15 = 0 AND note_id % 7 <> 3").withColumn("text_content", both), " again zzfresh"))
    index = text.index()
    places = index.chunks.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("places"))
    return places.join(index.vocabulary(), "token").select("token", "places", F.col("n").alias("chunks"), F.lit(index.docs).alias("docs"), F.lit(round(index.mean, 6)).alias("mean"))


@query("r29_migration", sql("chunks", "").rstrip() + """, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE id % 3 = 0) AS first, count(*) FILTER (WHERE id % 3 <> 2) AS second FROM chunks)
SELECT 1 AS step, first AS done, total, false AS swapped FROM n UNION ALL SELECT 2, second, total, false FROM n UNION ALL SELECT 3, total, total, true FROM n""")
def r29_migration(spark, sf_dir):
    """Three calls; in the first two some chunks get no vector and come again."""
    s = _snapshots(spark)
    c = V.chunks(spark, sf_dir).select("id", H.cache_key(MODEL, F.col("text_content")).alias("key"))
    s.replace("chunks", c.withColumn("vector", F.array(F.lit(1.0))))
    m, rows = store.Migration(s, "chunks", "other"), []
    m.begin()
    for step, good in enumerate(("id % 3 = 0", "id % 3 = 1", "true"), 1):
        m.add(m.pending().withColumn("vector", F.when(F.expr(good), F.array(F.lit(0.0), F.lit(1.0)))))
        done, total = m.progress()
        rows.append((step, done, total, m.swap()))
    return spark.createDataFrame(rows, "step int, done long, total long, swapped boolean")


@query("r36_stored_compaction", "SELECT o_orderkey, o_orderstatus, 4 AS files FROM orders")
def r36_stored_compaction(spark, sf_dir):
    s = _snapshots(spark)
    s.replace("orders", V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition(16))
    s.compacted("orders", 4)
    return s.current("orders").withColumn("files", F.lit(s.files("orders")))


@query("k21_backup", "SELECT k AS stamp, k <= 2 AS dropped FROM range(1, 8) t(k)")
def k21_backup(spark, sf_dir):
    """Seven backups, of which the newest five stay."""
    s = _snapshots(spark)
    s.replace("region", V.table(spark, sf_dir, "region"))
    dropped = {int(x) for k in range(1, 8) for x in s.backup(["region"], str(k), 5)}
    return spark.createDataFrame([(k, k in dropped) for k in range(1, 8)], "stamp long, dropped boolean")


@query("k25_matrix_seal", sql("raw_vectors", "SELECT note_id % 2 AS part, count(*) || ':' || max(id) || ':' || sum(4 * len(vector)) AS seal FROM raw_vectors GROUP BY 1"))
def k25_matrix_seal(spark, sf_dir):
    """What tells a kept matrix from a changed table, of two tables."""
    r = V.raw_vectors(spark, sf_dir)
    seal = lambda k: C.signature(r.where(f"note_id % 2 = {k}")).select(F.lit(k).cast("long").alias("part"), F.concat_ws(":", "n", "max_id", "bytes").alias("seal"))
    return seal(0).union(seal(1))


@query("k25_matrix", sql("raw_vectors", "").rstrip() + """, v AS (SELECT note_id, CASE WHEN id % 4 = 0 THEN list_transform(vector, lambda x, i: CASE WHEN i = 1 THEN 2 * x::DOUBLE ELSE -x::DOUBLE END) ELSE vector::DOUBLE[] END AS vector FROM raw_vectors),
  m AS (SELECT note_id, i, avg(x) AS x FROM (SELECT note_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v) GROUP BY ALL)
SELECT note_id AS id, round(sum(x * i) / sqrt(sum(x * x)), 6) AS moment FROM m GROUP BY 1""")
def k25_matrix(spark, sf_dir):
    """The kept matrix after chunks got other vectors of the same length under the same ids."""
    e = Engine(spark, f"{V.workspace(spark)}/{uuid.uuid4().hex}")
    rows = V.raw_vectors(spark, sf_dir).select("id", "note_id", F.col("vector").cast("array<double>").alias("vector"))
    e.tables.replace("chunks", rows)
    e.matrix()
    other = F.transform("vector", lambda x, i: F.when(i == 0, 2 * x).otherwise(-x))
    e.tables.merge("chunks", rows.where("id % 4 = 0").withColumn("vector", other), ["id"])
    return e.matrix().select("id", F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("moment"))


@query("k19_commits", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'x' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 1 THEN 0 ELSE round(o_totalprice, 2) END AS o_totalprice
FROM orders WHERE o_orderkey % 7 <> 2""")
def k19_commits(spark, sf_dir):
    """Two writers of one table: what they append from one version, then merge,
    delete and compact, is all there."""
    a = _snapshots(spark)
    b = store.Snapshots(spark, a.root)
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    a.replace("orders", orders.where("o_orderkey % 3 = 0"))
    a.current("orders"), b.current("orders")
    a.append("orders", orders.where("o_orderkey % 3 = 1"))
    b.append("orders", orders.where("o_orderkey % 3 = 2"))
    a.merge("orders", orders.where("o_orderkey % 10 = 1 AND o_orderkey % 7 <> 2").withColumns({"o_orderstatus": F.lit("x"), "o_totalprice": F.lit(0.0)}), ["o_orderkey"])
    b.merge("orders", None, ["o_orderkey"], gone=orders.where("o_orderkey % 7 = 2"))
    a.compacted("orders")
    return b.current("orders")


@query("k26_threads", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (ORDER BY conv_id * 1000 + turn DESC) <= 6")
def k26_threads(spark, sf_dir):
    """A thread saved and loaded again, its last six turns."""
    from folioscope.sources.threads import Threads

    c = V.table(spark, sf_dir, "conversations")
    t = Threads(spark, f"{V.workspace(spark)}/{uuid.uuid4().hex}")
    t.save("all", c.select(F.timestamp_seconds(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("text").alias("q"), F.lit("").alias("a"), F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sources")))
    return t.load("all", 6).select(F.get("sources", 0).cast("long").alias("conv_id"), F.get("sources", 1).cast("long").alias("turn"), F.col("q").alias("text"))


@query("p17_available", sql("raw_vectors", "SELECT note_id, count(*) > 0 AND min(len(vector)) = max(len(vector)) AS vectors FROM raw_vectors GROUP BY 1"))
def p17_available(spark, sf_dir):
    v = F.size("vector")
    return V.raw_vectors(spark, sf_dir).groupBy("note_id").agg(((F.count(F.lit(1)) > 0) & (F.min(v) == F.max(v))).alias("vectors"))


@query("t6_due_jobs", """
SELECT event_type || user_id AS job, max(ts) AS last FROM events GROUP BY event_type, user_id HAVING date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') >= 86400000000 * (1 + user_id % 7)""")
def t6_due_jobs(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.concat("event_type", "user_id").alias("job"), (86_400 * (1 + F.col("user_id") % 7)).alias("every_seconds"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.due(e.select("job", "every_seconds").distinct(), e, F.lit("2024-01-31").cast("timestamp")).select("job", "last")

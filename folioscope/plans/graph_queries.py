"""Queries of the link graph, freshness, contradictions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluate as E
from folioscope.operators import freshness as R
from folioscope.operators import graph as G
from folioscope.plans import views as V
from folioscope.plans.registry import query
from folioscope.plans.retrieval_queries import _CHUNK_LEX, _POOLED, _SOME, r13_suggested_edges
from folioscope.plans.views import TODAY, sql

_BODIES = """bodies AS (SELECT id, title, format, 'see [[Doc-' || (id + 1) || '#part ' || id % 4 || '|next]] and [[doc-' || (id * 7 % 1000) || ']], [[doc-' || (id + 1) || ']] or [[nowhere]] [[doc-' || id || ']]' AS text FROM notes)"""
_LINKS = _BODIES + """,
  links AS (SELECT id AS src, unnest(generate_series(1, len(x))) AS place, unnest(x) AS target FROM (SELECT id, regexp_extract_all(text, '\\[\\[([^\\[\\]|]+?)(?:\\|[^\\[\\]]*)?\\]\\]', 1) AS x FROM bodies WHERE coalesce(format, 'md') = 'md')),
  wiki AS (SELECT l.src, n.id AS dst, arg_min([nullif(trim(string_split(target, '#')[2]), '')], place)[1] AS label FROM links l
    JOIN (SELECT lower(title) AS key, min(id) AS id FROM notes GROUP BY 1) n ON n.key = lower(trim(string_split(target, '#')[1])) WHERE l.src <> n.id GROUP BY 1, 2)"""


def bodies(spark, sf_dir):
    text = F.concat(
        F.lit("see [[Doc-"), F.col("id") + 1, F.lit("#part "), F.col("id") % 4, F.lit("|next]] and [[doc-"), F.col("id") * 7 % 1000, F.lit("]], [[doc-"), F.col("id") + 1, F.lit("]] or [[nowhere]] [[doc-"), F.col("id"), F.lit("]]")
    )
    return V.notes(spark, sf_dir).select("id", "title", "format", text.alias("text"))


@query("f9_wikilinks", sql("notes", "").removesuffix("\n") + ", " + _BODIES + " SELECT id, array_to_string(regexp_extract_all(text, '\\[\\[([^\\[\\]|]+?)(?:\\|[^\\[\\]]*)?\\]\\]', 1), ',') AS links, len(regexp_extract_all(text, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS cited FROM bodies")
def f9_wikilinks(spark, sf_dir):
    return bodies(spark, sf_dir).select("id", F.array_join(T.wikilinks(F.col("text")), ",").alias("links"), F.size(T.citations(F.col("text"))).alias("cited"))


@query("r14_wikilink_edges", sql("notes", "").removesuffix("\n") + ", " + _LINKS + " SELECT src, dst, label FROM wiki")
def r14_wikilink_edges(spark, sf_dir):
    return G.wikilink_edges(bodies(spark, sf_dir))


@query("j17_title_index", sql("notes", "SELECT lower(title) AS key, min(id) AS id FROM notes GROUP BY 1"))
def j17_title_index(spark, sf_dir):
    return G.title_index(V.notes(spark, sf_dir))


_CONTRA = """lifted AS (SELECT c.id, c.severity, least(a.note_id, b.note_id) AS src, greatest(a.note_id, b.note_id) AS dst FROM contradictions c JOIN claims a ON a.id = claim_a_id JOIN claims b ON b.id = claim_b_id
    WHERE status <> 'dismissed' AND a.note_id <> b.note_id),
  contra AS (SELECT src, dst, arg_min(severity, id) AS severity FROM lifted GROUP BY 1, 2)"""


@query("r15_contradiction_edges", sql("claims contradictions", "").removesuffix("\n") + ", " + _CONTRA + " SELECT src, dst, severity FROM contra")
def r15_contradiction_edges(spark, sf_dir):
    return G.contradiction_edges(V.contradictions(spark, sf_dir), V.claims(spark, sf_dir))


_GRAPH = "WITH " + ",\n".join(V.SQL[v] for v in ("chunks", "notes", "claims", "contradictions")) + ", " + ", ".join((_SOME, _CHUNK_LEX.strip(), _POOLED.strip(), _LINKS, _CONTRA)) + """,
  edges AS (
    SELECT src, dst, 'wikilink' AS kind, 1.0::DOUBLE AS weight, label FROM wiki
    UNION ALL SELECT a_id, b_id, 'suggested', score, NULL FROM (SELECT a_id, b_id, score FROM pairs WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 3)
    UNION ALL SELECT src, dst, 'contradiction', 1.0, severity FROM contra)"""


def _edges(spark, sf_dir):
    return G.build(r14_wikilink_edges(spark, sf_dir), r13_suggested_edges(spark, sf_dir), r15_contradiction_edges(spark, sf_dir))


@query("r16_graph", _GRAPH + " SELECT * FROM edges")
def r16_graph(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("a11_graph_stats", _GRAPH + " SELECT kind, count(*) AS edges FROM edges GROUP BY 1")
def a11_graph_stats(spark, sf_dir):
    return G.stats(_edges(spark, sf_dir))


@query("k15_graph_dot", sql("notes", "").removesuffix("\n") + ", " + _LINKS + """
SELECT 0 AS part, 'digraph notes {' AS line UNION ALL SELECT 3, '}'
UNION ALL SELECT 1, '  n' || id || ' [label="' || title || '"];' FROM notes UNION ALL SELECT 2, '  n' || src || ' -> n' || dst || ' [label="wikilink"];' FROM wiki""")
def k15_graph_dot(spark, sf_dir):
    e = r14_wikilink_edges(spark, sf_dir).withColumn("kind", F.lit("wikilink"))
    return G.as_dot(V.notes(spark, sf_dir), e)


@query("f32_canvas", sql("notes", """
SELECT id, (dense_rank() OVER (ORDER BY coalesce(category, '')) - 1) * 320 AS x, (row_number() OVER (PARTITION BY coalesce(category, '') ORDER BY title, id) - 1) * 110 AS y FROM notes"""))
def f32_canvas(spark, sf_dir):
    return G.canvas_places(V.notes(spark, sf_dir))


@query("r30_stale", sql("notes freshness", f"""
SELECT note_path, title, days, window_days, days - window_days AS days_overdue FROM (
  SELECT f.note_path, n.title, CAST(date_diff('day', last_verified, TIMESTAMP '{TODAY}') AS INT) AS days, window_days FROM freshness f JOIN notes n ON n.path = f.note_path) WHERE days > window_days"""))
def r30_stale(spark, sf_dir):
    return R.stale(V.freshness(spark, sf_dir), V.notes(spark, sf_dir), F.lit(TODAY).cast("timestamp"))


_WINDOW = "CASE WHEN coalesce(category, '') = 'journal' OR category LIKE 'journal/%' THEN 30 WHEN category LIKE 'projects/%' THEN 90 WHEN category LIKE 'reference/%' THEN 365 ELSE 180 END"


@query("j21_window_days", sql("notes", f"SELECT id, {_WINDOW} AS window_days FROM notes"))
def j21_window_days(spark, sf_dir):
    return V.notes(spark, sf_dir).select("id", R.window_days(F.coalesce("category", F.lit(""))).alias("window_days"))


@query("j20_freshness_seed", sql("notes freshness", f"""
SELECT note_path, coalesce(f.last_verified, anchor) AS last_verified, coalesce(new_window, f.window_days) AS window_days,
  CASE WHEN f.window_days IS NULL THEN 'add' WHEN new_window IS NULL THEN 'remove' WHEN f.window_days <> new_window THEN 'update' ELSE 'keep' END AS action
FROM (SELECT path AS note_path, coalesce(last_tagged, last_seen) AS anchor, {_WINDOW} AS new_window FROM notes WHERE id % 10 <> 0) n FULL JOIN freshness f USING (note_path)"""))
def j20_freshness_seed(spark, sf_dir):
    return R.seed(V.notes(spark, sf_dir).where("id % 10 <> 0"), V.freshness(spark, sf_dir))


@query("j4_freshness_join", sql("notes freshness", "SELECT n.id, f.window_days FROM freshness f JOIN notes n ON n.path = f.note_path"))
def j4_freshness_join(spark, sf_dir):
    f, n = V.freshness(spark, sf_dir), V.notes(spark, sf_dir)
    return f.join(n, f["note_path"] == n["path"]).select("id", "window_days")


@query("r43_verify", sql("notes freshness", "SELECT note_path, CASE WHEN note_path LIKE 'src1/%' THEN TIMESTAMP '2025-02-01' ELSE last_verified END AS last_verified, window_days FROM freshness"))
def r43_verify(spark, sf_dir):
    f = V.freshness(spark, sf_dir)
    return R.verify(f, f.where("note_path LIKE 'src1/%'"), F.lit(TODAY).cast("timestamp"))


@query("w6_contradictions", sql("claims contradictions", """
SELECT c.id, severity, status, a.note_id AS note_a, a.claim_text AS text_a, b.note_id AS note_b, b.claim_text AS text_b, detected_at, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_order
FROM contradictions c JOIN claims a ON a.id = claim_a_id JOIN claims b ON b.id = claim_b_id WHERE status = 'open'"""))
def w6_contradictions(spark, sf_dir):
    return R.listed_contradictions(V.contradictions(spark, sf_dir), V.claims(spark, sf_dir))


@query("k10_set_status", sql("claims contradictions", """
SELECT id, severity, CASE WHEN severity = 'low' THEN 'dismissed' ELSE status END AS status, CASE WHEN severity = 'low' THEN TIMESTAMP '2025-02-01' END AS resolved_at FROM contradictions"""))
def k10_set_status(spark, sf_dir):
    c = V.contradictions(spark, sf_dir)
    return R.set_status(c, c.where("severity = 'low'"), "dismissed", F.lit(TODAY).cast("timestamp")).select("id", "severity", "status", "resolved_at")


@query("j19_new_contradictions", sql("claims contradictions", """
SELECT DISTINCT least(id, id + 4) AS claim_a_id, greatest(id, id + 4) AS claim_b_id FROM claims WHERE NOT EXISTS (SELECT 1 FROM contradictions c WHERE least(claim_a_id, claim_b_id) = claims.id AND greatest(claim_a_id, claim_b_id) = claims.id + 4)"""))
def j19_new_contradictions(spark, sf_dir):
    c = V.claims(spark, sf_dir)
    found = c.select((F.col("id") + 4).alias("claim_a_id"), F.col("id").alias("claim_b_id")).union(c.select("id", F.col("id") + 4))
    return R.new_contradictions(found, V.contradictions(spark, sf_dir).select("claim_a_id", "claim_b_id"))


_GOLD = """gold AS (
  SELECT item_id AS case_id, 0 AS turn_index, CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 'b' END AS category, item_id % 7 = 6 AS negative,
    CASE WHEN item_id % 7 = 6 THEN [] ELSE ['part ' || item_id, 'note ' || (item_id + 1)] END AS expected,
    ['Note ' || (item_id + 2), 'The Part: ' || (item_id % 5 * 8) || '!', 'note-' || (item_id + 1) || '#p.2', 'part ' || (item_id // 2 * 2)] AS titles FROM benchmark),
  toks AS (SELECT *, list_transform(expected, lambda e: regexp_extract_all(lower(e), '[a-z0-9]+')) AS e, list_transform(titles, lambda t: regexp_extract_all(lower(string_split(t, '#')[1]), '[a-z0-9]+')) AS t FROM gold),
  m AS (SELECT *, list_transform(t, lambda x: len(list_filter(e, lambda y: list_has_all(x, y))) > 0) AS hit FROM toks),
  turns AS (SELECT case_id, turn_index, category, negative, expected = [] OR coalesce(hit[1], false) AS hit_at_1, expected = [] OR list_contains(hit[1:3], true) AS hit_at_3,
    round(CASE WHEN expected = [] THEN 1.0 WHEN list_contains(hit, true) THEN 1.0 / list_position(hit, true) ELSE 0.0 END, 6)::DOUBLE AS mrr,
    round(CASE WHEN expected = [] THEN 1.0 ELSE len(list_filter(e, lambda y: len(list_filter(t, lambda x: list_has_all(x, y))) > 0)) / len(e) END, 6)::DOUBLE AS recall,
    CASE WHEN negative THEN 'na' WHEN expected = [] THEN 'ok' WHEN NOT list_contains(hit, true) THEN 'retrieval_miss' WHEN NOT list_contains(hit[1:2], true) THEN 'ranking_miss' ELSE 'ok' END AS outcome FROM m)"""


def _turns(spark, sf_dir):
    i = F.col("item_id")
    b = V.table(spark, sf_dir, "benchmark").select(
        i.alias("case_id"), F.lit(0).alias("turn_index"), F.when(i % 3 == 0, "a").otherwise("b").alias("category"), (i % 7 == 6).alias("negative"),
        F.when(i % 7 == 6, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("part "), i), F.concat(F.lit("note "), i + 1))).alias("expected"),
        F.array(F.concat(F.lit("Note "), i + 2), F.concat(F.lit("The Part: "), i % 5 * 8, F.lit("!")), F.concat(F.lit("note-"), i + 1, F.lit("#p.2")), F.concat(F.lit("part "), F.floor(i / 2) * 2)).alias("titles"),
    )
    return E.scored(b, 2)


@query("f5_turn_metrics", "WITH " + _GOLD + " SELECT case_id, turn_index, hit_at_1, hit_at_3, mrr, recall, outcome FROM turns")
def f5_turn_metrics(spark, sf_dir):
    return _turns(spark, sf_dir).select("case_id", "turn_index", "hit_at_1", "hit_at_3", "mrr", "recall", "outcome")


@query("a12_eval_summary", "WITH " + _GOLD + """
SELECT count(*) AS turns, count(*) FILTER (WHERE NOT negative) AS positive, round(avg(hit_at_1::INT) FILTER (WHERE NOT negative), 6) AS hit_at_1, round(avg(hit_at_3::INT) FILTER (WHERE NOT negative), 6) AS hit_at_3,
  round(avg(mrr) FILTER (WHERE NOT negative), 6) AS mrr, round(avg(recall) FILTER (WHERE NOT negative), 6) AS recall, round(avg((outcome = 'ok')::INT) FILTER (WHERE outcome <> 'na'), 6) AS pass_rate FROM turns""")
def a12_eval_summary(spark, sf_dir):
    return E.summary(_turns(spark, sf_dir))


@query("a13_by_category", "WITH " + _GOLD + " SELECT category, count(*) AS n, round(avg(hit_at_1::INT), 6) AS hit_at_1, round(avg(hit_at_3::INT), 6) AS hit_at_3, round(avg(mrr), 6) AS mrr FROM turns WHERE NOT negative GROUP BY 1")
def a13_by_category(spark, sf_dir):
    return E.by_category(_turns(spark, sf_dir))


@query("f7_outcomes", "WITH " + _GOLD + " SELECT outcome, count(*) AS n FROM turns GROUP BY 1")
def f7_outcomes(spark, sf_dir):
    return E.outcomes(_turns(spark, sf_dir))


@query("a15_stage_latency", "SELECT stage, round(avg(seconds), 6) AS seconds FROM (SELECT event_type AS stage, value AS seconds FROM events UNION ALL SELECT 'all', value FROM events WHERE user_id % 2 = 0) GROUP BY 1")
def a15_stage_latency(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    t = F.when(F.col("user_id") % 2 == 0, F.create_map(F.col("event_type"), F.col("value"), F.lit("all"), F.col("value"))).otherwise(F.create_map(F.col("event_type"), F.col("value")))
    return E.stage_means(e.select(t.alias("timings")))


@query("r34_run_diff", "WITH " + _GOLD + """,
  after AS (SELECT case_id, turn_index, CASE WHEN case_id % 4 = 0 THEN 1.0 ELSE mrr END AS mrr, CASE WHEN case_id % 5 = 1 THEN 0.0 ELSE recall END AS recall FROM turns WHERE case_id % 9 <> 2),
  before AS (SELECT case_id, turn_index, mrr, recall FROM turns WHERE case_id % 9 <> 5)
SELECT case_id, turn_index, round(a.mrr - b.mrr, 6)::DOUBLE AS d_mrr, round(a.recall - b.recall, 6)::DOUBLE AS d_recall,
  CASE WHEN b.mrr IS NULL THEN 'new' WHEN a.mrr IS NULL THEN 'dropped' WHEN (a.mrr < b.mrr - 1e-9 OR a.recall < b.recall - 1e-9) AND (a.mrr > b.mrr + 1e-9 OR a.recall > b.recall + 1e-9) THEN 'changed'
    WHEN a.mrr < b.mrr - 1e-9 OR a.recall < b.recall - 1e-9 THEN 'regressed' WHEN a.mrr > b.mrr + 1e-9 OR a.recall > b.recall + 1e-9 THEN 'improved' ELSE 'same' END AS status
FROM before b FULL JOIN after a USING (case_id, turn_index)""")
def r34_run_diff(spark, sf_dir):
    t = _turns(spark, sf_dir).select("case_id", "turn_index", "mrr", "recall")
    after = t.where("case_id % 9 <> 2").select("case_id", "turn_index", F.when(F.col("case_id") % 4 == 0, 1.0).otherwise(F.col("mrr")).alias("mrr"), F.when(F.col("case_id") % 5 == 1, 0.0).otherwise(F.col("recall")).alias("recall"))
    return E.compared(t.where("case_id % 9 <> 5"), after)

"""Queries of merges, streaming operators in batch form, and answering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import hashing as H
from folioscope.functions import providers as P
from folioscope.operators import answer as A
from folioscope.operators import catalog as C
from folioscope.operators import store as K
from folioscope.plans import views as V
from folioscope.plans.registry import query
from folioscope.plans.retrieval_queries import _CHUNK_LEX, _SOME, for_notes, r6_hybrid
from folioscope.plans.views import MODEL, sql
from folioscope.streaming import breaker
from folioscope.streaming import debounce as D

_OLD = "old AS (SELECT path, title, CASE WHEN id % 3 = 0 THEN 'h' ELSE file_hash END AS file_hash, size_bytes FROM notes WHERE id % 4 <> 1)"
_NEW = "new AS (SELECT path, upper(title) AS title, CASE WHEN id % 5 <> 0 THEN file_hash END AS file_hash, size_bytes + 1 AS size_bytes FROM notes WHERE id % 6 <> 2)"


@query("k1_upsert_notes", sql("notes", "").rstrip() + f", {_OLD}, {_NEW} SELECT path, coalesce(n.title, o.title) AS title, coalesce(n.file_hash, o.file_hash) AS file_hash, coalesce(n.size_bytes, o.size_bytes) AS size_bytes FROM old o FULL JOIN new n USING (path)")
def k1_upsert_notes(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    old = n.where("id % 4 <> 1").select("path", "title", F.when(F.col("id") % 3 == 0, "h").otherwise(F.col("file_hash")).alias("file_hash"), "size_bytes")
    new = n.where("id % 6 <> 2").select("path", F.upper("title").alias("title"), F.when(F.col("id") % 5 != 0, F.col("file_hash")).alias("file_hash"), (F.col("size_bytes") + 1).alias("size_bytes"))
    return K.upsert(old, new, ["path"], keep_old=["file_hash", "size_bytes"])


@query("k7_upsert_freshness", sql("notes freshness", """
SELECT note_path, coalesce(f.last_verified, n.last_verified) AS last_verified, coalesce(n.window_days, f.window_days) AS window_days FROM freshness f
FULL JOIN (SELECT path AS note_path, TIMESTAMP '2025-01-15' AS last_verified, CAST(id % 4 AS INT) AS window_days FROM notes) n USING (note_path)"""))
def k7_upsert_freshness(spark, sf_dir):
    new = V.notes(spark, sf_dir).select(F.col("path").alias("note_path"), F.lit("2025-01-15").cast("timestamp").alias("last_verified"), (F.col("id") % 4).cast("int").alias("window_days"))
    return K.upsert(V.freshness(spark, sf_dir), new, ["note_path"], never=["last_verified"])


@query("k5_sync_tags", sql("note_tags", """
SELECT note_id, tag FROM note_tags WHERE note_id % 3 <> 0 UNION SELECT doc_id, unnest(['x', source]) FROM documents WHERE doc_id % 3 = 0"""))
def k5_sync_tags(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    return K.sync_tags(V.note_tags(spark, sf_dir), d.select(F.col("doc_id").alias("note_id"), F.array(F.lit("x"), "source", F.lit("")).alias("tags")))


def _stored(spark, sf_dir):
    c = V.chunks(spark, sf_dir)
    hashed = H.chunk_hash(MODEL, F.col("text_content"))
    return c.where("id % 11 <> 3").select("note_id", "chunk_index", "id", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, "old").otherwise(hashed).alias("chunk_hash"), (F.col("chunk_index") + F.col("id") % 2).cast("int").alias("page"), F.lit(None).cast("string").alias("heading"))


def _candidates(spark, sf_dir):
    c = V.chunks(spark, sf_dir).where("note_id % 13 <> 5")
    return c.select("note_id", "chunk_index", H.chunk_hash(MODEL, F.col("text_content")).alias("chunk_hash"), F.col("chunk_index").alias("page"), F.lit(None).cast("string").alias("heading"))


_PLAN = f"""hashed AS (SELECT *, substr(sha256('{MODEL}' || chr(0) || text_content), 1, 32) AS h FROM chunks),
  stored AS (SELECT note_id, chunk_index, id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'old' ELSE h END AS sh, CAST(chunk_index + id % 2 AS INT) AS sp FROM hashed WHERE id % 11 <> 3),
  cand AS (SELECT note_id, chunk_index, h, chunk_index AS p FROM hashed WHERE note_id % 13 <> 5),
  plan AS (SELECT note_id, chunk_index, s.id, CASE WHEN s.id IS NULL THEN 'insert' WHEN c.h IS NULL THEN 'delete' WHEN sh IS DISTINCT FROM c.h THEN 'replace' WHEN sp <> p THEN 'reanchor' ELSE 'keep' END AS action
    FROM stored s FULL JOIN cand c USING (note_id, chunk_index))"""


@query("j22_chunk_plan", sql("chunks", "").rstrip() + f", {_PLAN} SELECT note_id, chunk_index, id, action FROM plan")
def j22_chunk_plan(spark, sf_dir):
    return K.chunk_plan(_stored(spark, sf_dir), _candidates(spark, sf_dir)).select("note_id", "chunk_index", "id", "action")


@query("r28_reembed", sql("chunks", "").rstrip() + f", {_PLAN} SELECT note_id, count(*) FILTER (WHERE action IN ('keep', 'reanchor')) AS kept, count(*) FILTER (WHERE action IN ('insert', 'replace')) AS embedded, count(*) FILTER (WHERE action IN ('delete', 'replace')) AS removed FROM plan GROUP BY 1")
def r28_reembed(spark, sf_dir):
    return K.plan_counts(K.chunk_plan(_stored(spark, sf_dir), _candidates(spark, sf_dir)))


@query("k3_delete_chunks", sql("chunks", "SELECT id FROM chunks WHERE note_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def k3_delete_chunks(spark, sf_dir):
    gone = V.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("note_id"))
    return V.chunks(spark, sf_dir).join(gone, "note_id", "left_anti").select("id")


@query("k4_reanchor", sql("chunks", "SELECT id, CASE WHEN id % 2 = 0 THEN chunk_index + 10 ELSE chunk_index END AS page FROM chunks"))
def k4_reanchor(spark, sf_dir):
    c = V.chunks(spark, sf_dir).select("id", F.col("chunk_index").alias("page"))
    return K.upsert(c, c.where("id % 2 = 0").select("id", (F.col("page") + 10).alias("page")), ["id"])


@query("k6_set_category", sql("notes", "SELECT id, CASE WHEN format = 'pdf' THEN 'reference/pdf' ELSE category END AS category FROM notes"))
def k6_set_category(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    return K.upsert(n.select("id", "category"), n.where("format = 'pdf'").select("id", F.lit("reference/pdf").alias("category")), ["id"])


@query("k8_replace_claims", sql("claims", """
SELECT note_id, claim_text FROM claims WHERE note_id % 4 <> 0 OR id % 2 = 0 UNION ALL SELECT DISTINCT note_id, 'new of ' || note_id FROM claims WHERE note_id % 4 = 0"""))
def k8_replace_claims(spark, sf_dir):
    c = V.claims(spark, sf_dir).select("id", "note_id", "claim_text")
    read = c.where("note_id % 4 = 0")
    scanned = read.where("id % 2 = 0").select("note_id", "claim_text").union(read.select("note_id", F.concat(F.lit("new of "), "note_id")).distinct())
    return K.replace_claims(c, scanned)[0].select("note_id", "claim_text")


@query("k8_claim_ids", sql("claims", "SELECT count(*) AS n, count(DISTINCT id) AS ids, max(id) AS top FROM (SELECT id FROM claims WHERE note_id % 4 <> 0 OR id % 2 = 0 UNION ALL SELECT (SELECT max(id) FROM claims) + row_number() OVER () FROM (SELECT DISTINCT note_id FROM claims WHERE note_id % 4 = 0))"))
def k8_claim_ids(spark, sf_dir):
    c = V.claims(spark, sf_dir).select("id", "note_id", "claim_text")
    read = c.where("note_id % 4 = 0")
    scanned = read.where("id % 2 = 0").select("note_id", "claim_text").union(read.select("note_id", F.concat(F.lit("new of "), "note_id")).distinct())
    return K.replace_claims(c, scanned)[0].agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.max("id").alias("top"))


@query("k11_run_audit", "SELECT max(ts) AS latest, count(*) AS runs FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def k11_run_audit(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(first), "event_type").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("runs"))


@query("k12_cache_misses", sql("chunks", f"SELECT DISTINCT sha256('{MODEL}' || chr(0) || text_content) AS key FROM chunks EXCEPT SELECT sha256('{MODEL}' || chr(0) || text_content) FROM chunks WHERE chunk_index = 0"))
def k12_cache_misses(spark, sf_dir):
    keyed = V.chunks(spark, sf_dir).select(H.cache_key(MODEL, F.col("text_content")).alias("key"), "chunk_index")
    return K.cache_misses(keyed, keyed.where("chunk_index = 0").select("key"))


@query("k13_metadata_merge", "SELECT event_id, props AS before, event_type AS kind FROM events")
def k13_metadata_merge(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    merged = K.merged_metadata(F.create_map(F.lit("kind"), F.lit("old"), F.lit("before"), F.col("props")), F.create_map(F.lit("kind"), F.lit("new")), F.create_map(F.lit("kind"), F.col("event_type")))
    return e.select("event_id", merged.alias("m")).select("event_id", F.element_at("m", "before").alias("before"), F.element_at("m", "kind").alias("kind"))


@query("k14_inject_links", "SELECT doc_id, rtrim(text, E' \\n') || chr(10) || chr(10) || '" + K.LINK_HEADING + "' || chr(10) || chr(10) || '- [[doc-' || (doc_id + 1) || ']] — near' || chr(10) AS body FROM documents")
def k14_inject_links(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    link = lambda reason: F.array(F.struct(F.concat(F.lit("doc-"), F.col("doc_id") + 1).alias("title"), F.lit(reason).alias("reason")))
    return d.select("doc_id", K.injected(K.injected(F.col("text"), link("first")), link("near")).alias("body"))


@query("r35_prune", sql("notes freshness note_tags", """
SELECT (SELECT count(*) FROM notes WHERE id % 9 <> 2) AS notes, (SELECT count(*) FROM note_tags WHERE note_id % 9 <> 2) AS note_tags, (SELECT count(*) FROM freshness WHERE note_path IN (SELECT path FROM notes WHERE id % 9 <> 2)) AS freshness"""))
def r35_prune(spark, sf_dir):
    n = V.notes(spark, sf_dir).select("id", "path")
    out = K.prune_missing({"notes": n, "note_tags": V.note_tags(spark, sf_dir), "freshness": V.freshness(spark, sf_dir)}, n.where("id % 9 <> 2"))
    counts = [t.agg(F.count(F.lit(1)).alias(k)) for k, t in out.items()]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("r36_purge_tags", sql("note_tags tags", "SELECT name FROM tags WHERE name IN (SELECT tag FROM note_tags)"))
def r36_purge_tags(spark, sf_dir):
    t, used = V.tags(spark, sf_dir), V.note_tags(spark, sf_dir)
    return t.join(C.unused_tags(t, used), "name", "left_anti")


@query("j23_pending", sql("raw_vectors", "SELECT id FROM raw_vectors WHERE id % 3 = 0"))
def j23_pending(spark, sf_dir):
    r = V.raw_vectors(spark, sf_dir).select("id")
    return C.pending(r, r.where("id % 3 <> 0"))


@query("t2_debounce", """
WITH e AS (SELECT 'user/' || user_id || '.md' AS path, ts FROM events),
g AS (SELECT *, sum(CASE WHEN ts - prev < INTERVAL '2 hours' THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY ts, n) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts) AS prev, row_number() OVER (PARTITION BY path ORDER BY ts) AS n FROM e))
SELECT path, min(ts) AS first, max(ts) AS last, count(*) AS events FROM g GROUP BY path, s""")
def t2_debounce(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), "user_id", F.lit(".md")).alias("path"), F.lit("modified").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return D.debounced(D.watched(e), "2 hours")


@query("t1_watched", "SELECT event_id FROM events WHERE event_type IN ('created', 'modified', 'moved', 'click', 'view')")
def t1_watched(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "modified").otherwise(F.col("event_type"))
    return D.watched(e.select("event_id", kind.alias("kind"), F.concat(F.lit("u/"), "user_id", F.lit(".MD")).alias("path"))).select("event_id")


@query("t8_rate_windows", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS failures FROM events GROUP BY 1, 2 HAVING count(*) >= 4")
def t8_rate_windows(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return D.rate_limited(e, "event_type", 4, "1 hour")


@query("t9_failure_runs", """
WITH m AS (SELECT user_id, event_id, (value > 30)::INT AS f FROM events),
g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM m), r AS (SELECT user_id, g, sum(f) AS n FROM g GROUP BY ALL)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest, max(n) >= 5 AS opens FROM r GROUP BY 1""")
def t9_failure_runs(spark, sf_dir):
    return D.failure_runs(V.table(spark, sf_dir, "events"), "user_id", F.col("value") > 30, ["event_id"])


@query("t9_breaker", """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, value <= 30 AS ok, event_id % 6 = 0 AS optional, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, -1::BIGINT AS event_id, '' AS verdict, 0 AS failures, NULL::TIMESTAMP AS until FROM events
  UNION ALL SELECT e.user_id, e.k, e.event_id,
    CASE WHEN NOT optional AND e.ts < until THEN 'refused' WHEN ok THEN CASE WHEN failures > 0 OR until IS NOT NULL THEN 'closed' ELSE 'ok' END
      WHEN NOT optional AND failures >= 2 THEN 'opened' ELSE 'failed' END,
    CASE WHEN NOT optional AND e.ts < until THEN failures WHEN ok THEN 0 WHEN optional THEN failures ELSE failures + 1 END,
    CASE WHEN NOT optional AND e.ts < until THEN until WHEN ok THEN NULL WHEN NOT optional AND failures >= 2 THEN e.ts + INTERVAL '1 day' ELSE until END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, verdict, failures FROM s WHERE k > 0""")
def t9_breaker(spark, sf_dir):
    """The events as a stream of calls of each user, judged by a breaker that
    three failures open for a day."""
    at = f"{V.workspace(spark)}/{uuid.uuid4().hex}"
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") <= 30).alias("ok"), (F.col("event_id") % 6 == 0).alias("optional"))
    # calls wait for the watermark: one far ahead lets all others through
    last = spark.range(2).select(F.lit("end").alias("key"), "id", F.timestamp_seconds(F.lit(8_000_000_000) + F.col("id") * 100_000).alias("ts"), F.lit(True).alias("ok"), F.lit(False).alias("optional"))
    e.write.parquet(f"{at}/in/1")
    last.coalesce(1).write.parquet(f"{at}/in/2")
    calls = spark.readStream.schema(e.schema).parquet(f"{at}/in/*")
    before = {k: spark.conf.get(k, None) for k in breaker.CONF}
    for k, v in breaker.CONF.items():
        spark.conf.set(k, v)
    try:
        q = breaker.judged(calls, limit=3, seconds=86_400).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    out = spark.read.schema(breaker.JUDGED).parquet(f"{at}/out").where("key <> 'end'")
    return out.select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "verdict", "failures")


@query("t10_daemon_status", "SELECT arg_max(event_type, (ts, event_id)) AS event, max(ts) AS at, count(*) AS events FROM events")
def t10_daemon_status(spark, sf_dir):
    return D.newest_event(V.table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


def _anchored(spark, sf_dir):
    return V.chunks(spark, sf_dir).withColumns({"page": F.col("chunk_index") + 1, "heading": F.lit(None).cast("string")})


@query("f11_verify_citations", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'as [[doc-1#p.2]] and [[doc-2]] say, not other' ELSE 'as doc-1#p.2 and [[doc-2]] say, not other' END AS answer, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS dropped FROM documents""")
def f11_verify_citations(spark, sf_dir):
    sources = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("doc-1#p.9"), F.lit("doc-2"))).otherwise(F.array(F.lit("doc-2#x")))
    clean, dropped = A.verified(F.lit("as [[doc-1#p.2]] and [[doc-2]] say, not [[other]]"), sources)
    return V.table(spark, sf_dir, "documents").select("doc_id", clean.alias("answer"), dropped.alias("dropped"))


@query("r22_distill", "WITH " + V.SQL["chunks"] + ",\n" + _SOME + "," + _CHUNK_LEX + """,
  chosen AS (SELECT id, note_id FROM held WHERE note_id IN (SELECT doc_id FROM documents WHERE lang = 'es')),
  c AS (SELECT bucket, sum(w) AS m FROM lex JOIN chosen USING (id) GROUP BY 1), n AS (SELECT bucket, m / sqrt((SELECT sum(m * m) FROM c)) AS m FROM c),
  s AS (SELECT note_id, id, round(sum(w * m), 6) AS score FROM lex JOIN chosen USING (id) JOIN n USING (bucket) GROUP BY ALL)
SELECT note_id, id, score, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3""")
def r22_distill(spark, sf_dir):
    c = V.lexical(spark, sf_dir)
    chosen = V.note_tags(spark, sf_dir).where("tag = 'es'").select("note_id")
    return A.distilled_sources(c, chosen)



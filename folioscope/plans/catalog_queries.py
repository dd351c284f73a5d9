"""Queries over notes, tags, categories and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.vectors import mean_pool
from folioscope.operators import catalog as C
from folioscope.plans import views as V
from folioscope.plans.registry import query
from folioscope.plans.views import sql


@query("p1_note_filter", sql("notes note_tags", """
SELECT id FROM notes n WHERE (category = 'reference' OR category LIKE 'reference/%') AND lower(coalesce(format, 'md')) IN ('md', 'txt')
  AND EXISTS (SELECT 1 FROM note_tags t WHERE t.note_id = n.id AND lower(tag) = 'en')
  AND EXISTS (SELECT 1 FROM note_tags t WHERE t.note_id = n.id AND lower(tag) = 'good')"""))
def p1_note_filter(spark, sf_dir):
    return C.note_filter(V.notes(spark, sf_dir), V.note_tags(spark, sf_dir), "reference", [".MD", "txt"], ["EN", "good"])


@query("p2_prefix", sql("notes", "SELECT id, category FROM notes WHERE category = 'journal/src1' OR starts_with(category, 'journal/src1/')"))
def p2_prefix(spark, sf_dir):
    return V.notes(spark, sf_dir).where(C.in_category(F.col("category"), "journal/src1")).select("id", "category")


@query("p3_point_lookup", sql("notes", "SELECT id, content_hash, file_hash, title, coalesce(format, 'md') AS format FROM notes WHERE path = 'src3/7.md' OR id = 12"))
def p3_point_lookup(spark, sf_dir):
    return V.notes(spark, sf_dir).where("path = 'src3/7.md' OR id = 12").select("id", "content_hash", "file_hash", "title", F.coalesce("format", F.lit("md")).alias("format"))


@query("p4_batch_lookup", sql("notes", "SELECT n.id, n.title, n.path FROM notes n JOIN (SELECT DISTINCT o_custkey AS id FROM orders) o ON n.id = o.id WHERE title IS NOT NULL"))
def p4_batch_lookup(spark, sf_dir):
    ids = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return V.notes(spark, sf_dir).select("id", "title", "path").where("title IS NOT NULL").join(ids, "id")


@query("p5_anchor_lookup", sql("chunks", """
SELECT note_id, text_content, arg_min(page, id) AS page, arg_min(heading, id) AS heading
FROM (SELECT *, chunk_index + 1 AS page, 'part ' || chunk_index AS heading FROM chunks) WHERE text_content IN (SELECT substr(text, 1, 1500) FROM documents) GROUP BY ALL"""))
def p5_anchor_lookup(spark, sf_dir):
    c = V.chunks(spark, sf_dir).withColumns({"page": F.col("chunk_index") + 1, "heading": F.concat(F.lit("part "), "chunk_index")})
    texts = V.notes(spark, sf_dir).select(F.substring("text", 1, 1500).alias("text_content")).distinct()
    asked = c.join(texts, "text_content").select("note_id", "text_content").distinct()
    return C.anchors(c, asked)


@query("p6_notes_by_category", sql("notes", "SELECT id, title, category FROM notes WHERE category = 'projects' OR category LIKE 'projects/%'"))
def p6_notes_by_category(spark, sf_dir):
    return C.by_category(V.notes(spark, sf_dir), "projects")


@query("p8_privacy", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE coalesce(json_extract_string(props, '$.privacy'), '') <> 'never_process'""")
def p8_privacy(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("meta", F.from_json("props", "map<string,string>"))
    return e.where(F.coalesce(F.element_at("meta", "privacy"), F.lit("")) != "never_process").select("event_id", F.element_at("meta", "k").alias("k"))


_STORED = "SELECT path, file_hash, CASE WHEN id % 5 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM notes WHERE id % 4 <> 0"


@query("p9_change_status", sql("notes", f"""
SELECT s.path, CASE WHEN t.file_hash = s.file_hash THEN 'unchanged_bytes' WHEN t.content_hash = s.content_hash THEN 'unchanged_text' WHEN t.content_hash IS NULL THEN 'new' ELSE 'changed' END AS status
FROM (SELECT path, CASE WHEN id % 3 = 0 THEN 'edited' ELSE file_hash END AS file_hash, content_hash FROM notes) s LEFT JOIN ({_STORED}) t ON s.path = t.path"""))
def p9_change_status(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    scanned = n.select("path", F.when(F.col("id") % 3 == 0, "edited").otherwise(F.col("file_hash")).alias("file_hash"), "content_hash")
    stored = n.where("id % 4 <> 0").select("path", "file_hash", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return C.change_status(scanned, stored)


def _rx(pattern):
    return "'" + pattern.replace("'", "''") + "'"


@query("p10_sensitive", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_rx(p)}) THEN '{n}' END" for n, p in T.SENSITIVE.items()) + "], lambda x: x IS NOT NULL), ',') AS classes FROM documents")
def p10_sensitive(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.sensitive_classes(F.col("text")), ",").alias("classes"))


@query("p14_signatures", sql("raw_vectors", "SELECT count(*) AS n, max(id) AS max_id, CAST(sum(len(vector) * 4) AS BIGINT) AS bytes, min(len(vector)) = max(len(vector)) AS uniform FROM raw_vectors"))
def p14_signatures(spark, sf_dir):
    return C.signature(V.raw_vectors(spark, sf_dir))


@query("p15_keyed_readers", sql("notes", "SELECT path, coalesce(last_tagged, last_seen) AS anchor  FROM notes"))
def p15_keyed_readers(spark, sf_dir):
    return V.notes(spark, sf_dir).select("path", F.coalesce("last_tagged", "last_seen").alias("anchor"))


@query("s2_ignored_dirs", sql("notes", "SELECT path FROM notes WHERE NOT list_has_any(string_split(path, '/'), ['src1', 'src5', '.git'])"))
def s2_ignored_dirs(spark, sf_dir):
    from folioscope.sources.vault import ignored

    return V.notes(spark, sf_dir).where(~ignored(F.col("path"), ["src1", "src5", ".git"])).select("path")


@query("s17_matrix_scan", sql("raw_vectors", "SELECT id, note_id, len(vector) AS dim, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM raw_vectors"))
def s17_matrix_scan(spark, sf_dir):
    return V.raw_vectors(spark, sf_dir).select("id", "note_id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("s26_note_rows", sql("notes", "SELECT id, path, title, content_hash, file_hash, lower(coalesce(format, 'md')) AS format, size_bytes FROM notes"))
def s26_note_rows(spark, sf_dir):
    return V.notes(spark, sf_dir).select("id", "path", "title", "content_hash", "file_hash", F.lower(F.coalesce("format", F.lit("md"))).alias("format"), "size_bytes")


@query("s23_event_log", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_type AS event, CAST(user_id AS VARCHAR) AS user_value, CAST(round(value, 2) AS DECIMAL(18, 2))::VARCHAR AS value_text FROM events")
def s23_event_log(spark, sf_dir):
    from folioscope.sources.logs import event_line, parse_event_lines

    e = V.table(spark, sf_dir, "events")
    at, fields = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), {"id": F.col("event_id").cast("string"), "user": F.col("user_id").cast("string"), "value": F.round("value", 2).cast("decimal(18,2)").cast("string")}
    p = parse_event_lines(e.select(event_line(at, F.col("event_type"), fields).alias("value")))
    return p.select(F.element_at("fields", "id").cast("long").alias("event_id"), "at", "event", F.element_at("fields", "user").alias("user_value"), F.element_at("fields", "value").alias("value_text"))


@query("s24_thread_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def s24_thread_turns(spark, sf_dir):
    return C.last_turns(V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3)


@query("j1_note_tags", sql("notes note_tags", "SELECT t.tag, n.title FROM note_tags t JOIN notes n ON n.id = t.note_id WHERE t.tag IN ('good', 'src2')"))
def j1_note_tags(spark, sf_dir):
    t = V.note_tags(spark, sf_dir).where("tag IN ('good', 'src2')")
    return t.join(V.notes(spark, sf_dir).select("id", "title"), F.col("id") == F.col("note_id")).select("tag", "title")


@query("j8_duplicate_members", sql("notes", "SELECT id, content_hash FROM notes WHERE content_hash IN (SELECT content_hash FROM notes WHERE content_hash <> '' GROUP BY 1 HAVING count(*) > 1)"))
def j8_duplicate_members(spark, sf_dir):
    n = V.hashes(spark, sf_dir)
    many = n.where("content_hash <> ''").groupBy("content_hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return n.join(many, "content_hash", "left_semi")


@query("j9_orphans", sql("notes", "SELECT id, path FROM notes WHERE path NOT IN (SELECT path FROM notes WHERE id % 9 <> 2)"))
def j9_orphans(spark, sf_dir):
    n = V.notes(spark, sf_dir).select("id", "path")
    return C.orphans(n, n.where("id % 9 <> 2").select("path"))


@query("j10_unused_tags", sql("note_tags tags", "SELECT name FROM tags WHERE name NOT IN (SELECT tag FROM note_tags)"))
def j10_unused_tags(spark, sf_dir):
    return C.unused_tags(V.tags(spark, sf_dir), V.note_tags(spark, sf_dir))


@query("j11_first_chunk", sql("raw_vectors", "SELECT note_id, min(id) AS chunk_id, round(CAST(arg_min(vector, id)[1] AS DOUBLE), 6) AS head FROM raw_vectors GROUP BY 1"))
def j11_first_chunk(spark, sf_dir):
    return C.first_chunks(V.raw_vectors(spark, sf_dir)).select("note_id", "chunk_id", F.round(F.get("vector", 0).cast("double"), 6).alias("head"))


@query("a1_tag_frequency", sql("note_tags", "SELECT tag, count(note_id) AS freq FROM note_tags GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def a1_tag_frequency(spark, sf_dir):
    return C.tag_frequency(V.note_tags(spark, sf_dir), 10)


@query("a2_tag_count", sql("note_tags", "SELECT count(DISTINCT tag) AS n FROM note_tags"))
def a2_tag_count(spark, sf_dir):
    return V.note_tags(spark, sf_dir).agg(F.count_distinct("tag").alias("n"))


@query("a3_category_frequency", sql("notes", "SELECT category, count(*) AS freq FROM notes WHERE category <> '' GROUP BY 1"))
def a3_category_frequency(spark, sf_dir):
    return C.category_frequency(V.notes(spark, sf_dir))


@query("a4_subtree_counts", sql("notes", """
SELECT node, count(*) AS notes FROM (SELECT unnest(list_transform(generate_series(1, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS node
  FROM (SELECT string_split(category, '/') AS p FROM notes WHERE category <> '')) GROUP BY 1"""))
def a4_subtree_counts(spark, sf_dir):
    return C.subtree_counts(V.notes(spark, sf_dir))


@query("a4_geography", """
SELECT node, count(*) AS notes FROM (
  SELECT unnest([r_name, r_name || '/' || n_name]) AS node FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1""")
def a4_geography(spark, sf_dir):
    c, n, r = (V.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    placed = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return C.subtree_counts(placed.select(F.concat("r_name", F.lit("/"), "n_name").alias("category")))


@query("a5_dashboard", sql("notes chunks", """
SELECT count(*) AS total, count(last_tagged) AS tagged, count(*) FILTER (WHERE category <> '') AS categorised, (SELECT count(*) FROM chunks) AS chunks FROM notes"""))
def a5_dashboard(spark, sf_dir):
    return C.dashboard(V.notes(spark, sf_dir), V.chunks(spark, sf_dir))


@query("a6_exact_duplicates", sql("notes", """
SELECT content_hash, count(*) OVER (PARTITION BY content_hash) AS n, min(id) OVER (PARTITION BY content_hash) AS first_id, id FROM notes WHERE content_hash <> '' QUALIFY count(*) OVER (PARTITION BY content_hash) > 1"""))
def a6_exact_duplicates(spark, sf_dir):
    return C.exact_duplicates(V.hashes(spark, sf_dir))


_POOL = """
  e AS (SELECT note_id, unnest(generate_series(1, len(vector))) AS i, unnest(vector) AS x FROM raw_vectors),
  m AS (SELECT note_id, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
  pooled AS (SELECT note_id, i, m / sqrt(sum(m * m) OVER (PARTITION BY note_id)) AS x FROM m)"""


@query("a7_mean_pool", "WITH " + V.SQL["raw_vectors"] + "," + _POOL + "\nSELECT note_id, round(sum(x * i), 6) AS moment, round(max(x), 6) AS top FROM pooled GROUP BY 1")
def a7_mean_pool(spark, sf_dir):
    p = mean_pool(V.raw_vectors(spark, sf_dir), ["note_id"])
    moment = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return p.select("note_id", F.round(moment, 6).alias("moment"), F.round(F.array_max("vector"), 6).alias("top"))


@query("a8_centroid", "WITH " + V.SQL["raw_vectors"] + ", " + """
  m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT unnest(generate_series(1, len(vector))) AS i, unnest(vector) AS x FROM raw_vectors WHERE label = 3) GROUP BY 1)
SELECT i AS place, round(m / sqrt((SELECT sum(m * m) FROM m)), 6) AS x FROM m""")
def a8_centroid(spark, sf_dir):
    c = mean_pool(V.raw_vectors(spark, sf_dir).where("label = 3").withColumn("all", F.lit(1)), ["all"])
    return c.select(F.posexplode("vector").alias("p", "v")).select((F.col("p") + 1).cast("long").alias("place"), F.round("v", 6).alias("x"))


@query("a9_last_extraction", sql("claims", "SELECT note_id, max(extracted_at) AS last_extracted FROM claims GROUP BY 1"))
def a9_last_extraction(spark, sf_dir):
    return V.claims(spark, sf_dir).groupBy("note_id").agg(F.max("extracted_at").alias("last_extracted"))


@query("a10_counts", sql("claims contradictions", "SELECT (SELECT count(*) FROM claims) AS claims, count(*) FILTER (WHERE status = 'open') AS open FROM contradictions"))
def a10_counts(spark, sf_dir):
    return V.claims(spark, sf_dir).agg(F.count(F.lit(1)).alias("claims")).crossJoin(V.contradictions(spark, sf_dir).agg(F.count_if(F.col("status") == "open").alias("open")))


@query("a14_quantile", """
SELECT event_type, value AS p90 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
WHERE k = round_even(0.9 * (n - 1), 0) + 1""")
def a14_quantile(spark, sf_dir):
    return C.quantile(V.table(spark, sf_dir, "events"), ["event_type"], "value", 0.9, "p90")


@query("a17_scan_counters", sql("notes", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN 'unchanged_bytes' WHEN id % 4 = 0 THEN 'new' WHEN id % 5 = 0 THEN 'changed' ELSE 'unchanged_text' END AS status FROM notes) GROUP BY 1"""))
def a17_scan_counters(spark, sf_dir):
    return p9_change_status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("w9_history", """
SELECT conv_id, count(*) AS turns, max(turn) AS newest FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY 1""")
def w9_history(spark, sf_dir):
    return C.last_turns(V.table(spark, sf_dir, "conversations"), 5).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("newest"))


@query("w11_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k > 5")
def w11_retention(spark, sf_dir):
    return C.newest(V.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("x1_reconcile_tags", sql("", """
SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (
  SELECT doc_id, CASE WHEN lang = source THEN [lang] ELSE [CASE lang WHEN 'en' THEN 'english' ELSE lang END, source] END AS list_distinct_ordered FROM documents)"""))
def x1_reconcile_tags(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.array(F.upper("lang"), F.concat(F.lit(" "), "source"), F.col("lang"), F.lit("--")).alias("tags"))
    return C.reconcile_tags(d, {"en": "english"}).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("x2_path_difference", sql("notes", "SELECT path FROM notes WHERE id % 2 = 0 EXCEPT SELECT path FROM notes WHERE id % 3 = 0"))
def x2_path_difference(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    return n.where("id % 2 = 0").select("path").subtract(n.where("id % 3 = 0").select("path"))


@query("x4_scan_union", sql("notes", "SELECT path FROM notes WHERE format = 'md' UNION SELECT path FROM notes WHERE size_bytes > 1000"))
def x4_scan_union(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    return n.where("format = 'md'").select("path").union(n.where("size_bytes > 1000").select("path")).distinct()


@query("x6_title_match", """
SELECT p_partkey, len(e) > 0 AND len(list_filter(e, lambda t: NOT list_contains(g, t))) = 0 AS matched FROM (
  SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS e, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS g FROM part)""")
def x6_title_match(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    return p.select("p_partkey", T.title_matches(F.col("p_type"), F.concat("p_name", F.lit(" "), "p_type")).alias("matched"))

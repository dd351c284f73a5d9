"""The engine's operations over an index folder.

An index is a set of tables of the commit log: notes, note_tags, chunks, text
(the segments of the full-text index), freshness, claims and contradictions.
Operations read the current versions; those that change something write what
changes, as deltas or segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.functions.providers import Offline, embedded
from folioscope.functions.text import sensitive_classes
from folioscope.functions.vectors import mean_pool
from folioscope.operators import answer, catalog, chunking, evaluate, freshness, graph, mirror, preflight, search, segments, similar, store
from folioscope.sources import files
from folioscope.sources import formats as extractors
from folioscope.sources import vault as vaults
from folioscope.sources.config import Settings
from folioscope.streaming import debounce

NOTES = "id long, path string, title string, category string, format string, content_hash string, file_hash string, size_bytes long, last_seen timestamp, last_tagged timestamp, text string"
CLAIMS = "id long, note_id long, claim_text string, char_start int, char_end int, vector array<double>, extracted_at timestamp"
CONTRADICTIONS = "id long, claim_a_id long, claim_b_id long, severity string, explanation string, status string, detected_at timestamp, resolved_at timestamp"
STATES = "note_id long, content_hash string"
RUNS = "ran_at timestamp, notes_scanned long, claims_extracted long, pairs_checked long, contradictions_found long"
CHUNKS = "id long, note_id long, chunk_index int, text_content string, vector array<double>, page int, heading string, chunk_hash string"
#: Tables of which old versions are dropped.
TABLES = (
    "notes note_tags chunks text freshness claims contradictions mirror_runs claim_states scanned changed candidates plan scan_report orphans pruned matrix "
    "to_read extracted claim_vectors claim_pairs decay"
).split()


def pooled(chunks: DataFrame) -> DataFrame:
    return mean_pool(chunks, ["note_id"]).withColumnRenamed("note_id", "id")


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, provider=Offline, model: str = "lexical-768"):
        self.spark, self.settings, self.provider, self.model = spark, settings or Settings(), provider, model
        self.tables = store.Snapshots(spark, root)
        self.text = segments.Segments(self.tables)

    def table(self, name: str, schema: str) -> DataFrame:
        found = self.tables.current(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    @property
    def notes(self) -> DataFrame:
        return self.table("notes", NOTES)

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks", CHUNKS)

    @property
    def note_tags(self) -> DataFrame:
        return self.table("note_tags", "note_id long, tag string")

    @property
    def freshness(self) -> DataFrame:
        return self.table("freshness", "note_path string, last_verified timestamp, window_days int, decay_check_at timestamp, likely_stale boolean")

    @property
    def claims(self) -> DataFrame:
        return self.table("claims", CLAIMS)

    @property
    def contradictions(self) -> DataFrame:
        return self.table("contradictions", CONTRADICTIONS)

    @property
    def mirror_runs(self) -> DataFrame:
        return self.table("mirror_runs", RUNS)

    def index(self) -> segments.Index:
        return self.text.index()

    # -- building

    def scan(self, vault: str, formats: Sequence[str] | None = None, now: Column | None = None, tag: bool = True, only: DataFrame | None = None) -> DataFrame:
        """Bring the index up to date with a folder, or with the paths ``only``
        in it; returns how files fared."""
        s, now = self.settings, F.current_timestamp() if now is None else now
        there = vaults.scan(self.spark, vault, formats or s.formats, s.ignored_dirs, s.sidecar_dir, only=only).select(F.col("rel").alias("path"), "ext", "content")
        stored = self.notes
        hashed = there.withColumn("file_hash", F.sha2("content", 256))
        same = hashed.select("path", "file_hash").join(stored.select("path", F.col("file_hash")), ["path", "file_hash"], "left_semi")
        docs = extractors.extracted(hashed.join(same, "path", "left_anti"))
        private = F.coalesce(F.element_at("metadata", "privacy"), F.lit("")) == "never_process"
        self.tables.replace("scanned", docs.withColumn("private", private))
        docs = self.tables.current("scanned")
        good = docs.where("error IS NULL AND NOT private")
        status = catalog.change_status(good.select("path", "file_hash", "content_hash"), stored)
        changed = good.join(status.where("status IN ('new', 'changed')"), "path")

        columns = [c.split()[0] for c in NOTES.split(", ")]
        rows = changed.select("path", "title", F.lit(None).cast("string").alias("category"), "format", "content_hash", "file_hash", "size_bytes", now.alias("last_seen"), F.lit(None).cast("timestamp").alias("last_tagged"), "text")
        if tag:
            numbered = store.with_ids(rows, stored, ["path"], ["path"])
            tagged = answer.tagged(numbered.select("id", "text"), self.provider)
            rows = numbered.drop("category", "last_tagged").join(tagged.select("id", "tags", "category"), "id").withColumn("last_tagged", now)
        else:
            rows = store.with_ids(rows, stored, ["path"], ["path"]).withColumn("tags", F.array().cast("array<string>"))
        self.tables.replace("changed", rows)
        rows = self.tables.current("changed")
        before = stored.join(rows.select("path"), "path", "left_semi")
        self.tables.merge("notes", store.upsert(before.select(*columns), rows.select(*columns), ["path"], keep_old=["file_hash", "size_bytes"]), ["path"])
        touched = good.join(status.where("status = 'unchanged_text'"), "path").select("path", "file_hash")
        self.tables.merge("notes", stored.drop("file_hash").join(touched, "path").select(*columns), ["path"])
        named = rows.select(F.col("id").alias("note_id"), F.explode("tags").alias("tag")).where("tag <> ''").distinct()
        self.tables.merge("note_tags", named, ["note_id"], gone=rows.select(F.col("id").alias("note_id")))

        sections = docs.select("path", "sections").join(rows.select("path", "id"), "path")
        self._rechunk(rows.select(F.col("id").alias("note_id"), "text"), sections.select(F.col("id").alias("note_id"), "sections"))
        self._seed()
        failed = docs.where("error IS NOT NULL").select("path", F.lit("error").alias("status"))
        hidden = docs.where("private").select("path", F.lit("private").alias("status"))
        report = status.union(failed).union(hidden).union(same.select("path", F.lit("unchanged_bytes").alias("status")))
        out = report.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
        self.tables.replace("scan_report", out)
        return self.tables.current("scan_report")

    def watch(self, events: DataFrame, vault: str, checkpoint: str, quiet: str = debounce.QUIET, late: str = "10 minutes"):
        """Scan the files of a stream of events (path, kind, ts) once each is quiet."""
        seen = debounce.watched(events, self.settings.formats, self.settings.ignored_dirs)

        def handle(paths: DataFrame, _: int) -> None:
            self.scan(vault, only=paths)

        return debounce.process(debounce.debounced(seen, quiet, late), handle, checkpoint)

    def _rechunk(self, texts: DataFrame, sections: DataFrame) -> None:
        s = self.settings
        how = {"size": s.chunk_size, "overlap": s.chunk_overlap}
        split = sections.where("size(sections) > 0")
        plain = texts.join(split.select("note_id"), "note_id", "left_anti")
        none = [F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("heading")]
        cut = chunking.semantic(plain, self.provider().embed, **how) if s.chunk_engine == "semantic" else chunking.pack_paragraphs(plain, **how)
        fresh = cut.select("note_id", "chunk_index", "chunk", *none).union(chunking.pack_sections(split, **how).select("note_id", "chunk_index", "chunk", "page", "heading"))
        fresh = fresh.select("note_id", "chunk_index", F.col("chunk").alias("text_content"), "page", "heading", hashing.chunk_hash(self.model, F.col("chunk")).alias("chunk_hash"))
        self.tables.replace("candidates", fresh)
        fresh, stored = self.tables.current("candidates"), self.chunks
        # notes that were read and have no chunks now lose theirs
        own = stored.join(texts.select("note_id"), "note_id", "left_semi")
        self.tables.replace("plan", store.chunk_plan(own, fresh))
        plan = self.tables.current("plan")
        todo = plan.where("action IN ('insert', 'replace')").select("note_id", "chunk_index").join(fresh, ["note_id", "chunk_index"])
        new = store.with_ids(todo, stored, ["note_id", "chunk_index"], ["note_id", "chunk_index"])
        vectors = embedded(new.select("id", "text_content"), "text_content", self.provider)
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        made = new.join(vectors, "id").where("vector IS NOT NULL").select(*columns)
        moved = own.drop("page", "heading").join(plan.where("action = 'reanchor'").select("id", "page", "heading"), "id").select(*columns)
        gone = plan.where("action IN ('delete', 'replace')").select("id")
        self.tables.merge("chunks", moved.unionByName(made), ["id"], gone=gone)
        self.text.update(self.chunks.join(todo.select("note_id", "chunk_index"), ["note_id", "chunk_index"], "left_semi"), gone)

    def reindex(self) -> None:
        """Bring the full-text index to the current chunks; only those that it
        does not have, or has too many, are written."""
        have, now = self.index().chunks.select("id", "length", "words"), self.chunks
        read = segments.forward_of(now).select("id", F.col("words").alias("_w"))
        other = now.join(read.join(have, "id", "left").where("words IS NULL OR words <> _w").select("id"), "id", "left_semi")
        self.text.update(other, have.select("id").join(now.select("id"), "id", "left_anti"))

    def _seed(self) -> None:
        verdicts = self.freshness.select("note_path", "decay_check_at", "likely_stale")
        seeds = freshness.seed(self.notes, self.freshness).where("action <> 'keep'")
        rows = seeds.where("action <> 'remove'").join(verdicts, "note_path", "left").select("note_path", "last_verified", "window_days", "decay_check_at", "likely_stale")
        self.tables.merge("freshness", rows, ["note_path"], gone=seeds.where("action = 'remove'"))

    def prune(self, vault: str, formats: Sequence[str] | None = None) -> DataFrame:
        """Drop what belongs to files that are gone; returns the orphans."""
        s = self.settings
        there = vaults.scan(self.spark, vault, formats or s.formats, s.ignored_dirs, s.sidecar_dir).select(F.col("rel").alias("path"))
        self.tables.replace("orphans", catalog.orphans(self.notes, there))
        gone = self.notes.join(there, "path", "left_anti").select("id", "path")
        self.tables.replace("pruned", gone)
        gone = self.tables.current("pruned")
        of_note, of_path = gone.select(F.col("id").alias("note_id")), gone.select(F.col("path").alias("note_path"))
        self.text.update(None, self.chunks.join(of_note, "note_id", "left_semi").select("id"))
        lost = self.claims.join(of_note, "note_id", "left_semi").select("id")
        pairs = self.contradictions
        sides = [pairs.join(lost.withColumnRenamed("id", side), side, "left_semi").select("id") for side in ("claim_a_id", "claim_b_id")]
        self.tables.merge("contradictions", None, ["id"], gone=sides[0].union(sides[1]).distinct()) if self.tables.version("contradictions") else None
        for name, keys, rows in (("note_tags", "note_id", of_note), ("chunks", "note_id", of_note), ("claims", "note_id", of_note), ("claim_states", "note_id", of_note), ("freshness", "note_path", of_path), ("notes", "path", gone)):
            if self.tables.version(name):
                self.tables.merge(name, None, [keys], gone=rows)
        return self.tables.current("orphans")

    def maintain(self, keep: int = 5) -> dict[str, list[int]]:
        """Drop old versions of all tables."""
        return {t: self.tables.prune(t, keep) for t in TABLES}

    def backup(self, stamp: str, keep: int = 5) -> list[str]:
        """Copy what cannot be made again from the files; returns dropped backups."""
        return self.tables.backup(["notes", "note_tags", "chunks", "freshness", "claims", "contradictions"], stamp, keep)

    # -- contradictions

    def mirror(self, now: Column | None = None, full: bool = False) -> dict[str, int]:
        """Read the claims of notes that changed (or of all), and have pairs of
        near claims judged; returns the run's counters, which are recorded too."""
        now = F.current_timestamp() if now is None else now
        states = self.table("claim_states", STATES)
        notes = self.notes.select("id", "content_hash", "text")
        self.tables.replace("to_read", notes if full else mirror.to_read(notes, states))
        read = self.tables.current("to_read")
        self.tables.replace("extracted", mirror.extracted(read, self.provider))
        found = self.tables.current("extracted")
        columns = [c.split()[0] for c in CLAIMS.split(", ")]
        after, new = store.replace_claims(self.claims, found)
        placed = found.where("claim_text IS NOT NULL").select("note_id", "claim_text", F.col("char_start").alias("_s"), F.col("char_end").alias("_e")).dropDuplicates(["note_id", "claim_text"])
        after = after.join(placed, ["note_id", "claim_text"], "left").withColumns({"char_start": F.coalesce("_s", "char_start"), "char_end": F.coalesce("_e", "char_end"), "extracted_at": F.coalesce("extracted_at", now)})
        self.tables.replace("claims", after.select(*columns))
        # also those whose vector could not be made before
        missing = self.claims.where("vector IS NULL").select("id", "claim_text")
        self.tables.replace("claim_vectors", embedded(missing, "claim_text", self.provider).where("vector IS NOT NULL"))
        fresh = self.tables.current("claim_vectors")
        with_vectors = self.claims.join(fresh.withColumnRenamed("vector", "_v"), "id", "left").withColumn("vector", F.coalesce("vector", "_v"))
        self.tables.replace("claims", with_vectors.select(*columns))
        claims = self.claims.where("vector IS NOT NULL")
        pairs = similar.claim_pairs(claims, self.contradictions, self.settings.claim_threshold, focus=fresh.select("id"))
        self.tables.replace("claim_pairs", pairs)
        pairs = self.tables.current("claim_pairs")
        before = self.contradictions.count()
        self.tables.replace("contradictions", mirror.recorded(mirror.judged(pairs, claims, self.provider), self.contradictions, now))
        rest = states.join(read.select(F.col("id").alias("note_id")), "note_id", "left_anti")
        self.tables.replace("claim_states", rest.unionByName(read.select(F.col("id").alias("note_id"), "content_hash")))
        out = {"notes_scanned": read.count(), "claims_extracted": found.where("claim_text IS NOT NULL").count(), "pairs_checked": pairs.count(), "contradictions_found": self.contradictions.count() - before}
        run = self.spark.range(1).select(now.alias("ran_at"), *(F.lit(v).cast("long").alias(k) for k, v in out.items()))
        self.tables.append("mirror_runs", run)
        return out

    def listed(self, status: str | None = "open") -> DataFrame:
        return freshness.listed_contradictions(self.contradictions, self.claims, status)

    def show(self, contradiction: int) -> DataFrame:
        return mirror.shown(self.contradictions.where(F.col("id") == contradiction), self.claims, self.notes)

    def settle(self, ids: DataFrame, status: str, now: Column | None = None) -> None:
        """Dismiss, resolve or open again contradictions (id)."""
        now = F.current_timestamp() if now is None else now
        self.tables.replace("contradictions", freshness.set_status(self.contradictions, ids, status, now))

    def check_decay(self, now: Column | None = None, today: Column | None = None) -> DataFrame:
        """Have stale notes judged; the verdicts are kept with their freshness."""
        now = F.current_timestamp() if now is None else now
        self.tables.replace("decay", mirror.decay(self.stale(today), self.notes, self.provider))
        verdicts = self.tables.current("decay")
        v = verdicts.where("likely_stale IS NOT NULL").select("note_path", F.col("likely_stale").alias("_v"))
        f = self.freshness.join(v, "note_path", "left")
        self.tables.replace("freshness", f.select("note_path", "last_verified", "window_days", F.when(F.col("_v").isNotNull(), now).otherwise(F.col("decay_check_at")).alias("decay_check_at"), F.coalesce("_v", "likely_stale").alias("likely_stale")))
        return verdicts

    # -- changing the model

    def migrate(self, model: str, provider, batch: int | None = None) -> dict[str, int | bool]:
        """Embed chunks again with another model beside the current vectors, and
        swap when none is missing. ``batch`` chunks at most are embedded in a
        call, so that a migration can be continued; failed ones come again."""
        m = store.Migration(self.tables, "chunks", model)
        m.begin()
        left = m.pending()
        left = left.orderBy("id").limit(batch) if batch else left
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        asked = left.drop("vector").withColumn("chunk_hash", hashing.chunk_hash(model, F.col("text_content")))
        made = asked.join(embedded(left.select("id", "text_content"), "text_content", provider), "id")
        m.add(made.select(*columns))
        done, total = m.progress()
        swapped = m.swap()
        if swapped:
            self.model, self.provider = model, provider
            self.reindex()
        return {"done": done, "total": total, "swapped": swapped}

    def abort_migration(self, model: str) -> None:
        store.Migration(self.tables, "chunks", model).abort()

    def matrix(self) -> DataFrame:
        """The pooled vectors of all notes, kept until there is another version
        of the chunks they were made from."""
        of = self.tables.version("chunks")
        if not self.tables.version("matrix") or self.tables.manifest("matrix")["about"].get("chunks") != of:
            chunks = self.tables.at("chunks", of) if of else self.chunks
            self.tables.replace("matrix", pooled(chunks), self.tables.version("matrix"), {"chunks": of})
        return self.tables.current("matrix")

    def available(self) -> dict[str, bool]:
        """Whether full text and vectors can be searched; vectors must be of one length."""
        v = catalog.signature(self.chunks.where("vector IS NOT NULL")).first()
        return {"full_text": bool(self.index().docs), "vectors": bool(v.n and v.uniform)}

    def preflight(self) -> DataFrame:
        found = self.chunks.where("vector IS NOT NULL").select(F.size("vector").alias("n")).first()
        return preflight.preflight(self.spark, self.settings, self.provider, found.n if found else None)

    def distil(self, tag: str | None = None, category: str | None = None) -> DataFrame:
        """A note distilled from all notes with a tag or in a category."""
        kind, value = files.selector(tag, category)
        if kind == "tag":
            chosen = self.note_tags.where(F.col("tag") == value).select("note_id").distinct()
        else:
            chosen = catalog.by_category(self.notes, value).select(F.col("id").alias("note_id"))
        written = self.notes.where(F.col("text").rlike(r"(?s)\A---\n(?:[^\n]*\n)*?generated: true\n")).select(F.col("id").alias("note_id"))
        passages = answer.distilled_sources(self.chunks, chosen.join(written, "note_id", "left_anti"))
        return answer.synthesis(passages, self.chunks, self.notes, self.provider)

    # -- asking

    def filter(self, category: str | None = None, formats: Sequence[str] = (), tags: Sequence[str] = ()) -> DataFrame | None:
        return catalog.note_filter(self.notes, self.note_tags, category, formats, tags)

    def retrieve(self, questions: DataFrame, top: int | None = None, rerank=None, **criteria) -> DataFrame:
        """Ranked chunks for questions (query_id, question)."""
        top, allowed = top or self.settings.top_k, self.filter(**criteria)
        asked = questions.join(embedded(questions.select("query_id", "question"), "question", self.provider), "query_id")
        if self.settings.hybrid:
            return search.hybrid(asked, self.index(), self.chunks, top, self.settings.rrf_k, allowed, rerank)
        return search.dense(asked, self.chunks, top, allowed=allowed)

    def search(self, questions: DataFrame, top: int | None = None, **criteria) -> DataFrame:
        return search.shown(self.retrieve(questions, top, **criteria), self.chunks, self.notes)

    def ask(self, questions: DataFrame, top: int | None = None, **criteria) -> DataFrame:
        contexts = answer.context(self.retrieve(questions, top, **criteria), self.chunks, self.notes)
        return answer.ask(questions, contexts, self.provider)

    def connect(self) -> DataFrame:
        return similar.connect(self.chunks.where("vector IS NOT NULL"), least=self.settings.connect_threshold)

    def pooled(self) -> DataFrame:
        return pooled(self.chunks)

    def duplicates(self) -> tuple[DataFrame, DataFrame]:
        """Groups of equal notes, and pairs of similar ones."""
        return catalog.exact_duplicates(self.notes), similar.near_duplicate_notes(self.pooled(), self.notes, self.settings.dedupe_threshold)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges."""
        p = self.matrix()
        opposed = graph.contradiction_edges(self.contradictions, self.claims)
        return graph.nodes(self.notes, self.note_tags), graph.build(graph.wikilink_edges(self.notes), similar.suggested_edges(p, p.select("id", F.col("id").alias("note_id"), "vector")), opposed)

    def stale(self, today: Column | None = None) -> DataFrame:
        return freshness.stale(self.freshness, self.notes, F.current_timestamp() if today is None else today)

    def verify(self, paths: DataFrame, now: Column | None = None) -> None:
        self.tables.replace("freshness", freshness.verify(self.freshness, paths, F.current_timestamp() if now is None else now))

    def categories(self) -> DataFrame:
        return catalog.subtree_counts(self.notes)

    def tags(self) -> DataFrame:
        return catalog.tag_frequency(self.note_tags)

    def status(self) -> DataFrame:
        return catalog.dashboard(self.notes, self.chunks)

    def sensitive(self) -> DataFrame:
        return self.notes.select("path", sensitive_classes(F.col("text")).alias("classes")).where("size(classes) > 0")

    def evaluate(self, golden: DataFrame, top: int = 5, pool: int = 20) -> DataFrame:
        """Turns of golden questions with metrics; all are retrieved in one plan."""
        numbered = golden.withColumn("query_id", F.abs(F.xxhash64("case_id", "turn_index")))
        hits = search.ranked_notes(self.retrieve(numbered.select("query_id", "question"), pool))
        titles = hits.join(self.notes.select(F.col("id").alias("note_id"), "title"), "note_id").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"))
        turns = numbered.join(titles, "query_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>"))).withColumnRenamed("expected_sources", "expected")
        return evaluate.scored(turns, top)

    def baseline(self, golden: DataFrame) -> DataFrame:
        """How turns change from dense retrieval alone to hybrid."""
        import dataclasses

        plain = Engine(self.spark, self.tables.root, dataclasses.replace(self.settings, hybrid=False), self.provider, self.model)
        fused = Engine(self.spark, self.tables.root, dataclasses.replace(self.settings, hybrid=True), self.provider, self.model)
        return evaluate.compared(plain.evaluate(golden), fused.evaluate(golden))

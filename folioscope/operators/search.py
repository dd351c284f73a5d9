"""Full-text, dense and hybrid retrieval for batches of questions.

Every operator keeps a ``query_id``, so many questions are one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import snippet, tokens
from folioscope.operators.blocks import fixed, met, packed, unpacked
from folioscope.operators.segments import BLOCK, K1, B, Index, impact
from folioscope.operators.similar import CELLS, oversample, per_note, top_k
from folioscope.operators.store import held

MOST_TERMS = 50
#: Terms of a question whose best blocks are scored first.
SEEDS = 4
#: Room for scores that are rounded before they are ranked.
EPSILON = 2e-6
#: Tokens that are looked up by name.
LISTED = 1000
#: Questions beyond which bounds are not worth their joins.
PRUNED = 16
#: Chunks and questions of a tile.
CHUNKS, QUESTIONS = 16_384, 8_192
#: Rows asked, and their characters, that go to the chunks' own tasks.
FEW, CARRIED = 8_192, 1 << 22
#: Rows of tiles that a task holds before it merges them.
HELD = 1 << 18
#: Chunks, each as often as it is sent, that an exchange may have.
MOVED = 1 << 18


def _picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the tokens ``wanted``: few are looked up in the files' statistics,
    many by a join."""
    few = [r.token for r in wanted.limit(LISTED + 1).collect()]
    return rows.where(F.col("token").isin(few)) if len(few) <= LISTED else rows.join(wanted, "token", "left_semi")


def _terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, parts, repeats): the tokens of each term, which is a
    phrase if there are several."""
    words = questions.select("query_id", F.explode(F.slice(F.array_remove(F.split("question", r"\s+"), ""), 1, MOST_TERMS)).alias("word"))
    parts = words.select("query_id", tokens(F.col("word")).alias("parts")).where("size(parts) > 0")
    return parts.groupBy("query_id", F.array_join("parts", " ").alias("term"), "parts").agg(F.count(F.lit(1)).alias("repeats"))


def _phrase_hits(index: Index, terms: DataFrame) -> DataFrame:
    """(term, segment, id, tf, length) of phrases: chunks of a phrase's rarest
    token in which its tokens follow each other."""
    phrases = terms.where("size(parts) > 1").select("term", "parts").distinct()
    each = phrases.select("term", "parts", F.explode("parts").alias("token"))
    wanted = each.select("token").distinct()
    rare = each.join(_picked(index.vocabulary(wanted), wanted), "token").groupBy("term", "parts").agg(F.min_by("token", "n").alias("token"))
    at = rare.join(_picked(index.blocks, wanted), "token").select("term", "parts", "segment", F.explode("ids").alias("id"))
    read = index.live(at).join(index.forward.select("segment", "id", "length", "words"), ["segment", "id"])
    last = F.col("length") - F.size("parts") + 1
    tf = F.size(F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice("words", i, F.size("parts")) == F.col("parts")))
    return read.select("term", "segment", "id", tf.alias("tf"), "length").where("tf > 0")


def _highest(bound: Column, mean: float) -> Column:
    """The highest impact of postings with these bounds (tf, least length)."""
    return F.array_max(F.transform(bound, lambda b: impact(b["tf"], b["length"], mean)))


def _weighed(index: Index, terms: DataFrame, hits: DataFrame) -> DataFrame:
    """Terms that occur, with their weight and the most they add to a score."""
    wanted = terms.where("size(parts) = 1").select(F.col("term").alias("token")).distinct()
    single = _picked(index.vocabulary(wanted), wanted).withColumnRenamed("token", "term")
    least = hits.groupBy("term", "tf").agg(F.min("length").alias("length"), F.count(F.lit(1)).alias("n"))
    phrase = least.groupBy("term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("tf", "length")).alias("bound"))
    known = terms.join(single.unionByName(phrase), "term")
    idf = F.log((F.lit(index.docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("repeats")
    return known.select("query_id", "term", "parts", weight.alias("w"), "bound").select("query_id", "term", "parts", "w", (F.col("w") * _highest(F.col("bound"), index.mean)).alias("top"))


_SCORED = "query_id long, id long, note_id long, score double"


def _score(mean: float):
    """Scores of chunks for a question each: the words of a chunk against the
    question's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pa.array(np.argsort(b.column("query_id").to_numpy(), kind="stable")))
            asked, first = np.unique(b.column("query_id").to_numpy(), return_index=True)
            words, length = b.column("words"), b.column("length").to_numpy().astype(np.float64)
            sizes = words.value_lengths().to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            flat, place = coded.indices.to_numpy(), {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
            row = np.repeat(np.arange(b.num_rows), sizes)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            score = np.zeros(b.num_rows)
            shrink = K1 * (1 - B + B * length / mean)
            for begin, end in zip(first, np.append(first[1:], b.num_rows), strict=True):
                code, at = flat[ends[begin] : ends[end]], row[ends[begin] : ends[end]]
                for parts, w in zip(b.column("terms")[int(begin)].as_py(), b.column("weights")[int(begin)].as_py(), strict=True):
                    codes = [place.get(t, -1) for t in parts]
                    if -1 in codes:
                        continue
                    hit = code == codes[0]
                    for j, c in enumerate(codes[1:], 1):
                        hit[: len(code) - j] &= (code[j:] == c) & (at[j:] == at[: len(code) - j])
                        hit[max(len(code) - j, 0) :] = False
                    tf = np.bincount(at[hit] - begin, minlength=end - begin)
                    score[begin:end] += w * tf * (K1 + 1) / (tf + shrink[begin:end])
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), b.column("note_id"), pa.array(score)], ["query_id", "id", "note_id", "score"])

    return run


def _scores(index: Index, pairs: DataFrame, weights: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Scores of pairs (query_id, segment, id) that are live and allowed."""
    asked = weights.groupBy("query_id").agg(F.collect_list("parts").alias("terms"), F.collect_list("w").alias("weights"))
    read = index.live(pairs).join(index.forward, ["segment", "id"])
    if allowed is not None:
        read = read.join(allowed.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    rows = read.join(asked, "query_id").select("query_id", "id", "note_id", "length", "words", "terms", "weights")
    return rows.mapInArrow(_score(index.mean or 1.0), _SCORED).where("score > 0")


def _candidates(index: Index, questions: DataFrame, limit: int, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Weighed terms, and all pairs (query_id, segment, id) that can be among the
    best ``limit``; see ``bm25``."""
    terms = held(_terms(questions))
    hits = held(_phrase_hits(index, terms))
    weights = held(_weighed(index, terms, hits))
    single = weights.where("size(parts) = 1").withColumnRenamed("term", "token")
    wanted = single.select("token").distinct()
    blocks = _picked(index.blocks, wanted)
    bound = F.array_max(F.zip_with("bound_tfs", "bound_lengths", lambda tf, n: impact(tf, n, index.mean or 1.0)))

    most = single.withColumn("_k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("top"), "token"))).where(F.col("_k") <= SEEDS)
    # a token's best blocks, until they have as many postings as a full one
    before = W.partitionBy("query_id", "token").orderBy(F.desc("_bound")).rowsBetween(W.unboundedPreceding, -1)
    best = most.join(blocks, "token").select("query_id", "token", "segment", "n", "ids", bound.alias("_bound")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < BLOCK)
    seeds = best.select("query_id", "segment", F.explode("ids").alias("id")).distinct()
    ranked = _scores(index, seeds, weights, allowed).withColumn("_k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"))))
    least = ranked.where(F.col("_k") == limit).select("query_id", F.col("score").alias("least"))

    whole = W.partitionBy("query_id")
    upto = whole.orderBy("top", "term").rowsBetween(W.unboundedPreceding, 0)
    needed = F.coalesce("least", F.lit(0.0)) - EPSILON
    needy = (
        weights.withColumns({"_upto": F.sum("top").over(upto), "_all": F.sum("top").over(whole)}).join(least, "query_id", "left")
        .where(F.col("_upto") >= needed).select("query_id", "term", "w", (needed - F.col("_all") + F.col("top")).alias("needed"))
    )
    read = needy.withColumnRenamed("term", "token").join(blocks, "token").where(F.col("w") * bound >= F.col("needed"))
    found = read.select("query_id", "segment", F.explode("ids").alias("id"))
    phrases = needy.join(hits, "term").where(F.col("w") * impact(F.col("tf"), F.col("length"), index.mean or 1.0) >= F.col("needed")).select("query_id", "segment", "id")
    return weights, found.unionByName(phrases).distinct()


class _Places:
    """Where the tokens of some chunks are."""

    def __init__(self, chunks: pa.Table, tokens: pa.Array):
        words = chunks["words"].combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        coded = words.flatten().dictionary_encode()
        self.row = np.repeat(np.arange(len(chunks)), words.value_lengths().to_numpy(zero_copy_only=False))
        self.flat, self.dictionary = coded.indices.to_numpy(), coded.dictionary
        # only tokens that are asked for are sorted
        wanted = np.zeros(len(self.dictionary) + 1, bool)
        wanted[self.codes(tokens)] = True
        wanted[-1] = False
        at = np.flatnonzero(wanted[self.flat])
        self.at = at[np.argsort(self.flat[at], kind="stable")]
        self.begin = np.searchsorted(self.flat[self.at], np.arange(len(self.dictionary) + 1))

    def codes(self, tokens: pa.Array) -> np.ndarray:
        """Numbers of tokens, -1 for those that no chunk has."""
        return pc.fill_null(pc.index_in(tokens, self.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks in which tokens follow each other, and how often."""
        if (codes < 0).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = int((self.begin[codes + 1] - self.begin[codes]).argmin())
        at = self.at[self.begin[codes[k]] : self.begin[codes[k] + 1]]
        if len(codes) > 1:
            at = at - k
            at = at[(at >= 0) & (at + len(codes) <= len(self.flat))]
            at = at[self.row[at] == self.row[at + len(codes) - 1]]
            for j, c in enumerate(codes):
                at = at[self.flat[at + j] == c]
        return np.unique(self.row[at], return_counts=True)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of each token that is asked for, how often they have it, and
        where the token of each number begins."""
        code, row = self.flat[self.at], self.row[self.at]
        new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        return row[new], np.diff(np.append(new, len(code))), np.searchsorted(code[new], np.arange(len(self.dictionary) + 1))


_PHRASES = pa.schema([("term", pa.string()), ("n", pa.int64())])


def _phrases(phrases: pa.Table, chunks: pa.Table) -> pa.Table:
    """In how many of some chunks phrases (term, parts) are."""
    if not len(phrases) or not len(chunks):
        return _PHRASES.empty_table()
    parts = phrases["parts"].combine_chunks()
    tokens, ends = parts.flatten(), np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))))
    places = _Places(chunks, tokens)
    code = places.codes(tokens)
    n = np.array([len(places.hits(code[a:b])[0]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    some = np.flatnonzero(n)
    return pa.table({"term": phrases["term"].take(some), "n": n[some]}).cast(_PHRASES)


_TILE = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("note_id", pa.int64()), ("score", pa.float64())])


def _best(asked: pa.Table, chunks: pa.Table, mean: float, limit: int) -> pa.Table:
    """The best ``limit`` of some chunks for questions (query_id, terms, weights)."""
    if not len(asked) or not len(chunks):
        return _TILE.empty_table()
    chunks = chunks.sort_by("id")
    terms = asked["terms"].combine_chunks()
    parts, ends = terms.flatten(), np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))))
    tokens, cuts = parts.flatten(), np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))))
    weight = asked["weights"].combine_chunks().flatten().to_numpy()
    places = _Places(chunks, tokens)
    code = places.codes(tokens)
    row, tf, first = places.postings()
    # phrases get numbers after those of the tokens
    number, rows, tfs, known = code[cuts[:-1]], [row], [tf], {}
    for t in np.flatnonzero(np.diff(cuts) > 1):
        own = code[cuts[t] : cuts[t + 1]]
        if (key := own.tobytes()) not in known:
            known[key] = len(first) - 1 + len(known)
            for x, y in zip((rows, tfs), places.hits(own), strict=True):
                x.append(y)
        number[t] = known[key]
    first = np.append(first, first[-1] + np.cumsum([len(x) for x in rows[1:]], dtype=np.int64))
    row, tf = np.concatenate(rows), np.concatenate(tfs)
    part = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * chunks["length"].to_numpy().astype(np.float64) / mean))[row])
    begin, many = first[number], np.where(number < 0, 0, first[number + 1] - first[number])
    upto = np.concatenate(([0], np.cumsum(many)))[ends]
    query, at, scores, k = [], [], [], 0
    while k < len(asked):
        # questions whose scores and hits are few enough to be worked on at once
        last = min(k + max(1, CELLS // len(chunks)), max(k + 1, int(np.searchsorted(upto, upto[k] + CELLS, "right")) - 1), len(asked))
        some = slice(ends[k], ends[last])
        n = many[some]
        hit = np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(np.repeat(np.arange(last - k), np.diff(ends[k : last + 1])), n) * len(chunks) + row[hit]
        score = np.bincount(place, np.repeat(weight[some], n) * part[hit], (last - k) * len(chunks)).reshape(last - k, len(chunks))
        least = np.partition(score, len(chunks) - limit, axis=1)[:, len(chunks) - limit, None] - EPSILON if len(chunks) > limit else 0.0
        r, c = np.nonzero((score >= least) & (score > 0))
        value = np.round(score[r, c], 6)
        order = np.lexsort((c, -value, r))  # ties go to lower ids
        r, c, value = r[order], c[order], value[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < limit
        query.append(k + r[best])
        at.append(c[best])
        scores.append(value[best])
        k = last
    at = np.concatenate(at)
    return pa.table({"query_id": asked["query_id"].take(np.concatenate(query)), "id": chunks["id"].take(at), "note_id": chunks["note_id"].take(at), "score": np.concatenate(scores)}).cast(_TILE)


def _added(counts: pa.Table) -> pa.Table:
    """Counts of phrases from several tiles, added up."""
    return counts.group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"]).select(_PHRASES.names).cast(_PHRASES)


def _leading(hits: pa.Table, limit: int) -> pa.Table:
    """The best ``limit`` of each question from several tiles; ties go to lower ids."""
    query = hits["query_id"].to_numpy()
    order = np.lexsort((hits["id"].to_numpy(), -hits["score"].to_numpy(), query))
    query = query[order]
    return hits.take(pa.array(order[np.arange(len(order)) - np.searchsorted(query, query) < limit]))


class _Merged:
    """The results of one block of rows asked with many tables of chunks."""

    def __init__(self, merge):
        self.merge, self.tables, self.last = merge, [], 0

    def add(self, table: pa.Table) -> None:
        self.tables.append(table)
        # what stays is not merged again for each tile
        if sum(map(len, self.tables)) > 2 * self.last + HELD:
            self.tables = [self.result()]
            self.last = len(self.tables[0])

    def result(self) -> pa.Table:
        return self.merge(pa.concat_tables(self.tables).combine_chunks())


def _dealt(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _everywhere(rows: DataFrame, n: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _crossed(asked: DataFrame, key: str, size: Column, chunks: DataFrame, docs: int, run, merge, schema: str) -> DataFrame:
    """``run`` of tables of up to about ``QUESTIONS`` of the rows asked with
    tables of about ``CHUNKS`` chunks: each with each. Rows asked that are few and
    short go to the chunks' own tasks as they are, which merge what they find, and
    many go there as blocks; no chunk is exchanged. Only of a few chunks each table
    is sent to tasks of its own. size: characters of a row."""
    n, long = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= FEW and long <= CARRIED:
        carried = asked.toArrow().combine_chunks()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merged, some, n_rows = _Merged(merge), [], 0
            for b in (b.slice(k, CHUNKS) for b in batches for k in range(0, b.num_rows, CHUNKS)):
                if n_rows + b.num_rows > CHUNKS:
                    merged.add(run(carried, pa.Table.from_batches(some).combine_chunks()))
                    some, n_rows = [], 0
                some.append(b)
                n_rows += b.num_rows
            if some:
                merged.add(run(carried, pa.Table.from_batches(some).combine_chunks()))
                yield from merged.result().to_batches(max_chunksize=1 << 16)

        return chunks.mapInArrow(scan, schema)

    i, j = max(1, -(-n // QUESTIONS)), max(1, -(-docs // CHUNKS))
    if docs * i <= MOVED:
        left, right = _everywhere(_dealt(asked, key, i, "_i"), j, "_j"), _everywhere(_dealt(chunks, "id", j, "_j"), i, "_i")
        return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(lambda a, b: run(a.combine_chunks(), b.combine_chunks()), schema)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, _Merged] = {}
        key, some = None, None
        for b in batches:
            for k, j in enumerate(b.column("_j").to_pylist()):
                if j != key:
                    key, some = j, unpacked(b.column("_b")[k])
                merged.setdefault(j, _Merged(merge)).add(run(some, unpacked(b.column("_a")[k])))
        for m in merged.values():
            yield from m.result().to_batches(max_chunksize=1 << 16)

    # chunks are packed anew for each block of rows asked, which takes no disk
    blocks = fixed(packed(asked, QUESTIONS).repartition(i, "_k"))
    return met(packed(chunks, CHUNKS), blocks).mapInArrow(tiles, schema)


def _whole(index: Index, questions: DataFrame, limit: int, allowed: DataFrame | None) -> DataFrame:
    """The best chunks of each tile of questions and chunks; all are scored."""
    mean = index.mean or 1.0
    terms = held(_terms(questions))
    phrases = held(terms.where("size(parts) > 1").select("term", "parts").distinct())
    live = index.live(index.forward).select("id", "note_id", "length", "words")
    counted = _crossed(phrases, "term", F.length("term"), live.select("id", "words"), index.docs, _phrases, _added, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    wanted = terms.where("size(parts) = 1").select(F.col("term").alias("token")).distinct()
    single = index.vocabulary(wanted).select(F.col("token").alias("term"), "n")
    idf = F.log((F.lit(index.docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = terms.join(single.unionByName(counted), "term").withColumn("w", F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("repeats"))
    asked = held(weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("parts", "w"))).alias("t")).select("query_id", F.col("t.parts").alias("terms"), F.col("t.w").alias("weights")))
    if allowed is not None:
        live = live.join(allowed.select(F.col("id").alias("note_id")), "note_id", "left_semi").select(*live.columns)
    return _crossed(asked, "query_id", F.length(F.array_join(F.flatten("terms"), "")), live, index.docs, lambda a, b: _best(a, b, mean, limit), lambda hits: _leading(hits, limit), _SCORED).withColumn("score", -F.col("score"))


def bm25(index: Index, questions: DataFrame, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, note_id, score, rank); the lower the score the better.

    questions: query_id, question. White space parts the terms; a term of
    several tokens is a phrase. Terms in most chunks count almost nothing.
    allowed: ids of notes, or None for all; cut after it applies.

    Not every posting is read. The best blocks of a question's weightiest terms
    are scored first; their ``limit``-th score is one that a result must reach.
    Of the terms in order of what they can add, those that together stay below
    it cannot make a result by themselves; they are looked up only in the
    candidates. Of the others only those blocks are read whose bound reaches it
    with all that the other terms can add. The ranks are those of scoring all.

    More than ``PRUNED`` questions reach most chunks together, and of few allowed
    notes the best blocks may hold none, so that nothing bounds the result: then
    all chunks are scored, tile by tile, and each tile gives its best ones.
    """
    if allowed is not None or questions.limit(PRUNED + 1).count() > PRUNED:
        scored = _whole(index, questions, limit, allowed)
    else:
        weights, pairs = _candidates(index, questions, limit, allowed)
        scored = _scores(index, pairs, weights, allowed).select("query_id", "id", "note_id", F.round(-F.col("score"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "id", "note_id", "score", "rank")


def effort(index: Index, questions: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, postings, scored): postings of a question's terms, and the
    chunks that are scored for it."""
    weights, pairs = _candidates(index, questions, limit, None)
    wanted = weights.select(F.explode("parts").alias("token")).distinct()
    n = index.vocabulary(wanted)
    postings = weights.select("query_id", F.explode("parts").alias("token")).join(n, "token").groupBy("query_id").agg(F.sum("n").alias("postings"))
    return postings.join(pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored")), "query_id")


def dense(questions: DataFrame, chunks: DataFrame, top: int = 5, excluded: DataFrame | None = None, notes: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """The nearest chunks, one a note if ``notes``; questions: query_id, vector."""
    if allowed is not None:
        chunks = chunks.join(allowed.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    hits = top_k(questions.select(F.col("query_id").alias("id"), "vector"), chunks, oversample(top, excluded is not None, notes))
    if notes:
        return per_note(hits, top, excluded)
    if excluded is not None:
        hits = hits.join(excluded, ["query_id", "note_id"], "left_anti")
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)


def fuse(near: DataFrame, text: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, id, note_id, rank)."""
    a = near.select("query_id", "id", F.col("note_id").alias("_na"), F.col("rank").alias("dense_rank"))
    b = text.select("query_id", "id", F.col("note_id").alias("_nb"), F.col("rank").alias("bm25_rank"))
    j = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda r: F.coalesce(1 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    out = j.select("query_id", "id", F.coalesce("_na", "_nb").alias("note_id"), F.round(part("dense_rank") + part("bm25_rank"), 9).alias("score"), "dense_rank", "bm25_rank")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order))


def hybrid(questions: DataFrame, index: Index, chunks: DataFrame, top: int = 5, rrf_k: int = 60, allowed: DataFrame | None = None, rerank=None) -> DataFrame:
    """Fused retrieval; questions: query_id, question, vector.

    rerank: a function of the pool (query_id, id, note_id, score, rank) that
    returns it with a new score in ``rerank_score``; the head is reordered.
    """
    pool = max(4 * top, 20)
    near = dense(questions, chunks, pool, notes=False, allowed=allowed)
    text = bm25(index, questions, pool, allowed)
    fused = fuse(near, text, rrf_k)
    if rerank is not None:
        again = rerank(fused.where(F.col("rank") <= pool))
        fused = again.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")))
    return fused.where(F.col("rank") <= top)


def ranked_notes(hits: DataFrame) -> DataFrame:
    """Notes in order of their first hit, ranked anew."""
    first = hits.groupBy("query_id", "note_id").agg(F.min("rank").alias("_r"))
    return first.select("query_id", "note_id", F.row_number().over(W.partitionBy("query_id").orderBy("_r")).alias("rank"))


def shown(hits: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of a search page: title and snippet of each hit."""
    named = hits.join(chunks.select("id", "text_content"), "id").join(notes.select(F.col("id").alias("note_id"), "title"), "note_id")
    return named.select("query_id", "rank", "note_id", "title", snippet(F.col("text_content")).alias("snippet"), "score")

"""From questions to answers: context, prompts, citations, synthesis.

The language model is a provider; everything around it is DataFrame work over
batches of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.providers import Offline, completed, task_prompt
from folioscope.functions.text import citations, sanitize_prompt, source_label, wrap_untrusted
from folioscope.functions.vectors import centroid, dot
from folioscope.operators.catalog import budgeted

BUDGET = 16_000


def context(hits: DataFrame, chunks: DataFrame, notes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, context, sources): labelled passages in rank order within a budget.

    hits: query_id, id, note_id, rank; chunks: id, text_content, page, heading.
    """
    named = hits.select("query_id", "id", "note_id", "rank").join(chunks.select("id", "text_content", "page", "heading"), "id").join(notes.select(F.col("id").alias("note_id"), "title"), "note_id")
    label = source_label(F.col("title"), F.col("page"), F.col("heading"))
    blocks = named.select("query_id", "rank", label.alias("label"), F.concat(F.lit("[["), label, F.lit("]]\n"), wrap_untrusted(sanitize_prompt(F.col("text_content")))).alias("block"))
    fits = budgeted(blocks, ["query_id"], ["rank"], "block", budget).where("taken").select("query_id", "rank")
    listed = blocks.join(fits, ["query_id", "rank"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label", "block"))).alias("b"))
    return listed.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.array_distinct(F.transform("b", lambda x: x["label"])).alias("sources"))


def verified(answer: Column, sources: Column) -> tuple[Column, Column]:
    """An answer whose unknown citations lost their brackets, and their number."""
    titles = F.transform(sources, lambda s: F.trim(F.substring_index(s, "#", 1)))
    known = lambda c: F.array_contains(sources, F.trim(c)) | F.array_contains(titles, F.trim(F.substring_index(c, "#", 1)))
    unknown = F.filter(citations(answer), lambda c: ~known(c))
    # each is replaced once; equal ones are replaced together
    clean = F.aggregate(F.array_distinct(unknown), answer, lambda a, c: F.replace(a, F.concat(F.lit("[["), c, F.lit("]]")), F.trim(c)))
    return clean, F.size(unknown)


def ask(questions: DataFrame, contexts: DataFrame, provider=Offline) -> DataFrame:
    """(query_id, question, answer, sources, dropped_citations)."""
    q = questions.join(contexts, "query_id", "left")
    prompt = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), sanitize_prompt(F.col("question")))
    replies = completed(q.select("query_id", "question", "sources", prompt.alias("prompt")), "prompt", provider)
    answer = F.coalesce(F.get_json_object("reply", "$.answer"), F.get_json_object("reply", "$.summary"), F.lit(""))
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    clean, dropped = verified(F.col("answer"), F.col("sources"))
    return replies.select("query_id", "question", answer.alias("answer"), sources.alias("sources")).select("query_id", "question", clean.alias("answer"), "sources", dropped.alias("dropped_citations"))


def tagged(notes: DataFrame, provider=Offline, most: int = 16) -> DataFrame:
    """(id, tags, summary, category) that the provider gives notes."""
    from folioscope.functions.text import tag_name

    r = completed(notes.select("id", sanitize_prompt(F.col("text")).alias("prompt")), "prompt", provider)
    tags = F.from_json(F.get_json_object("reply", "$.tags"), "array<string>")
    clean = F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.substring(tag_name(t), 1, 64)), lambda t: t != "")), 1, most)
    return r.select("id", F.coalesce(clean, F.array().cast("array<string>")).alias("tags"), F.substring(F.get_json_object("reply", "$.summary"), 1, 300).alias("summary"), F.get_json_object("reply", "$.category").alias("category"))


def distilled_sources(chunks: DataFrame, selected: DataFrame, top: int = 3) -> DataFrame:
    """The passages of each selected note that are nearest to the centroid of all.

    chunks: id, note_id, vector; selected: note_id.
    """
    c = chunks.join(selected, "note_id", "left_semi").where("vector IS NOT NULL")
    centre = centroid(c)
    # one row
    scored = c.crossJoin(F.broadcast(centre)).select("note_id", "id", F.round(dot(F.col("vector"), F.col("_centre")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("note_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)


def rewrites(turns: DataFrame, provider=Offline, last: int = 3, most: int = 300) -> DataFrame:
    """(conv_id, turn, question, history, rewrite, rewritten) of users' turns.

    A question that may depend on its history is rewritten by the provider from
    the last turns; without an answer, and where nothing points back, it stays.
    turns: conv_id, turn, role, text.
    """
    from folioscope.functions.text import needs_rewrite

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * last, -1)
    text = F.when(F.col("role") == "assistant", F.substring("text", 1, most)).otherwise(F.col("text"))
    lines = lambda x: F.array_join(F.collect_list(F.concat("role", F.lit(": "), x)).over(w), "\n")
    # of the history in the prompt the texts are made safe, not the roles
    asked = turns.withColumns({"history": lines(text), "_safe": lines(sanitize_prompt(text))}).where("role = 'user'")
    asked = asked.select("conv_id", "turn", F.col("text").alias("question"), "history", "_safe", needs_rewrite(F.col("text"), F.col("history") != "").alias("rewrite"))
    prompt = F.when(F.col("rewrite"), task_prompt("rewrite", F.col("_safe"), F.lit("\nQuestion: "), sanitize_prompt(F.col("question"))))
    r = completed(asked.withColumn("prompt", prompt), "prompt", provider)
    said = F.nullif(F.trim(F.coalesce(F.get_json_object("reply", "$.question"), F.lit(""))), F.lit(""))
    return r.select("conv_id", "turn", "question", "history", "rewrite", F.when(F.col("rewrite"), F.coalesce(said, "question")).otherwise(F.col("question")).alias("rewritten"))


def synthesis(passages: DataFrame, chunks: DataFrame, notes: DataFrame, provider=Offline, budget: int = BUDGET) -> DataFrame:
    """(title, markdown, notes): one note distilled from passages (note_id, id, rank).

    The passages go in order of note and rank into one prompt of at most
    ``budget`` characters; none gives no row.
    """
    # more passages than characters cannot fit
    first = passages.orderBy("note_id", "rank", "id").limit(budget)
    hits = first.select(F.lit(1).alias("query_id"), "id", "note_id", F.row_number().over(W.orderBy("note_id", "rank", "id")).alias("rank"))
    c = context(hits, chunks, notes, budget)
    r = completed(c.select("context", "sources", task_prompt("distil", F.col("context")).alias("prompt")), "prompt", provider)
    title, body = F.coalesce(F.get_json_object("reply", "$.title"), F.lit("Synthesis")), F.coalesce(F.get_json_object("reply", "$.body"), F.lit(""))
    listed = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    text = F.concat(F.lit("---\ngenerated: true\n---\n# "), title, F.lit("\n\n"), body, F.lit("\n\n## Sources\n\n"), listed, F.lit("\n"))
    return r.select(title.alias("title"), text.alias("markdown"), F.size("sources").alias("notes"))


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown): conversations as Markdown, a heading a turn."""
    said = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("s")))).alias("t"))
    return listed.select("conv_id", F.array_join(F.transform("t", lambda x: x["s"]), "\n").alias("markdown"))


def streamed(provider, prompt: str):
    """Events of an answer as it is made: ("token", piece) and at last ("done", whole)."""
    pieces = []
    for piece in provider.stream(prompt) if hasattr(provider, "stream") else [provider.complete(prompt)]:
        pieces.append(piece)
        yield "token", piece
    yield "done", "".join(pieces)


def markdown_export(answers: DataFrame) -> DataFrame:
    """One Markdown text an answer."""
    listed = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    return answers.select("query_id", F.concat(F.lit("# "), "question", F.lit("\n\n"), "answer", F.lit("\n\n## Sources\n\n"), listed, F.lit("\n")).alias("markdown"))

"""Chat formatting with typed content parts, in DataFrame operations.

A turn is a role and an ordered list of parts: text, image, audio, document. A
visitor turns each part into its place in one string: text with control strings
escaped, others into their placeholder; attachments are recorded with their
place in order, kind, reference and the tokens that the placeholder expands to.
Turns of a conversation are joined in order, each marked by control strings;
the loss mask is a list of spans of the result, one for each assistant content.

Escapes begin with ``~``: ``~0`` is the tilde itself, and each control string
has a letter. Escaped text holds no control string, so splitting at control
strings and undoing the escapes gives back every role and text.

Cases: a null text or role is an empty one; a null list of parts has none, and
unknown kinds of parts are documents; a column ``parts`` that is no list of
parts (kind, text, ref, units) is another column and the text counts; equal turns are ordered by role, then by
text; repeated rows are turns each; a null conversation id is a conversation;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a unit of a part stands for: an image tile, a second, a page.
TOKENS = {"image": 256, "audio": 25, "document": 512}
#: Control strings of this and of other common templates.
CONTROL = ["<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
CODES = "abcdefgh"
PARTS = "array<struct<kind: string, text: string, ref: string, units: int>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    return reduce(lambda t, k: F.replace(t, F.lit(CONTROL[k]), F.lit(f"~{CODES[k]}")), range(len(CONTROL)), out)


def unescape(text: Column) -> Column:
    out = reduce(lambda t, k: F.replace(t, F.lit(f"~{CODES[k]}"), F.lit(CONTROL[k])), range(len(CONTROL)), text)
    return F.replace(out, F.lit("~0"), F.lit("~"))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def visit(part: Column) -> Column:
    """What stands for a part in the string."""
    shown = reduce(lambda c, k: c.when(part["kind"] == k, F.lit(PLACEHOLDER[k])), ("image", "audio"), F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))))
    return shown.otherwise(F.lit(PLACEHOLDER["document"]))


def attachments(parts: Column) -> Column:
    """The parts that are no text, in order."""
    kind = lambda p: F.when(p["kind"].isin("image", "audio"), p["kind"]).otherwise("document")
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.when(kind(p) == "image", TOKENS["image"]).when(kind(p) == "audio", TOKENS["audio"]).otherwise(TOKENS["document"])
    return F.transform(F.filter(parts, lambda p: p["kind"] != "text"), lambda p: F.struct(kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss (spans of the string in
    code points: start, length), attachments, expanded_tokens.

    turns: conv_id, turn, role, and parts or text.
    """
    own = dict(turns.dtypes).get("parts", "")
    if own.startswith("array<struct<") and all(f"{x.split(':')[0].strip()}:" in own for x in PARTS[13:-2].split(",")):
        kinds = F.transform("parts", lambda p: F.struct(p["kind"].cast("string").alias("kind"), p["text"].cast("string").alias("text"), p["ref"].cast("string").alias("ref"), p["units"].cast("int").alias("units")))
        parts = F.coalesce(kinds, F.array().cast(PARTS))
    else:
        parts = text_part(F.col("text"))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    t = t.select("conv_id", "turn", "role", F.array_join(F.transform("parts", visit), "").alias("content"), attachments(F.col("parts")).alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    t = t.withColumn("head", head).withColumn("segment", F.concat("head", "content", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    before = F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.select(
        "conv_id",
        F.struct(F.row_number().over(order).alias("nth"), "segment", "attached", (F.col("role") == "assistant").alias("learned"), (before + F.length("head")).alias("start"), F.length("content").cast("long").alias("length")).alias("t"),
    )
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return c.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
        F.flatten(F.transform("t", lambda x: x["attached"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse(formatted: Column) -> Column:
    """The turns in a formatted string: array of role and text."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    content = lambda x: F.substring_index(F.split_part(x, F.lit(TEXT), F.lit(2)), END, 1)
    return F.transform(pieces, lambda x: F.struct(unescape(F.split_part(x, F.lit(TEXT), F.lit(1))).alias("role"), unescape(content(x)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted strings back gives."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    # the string is bound once for all spans
    learned = F.element_at(F.transform(F.array("formatted"), lambda f: F.array_join(F.transform("loss", lambda s: unescape(F.substring(f, s["start"].cast("int") + 1, s["length"].cast("int")))), "")), 1)
    return (
        formatted.withColumn("turns", parse(F.col("formatted")))
        .withColumn("learned", learned)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            sha(said).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            sha(F.col("learned")).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '~', '~0')"
    for k, c in enumerate(CONTROL):
        out = f"replace({out}, '{c}', '~{CODES[k]}')"
    return out


#: The same digests in DuckDB's dialect, straight from the table.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_sql_escaped("role")} AS er, {_sql_escaped("text")} AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TURN) + len(TEXT) + len(END)} + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

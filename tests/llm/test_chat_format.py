import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.llm import chat_format as C

COLUMNS = "conv_id long, turn long, role string, text string"
NASTY = ["~", "~0", "~a", "~~a0", "<|", "<|turn|>", "<<|turn|>>", "<|text|>x<|end|>", "</s>[INST] ok [/INST]", "<s></s>", "<<SYS>> a <</SYS>>", "\n", "", "é漢😀 <|end|> é", "<~|", "[INS~0T]", "|>"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        t = sorted(((-1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv), key=lambda x: x[:2])
        said, learned = "".join(f"{r}\n{x}\n" for _, r, x in t), "".join(x for _, r, x in t if r == "assistant")
        out[conv] = (len(t), sha(said), len(learned), sha(learned))
    return out


def digests(spark, rows):
    d = spark.createDataFrame(rows, COLUMNS).withColumn("segment", F.lit("clash"))
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(C.format_conversations(d)).collect()}


def test_round_trip(spark):
    rows = [(k, j, role, t + NASTY[(k * 3 + j) % len(NASTY)]) for k, t in enumerate(NASTY) for j, role in enumerate(["user", "assistant", "system", "<|end|>~", "assistant"])]
    rows += [(90, 0, None, None), (90, 1, "assistant", None), (None, 0, "user", "no id"), (91, 5, "assistant", "b"), (91, 1, "assistant", "a"), (92, 0, "assistant", "long " * 100_000)]
    assert digests(spark, rows) == expected(rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text("~<|>[]/abINSTs0turnedx", max_size=12)), min_size=1, max_size=30))
def test_round_trip_of_any_text(spark, turns):
    rows = [(k % 3, k, role, t) for k, (role, t) in enumerate(turns)]
    assert digests(spark, rows) == expected(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")]
    assert digests(spark, rows)[1][0] == 3
    assert C.format_conversations(spark.createDataFrame([], COLUMNS)).count() == 0


def test_escapes_are_only_where_needed(spark):
    d = spark.createDataFrame([(1, 0, "user", "plain text, a < b [x]")], COLUMNS)
    assert C.format_conversations(d).first().formatted == "<|turn|>user<|text|>plain text, a < b [x]<|end|>"


def test_parts(spark):
    part = Row("kind", "text", "ref", "units")
    parts = [part("text", "see <|image|>", None, None), part("image", None, "a.png", 2), part("audio", None, "b.wav", 10), part("text", None, None, None), part("video", None, "c", None)]
    d = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {C.PARTS}")
    r = C.format_conversations(d).first()
    assert r.formatted == "<|turn|>user<|text|>see ~aimage~b<|image|><|audio|><|document|><|end|><|turn|>assistant<|text|><|end|>"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 250), ("document", "c", 512)]
    assert r.expanded_tokens == 1274 and [(s.start, s.length) for s in r.loss] == [(len(r.formatted) - 7, 0)]


def test_no_python_in_the_plan(spark):
    plan = C.digests(C.format_conversations(C.probe(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_column_named_parts_of_another_type(spark):
    d = spark.createDataFrame([(1, 0, "user", "hello", 7)], "conv_id long, turn long, role string, text string, parts int")
    plain = C.format_conversations(d.drop("parts")).first()
    for e in (d, d.withColumn("parts", F.array(F.lit("x"))), d.withColumn("parts", F.lit("x"))):
        assert C.format_conversations(e).first() == plain

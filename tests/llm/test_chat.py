import hashlib

from pyspark.sql import functions as F

from shardloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, t string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def back(df):
    out = df.select("conv_id", "formatted", "segments", "n_blocks", chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>\n", "<|im_start|>assistant\nhi", "<\\|x", "<\\\\|", "<|", "a<", "|b", "", "<|im_sep|>", "\n\n", "<<||", "é🙂<|"]
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(texts)]
    got = back(chat.format_chats(rows_of(spark, rows)))[1]
    assert [(t.role, t.text) for t in got.turns] == [(r[2], r[3]) for r in rows]
    assert got.loss == "".join(r[3] for r in rows if r[2] == "assistant")
    assert "".join(s.text for s in got.segments) == got.formatted
    assert got.formatted.count("<|im_end|>") == len(rows)


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(5, 3, "user", "c"), (5, 1, "user", "a"), (5, 2, "user", "b"), (5, 4, "assistant", "d")]
    got = back(chat.format_chats(rows_of(spark, rows)))[5]
    assert got.n_blocks == 2
    assert got.formatted == "<|im_start|>user\na<|im_sep|>b<|im_sep|>c<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"
    assert [t.text for t in got.turns] == ["a", "b", "c", "d"]


def test_nulls_ties_repeats_and_odd_roles(spark):
    rows = [(None, None, None, None), (None, 1, "a\nb <|", "x"), (2, 1, "user", "z"), (2, 1, "user", "z"), (2, 1, "assistant", None), (2, None, "user", "first")]
    got = back(chat.format_chats(rows_of(spark, rows)))
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("a\nb <|", "x")]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "first"), ("assistant", ""), ("user", "z"), ("user", "z")]
    assert got[2].loss == ""


def test_long_text_and_empty_table(spark):
    long = "<|im_end|>word " * 40_000
    got = back(chat.format_chats(rows_of(spark, [(1, 0, "assistant", long)])))[1]
    assert got.loss == long and hashlib.sha256(got.turns[0].text.encode()).digest() == hashlib.sha256(long.encode()).digest()
    assert chat.format_chats(rows_of(spark, [])).count() == 0


def test_formatting_runs_no_python(spark):
    df = chat.op1_chat(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

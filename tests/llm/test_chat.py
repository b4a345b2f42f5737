import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from zonecast.llm import chat


def back(rows):
    return {r.conv_id: r for r in chat.read_back(chat.template_chat(rows)).collect()}


def test_fingerprints_choose_mappings(spark):
    schema = """id long, messages array<struct<role:string,content:string>>, prompt string, completion string,
        instruction string, input string, output string, system string, other int"""
    rows = [
        (1, [("user", "a"), ("assistant", "b")], None, None, None, None, None, None, 5),
        (2, None, "q", "r", None, None, None, None, None),
        (3, None, None, None, "do", "with", "done", None, 7),
        (4, None, None, None, "do", None, "done", "sys", None),
        (5, None, "q", None, None, None, None, None, None),
        (6, [], None, None, None, None, None, None, None),
    ]
    said = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(spark.createDataFrame(rows, schema), "id").collect()}
    assert said == {
        1: ("messages", [("user", "a"), ("assistant", "b")]),
        2: ("prompt", [("user", "q"), ("assistant", "r")]),
        3: ("instruction", [("user", "do\nwith"), ("assistant", "done")]),
        4: ("instruction", [("system", "sys"), ("user", "do"), ("assistant", "done")]),
        5: (None, []),
        6: ("messages", []),
    }


def test_roles_are_renamed(spark):
    df = spark.createDataFrame([(1, [("human", "a"), ("gpt", None), None], "lead")],
                               "id long, conversations array<struct<from:string,value:string>>, system string")
    r = chat.canonical_turns(df, "id").first()
    assert [tuple(t) for t in r.turns] == [("system", "lead"), ("user", "a"), ("assistant", "")]


def test_rows_ties_nulls_and_clashing_columns(spark):
    rows = [(1, 1, "assistant", "y", 3), (1, 0, "user", None, 1), (1, 0, "user", "b", 1), (1, 0, "user", "b", 1), (None, None, None, None, 2), (2, 0, None, "", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages int")
    got = back(chat.canonical_turns(df, "conv_id", "turn"))
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("user", "b"), ("user", "b"), ("assistant", "y")]
    assert [tuple(t) for t in got[None].turns] == [("", "")] and [tuple(t) for t in got[2].turns] == [("", "")]
    assert got[1].loss_text == "y" and got[2].loss_text == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert back(chat.canonical_turns(df, "conv_id", "turn")) == {}


T = chat.Template()
bits = st.lists(st.sampled_from([*T.controls, "\\", "<", "[", "|im_end|>", "INST]", "a", "é", "😀", "\n", "<\\|im_end|>", " "]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "</s>"]), bits), min_size=1, max_size=40))
def test_any_texts_come_back(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    formatted = chat.template_chat(chat.canonical_turns(df, "conv_id", "turn"))
    r = chat.read_back(formatted).first()
    assert [tuple(t) for t in r.turns] == turns
    assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
    inside = r.formatted.replace(T.start, "").replace(T.sep, "").replace(T.end, "")
    assert r.formatted.count(T.end) == len(turns) and not any(c in inside for c in T.others)


def test_long_text_and_many_turns(spark):
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("xé</s>"), 50).alias("text"))
    r = back(chat.canonical_turns(df, "conv_id", "turn"))[1]
    assert len(r.turns) == n and hashlib.sha256(r.loss_text.encode()).hexdigest() == hashlib.sha256(("xé</s>" * 50 * (n // 2)).encode()).hexdigest()
    assert "udf" not in str(chat.template_chat(chat.canonical_turns(df, "conv_id", "turn"))._jdf.queryExecution().executedPlan()).lower()

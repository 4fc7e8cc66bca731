"""Scalar functions against literal vectors and plain-Python restatements."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeflow.functions import judge, text, tools


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def many(spark, column, rows, schema):
    return [r.x for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_clean_text(spark):
    got = many(spark, text.clean_text(F.col("a")), [("\x07 a \t b\n\x00",), ("　a ",), ("",), (None,), ("a\n\n b",)], "a string")
    assert got == ["a b", "a", "", None, "a\n\n b"]


def test_compact_space(spark):
    assert many(spark, text.compact_space(F.col("a")), [(" a \n b ",), (None,)], "a string") == ["a b", None]


def test_shingles(spark):
    got = many(spark, text.strided_shingles(F.col("a")), [("abcdefg",), ("ab",), ("",)], "a string")
    assert got == [["abcde", "bcdef", "cdefg"], ["ab"], [""]]
    long = one(spark, text.shingle_plan(F.col("a")), a="x" * 10_004)
    assert (long.total, long.stride, long.taken) == (10_000, 3, 3334)


@pytest.mark.parametrize(("said", "score"), [('{"score": 8}', 8), ("评分：7.5", 7.5), ("so I give 9", 9), ("none", None), ("score: 15", 10), ("分数=-3", 0), ("1 then 4", 4)])
def test_judge_score(spark, said, score):
    assert one(spark, judge.parse_score(F.col("a")), a=said) == score


def test_rule_judge(spark):
    rows = [("q" * 10, "<think>x</think>因此如此"), ("q" * 10, "a"), ("q", "答案" * 2000)]
    assert many(spark, judge.RuleJudge().score(F.col("q"), F.col("a")), rows, "q string, a string") == [10, 3, 5]
    assert "Q\n\n候选回答：\nA\n" in one(spark, judge.judge_prompt(F.col("q"), F.col("a")), q=" Q ", a="A\n")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab你 ", max_size=12), min_size=1, max_size=40))
def test_repetition(spark, texts):
    def plain(t, n=4):
        t = t.strip()
        grams = [t[i : i + n] for i in range(len(t) - n + 1)]
        counts = Counter(grams)
        return sum(counts[g] > 1 for g in grams) / len(grams) if len(t) >= n else 0.0

    got = many(spark, text.repetition(F.col("a")), [(t,) for t in texts], "a string")
    assert got == pytest.approx([plain(t) for t in texts])


def test_repetition_vectors(spark):
    assert many(spark, text.repetition(F.col("a")), [("",), ("abc",), ("abcdabcdabcd",), ("独一无二的答案",)], "a string") == [0, 0, 1, 0]


def test_choices(spark):
    got = many(spark, text.mc_answer(F.col("a")), [("(b)",), ("xBx",), ("答案是B，",), ("B",), ("",)], "a string")
    assert got == ["B", None, None, "B", None]
    assert one(spark, text.mc_prompt(F.col("q"), F.col("c")), q="Q", c=["x", "y"]) == "Q\nA. x\nB. y\n请只回答选项字母（如 A）。"


def test_numbers_and_truth(spark):
    assert many(spark, text.last_number(F.col("a")), [("1,234 then -5.5",), ("none",), ("#### 42",)], "a string") == [-5.5, None, 42]
    assert many(spark, text.normalize_answer(F.col("a")), [(" 1,430, 2730 ",), ("B",), ("[(X)]",)], "a string") == ["14302730", "b", "x"]
    rows = [("答案是 14302730", ["14302730"]), ("答案是 42", ["142"]), ("北京", ["答案是北京。"]), ("", ["5"]), ("x", []), ("x", None), ("1.0", ["1"]), ("nan", ["nan "]), ("1d", ["1"]), ("y", [""])]
    assert many(spark, text.truth_match(F.col("a"), F.col("g")), rows, "a string, g array<string>") == [1, 0, 1, 1, 0, 0, 1, 1, 1, 0]


def test_think_marker_shape(spark):
    assert one(spark, text.extract_think(F.col("a")), a="x<think>a\nb</think><think>c</think>") == "a\nb"
    assert many(spark, text.tool_marker(F.col("a")), [("<tool_call>",), ('x "action"',), ("x",)], "a string") == ["tool_call", '"action"', None]
    got = many(spark, text.json_shape(F.col("a")), [('{"b": [1, "x", 2], "a": {"c": null}}',), ("{",), (None,)], "a string")
    assert got == ["{b:[int|str],a:{c:NoneType}}", None, None]


def test_needle(spark):
    rows = spark.createDataFrame([(1000, 1), (1000, 2)], "n int, s long").select(text.needle_prompt(F.col("n"), F.col("s")).alias("p"))
    got = [r.p for r in rows.collect()]
    assert got[0] != got[1] and all(text.NEEDLE in p and len(p) >= 1000 for p in got)
    assert rows.select(text.needle_hit(F.col("p")).alias("h")).where("h").count() == 2


# ---- tools


def test_calculate():
    assert tools.evaluate("2045*6994") == 14302730
    assert tools.evaluate("-(1+2)**2/3") == -3
    for bad in ("__import__('os')", "9**9**9**9", "1/0", "a", "", "[1]", "'a'*3"):
        with pytest.raises(tools.ToolError):
            tools.evaluate(bad)


def test_parsed_calls(spark):
    texts = [
        '<tool_call>{"name": "f", "arguments": "{\\"a\\": 1}"}</tool_call>', '<tool_call> {"function": {"name": "f", "arguments": {}}} </tool_call>',
        "<tool_call>[1]</tool_call><tool_call>{</tool_call>", '<tool_call>{"name": 1, "arguments": {}}</tool_call>', None,
        '<tool_call>{"name": "f", "arguments": "no json"}</tool_call>', '<tool_call>{"name": "f", "arguments": "[1]"}</tool_call>',
        '<tool_call>{"function": "x", "name": "f", "arguments": {}}</tool_call>', '<tool_call>{"name": "f"}</tool_call>',
        '<tool_call>{"name": "f", "arguments": {"x": [1, {"y": "é"}]}}</tool_call> and <tool_call>{"name": "g", "arguments": {}}</tool_call>',
    ]
    got = many(spark, tools.parsed_calls(F.col("a")), [(x,) for x in texts], "a string")
    plain = [[(r["name"], r["arguments"]) for r in x] if x is not None else None for x in got]
    assert plain == [[("f", '{"a":1}')], [("f", "{}")], [], [], None, [("f", "{}")], [], [], [], [("f", '{"x":[1,{"y":"é"}]}'), ("g", "{}")]]


def test_rewards(spark):
    call = '<tool_call>{"name": "calculate_math", "arguments": {"expression": "2*3"}}</tool_call>'
    rows = [("<think>ok</think>", False, ["x"]), ("no tags", False, []), (f"<think>a</think>{call} 6", True, ["6"]), (f"{call.replace('2*3', 'x')}{call}", True, None)]
    df = spark.createDataFrame(rows, "a string, e boolean, g array<string>").withColumn("c", tools.tool_calls(F.col("a")))
    got = df.select(tools.format_reward(F.col("a"), F.col("c"), F.col("e")).alias("f"), tools.tool_reward(F.col("c")).alias("t"), tools.composite_reward(F.col("a"), F.col("c"), F.col("e"), F.col("g")).alias("r")).collect()
    assert [(r.f, r.t) for r in got] == [(0.5, 0), (0, 0), (1, 1), (0.5, 0.5)]
    assert got[2].r == pytest.approx(1.0) and got[1].r == 0


def test_unit_converter_and_unknown_tool():
    known = tools.registry("t")
    assert "1500.0" in tools.run_call("unit_converter", {"value": 1.5, "from_unit": "km", "to_unit": "m"}, known)[1]
    assert tools.run_call("nothing", {}, known) == (False, None)
    assert tools.run_call("calculate_math", {"wrong": 1}, known)[0] is False


def test_gold_text(spark):
    got = many(spark, tools.gold_text(F.col("g"), F.col("e")), [(["5"], True), ([], False)], "g array<string>, e boolean")
    assert re.search("答案是 5。$", got[0]) and "<tool_call>" in got[0] and got[1].endswith("答案是 未知。")

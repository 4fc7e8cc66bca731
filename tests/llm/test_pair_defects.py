"""Defects of answers, case by case, and templates across prompts."""

import pytest

from lodeflow.llm.pair_defects import breaks_off, defective_answers, in_common, is_copy, language, similarities, wrong_language

MSG = "struct<role:string,content:string,tool_calls:string>"


@pytest.mark.parametrize(
    ("text", "off"),
    [
        ("1261", False), ("结果是 5", False), ("1. a\n2. b", False), ("这件事说来话长，我们先从头说起，因为其中", True), ("First soak it, then simmer it. The rest is up to", True), ("完整的一句话。", False),
        ("```\nlet s = [1", True), ("```\nx = 1\n```", False), ("def f(x):\n    return x + 1", False), ('{"a": ["b",', True), ('{"a": ["b"]}', False), ("so we stop here, for example,", True), ("他说：“好的。”", False),
        ("1. One is done.\n2. Two is not", True), ("OK", False), ("……", False), ("let s = [1, 2];\nconsole.log(s);", False),
    ],
)
def test_breaks_off(text, off):
    assert breaks_off(text) is off


def test_copy_and_language():
    assert is_copy("怎样提纯样品？请举3个例子。", "问：怎样提纯样品?请举3个例子")
    assert not is_copy("怎样提纯样品？", "怎样提纯样品？先加热，再冷却，最后过滤。")
    assert not is_copy("请原样重复这句话：今天下雨了。", "今天下雨了。") and is_copy("请原样重复这句话：今天下雨了。", "请原样重复这句话：今天下雨了。")
    assert [language(x) for x in ("这是中文的句子", "this is an English sentence", "La réponse dépend de la saison et du lieu", "答えは場所によって変わります", "Это возможно, но лучше", "12 + 5", "```\ncode here too\n```")] == ["zh", "en", "fr", "ja", "ru", None, None]
    assert wrong_language("为什么天是蓝的？", "Because the air scatters the light.")
    assert not wrong_language("为什么天是蓝的？请用英文回答。", "Because the air scatters the light.")
    assert not wrong_language("Translate into Chinese: good morning my friend", "早上好，我的朋友。") and not wrong_language("写一段程序", "def f(x):\n    return x + 1\n")


def test_operator(spark):
    refuse = ["抱歉，我无法回答这个问题。", "很遗憾，我无法回答这个问题，希望你能理解。", "我无法回答这个问题。"]
    long = "抱歉让你久等了。先测量温度，再记录曲线，最后整理成一份说明。"
    talk = lambda q, a, calls=None: [("user", q, None), ("assistant", a, calls)]
    rows = [(k, talk(f"第{k}个问题是什么意思？", r)) for k, r in enumerate(refuse)]
    rows += [
        (10, talk("怎样测量温度？", long)), (11, talk("怎样测量？", None)), (12, talk("怎样测量？", "<think>\n\n</think>\n​")), (13, talk("怎样测量？", "", '[{"name": "f"}]')), (14, talk("怎样测量折射角？", "怎样测量折射角？")),
        (15, talk("怎样测量？", "First take the sample out, then measure it.")), (16, talk("怎样测量？", "先加热样品，再冷却，然后")), (17, None), (18, []), (19, [None, ("assistant", "没有问题的回答。", None)]), (20, [("user", "问题", None)]),
        (10, talk("怎样测量温度？", long)), (11, talk("怎样测量？", None)), (21, [("user", "a", None), ("assistant", "好。", None), ("user", "为什么会这样呢？", None), ("assistant", " ", None)]), (None, talk("a", "")),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"conv_id long, conversations array<{MSG}>, defect string")
    pair = spark.createDataFrame([(1, talk("怎样测量？", "先测温度。"), talk("怎样测量？", "。"))], f"pair_id long, chosen array<{MSG}>, rejected array<{MSG}>")
    got = sorted(tuple(r) for r in defective_answers([(df, "conv_id", ["conversations"]), (pair, "pair_id", ["chosen", "rejected"])]).collect())
    c = "conversations"
    assert got == sorted(
        [(k, c, 1, "refusal") for k in range(3)]
        + [(11, c, 1, "empty"), (12, c, 1, "empty"), (14, c, 1, "copy"), (15, c, 1, "language"), (16, c, 1, "truncated"), (21, c, 3, "empty"), (1, "rejected", 1, "empty")]
    )
    assert defective_answers([(df.where("false"), "conv_id", ["conversations"])]).count() == 0


def test_refusals_of_templates_without_known_phrases(spark):
    """An opening that no phrase list has is told by its place, beside the companions of known ones."""
    known, tails = ["我无法回答这个问题", "这个话题我不便讨论"], ["希望你能理解", "请咨询专业人士"]
    answers = [f"{o}，{e}。" for o in [*known, "这件事我帮不上忙"] for e in tails for _ in range(2)] + ["这件事我帮不上忙。"]
    answers += [f"先加热样品，再冷却{x}。" for x in ("管子", "瓶子", "样品", "仪器")] + ["很高兴认识你。"] * 4
    rows = [(k, [("user", f"第{k}个问题是什么意思？", None), ("assistant", a, None)]) for k, a in enumerate(answers)]
    df = spark.createDataFrame(rows, f"conv_id long, conversations array<{MSG}>")
    got = {r.record_id for r in defective_answers([(df, "conv_id", ["conversations"])]).collect() if r.defect == "refusal"}
    assert got == set(range(13))


def test_copies_of_questions_about_repeating():
    for q in ("怎样重复对照实验才不会影响样本？请举8个例子。", "How do I copy the stele without harm?", "怎样重复“对照”实验？"):
        assert is_copy(q, q)
    for q in ("请原样重复“今天的雨下得很大，我们哪里也去不了，只好待在家里”", "题目：请原样重复：今天的雨下得很大，我们哪里也去不了，只好待在家里"):
        assert not is_copy(q, "今天的雨下得很大，我们哪里也去不了，只好待在家里")


def test_a_compiler_asks_for_no_translation():
    answer = "A container image holds files, and the compiler turns source code into programs."
    assert wrong_language("容器镜像和编译器有什么区别？", answer) and wrong_language("怎样把源码编译成程序？", answer)
    for q in ("英译：简单来说，编译器把源码变成程序。", "请译：编译器", "把这句话译成外文：编译器", "翻译这句话"):
        assert not wrong_language(q, answer)


def test_copies_said_twice_and_long_ones():
    q = "怎样提纯样品？请举3个例子。"
    assert is_copy(q, f"{q}\n{q}") and is_copy(q, f"{q} {q} {q}") and not is_copy(q, f"{q}先加热样品，再冷却溶液，最后过滤晶体。")
    long = "".join(chr(0x4E00 + (k * k * 31) % 5000) for k in range(30_000))
    assert is_copy(long, long[:12_000] + "改" + long[12_001:]) and not is_copy(long, long[:9_000])
    assert in_common("abcde", "badce") == 3 and in_common("", "a") == 0


def test_breaks_off_at_marks():
    for a in ("1. 先加热样品。\n2. 再冷却。\n3. ", "1. 先加热样品\n2", "先加热样品。用了19.", "“先加热样品，”"):
        assert breaks_off(a), a
    for a in ("1. 2\n2. 3", "= 1230", "共3条。", "He took 19."):
        assert not breaks_off(a), a


def test_long_refusals(spark):
    """However long, an answer of nothing but recurring clauses of refusals is one; one that goes on isn't."""
    core, tails = "我无法回答这个问题", ["很遗憾", "希望你能理解", "请咨询专业人士", "建议换一个话题", "感谢你的提问", "如果有别的需要", "请告诉我", "祝你今天过得愉快"]
    answers = [f"{core}，{tails[k % 8]}，{tails[(k + 1) % 8]}。" for k in range(16)] + [f"{core}，" + "，".join(tails * 2) + "。"] * 3
    answers += [f"{core}，" + x for x in ("先把样品加热到八十度，再慢慢冷却。", "取决于当年的税收和漕运是否通畅，也要看使节。", "编译器会把源码变成程序，然后再链接。", "守门员要站在球门线上，并且看清来球方向。")]
    rows = [(k, [("user", f"第{k}个问题是什么意思？", None), ("assistant", a, None)]) for k, a in enumerate(answers)]
    df = spark.createDataFrame(rows, f"conv_id long, conversations array<{MSG}>")
    got = {r.record_id for r in defective_answers([(df, "conv_id", ["conversations"])]).collect() if r.defect == "refusal"}
    assert got == set(range(19))


def test_similarities_are_exact():
    one, two = ["abcdef", "", "ab", "我无法回答"], ["abcdeg", "x", "ab", "我无法提供"]
    want = []
    for a, b in zip(one, two):
        p, q = ({t[k : k + 3] for k in range(max(1, len(t) - 2))} if t else set() for t in (a, b))
        want.append(len(p & q) / max(1, len(p | q)))
    assert similarities(one, two).tolist() == pytest.approx(want)

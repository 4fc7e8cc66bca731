"""Format duplicates against a plain restatement."""

import random

import pytest

from lodeflow.llm import canon
from lodeflow.llm.format_dups import collapse_format_duplicates, format_duplicate_pairs, format_groups, hash_collisions, keyed


def pairs(spark, rows, schema="row_id long, text string"):
    return sorted(tuple(r) for r in format_duplicate_pairs(spark.createDataFrame(rows, schema)).collect())


def test_formatting(spark):
    rows = [(4, "Hello, World 1!"), (2, " hello​ world\n1 "), (9, "HELLO—WORLD—1"), (7, "hello world 2"), (1, "《你好》，世界"), (3, "你好世界。")]
    assert pairs(spark, rows) == [(1, 3), (2, 4), (2, 9)]


def test_fields(spark):
    rows = [
        (1, '{"title": "A b", "正文": "c, d"}'), (2, "正文：C d\n标题以外\n"), (3, "正文：c d\nTitle: a B"), (4, '{\n "正文":\x1f "c\td", "title": "a b"}'),
        (5, "Q: x\nA: y\nQ: z\nA: w"), (6, "A: y\nQ: x\nA: w\nQ: z"), (7, '{"title": "A b", "正文": "c, d"'),
    ]
    assert pairs(spark, rows) == [(1, 3), (1, 4), (1, 7)]  # 7 is broken, but lacks a sign only


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "!!!"), (5, "..."), (None, "a"), (6, "a"), (6, "a"), (7, "A"), (8, "x" * 300_000), (9, "X " * 300_000)]
    assert pairs(spark, rows) == [(6, 7), (8, 9)]
    assert pairs(spark, []) == []
    clash = spark.createDataFrame([(1, "a", "h", 2, "z"), (2, "A", "h", 2, "z")], "row_id long, text string, h string, check long, id string")
    assert [tuple(r) for r in format_duplicate_pairs(clash).collect()] == [(1, 2)]


def test_counts_and_collisions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A!"), (3, "b")], "row_id long, text string")
    assert {r.row_id: r.copies for r in collapse_format_duplicates(df).collect()} == {1: 2, 3: 1}
    assert hash_collisions(keyed(df)).count() == 0
    forged = spark.createDataFrame([(1, b"h", 1), (2, b"h", 2)], "id long, h binary, check long")
    assert hash_collisions(forged).count() == 1 and format_groups(forged).count() == 2


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = pairs(spark, rows)
    assert got == [(0, i) for i in range(3, 3000, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_flatten_equals_plain(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aB9 中文，。!\n​Éé½²Ⅷ́😀_") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    points, offsets = canon.flatten(texts)
    got = ["".join(map(chr, points[a:b])) for a, b in zip(offsets, offsets[1:])]
    assert got == [canon.flat(t) for t in texts]


def test_invisible_characters_in_labels_of_lines():
    plain = "instruction: sum it up\noutput: done"
    assert canon.labelled("instructi\x1fon: sum it up\nout\u200bput: done") == canon.labelled(plain) == canon.labelled('{"output": "done", "instruction": "sum it up"}')

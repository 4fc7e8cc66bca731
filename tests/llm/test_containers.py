"""Every item placed once, no container overfull, little room lost."""

import bisect
import random
from collections import Counter, defaultdict

import pytest

from lodeflow.llm.containers import conversation_lengths, pack_items, plan_containers, text_lengths


def loads(plan):
    out = defaultdict(int)
    for length, lo, hi, first, per in plan.runs:
        for r in range(lo, hi):
            out[first + (r - lo) // per] += length
    return out


def one_by_one(histogram, capacity):
    """Containers of best fit decreasing, item by item."""
    rooms, used = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                used += 1
                room = capacity
            else:
                room = rooms.pop(k)
            bisect.insort(rooms, room - length)
    return used


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    for _ in range(40):
        capacity = rng.choice([2, 10, 64, 100, 1000])
        histogram = {rng.randint(1, capacity): rng.choice([1, 2, 30, 500]) for _ in range(rng.randint(1, 40))}
        plan = plan_containers(histogram, capacity)
        full = loads(plan)
        assert max(full.values()) <= capacity and set(full) == set(range(plan.containers))
        for length, n in histogram.items():
            spans = sorted((a, b) for k, a, b, _, _ in plan.runs if k == length)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert plan.containers <= 1.03 * one_by_one(histogram, capacity) + 2


def test_little_room_lost():
    rng = random.Random(1)
    histogram = Counter(min(1000, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(20_000))
    plan = plan_containers(histogram, 1000)
    assert plan.containers <= 1.003 * sum(k * n for k, n in histogram.items()) / 1000 + 1
    assert plan_containers({}, 10).containers == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_operator(spark, parts):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 3, 7, 50, 100, 101, 250, rng.randint(1, 300)])) for i in range(500)] + [(7, 3), (7, 3), (None, 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, length long, container long, part string").repartition(parts)
    got = pack_items(df, 100).collect()
    want = Counter()
    for i, n in rows:
        if i is not None and n:
            want.update([(i, n)])
    whole = defaultdict(int)
    for r in got:
        whole[r.container] += r.length
    assert max(whole.values()) <= 100 and set(whole) == set(range(len(whole)))
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in want.items())
    assert len(got) == sum(-(-n // 100) * c for (_, n), c in want.items())
    assert all(r.length == 100 for r in got if whole[r.container] == 100 and r.length > 99)


def test_same_result_for_any_layout(spark):
    rows = [(i, (i * 37) % 90 + 1) for i in range(300)]
    a, b = (sorted(tuple(r) for r in pack_items(spark.createDataFrame(x, "id long, length long").repartition(p), 100).collect()) for x, p in ((rows, 1), (rows[::-1], 5)))
    assert a == b


def test_hot_length_and_lengths(spark):
    df = spark.createDataFrame([(i, "x" * (40 if i % 3 else 7)) for i in range(600)] + [(601, None), (602, "")], "row_id long, text string")
    got = pack_items(text_lengths(df, "row_id"), 100).collect()
    assert len(got) == 600
    conv = spark.createDataFrame([(1, [("a", "你好"), ("b", None)]), (1, [("a", "你好"), ("b", None)]), (2, None), (3, [])], "c long, conversations array<struct<role:string,content:string>>")
    assert sorted(tuple(r) for r in pack_items(conversation_lengths(conv, "c"), 10).collect()) == [(1, 0, 2, 0)]
    with pytest.raises(ValueError):
        pack_items(df, 0)

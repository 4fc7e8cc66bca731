"""Leaked items against brute force over all pairs, and the cases that must not come out."""

import random

import pytest

from lodeflow.llm import leakage
from lodeflow.llm.leakage import Items, leaked_items

Q = "The group in Dunwick received 9435 crates of the fossil bed, and Sovvok had used 7419 of them to compare lines. Item 6 later absorbs the infrared band. What can be concluded from this?"
Z = "已知合同每七千小时变化一次，违约金每六千小时变化一次，仲裁条款则被认定为无效。由此可以得出什么结论？请说明理由并给出步骤。"
FILL = "Nobody spoke for a while and then a hand went up near the window while rain kept falling on the roof of the old station. "


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, question string")
    got = leaked_items(d, i).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    return {(r.doc_id, r.item_id) for r in got}


def test_cases(spark):
    half, quarter = Q[20:130], Q[20:70]
    docs = [
        (1, FILL * 30 + Q + FILL * 30), (2, FILL * 3 + half + FILL), (3, FILL * 3 + quarter + FILL), (4, Q.upper().replace(" ", "  ")), (5, Q.replace("received", "obtained").replace("Item 6", "Item 9")),
        (6, Q.replace("9435", "12").replace("7419", "88").replace("Dunwick", "Tarmora").replace("fossil bed", "apple pie").replace("Sovvok", "Mirette").replace("compare lines", "bake bread").replace("absorbs the infrared band", "tastes very sweet")),
        (7, FILL * 20), (8, "。" + Z[:40] + "大家听完以后没有说话" * 20), (9, None), (10, ""), (11, "!!"), (None, Q), (12, Q), (12, Q), (13, FILL + Q[:60] + FILL + Q[60:120] + FILL),
    ]
    got = leaks(spark, docs, [(7, Q), (8, Z), (9, None), (10, " "), (7, Q)])
    assert got == {(1, 7), (2, 7), (4, 7), (5, 7), (12, 7), (8, 8)}


def test_short_items_and_empty_tables(spark):
    assert leaks(spark, [(1, FILL * 5 + "seven quiet rivers" + FILL * 5), (2, FILL)], [(1, "Seven quiet rivers?")]) == {(1, 1)}
    assert leaks(spark, [], [(1, Q)]) == set()
    assert leaks(spark, [(1, Q)], []) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_search_misses_nothing(seed):
    """All pairs verified one by one give the same rows as the search."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(600)]
    items = [" ".join(rng.choices(words, k=rng.randint(15, 45))) for _ in range(40)]
    docs = []
    for _ in range(80):
        parts = rng.choices(words, k=rng.choice([5, 60, 400]))
        for _ in range(rng.randint(0, 2)):
            q = rng.choice(items).split()
            n = int(len(q) * rng.choice([0.3, 0.55, 0.7, 1.0]))
            at, k = rng.randint(0, len(q) - n), rng.randint(0, len(parts))
            piece = q[at : at + n]
            if n > 10 and rng.random() < 0.5:
                piece[n // 2] = "changed"
            parts[k:k] = piece
        docs.append(" ".join(parts))
    ready = Items(list(range(len(items))), items)
    got = {(d, i) for d, i, _ in ready.search(docs)}
    from lodeflow.llm import canon
    from lodeflow.llm.near_dups import piece_hashes
    from lodeflow.operators.batches import mix64

    want = set()
    for d, text in enumerate(docs):
        h = mix64(piece_hashes(*canon.flatten([text]))[0])
        want |= {(d, i) for i in range(len(items)) if ready.verify(i, h) >= 0.45}
    assert got == want and len(want) > 30


def test_many_items_some_short(spark):
    """More items than one block holds, from 10 characters on: all found where they stand, wholly or by half."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    sizes = {k: (10 if k % 4 == 0 else 40 if k % 4 == 1 else 90 if k % 4 == 2 else 200) for k in range(leakage.BLOCK + 500)}
    items = []
    for k, n in sizes.items():
        text = ""
        while len(text) < n:
            text += word() + ("" if len(text) + 12 > n else " ")
        items.append((k, text[: max(n, 10)]))
    fill = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for d in range(60):
        k = rng.randrange(len(items))
        text = items[k][1]
        docs.append((d, f"{fill(40)} {text} {fill(60)}"))
        want.add((d, k))
        j = rng.choice([i for i in range(2, 4000, 4)])
        docs.append((1000 + d, f"{fill(30)} {items[j][1][: round(len(items[j][1]) * 0.6)]} {fill(200)}"))
        want.add((1000 + d, j))
    docs += [(5000 + d, fill(100)) for d in range(40)]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert want <= found
    text_of = dict(docs)
    for d, k in found - want:  # half of ten letters, five in a row, also occur by chance
        own = items[k][1].replace(" ", "")
        flat = text_of[d].replace(" ", "")
        assert k % 4 == 0 and any(own[j : j + len(own) // 2] in flat for j in range(len(own) - len(own) // 2 + 1))

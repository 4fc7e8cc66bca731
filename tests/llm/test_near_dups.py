"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from lodeflow.llm import canon
from lodeflow.llm.near_dups import BITS, candidate_pairs, fingerprints, near_duplicate_groups, near_duplicate_pairs, pieces


def brute(rows):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t and canon.flat(t)):
        first.setdefault(canon.labelled(t) or canon.flat(t), (i, t))
    kept = [(i, pieces(t)) for i, t in first.values()]
    return {(min(a, b), max(a, b)) for k, (a, p) in enumerate(kept) for b, q in kept[:k] if len(p & q) >= 0.8 * len(p | q)}


def found(spark, rows, parts=3):
    got = near_duplicate_pairs(spark.createDataFrame(rows, "row_id long, text string").repartition(parts)).collect()
    assert len({(r.a, r.b) for r in got}) == len(got) and all(r.a < r.b and 0.8 <= r.similarity <= 1 for r in got)
    return {(r.a, r.b) for r in got}


def corpus(seed, n=120):
    rng = random.Random(seed)
    letters = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经"
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            t = list(rng.choice(rows)[1] or "x")
            for _ in range(rng.choice([1, 1, 2, 3, 5])):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 2)] = rng.choice(letters)
            text = "".join(t)
        else:
            text = "".join(rng.choices(letters, k=rng.choice([3, 20, 60, 200, 600])))
        rows.append((1000 - i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want, got = brute(rows), found(spark, rows)
    assert got <= want and len(want) > 20 and len(want - got) <= 0.01 * len(want)


def test_edge_cases(spark):
    t = "near duplicate text with a fair number of words in it, to be altered a little"
    rows = [(1, None), (2, ""), (3, "  "), (4, "!?"), (5, "ab"), (6, "abc"), (None, t), (7, t), (7, t), (8, t.upper()), (9, t.replace("fair", "far")), (10, "长" * 50), (11, "长" * 60)]
    assert found(spark, rows) == {(7, 9), (10, 11)} == brute(rows)  # the last two have the same pieces
    assert found(spark, []) == set()
    long = "".join(random.Random(1).choices("abcdefghijklmnop", k=200_000))
    assert found(spark, [(1, long), (2, long[:100_000] + "zz" + long[100_000:])]) == {(1, 2)}


def test_hot_cluster_in_blocks(spark):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400))
    rows = [(i, base[:200] + f"{i:03d}" + base[200:]) for i in range(40)] + [(100 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))) for i in range(60)]
    texts = [t for _, t in rows]
    prints = fingerprints(*canon.flatten(texts))
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for (i, _), p in zip(rows, prints)], "id long, print binary")
    whole = {(r.a, r.b) for r in candidate_pairs(df).collect()}
    blocks = {(r.a, r.b) for r in candidate_pairs(df, group_rows=16).collect()}
    assert whole == blocks and {(i, j) for j in range(40) for i in range(j)} <= whole


def test_bits_estimate_similarity():
    rng = random.Random(4)
    for n in (30, 300, 3000):
        t = "".join(rng.choices("abcdefghijklmnopqrst", k=n))
        u = t[: n // 2] + "#".join(t[n // 2 : n // 2 + 3]) .replace("#", "zz") + t[n // 2 + 3 :]
        p, q = fingerprints(*canon.flatten([t, u]))
        j = len(pieces(t) & pieces(u)) / len(pieces(t) | pieces(u))
        assert abs(np.bitwise_count(p ^ q).sum() / BITS - (1 - j) / 2) < 0.09
    same = fingerprints(*canon.flatten([t, t.upper(), "x"]))
    assert (same[0] == same[1]).all() and len(same[2]) == BITS // 8


def test_groups(spark):
    t = "a text that is copied with a small change now and then, and long enough for that not to matter much at all"
    rows = [(5, t), (9, t.upper()), (6, t.replace("small", "tiny")), (7, t.replace("small", "tiny").replace("much", "a lot")), (8, "something else " * 9), (None, t)]
    got = {r.row_id: (r.group_id, r.record) for r in near_duplicate_groups(spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert got == {5: (5, 5), 9: (5, 5), 6: (5, 6), 7: (5, 7)}
    assert near_duplicate_groups(spark.createDataFrame([], "row_id long, text string")).count() == 0

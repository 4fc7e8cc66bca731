"""Subjects of made-up documents with known shares."""

import pickle
import itertools
import random
from collections import Counter

from lodeflow.llm import subjects
from lodeflow.llm.subjects import Cutter, all_terms, fit_rules, labelled_documents, subject_areas

TERMS = {"cooking": ["高汤", "葱油", "平底锅", "腌料", "skillet", "marinade"], "law": ["法庭", "违约金", "起诉状", "仲裁条款", "court", "pleading"], "sport": ["守门员", "前锋", "短跑", "接力棒", "goalkeeper", "sprint"]}


def sentence(rng, s):
    a, b = rng.sample(TERMS[s][:4], 2)
    return rng.choice([f"编辑还提到，使用{a}之前最好检查{b}，否则会受到影响。", f"很多人以为{a}比{b}更重要，其实早就说明了。"])


def document(rng, shares):
    out = [sentence(rng, s) for s, n in shares.items() for _ in range(n)]
    rng.shuffle(out)
    return "".join(out)


def test_subjects(spark):
    rng = random.Random(2)
    docs, labels, truth = [], [], {}
    for i in range(300):
        s = list(TERMS)
        rng.shuffle(s)
        shares = rng.choice([{s[0]: 12}, {s[0]: 11, s[1]: 1}, {s[0]: 6, s[1]: 6}])
        docs.append((i, document(rng, shares)))
        truth[i] = {k for k, n in shares.items() if n > 2}
        if i < 120:
            labels += [(i, k.upper() if i % 9 == 0 else k) for k in truth[i]]
    labels += [(0, None), (1, "nothing"), (2, labels[2][1]), (9999, "law"), (None, "law")]
    docs += [(1000, None), (1001, ""), (1002, "  "), (1003, "高汤 " * 80), (1004, "没有任何相关内容的一句话。"), (None, "法庭"), (5, docs[5][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, subject string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    sub = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    got = {}
    rows = subject_areas(d, lab, sub).collect()
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(rows) == sum(map(len, got.values()))
    right = sum(got.get(i) == t for i, t in truth.items() if i >= 120)
    assert right >= 0.97 * 180 and not {1000, 1001, 1002, 1003, 1004, None} & set(got)
    assert subject_areas(d, lab.where("false"), sub).count() == 0
    assert subject_areas(d.where("false"), lab, sub).count() == 0
    few = labelled_documents(d, lab, sub, limit=5)
    assert few.count() <= 5 and fit_rules(few).share > 0


def test_cutter():
    cut = pickle.loads(pickle.dumps(Cutter(["平底锅", "底锅", "锅里", "night train", "train", "night"])))
    sizes, found = cut("平底锅里。The night train. A train at night\nnight")
    assert found == [["平底锅"], ["night train"], ["train", "night"], ["night"]] and sizes[0] == 4
    assert cut("") == ([0], [[]])
    assert {"平底", "平底锅", "night", "night train"} <= all_terms("平底锅 night train")


def test_patterns_against_all_subsets(spark):
    """Patterns of one and two terms are those of all subsets; a long sentence repeated often costs its pairs only."""
    rng = random.Random(3)
    rows = [[*sorted(rng.sample([f"t{k}" for k in range(12)], rng.randint(1, 6))), "=" + rng.choice("xy")] for _ in range(200)]
    rows += [[*sorted(f"u{k:02d}" for k in range(40)), "=x"]] * 10
    df = spark.createDataFrame([(r,) for r in rows], "items array<string>")
    one, two = Counter(), Counter()
    for *terms, s in rows:
        one.update((a, s) for a in terms)
        two.update((a, b, s) for a, b in itertools.combinations(terms, 2))
    assert {(r.a, r.s): r.n for r in subjects.grown_once(df).collect()} == one
    want = {}
    for (a, b, s), n in two.items():
        total = sum(two[a, b, x] for x in ("=x", "=y"))
        if n >= subjects.TERM_SENTENCES and n >= subjects.CONFIDENCE * total:
            want[a, b] = (s, n, total)
    assert {(r.a, r.b): (r.s, r.n, r.total) for r in subjects.grown_twice(df).collect()} == want

"""Corpus operators against plain loops and literal vectors."""

import random

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeflow.functions import formulas
from lodeflow.operators import chat, dedup, evals, packing, preference, profile, skew
from lodeflow.operators.graph import components
from lodeflow.operators.order import ranks
from lodeflow.operators.tokenizers import ByteTokenizer, decode_ids, encode_texts
from lodeflow.plans.config import load_config, merged
from lodeflow.schemas import CONVERSATION, MESSAGE


def msg(role, content, **more):
    return (role, content, more.get("reasoning"), more.get("tools"), more.get("calls"))


def test_pipeline_vector(spark):
    texts = ["今天天气很好。", "今天天气很好。", "机器学习模型需要大量高质量的训练数据。" * 5, "短"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = {r.outcome: r.n_rows for r in dedup.outcome_counts(dedup.outcomes(df, min_chars=3)).collect()}
    assert got == {"kept": 2, "exact_dup": 1, "too_short": 1}


def test_outcomes_edge_cases(spark):
    same = "x" * 40
    rows = [(5, same), (3, same), (3, same), (None, same), (9, None), (1, ""), (2, "y" * 100_001)]
    got = sorted((r.id, r.outcome) for r in dedup.outcomes(spark.createDataFrame(rows, "row_id long, text string")).collect())
    assert got == [(1, "too_short"), (2, "too_long"), (3, "kept"), (3, "kept"), (5, "exact_dup")]
    empty = spark.createDataFrame([], "row_id long, text string, id string, digest string")
    assert dedup.outcomes(empty).count() == 0


def test_hot_text(spark):
    rows = [(i, "hot text " * 10 if i % 3 else f"text number {i} " * 5) for i in range(3000)]
    got = {r.outcome: r.n_rows for r in dedup.outcome_counts(dedup.outcomes(spark.createDataFrame(rows, "row_id long, text string"))).collect()}
    assert got == {"kept": 1001, "exact_dup": 1999}


def test_join_hot_split(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else str(i)) for i in range(200)] + [(999, None)], "id int, k string")
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    got = skew.join_hot_split(rows, groups, ["k"], "n", 200)
    assert got.count() == 200 and got.where("k = 'a'").select("n").distinct().first().n == 100


def test_ranks(spark):
    values = random.Random(1).sample(range(10_000), 500)
    got = ranks(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), ["v"], "r").collect()
    assert {r.v: r.r for r in got} == {v: i for i, v in enumerate(sorted(values))}


def test_sketch_similarity():
    a = "机器学习模型需要大量高质量的训练数据。" * 4
    assert dedup.similarity(a, a) == 1.0
    assert dedup.similarity(a, "今天的晚饭是西红柿炒鸡蛋和米饭，味道不错。" * 4) < 0.3
    assert dedup.greedy_keep(["same words here", "same  words here"]) == [0]
    assert dedup.greedy_keep([]) == []


def adjacent_loop(ids, signs, threshold=0.8):
    """The rule, row by row: per band sort by key, compare neighbours, drop the later."""
    drops = set()
    rows = dedup.HASHES // dedup.BANDS
    for b in range(dedup.BANDS):
        keyed = sorted((tuple(s[r * dedup.BANDS + b] for r in range(rows)), i, tuple(s)) for i, s in zip(ids, signs))
        for (k1, _, s1), (k2, i2, s2) in zip(keyed, keyed[1:]):
            if k1 == k2 and sum(x == y for x, y in zip(s1, s2)) >= threshold * dedup.HASHES:
                drops.add(i2)
    return drops


@pytest.mark.parametrize("parts", [1, 5])
def test_near_duplicates_equal_loop(spark, parts):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    for i in range(60):
        t = rng.choice(texts[:60]).split()
        for _ in range(rng.choice([0, 1, 2])):
            t[rng.randrange(60)] = "zz"
        texts.append(" ".join(t))
    texts += ["hot " * 30] * 30
    signs = dedup.sketch_texts(texts)
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(signs)], "id long, sig array<long>").repartition(parts)
    got = {r.id for r in dedup.near_duplicate_drops(df).collect()}
    assert got == adjacent_loop(range(len(texts)), signs.tolist()) and len(got) > 40


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing


def pack_loop(docs, n, eos, pad):
    """Straight from the rule: fill a buffer, seal it when a place or none is left."""
    out, ids, ds = [], [], []

    def seal():
        out.append((ids + [pad] * (n - len(ids)), ds + [-1] * (n - len(ds))))

    for d, doc in enumerate(docs):
        rest = list(doc)
        while rest:
            if n - len(ids) <= 1:
                seal()
                ids, ds = [], []
            free = n - len(ids)
            take, rest = rest[: free - 1], rest[free - 1 :]
            ids = ids + take + ([] if rest else [eos])
            ds = ds + [d] * (len(take) + (not rest))
            if rest:
                seal()
                ids, ds = [], []
    if ids:
        seal()
    return out


def packed(spark, docs, n, **kw):
    df = spark.createDataFrame([(i * 7, d) for i, d in enumerate(docs)], "id long, ids array<int>")
    rows = packing.pack(df.repartition(3), n, 0, **kw).orderBy("shard", "seq").collect()
    return [(r.input_ids, r.document_ids) for r in rows]


def test_pack_vectors(spark):
    assert packed(spark, [[1, 2, 3], [4, 5], [6]], 9) == [([1, 2, 3, 0, 4, 5, 0, 6, 0], [0, 0, 0, 0, 1, 1, 1, 2, 2])]
    assert packed(spark, [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]], 6) == [([1, 2, 3, 4, 5, 0], [0] * 6), ([6, 7, 8, 9, 10, 0], [1] * 6)]
    assert packed(spark, [[1, 2, 3, 4, 5]], 4) == [([1, 2, 3, -1], [0, 0, 0, -1]), ([4, 5, 0, -1], [0, 0, 0, -1])]
    assert packed(spark, [[], [7]], 4) == [([7, 0, -1, -1], [1, 1, -1, -1])]
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, [1])], "id long, ids array<int>"), 1, 0)


def test_pack_equals_loop(spark):
    rng = random.Random(5)
    for n in (2, 3, 7, 16):
        docs = [[rng.randint(1, 99) for _ in range(rng.choice([0, 1, 2, n - 1, n, 3 * n, rng.randint(0, 40)]))] for _ in range(30)]
        assert packed(spark, docs, n) == pack_loop(docs, n, 0, -1)


def test_pack_shards_and_labels(spark):
    df = spark.createDataFrame([(i, [i + 1] * 3, [-100, i + 1, i + 1]) for i in range(5)], "id long, ids array<int>, labels array<int>")
    rows = packing.pack(df, 8, 0, labels_col="labels", chunk=2).orderBy("shard", "seq").collect()
    assert [r.document_ids[0] for r in rows] == [0, 0, 0] and len({r.shard for r in rows}) == 3
    assert rows[0].labels == [-100, 1, 1, -100, -100, 2, 2, -100]
    counts = packing.packed_counts(packing.pack(df, 8, 0)).first()
    assert (counts.slots, counts.tokens) == (24, 20)


def test_model_inputs_and_mask(spark):
    df = spark.createDataFrame([(1, [5, 6])], "id long, ids array<int>")
    r = packing.model_inputs(packing.pack(df, 4, 0)).first()
    assert r.input_ids == [5, 6, 0, 0] and r.labels == [5, 6, 0, -100]
    assert packing.may_attend([0, 0, 1]) == [[True, False, False], [True, True, False], [False, False, True]]


def test_byte_tokenizer(spark):
    tok = ByteTokenizer()
    text = "<|im_start|>你好 é\n<think>x</think><|endoftext|>"
    ids, offsets = tok.encode_offsets(text)
    assert tok.decode(ids) == text and tok.encode(text) == ids and len(ids) == len(offsets) and tok.encode("<|endoftext|>") == [tok.eos_id]
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, clean string")
    got = {r.id: r.text for r in decode_ids(encode_texts(df, tok), tok).collect()}
    assert got == {1: text, 2: "", 3: ""}


# ---- chat and preference


def test_chat_and_labels(spark):
    rows = [([msg("system", "s", tools='[{"a": 1}]'), msg("user", "hi"), msg("assistant", "yo", reasoning=" r ", calls='{"n": 1}'), msg("tool", "42")],), ([],), (None,)]
    df = spark.createDataFrame(rows, CONVERSATION)
    got = df.select(chat.chat_text(F.col("conversations"), chat.lifted_tools(F.col("conversations"))).alias("x")).collect()
    assert got[0].x == (
        '<|im_start|>system\n# Tools\n[{"a": 1}]<|im_end|>\n<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n'
        '<|im_start|>assistant\n<think>\nr\n</think>\n\nyo\n<tool_call>\n{"n": 1}\n</tool_call><|im_end|>\n<|im_start|>user\n<tool_response>\n42\n</tool_response><|im_end|>\n'
    )
    assert got[2].x is None
    tok = ByteTokenizer()
    ids, labels = chat.label_tokens("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nbc<|im_end|>\n", tok, 100)
    assert [x for x in labels if x != -100] == tok.encode("bc")
    assert len(chat.label_tokens("x" * 50, tok, 10)[0]) == 10
    assert [x for x in chat.label_tokens("<|im_start|>assistant\nb<|im_end|>", tok, 100, include_end=True)[1] if x != -100] == tok.encode("b<|im_end|>")


def test_drop_final_empty_assistant(spark):
    rows = [([msg("user", "a"), msg("assistant", " ")],), ([msg("user", "a"), msg("assistant", "b")],), ([],), ([msg("assistant", None)],)]
    got = spark.createDataFrame(rows, CONVERSATION).select(F.size(chat.drop_final_empty_assistant(F.col("conversations"))).alias("n")).collect()
    assert [r.n for r in got] == [1, 2, 0, 0]


def test_best_and_worst(spark):
    rows = [(1, 0, "a", 1.0), (1, 1, "b", 1.0), (1, 2, "c", 0.5), (2, 0, "a", 1.0), (2, 1, "b", 1.0), (2, 2, "c", 1.0), (3, 0, "x", None)]
    got = {r.idx: (r.chosen, r.rejected) for r in preference.best_and_worst(spark.createDataFrame(rows, "idx long, seq long, text string, score double")).collect()}
    assert got == {1: ("a", "c"), 2: ("a", "c"), 3: ("x", "x")}


def test_advantages(spark):
    rows = [(1, 1.0), (1, 2.0), (1, 3.0), (2, 4.0), (2, 4.0), (3, 1.0)]
    got = preference.advantages(spark.createDataFrame(rows, "idx long, reward double")).collect()
    by = {k: [r.advantage for r in got if r.idx == k] for k in (1, 2, 3)}
    assert sum(by[1]) == pytest.approx(0) and max(by[1]) == pytest.approx(1, abs=1e-5) and by[2] == [0, 0] and by[3] == [None]


def test_pairs_and_prompts(spark):
    schema = "pair_id long, chosen array<struct<role:string,content:string,reasoning_content:string,tools:string,tool_calls:string>>, rejected array<struct<role:string,content:string,reasoning_content:string,tools:string,tool_calls:string>>"
    good = ([msg("user", "q"), msg("assistant", "a")], [msg("user", "q"), msg("assistant", "b")])
    df = spark.createDataFrame([(1, *good), (2, None, good[1]), (3, good[0][:1], good[1])], schema)
    got = preference.preference_pairs(df).collect()
    assert [r.id for r in got] == [1] and got[0].same_prompt and got[0].prompt.endswith("assistant\n")
    agents = spark.createDataFrame([(1, good[0], ["5"]), (2, good[0], []), (3, good[0], None)], f"task_id long, {schema.split(', ', 1)[1].rsplit(', rejected', 1)[0].replace('chosen', 'conversations')}, gt array<string>")
    assert [(r.id, r.expect_tool) for r in preference.agent_prompts(agents).collect()] == [(1, False)]
    assert MESSAGE.fieldNames()[0] == "role"


# ---- profile, evaluation, formulas


def test_rank_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in range(0, 100, 10)], "v int").withColumn("g", F.lit(None).cast("string"))
    r = profile.length_stats(df, F.col("v"), ["g"]).first()
    assert (r.n, r.median, r.p90, r.p99, r.min_chars, r.max_chars, r.mean_chars) == (10, 50, 90, 90, 0, 90, 45)


def test_top_counts_and_sample(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id int, k string")
    assert [(r.key, r.n) for r in profile.top_counts(df, F.col("k"), F.col("id"), 2).collect()] == [("b", 2), ("a", 2)]
    assert profile.uniform_sample(df, "id", 3).count() == 3


def test_eval_summaries(spark):
    df = spark.createDataFrame([("<think>ab</think>x", "xyz"), ("ab", "")], "a string, b string")
    r = evals.thinking_summary(df, F.col("a"), F.col("b")).first()
    assert r.n == 2 and r.think_trigger_rate == 0.5 and r.mean_length_ratio == pytest.approx(((18 - 3) / 3 + 2) / 2)
    none = evals.thinking_summary(df.where("false"), F.col("a"), F.col("b")).first()
    assert none.n == 0 and none.think_trigger_rate == 0
    assert evals.judge_mean(spark.createDataFrame([(None,), (4.0,)], "score double")).first().judge_mean == 2
    gate = evals.quality_gate(spark.createDataFrame([(0.3, 1.0, 0.55)], "think_trigger_rate double, mean_length_ratio double, rep4_mean double"), spark.createDataFrame([(3.999, 5)], "judge_mean double, judge_n int")).first()
    assert gate.pass_think and gate.pass_rep and not gate.pass_judge and not gate.pass_all and gate.judge_mean == 4.0


def test_choice_layouts(spark):
    row = spark.createDataFrame([("q", "1", "2", "3", "4", "C")], "Question string, A string, B string, C string, D string, Answer string")
    r = evals.choice_items(row, "cmmlu").first()
    assert r.gold == 2 and r.choices == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        evals.choice_items(row, "other")


def test_losses(spark):
    df = spark.createDataFrame([([0.0], [2.0], 1.0, [True])], "old array<double>, new array<double>, a double, m array<boolean>")
    c = F.col
    r = df.select(formulas.clipped_ratio_loss(c("old"), c("new"), c("a")).alias("s"), formulas.clipped_token_terms(c("old"), c("new"), c("a"), c("m")).alias("t"), formulas.preference_loss(c("new"), c("old")).alias("p")).first()
    assert r.s == pytest.approx(-1.28) and r.t.loss == pytest.approx(-1.28) and r.p == pytest.approx(np.log1p(np.exp(-(2 * 2 - 1.2))))
    steps = spark.range(1000, 5501, 500).select(formulas.cosine_resume_rate(F.col("id"), 1000, 5500, 1.0, 0.1).alias("x")).collect()
    values = [r.x for r in steps]
    assert values[0] == 1.0 and values[-1] == pytest.approx(0.1) and values == sorted(values, reverse=True)


def test_interrupted_rate(spark):
    names = ("sequences", "held_out", "batch", "workers", "accumulate", "epochs", "warmup_share", "rate", "floor")
    run = F.struct(*(F.lit(v).alias(k) for k, v in zip(names, (1000, 0, 10, 1, 1, 1, 0.1, 1.0, 0.1))))
    got = {r.id: r.x for r in spark.range(101).select("id", formulas.interrupted_rate(run, F.col("id")).alias("x")).collect()}
    assert got[0] == pytest.approx(0.1) and got[9] == 1.0 and got[100] == pytest.approx(0.1) and got[55] == pytest.approx(0.55)


def test_report(spark):
    import json

    df = spark.createDataFrame([([msg("user", "ab"), msg("assistant", "c", reasoning="r", calls='[{"name": "f"}]')],), (None,)], CONVERSATION)
    rows = profile.report_rows(df, F.lit("x tool_call"))
    got = json.loads(profile.report(rows).first().value)
    assert got["count"]["records"] == 2 and got["role"] == {"assistant": 1, "user": 1} and got["char_len"]["total_chars"] == 3 and got["reasoning"] == {"messages": 1, "records": 1}
    assert got["key"] == {"conversations": 1} and got["shape"] == {"[{name:str}]": 1} and got["marker"] == {"tool_call": 1}
    assert json.loads(profile.report(profile.report_rows(df.where("false"), F.lit("x"))).first().value)["count"]["records"] == 0


def test_nucleus(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.5, 0.3, 0.15, 0.05])], "g int, i int, p double")
    kept = formulas.nucleus(df, ["g"], "p", [F.col("i")], 0.6).orderBy("i").collect()
    assert [r.i for r in kept] == [0, 1] and sum(r.kept_prob for r in kept) == pytest.approx(1)


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 1}')
    (tmp_path / "child.json").write_text('{"extends": "base.json", "a": {"y": 3}}')
    assert load_config(tmp_path / "child.json") == {"a": {"x": 1, "y": 3}, "b": 1}
    assert merged({"a": [1]}, {"a": [2]}) == {"a": [2]}


def test_registered_corpus_queries_drop_near_duplicates(spark, tmp_path):
    from lodeflow.plans import catalog

    base = " ".join(f"word{k} stands here" for k in range(60))
    rows = [(1, base), (2, base + " once"), (3, base), (4, "short"), (5, " ".join(f"{k * 7919} other" for k in range(60)))]
    spark.createDataFrame(rows, "row_id long, text string").write.parquet(str(tmp_path / "pretrain_t2t.parquet"))
    run = {n: catalog.queries()[n](spark, str(tmp_path)) for n in ("corpus_outcomes", "corpus_token_counts", "corpus_counters", "token_counts")}
    assert {r.outcome: r.n_rows for r in run["corpus_outcomes"].collect()} == {"kept": 2, "near_dup": 1, "exact_dup": 1, "too_short": 1}
    assert sorted(r.row_id for r in run["corpus_token_counts"].collect()) == [1, 5]
    assert sorted(r.row_id for r in run["token_counts"].collect()) == [1, 2, 5]
    assert run["corpus_counters"].first().tokens == len(rows[0][1]) + len(rows[4][1]) + 2  # each with an end mark


def test_running_sums_and_temporaries(spark):
    from lodeflow.operators.order import running
    from lodeflow.session import materialize, temporaries, work_root

    df = spark.createDataFrame([(k, 10 - k) for k in range(10)] + [(3, 7)], "id long, v long").repartition(3)
    got = sorted((r.id, r.s) for r in running(df, ["id", "v"], "v", "s").collect())
    want, total = [], 0
    for k, v in sorted([(k, 10 - k) for k in range(10)] + [(3, 7)]):
        want.append((k, total))
        total += v
    assert got == want
    with temporaries(spark):
        path = materialize(df, "gone").inputFiles()[0]
        assert materialize(df, "gone-too").count() == 11
    assert work_root(spark) in path and not os.path.exists(path.removeprefix("file://"))

"""Scoring model outputs: benchmarks, thinking, sample metrics, quality gates. Generators plug in as columns or UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.text import extract_think, last_number, mc_answer, mc_prompt, preview, repetition
from lodeflow.functions.formulas import perplexity

#: Least thinking rate, most repetition and least judge mean that pass (fixed values).
GATES = (0.3, 0.55, 4.0)
HIT = 0.9


def choice_items(table: DataFrame, kind: str) -> DataFrame:
    """(``question``, ``choices``, ``gold`` from 0) of the three layouts of multiple-choice tests."""
    if kind == "mmlu":
        return table.select("question", "choices", F.col("answer").cast("int").alias("gold"))
    names = {"cmmlu": ("Question", "Answer"), "ceval": ("question", "answer")}
    if kind not in names:
        raise ValueError(f"unknown layout {kind}")
    q, a = names[kind]
    return table.select(F.col(q).alias("question"), F.array("A", "B", "C", "D").alias("choices"), (F.ascii(a) - F.lit(ord("A"))).alias("gold"))


def choice_prompts(items: DataFrame) -> DataFrame:
    return items.withColumn("prompt", mc_prompt(F.col("question"), F.col("choices")))


def choice_hits(items: DataFrame, output: Column, gold: Column) -> DataFrame:
    """Adds ``got`` and ``hit``; an output without a letter is no hit."""
    return items.withColumn("got", mc_answer(output)).withColumn("hit", F.coalesce(F.ascii("got") - F.lit(ord("A")) == gold, F.lit(False)))


def number_hits(items: DataFrame, output: Column, answer: Column) -> DataFrame:
    close = F.abs(last_number(output) - last_number(answer)) < 1e-6
    return items.withColumn("hit", F.coalesce(close, F.lit(False)))


def accuracy(hits: DataFrame, by: list[str]) -> DataFrame:
    """(``by``..., ``acc``, ``n``); one row with 0 and 0 if nothing is there and ``by`` is empty."""
    acc = F.sum(F.col("hit").cast("double")) / F.greatest(F.count("*"), F.lit(1))
    return hits.groupBy(*by).agg(F.coalesce(acc, F.lit(0.0)).alias("acc"), F.count("*").alias("n"))


def eval_records(samples: DataFrame, kind: Column, prompt: Column, output: Column) -> DataFrame:
    """(``kind``, ``prompt``, ``output``, ``n_chars``, ``think_chars``, ``rep4``) and the other columns."""
    rows = samples.withColumns({"kind": kind, "prompt": preview(prompt), "output": output})
    return rows.withColumns({"n_chars": F.length("output"), "think_chars": F.length(extract_think(F.col("output"))), "rep4": F.bround(repetition(F.col("output")), 4)})


def thinking_summary(pairs: DataFrame, on: Column, off: Column) -> DataFrame:
    """One row: ``n``, ``think_trigger_rate``, ``think_share_of_on``, ``mean_length_ratio`` of (on - off) / off lengths."""
    think, a, b = F.length(extract_think(on)), F.length(on), F.length(off)
    n = F.greatest(F.count("*"), F.lit(1))
    zero = F.lit(0.0)
    return pairs.agg(
        F.count("*").alias("n"),
        (F.coalesce(F.sum(F.when(think > 0, 1.0).otherwise(0.0)), zero) / n).alias("think_trigger_rate"),
        (F.coalesce(F.sum(think), F.lit(0)) / F.greatest(F.coalesce(F.sum(a), F.lit(0)), F.lit(1))).alias("think_share_of_on"),
        (F.coalesce(F.sum((a - b) / F.greatest(b, F.lit(1))), zero) / n).alias("mean_length_ratio"),
    )


def sample_metrics(records: DataFrame, key: str) -> DataFrame:
    """One row of rounded metrics. Thinking on and off are matched by ``key``; repetition is over all kinds."""
    per = records.groupBy(key).agg(
        F.sum(F.when(F.col("kind") == "thinking_on", F.col("n_chars"))).alias("on_len"),
        F.sum(F.when(F.col("kind") == "thinking_off", F.col("n_chars"))).alias("off_len"),
        F.sum(F.when((F.col("kind") == "thinking_on") & (F.col("think_chars") > 0), 1).otherwise(0)).alias("triggered"),
        F.count_if(F.col("kind") == "thinking_on").alias("on_n"), F.sum("rep4").alias("rep"), F.count("*").alias("n"),
    )
    on_n = F.greatest(F.sum("on_n"), F.lit(1))
    ratio = F.when(F.col("on_len").isNotNull() & F.col("off_len").isNotNull(), F.col("on_len") / F.greatest(F.col("off_len"), F.lit(1)))
    return per.agg(
        F.bround(F.sum("triggered") / on_n, 4).alias("think_trigger_rate"),
        F.bround(F.coalesce(F.sum(ratio), F.lit(0.0)) / on_n, 4).alias("mean_length_ratio"),
        F.bround(F.sum("rep") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("rep4_mean"),
    )


def judge_mean(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: mean score with a missing one as 0, 0 without any, and how many."""
    return scores.agg(F.coalesce(F.avg(F.coalesce(score, F.lit(0.0))), F.lit(0.0)).alias("judge_mean"), F.count("*").alias("judge_n"))


def quality_gate(metrics: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of metrics and of whether each, and all, pass. Both inputs have one row."""
    think, rep, judge = GATES
    row = metrics.crossJoin(F.broadcast(judged))
    row = row.withColumns({"pass_think": F.col("think_trigger_rate") >= think, "pass_rep": F.col("rep4_mean") <= rep, "pass_judge": F.col("judge_mean") >= judge})
    return row.withColumn("pass_all", F.col("pass_think") & F.col("pass_rep") & F.col("pass_judge")).withColumn("judge_mean", F.bround("judge_mean", 2))


def agent_summary(rewards: DataFrame, reward: str = "reward") -> DataFrame:
    return rewards.agg(F.avg(reward).alias("mean_reward"), F.avg((F.col(reward) > HIT).cast("double")).alias("gt_hit"), F.count("*").alias("n"))


def continuable(packed: DataFrame, prefix: int = 128, more: int = 32) -> DataFrame:
    """Prefixes of the sequences with enough supervised places to be continued."""
    rows = packed.where(F.size(F.filter("labels", lambda x: x != -100)) >= prefix + more)
    return rows.withColumn("prefix_ids", F.slice("input_ids", 1, prefix))


def loss_perplexity(losses: DataFrame, loss: str, tokens: str) -> DataFrame:
    return losses.agg(perplexity(F.col(loss), F.col(tokens)).alias("ppl"))

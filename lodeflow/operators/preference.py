"""Preference pairs, prompt sets, and what is computed over groups of scored samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.text import strip
from lodeflow.operators.batches import sized_slices
from lodeflow.operators.chat import chat_text, drop_final_empty_assistant, lifted_tools
from lodeflow.operators.tokenizers import Tokenizer


def preference_pairs(table: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(``id``, ``prompt``, ``chosen``, ``rejected`` as texts, ``same_prompt``) of pairs with two messages on either side.

    The prompt is that of the chosen side; ``same_prompt`` tells whether the other side has the same.
    """
    rows = table.where((F.size(chosen) >= 2) & (F.size(rejected) >= 2))
    head = lambda c: F.slice(F.col(c), F.lit(1), F.size(c) - 1)
    same = F.to_json(F.struct(head(chosen).alias("m"))) == F.to_json(F.struct(head(rejected).alias("m")))
    return rows.select(
        F.col(id_col).alias("id"),
        chat_text(head(chosen), generation_prompt=True).alias("prompt"),
        chat_text(F.col(chosen)).alias("chosen"),
        chat_text(F.col(rejected)).alias("rejected"),
        same.alias("same_prompt"),
    )


def token_pairs(pairs: DataFrame, tokenizer: Tokenizer, max_len: int | None = None) -> DataFrame:
    """(``id``, ``prompt``, ``chosen``, ``rejected`` as token ids, ``prompt_len``) of ``preference_pairs``.

    Pairs of which a side is longer than ``max_len`` are left out; the prompt's length isn't looked at.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = ["prompt", "chosen", "rejected"]
        for batch in batches:
            for part in sized_slices(batch, sides):
                ids = [pa.array([sent.value.encode(x) for x in part.column(c).to_pylist()], pa.list_(pa.int32())) for c in sides]
                yield pa.RecordBatch.from_arrays([part.column("id"), *ids], ["id", *sides])

    kind = pairs.schema["id"].dataType.simpleString()
    found = pairs.select("id", "prompt", "chosen", "rejected").mapInArrow(run, f"id {kind}, prompt ARRAY<INT>, chosen ARRAY<INT>, rejected ARRAY<INT>")
    found = found.withColumn("prompt_len", F.size("prompt"))
    return found if max_len is None else fitting(found, ["chosen", "rejected"], max_len)


def fitting(table: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Rows whose token arrays all have at most ``most`` ids."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.size(c) <= most)
    return table.where(keep)


def judge_context(messages: Column) -> Column:
    """``role: content`` of all messages but the last, one per line, stripped."""
    head = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    lines = F.transform(head, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return strip(F.array_join(lines, "\n"))


def rlaif_prompts(table: DataFrame, id_col: str = "prompt_id", messages_col: str = "conversations") -> DataFrame:
    """(``id``, ``text``: the prompt with thinking opened, ``question``: the judge's context)."""
    rows = table.where(F.col(messages_col).isNotNull())
    text = chat_text(drop_final_empty_assistant(F.col(messages_col)), generation_prompt=True, thinking=True)
    return rows.select(F.col(id_col).alias("id"), text.alias("text"), judge_context(F.col(messages_col)).alias("question"))


def agent_prompts(table: DataFrame, id_col: str = "task_id", messages_col: str = "conversations", gt_col: str = "gt") -> DataFrame:
    """(``id``, ``text``, ``gt``, ``expect_tool``) of the tasks with a ground truth."""
    rows = table.where(F.col(messages_col).isNotNull() & (F.size(gt_col) > 0))
    messages = drop_final_empty_assistant(F.col(messages_col))
    tools = lifted_tools(messages)
    text = chat_text(messages, tools, generation_prompt=True, thinking=True)
    return rows.select(F.col(id_col).alias("id"), text.alias("text"), F.transform(gt_col, lambda x: x.cast("string")).alias("gt"), tools.isNotNull().alias("expect_tool"))


def with_questions(samples: DataFrame, questions: DataFrame, idx: str = "idx", question: str = "question") -> DataFrame:
    """Each sample with its question; ``prompt_<idx>`` where there is none."""
    joined = samples.join(questions.select(idx, question), idx, "left")
    return joined.withColumn(question, F.coalesce(question, F.concat(F.lit("prompt_"), F.col(idx))))


def best_and_worst(samples: DataFrame, idx: str = "idx", seq: str = "seq", text: str = "text", score: str = "score") -> DataFrame:
    """(``idx``, ``chosen``, ``rejected``, their scores, ``n``): of equal scores the earliest is best and the latest worst.

    A missing score counts 0; a single sample is both. Two-phase aggregation, no group is gathered.
    """
    points = F.coalesce(F.col(score), F.lit(0.0))
    rank = F.struct(points, -F.col(seq))
    return samples.groupBy(idx).agg(
        F.max_by(text, rank).alias("chosen"), F.min_by(text, rank).alias("rejected"), F.max(points).alias("best"), F.min(points).alias("worst"), F.count("*").alias("n")
    )


def pairs_with_prompts(found: DataFrame, prompts: DataFrame, idx: str = "idx") -> DataFrame:
    """Best and worst texts with the prompt they answer, by index. prompts: (``idx``, ``prompt_ids``, ``prompt_len``)."""
    return found.join(prompts.select(idx, F.slice("prompt_ids", F.lit(1), F.col("prompt_len")).alias("prompt_ids")), idx)


def samples_with_truth(samples: DataFrame, truths: DataFrame, idx: str = "idx") -> DataFrame:
    """Samples with the ground truth of their task. truths: (``idx``, ``gt``, ``expect_tool``)."""
    return samples.join(truths.select(idx, "gt", "expect_tool"), idx)


def advantages(samples: DataFrame, idx: str = "idx", reward: str = "reward", eps: float = 1e-6) -> DataFrame:
    """Adds ``advantage``: distance from the group's mean in sample standard deviations; NULL in a group of one.

    Means come from an aggregation joined back, not from a window that would hold a group in one task.
    """
    moments = samples.groupBy(idx).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std"))
    joined = samples.join(moments, idx)
    return joined.withColumn("advantage", (F.col(reward) - F.col("_mean")) / (F.col("_std") + eps)).drop("_mean", "_std")


def expanded(prompts: DataFrame, samples: int, seq: str = "seq") -> DataFrame:
    """Each prompt once for every sample to be drawn."""
    return prompts.withColumn(seq, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def worker_share(table: DataFrame, idx: str, rank: int, world: int) -> DataFrame:
    return table.where(F.pmod(F.col(idx), F.lit(world)) == rank)


def tail_split(table: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``is_val``: whether a row is one of the last n by ``order``, which is unique. The n largest are found by top-n,
    not by sorting the table."""
    last = table.select(order).orderBy(F.col(order).desc()).limit(n)
    return table.join(last.withColumn("_v", F.lit(True)), order, "left").withColumn("is_val", F.coalesce("_v", F.lit(False))).drop("_v")


def keep_last(table: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """The k latest rows of each group."""
    w = Window.partitionBy(*group).orderBy(F.col(order).desc())
    return table.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def first_rows(table: DataFrame, row_id: str, n: int) -> DataFrame:
    """The rows with the first n ordinals, the same in every run; no sort, and the condition reaches the scan."""
    return table.where(F.col(row_id) < n)


def first_of_kind(records: DataFrame, kind: str, order: str, n: int) -> DataFrame:
    """The first n records of a kind, by top-n."""
    return records.where(F.col("kind") == kind).orderBy(order).limit(n)

"""Corpus profiling: lengths, counts, shapes. Quantiles are exact and read off a histogram of lengths, so no group of
values is gathered or sorted in one task."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.text import content_length, json_shape, strip, tool_marker

QUANTILES = {"median": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def length_stats(table: DataFrame, length: Column, by: list[str]) -> DataFrame:
    """(``by``..., ``n``, ``total_chars``, ``mean_chars``, quantiles, ``min_chars``, ``max_chars``).

    A quantile p is the value at place floor(p n), from 0, of the sorted values. Rows without a length don't count.
    """
    hist = table.select(*by, length.cast("bigint").alias("v")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("c"))
    keys = [F.coalesce(F.col(b).cast("string"), F.lit("\u0000")) for b in by]
    part = Window.partitionBy(*keys)
    upto = part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = hist.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(part))
    place = {name: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))) for name, p in QUANTILES.items()}
    return placed.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total_chars"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_chars"),
        *(F.min(F.when(F.col("upto") > at, F.col("v"))).alias(name) for name, at in place.items()),
        F.min("v").alias("min_chars"), F.max("v").alias("max_chars"),
    )


def top_counts(table: DataFrame, key: Column, first: Column, k: int, name: str = "key") -> DataFrame:
    """The k most frequent keys; of equal counts the one seen first by ``first``, then by name."""
    counts = table.select(key.alias(name), first.alias("_f")).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), F.min("_f").alias("_f"))
    return counts.orderBy(F.col("n").desc(), "_f", name).limit(k).drop("_f")


def role_counts(table: DataFrame, messages: str = "conversations") -> DataFrame:
    """(``role``, ``n`` messages)."""
    return table.select(F.explode(F.col(messages)["role"]).alias("role")).where("role IS NOT NULL").groupBy("role").agg(F.count("*").alias("n"))


def reasoning_counts(table: DataFrame, messages: str = "conversations") -> DataFrame:
    """One row: ``messages`` with reasoning, and ``records`` that have such a message."""
    with_it = F.size(F.filter(messages, lambda m: strip(F.coalesce(m["reasoning_content"], F.lit(""))) != ""))
    n = F.when(F.col(messages).isNotNull(), with_it).otherwise(0)
    return table.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("messages"), F.count_if(n > 0).alias("records"))


def marker_counts(table: DataFrame, raw: Column) -> DataFrame:
    """(``marker``, ``n``) of the records that hold one."""
    return table.select(tool_marker(raw).alias("marker")).where("marker IS NOT NULL").groupBy("marker").agg(F.count("*").alias("n"))


def shape_counts(table: DataFrame, raw: Column) -> DataFrame:
    """(``shape``, ``n``) of JSON texts."""
    return table.select(json_shape(raw).alias("shape")).where("shape IS NOT NULL").groupBy("shape").agg(F.count("*").alias("n"))


def conversation_profile(table: DataFrame, messages: str = "conversations") -> DataFrame:
    """Length statistics of whole conversations, one row."""
    return length_stats(table.where(F.col(messages).isNotNull()).withColumn("_all", F.lit("all")), content_length(F.col(messages)), ["_all"]).drop("_all")


def uniform_sample(table: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k rows, each as likely as any other, the same in every run: the smallest digests of the ids, found by top-k."""
    return table.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(k)


def report_rows(table: DataFrame, raw: Column, messages: str = "conversations") -> DataFrame:
    """(``section``, ``name``, ``value``) of a profile: records, keys, roles, reasoning, markers of tool use, shapes of the
    tool calls, lengths. Every section is an aggregate of a few rows."""
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    some = table.where(F.col(messages).isNotNull())
    keys = table.select(F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in table.columns)))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    calls = table.select(F.explode(messages).alias("m")).where("m.tool_calls IS NOT NULL").select("m.tool_calls")
    parts = [
        row(table.agg(F.count("*").alias("n")).withColumn("k", F.lit("records")), "count", "k", "n"),
        row(keys, "key", "key", "n"), row(role_counts(table, messages), "role", "role", "n"), row(marker_counts(some, raw), "marker", "marker", "n"),
        row(shape_counts(calls, F.col("tool_calls")), "shape", "shape", "n"),
        row(reasoning_counts(table, messages).unpivot([], ["messages", "records"], "k", "n"), "reasoning", "k", "n"),
    ]
    lengths = conversation_profile(table, messages)
    parts.append(row(lengths.select(*(F.col(c).cast("double") for c in lengths.columns)).unpivot([], lengths.columns, "k", "n"), "char_len", "k", "n"))
    return functools.reduce(DataFrame.unionByName, parts)


def report(rows: DataFrame) -> DataFrame:
    """One row of JSON of ``report_rows``: a mapping of each section. Sections are bounded, so it is a small document."""
    section = rows.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("m"))
    by_name = lambda a, b: F.when(a["section"] < b["section"], -1).when(a["section"] > b["section"], 1).otherwise(0)
    return section.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "m")), by_name))).alias("value"))

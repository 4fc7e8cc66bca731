"""The pN_ queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm import containers, encode, format_dups, leakage, near_dups, pair_defects, quality, subjects


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_dups.near_duplicate_pairs(_t(spark, sf_dir, "pretrain_t2t"))
    return pairs.selectExpr("a AS row_id_a", "b AS row_id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicate_groups(_t(spark, sf_dir, "pretrain_t2t"))


def _packed_texts(capacity: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = containers.text_lengths(_t(spark, sf_dir, "pretrain_t2t"), "row_id")
        return containers.pack_items(items, capacity).withColumnRenamed("id", "row_id")

    return run


def _packed_conversations(capacity: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = containers.conversation_lengths(_t(spark, sf_dir, "sft_t2t_mini"), "conv_id")
        return containers.pack_items(items, capacity).withColumnRenamed("id", "conv_id")

    return run


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(_t(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_t(spark, sf_dir, "pretrain_t2t"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_texts(_t(spark, sf_dir, "pretrain_t2t"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [(_t(spark, sf_dir, "sft_t2t_mini"), "conv_id", ["conversations"]), (_t(spark, sf_dir, "dpo"), "pair_id", ["chosen", "rejected"])]
    return pair_defects.defective_answers(sources)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.format_duplicate_pairs(_t(spark, sf_dir, "pretrain_t2t"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.collapse_format_duplicates(_t(spark, sf_dir, "pretrain_t2t"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked_items(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(*(_t(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p2_found": p2_found,
        "p2_scores": p2_scores,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_copies": p4_copies,
        "p5_texts_4096": _packed_texts(4096),
        "p5_texts_8192": _packed_texts(8192),
        "p5_conversations_4096": _packed_conversations(4096),
        "p5_conversations_8192": _packed_conversations(8192),
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p8_found": p8_found,
    }


def oracle_sql() -> dict[str, str]:
    return {}

"""Writers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def write_packed(packed: DataFrame, path: str, max_len: int = 8192) -> None:
    """Packed vectors of ``max_len`` places."""
    vectors = [c for c, kind in packed.dtypes if kind.startswith("array")]
    dense_writer(packed, max_len * max(1, len(vectors))).mode("overwrite").parquet(path)


def dense_writer(table: DataFrame, width: int, portion: int = 4_000_000) -> DataFrameWriter:
    """A writer of rows of ``width`` numbers whose row groups hold ``portion`` numbers at most, or a single row.

    Dense rows are small on disk, so that a group bounded by its bytes holds all of them; readers decode up to 4,096 rows of
    a group at once, whatever their width.
    """
    return table.write.option("parquet.block.row.count.limit", max(1, portion // width))


def padded(table: DataFrame, column: str, max_len: int, fill: int = 0) -> DataFrame:
    """A dense row of ``max_len`` numbers beside the real length."""
    n = F.size(column)
    return table.withColumn(f"{column}_len", n).withColumn(column, F.concat(column, F.array_repeat(F.lit(fill), F.greatest(F.lit(max_len) - n, F.lit(0)))))


def flat_int32(table: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(``part``, ``n``, ``data``): the arrays of each partition end to end as int32 bytes, in global order of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for k, batch in enumerate(batches):
            values = batch.column(column).flatten().cast(pa.int32())
            data = values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([k]), pa.array([len(values)], pa.int64()), pa.array([data], pa.binary())], ["part", "batch", "n", "data"])

    return table.orderBy(*order).select(column).mapInArrow(run, "part BIGINT, batch BIGINT, n BIGINT, data BINARY")


def content_digest(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row, ``source_digest``: the bits of all rows' sha256 over id and text, combined by exclusive or.

    Unlike the hash of a file it is made by partial aggregation, whatever the number of files and their layout; the ids make
    it depend on which row holds which text.
    """
    rows = table.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    own = F.conv(F.left(F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col(text_col)), 256), F.lit(15)), 16, 10).cast("bigint")
    return rows.agg(F.lpad(F.lower(F.hex(F.coalesce(F.bit_xor(own), F.lit(0).cast("bigint")))), 16, "0").alias("source_digest"))


def manifest(counts: DataFrame, facts: dict, columns: list[str] | None = None) -> DataFrame:
    """One row of JSON: the facts given, values or columns, and the counts."""

    def fixed(v: object) -> Column:
        return v if isinstance(v, Column) else F.lit(json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v)

    return counts.select(F.to_json(F.struct(*(fixed(v).alias(k) for k, v in facts.items()), *(columns or counts.columns))).alias("value"))


def write_lines(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; ``append`` for logs of metrics."""
    table.write.mode(mode).json(path)


def write_shards(table: DataFrame, path: str, idx: str, world: int) -> None:
    """One folder ``samples_rank=<r>`` for each worker's share, in one pass."""
    table.withColumn("samples_rank", F.pmod(F.col(idx), F.lit(world))).write.mode("overwrite").partitionBy("samples_rank").json(path)


def write_pairs(pairs: DataFrame, path: str, max_len: int) -> None:
    """Token pairs as dense rows padded with 0, beside their real lengths."""
    sides = ("prompt", "chosen", "rejected")
    for c in sides:
        pairs = padded(pairs, c, max_len)
    dense_writer(pairs, max_len * len(sides)).mode("overwrite").parquet(path)


def sample_report(records: DataFrame, metrics: DataFrame, step: int, stamp: str) -> DataFrame:
    """(``place``, ``line``) of the readable report on sampled outputs: two lines of metrics, then each record in order.

    records: (``place``, ``kind``, ``prompt``, ``output``). metrics: one row.
    """
    head = F.concat(
        F.lit(f"# 定时抽查 step={step}  {stamp}\n# think_trigger_rate="), F.col("think_trigger_rate").cast("string"), F.lit(" length_ratio="), F.col("mean_length_ratio").cast("string"),
        F.lit(" rep4="), F.col("rep4_mean").cast("string"), F.lit(" ppl="), F.coalesce(F.col("ppl").cast("string"), F.lit("None")), F.lit("\n\n"),
    )
    first = metrics.select(F.lit(-1).cast("bigint").alias("place"), head.alias("line"))
    body = F.concat(F.lit("## ["), "kind", F.lit("] "), "prompt", F.lit("\n"), "output", F.lit("\n\n"))
    return first.unionByName(records.select(F.col("place").cast("bigint").alias("place"), body.alias("line")))


def write_metrics(metrics: DataFrame, path: str, step: int, stamp: str) -> None:
    """Appends one stamped line to the log of metrics."""
    write_lines(metrics.select(F.lit(stamp).alias("ts"), F.lit(step).alias("step"), "*"), path, "append")


def gate_report(gate: dict) -> str:
    """The report of a quality gate, as Markdown."""
    verdict = "通过" if gate["pass_all"] else "未通过"
    return (
        "# SFT 质量报告\n\n"
        f"- 思考触发率：{gate['think_trigger_rate']}\n- rep-4 重复度：{gate['rep4_mean']}\n"
        f"- judge 均分（{gate['judge_n']} 条）：{gate['judge_mean']:.2f} / 10\n- 判定：**{verdict}**\n"
    )

"""Readers. Schemas are given, never inferred; lines that can't be parsed are dropped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeflow.functions.text import strip
from lodeflow.operators.order import ranks
from lodeflow.schemas import PRETRAIN, SAMPLE


def json_texts(spark: SparkSession, path: str, field: str = "text", backend: str = "json") -> DataFrame:
    """(``row_id``, ``text``) of the lines with a string in ``field``.

    ``json`` reads lines as records; ``lines`` reads raw lines first, for files with a line that isn't JSON at all. Ids
    follow file and place in it, are unique, and don't depend on the cluster's size.
    """
    if backend == "json":
        schema = T.StructType([T.StructField(field, T.VariantType()), T.StructField("_bad", T.StringType())])
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
        text = rows.select(F.col(field).alias("v"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    elif backend == "lines":
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
        text = rows.select(F.expr(f"try_variant_get(try_parse_json(value), '$.{field}', 'variant')").alias("v"), "_file", "_at")
    else:
        raise ValueError(f"unknown backend {backend}")
    kept = text.where(F.schema_of_variant("v") == "STRING").select(F.expr("variant_get(v, '$', 'string')").alias("text"), "_file", "_at")
    return ranks(kept, ["_file", "_at"], "row_id").drop("_file", "_at")


def records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested records, one JSON object a line."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``line``) stripped, without blank ones."""
    return spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")


def sample_shards(spark: SparkSession, path: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """The rows of all shards ``samples_rank*``, files or folders, with ``seq`` in order of shard, file and line."""
    rows = spark.read.schema(schema).json(f"{path}/samples_rank*")
    rows = rows.where("idx IS NOT NULL").select(*schema.names, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return ranks(rows, ["_file", "_at"], "seq").drop("_file", "_at")


def streamed_texts(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same records as a stream of files."""
    return spark.readStream.schema(PRETRAIN).option("maxFilesPerTrigger", max_files).json(path).where("text IS NOT NULL")


def line_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count("*").alias("lines"))


def parse_errors(spark: SparkSession, path: str) -> DataFrame:
    """One row: non-blank lines, and how many aren't JSON."""
    lines = text_lines(spark, path)
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.try_parse_json("line").isNull()).alias("errors"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``length``, ``sha256``) of each file, for manifests. A file is hashed by one task, a portion at a time, so
    its size doesn't matter; the list of files comes from the file system, without their contents and without empty files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_sha256(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "length", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(run, "path STRING, length BIGINT, sha256 STRING")


def _sha256(uri: str, portion: int = 8 << 20) -> str:
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    state = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as f:
        while data := f.read(portion):
            state.update(data)
    return state.hexdigest()


def ordered_digest(digests: DataFrame) -> DataFrame:
    """One row, ``sha256`` over the digests of the files in order of their names; files number few beside the rows."""
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return digests.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["sha256"]), ""), 256).alias("sha256"), F.count("*").alias("files"))


def packed_sequences(spark: SparkSession, path: str, max_len: int) -> DataFrame:
    """Packed sequences, with a check that each vector has ``max_len`` places."""
    rows = spark.read.parquet(path)
    for c in ("input_ids", "document_ids", "labels"):
        if c in rows.columns:
            rows = rows.where(F.assert_true(F.size(c) == max_len, F.lit(f"{c} of a sequence hasn't {max_len} places")).isNull())
    return rows


def token_pairs(spark: SparkSession, path: str, max_len: int) -> DataFrame:
    """Dense pairs written by ``sinks.write_pairs``: each side without its padding, and the head of the prompt."""
    rows = spark.read.parquet(path)
    for c in ("prompt", "chosen", "rejected"):
        rows = rows.where(F.assert_true(F.size(c) == max_len, F.lit(f"{c} hasn't {max_len} places")).isNull())
    return rows.select("id", *(F.slice(c, F.lit(1), F.col(f"{c}_len")).alias(c) for c in ("prompt", "chosen", "rejected")), "prompt_len")


def prompt_slices(dense: DataFrame, column: str = "prompt", length: str = "prompt_len") -> DataFrame:
    """Prompts of a dense table without their padding."""
    return dense.withColumn(column, F.slice(column, F.lit(1), F.col(length)))


def benchmark(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")

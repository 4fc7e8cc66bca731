"""Streams that go on: restarts, timed and counted batches, packing and near duplicates across batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.operators import dedup
from lodeflow.operators.packing import PORTION
from lodeflow.operators.tokenizers import ByteTokenizer
from lodeflow.plans.corpus import _BYTES, _SIGNED, _VECTORS, PRETRAIN_LEN, _digested, _packing_sql
from lodeflow.plans.registry import _GATED, query, t
from lodeflow.session import materialize, work_root
from lodeflow.streaming import incremental

PARTS = 3


def _arriving(spark: SparkSession, sf_dir: str, table: str, id_col: str, columns: list[str]):
    """A folder, and one function for each of the parts of a table, in order of the id, that makes it arrive there."""
    rows = t(spark, sf_dir, table).select(*columns)
    top = rows.agg((F.max(id_col) + 1).alias("n")).first().n or 1
    path = f"{work_root(spark)}/arrivals-{uuid.uuid4().hex}"

    def arrive(k: int) -> None:
        own = rows.where((F.col(id_col) >= top * k // PARTS) & (F.col(id_col) < top * (k + 1) // PARTS))
        own.coalesce(1).write.mode("append").parquet(path)

    return path, rows.schema, [lambda k=k: arrive(k) for k in range(PARTS)]


def _stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("SELECT row_id, md5(text) AS digest FROM pretrain_t2t WHERE text IS NOT NULL")
def resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query started again after each arrival finds its checkpoint, and every row comes out once."""
    path, schema, arrivals = _arriving(spark, sf_dir, "pretrain_t2t", "row_id", ["row_id", "text"])
    folder = f"{work_root(spark)}/resumed-{uuid.uuid4().hex}"
    for arrive in arrivals:
        arrive()
        rows = _stream(spark, path, schema).where("text IS NOT NULL").select("row_id", F.md5("text").alias("digest"))
        found = incremental.run_available(rows, "resumed", folder=folder)
    return found


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def timed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts brought up to date at an interval of time."""
    path = f"{work_root(spark)}/events-{uuid.uuid4().hex}"
    events = t(spark, sf_dir, "events").select("event_type", "ts", "value")
    events.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return incremental.run_available(stream.groupBy("event_type").agg(F.count("*").alias("n")), "timed", output="complete", interval="200 milliseconds")


@query(f"SELECT count(DISTINCT k) AS batches, count(DISTINCT k) FILTER (WHERE k % 2 = 0) AS acted FROM (SELECT unnest(range({PARTS})) AS k)")
def batch_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, and those that an action for every second one saw."""
    path, schema, arrivals = _arriving(spark, sf_dir, "pretrain_t2t", "row_id", ["row_id"])
    for arrive in arrivals:
        arrive()
    seen: dict[str, list[int]] = {"all": [], "second": []}
    second = incremental.every(2, lambda _, k: seen["second"].append(k))

    def each(batch: DataFrame, k: int) -> None:
        seen["all"].append(k)
        second(batch, k)

    incremental.run_available(_stream(spark, path, schema), "intervals", each_batch=each)
    return spark.createDataFrame([(len(seen["all"]), len(seen["second"]))], "batches long, acted long")


@query("SELECT chunk, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 500 AS chunk FROM pretrain_t2t) GROUP BY chunk")
def flushed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in chunks of 500, as a bounded buffer flushes them."""
    chunks = incremental.flushed(t(spark, sf_dir, "pretrain_t2t").select("row_id"), ["row_id"], 500)
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query(_GATED.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + ", docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_id) - 1 AS doc, CAST(strlen(clean) AS BIGINT) AS n, clean FROM g WHERE gate IS NULL)"
       + _packing_sql(PRETRAIN_LEN) + f", tok AS (SELECT doc, {_BYTES % 'clean'} AS ids FROM docs)" + _VECTORS.format(L=PRETRAIN_LEN, more=""))
def streamed_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts packed across batches: the last version of each sequence is that of one pass over all of them."""
    path, schema, arrivals = _arriving(spark, sf_dir, "pretrain_t2t", "row_id", ["row_id", "text"])
    for arrive in arrivals:
        arrive()
    packed = incremental.packed_stream(incremental.clean_stream(_stream(spark, path, schema)), ByteTokenizer(), PRETRAIN_LEN)
    found = incremental.run_available(packed, "packing", output="update", group_rows=PORTION // PRETRAIN_LEN, arrow_rows=500)
    vectors = ["input_ids", "document_ids"]
    said = _digested(found.withColumnRenamed("lane", "shard"), vectors, ["shard", "seq", "batch", "closed"])
    last = said.groupBy("shard", "seq").agg(F.max_by(F.struct(*vectors), F.struct("batch", "closed")).alias("v"))
    return last.select("shard", "seq", "v.*")


@query(_SIGNED + f"""
, b AS (SELECT row_id, k % 16 AS band, list(v ORDER BY k) AS key FROM sig GROUP BY ALL),
nb AS (SELECT DISTINCT lag(row_id) OVER (PARTITION BY band, key ORDER BY row_id) AS prev, row_id FROM b)
SELECT DISTINCT row_id FROM (SELECT p.prev, p.row_id FROM nb p JOIN sig u ON u.row_id = p.prev JOIN sig v ON v.row_id = p.row_id AND v.k = u.k
 GROUP BY p.prev, p.row_id HAVING count(*) FILTER (WHERE u.v = v.v) >= 52) WHERE row_id >= (SELECT max(row_id) // {PARTS} FROM kept)""")
def near_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows that are near duplicates of stored or of each other; the stored buckets are probed, not sorted."""
    signed = materialize(dedup.sketches(dedup.surviving_texts(t(spark, sf_dir, "pretrain_t2t"), near=False)), "sketches")
    top = signed.agg(F.floor(F.max("id") / PARTS).alias("n")).first().n or 0
    stored, new = signed.where(F.col("id") < top), signed.where(F.col("id") >= top)
    return incremental.near_new(new, stored, stored_bands=materialize(dedup.bands_of(stored), "stored-bands")).select(F.col("id").alias("row_id"))

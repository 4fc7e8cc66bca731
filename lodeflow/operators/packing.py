"""Packing token sequences in document order into vectors of one length.

The place of a document depends on the lengths before it, and on two numbers only: the sequence being filled and how far.
So the sequential part sees nothing but lengths, a shard of at most ``CHUNK`` documents at a time; the token arrays are cut
and put together in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.operators.batches import sized_slices
from lodeflow.operators.order import ranks
from lodeflow.session import materialize

CHUNK = 200_000
#: Tokens that a task holds at once: of a column in a row group, of a slice of pieces, of a vector's batch.
PORTION = 1_000_000
_PIECES = "shard BIGINT, id BIGINT, doc INT, seq BIGINT, start INT, size INT, eos BOOLEAN, place INT"


def place_documents(lengths: list[int], max_len: int, filled: int = 0) -> list[tuple[int, int, int, int, bool, int]]:
    """(document, sequence, first token, tokens, whether an end mark follows, place in the sequence) of every piece.

    A document with an end mark fits if its tokens are fewer than the places left; otherwise all places but one are taken
    and the last stays empty. With one place left or none a new sequence begins. Empty documents take no place.
    filled: places of the first sequence that are taken already.
    """
    if max_len < 2:
        raise ValueError("max_len must be 2 at least")
    out = []
    seq, used = 0, filled
    for doc, n in enumerate(lengths):
        start = 0
        while start < n:
            if max_len - used <= 1:
                seq, used = seq + 1, 0
            size = min(n - start, max_len - used - 1)
            last = start + size == n
            out.append((doc, seq, start, size, last, used))
            start += size
            # after a piece that isn't the last, the one place left can't be used
            used = used + size + 1
    return out


def with_shards(table: DataFrame, id_col: str = "id", chunk: int = CHUNK) -> DataFrame:
    """Adds ``shard`` and ``doc``, the ordinal within it, in order of the id, to a narrow table."""
    shard = F.floor(F.col("_rank") / F.lit(chunk))
    return ranks(table, [id_col], "_rank").withColumn("shard", shard).withColumn("doc", (F.col("_rank") - F.col("shard") * chunk).cast("int")).drop("_rank")


def pieces_of(lengths: DataFrame, max_len: int, chunk: int = CHUNK) -> DataFrame:
    """(``shard``, ``id``, ``doc``, ``seq``, ``start``, ``size``, ``eos``, ``place``) of every piece. lengths: (``id``, ``n``)."""
    if max_len < 2:
        raise ValueError("max_len must be 2 at least")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc")
        out = pd.DataFrame(place_documents(pdf["n"].clip(lower=0).tolist(), max_len), columns=["doc", "seq", "start", "size", "eos", "place"])
        at = out["doc"].to_numpy(dtype=int)
        out["id"], out["doc"], out["shard"] = pdf["id"].to_numpy()[at], pdf["doc"].to_numpy()[at], pdf["shard"].iloc[0]
        return out[["shard", "id", "doc", "seq", "start", "size", "eos", "place"]]

    return with_shards(lengths.select("id", "n"), "id", chunk).groupBy("shard").applyInPandas(fold, _PIECES)


def piece_counts(pieces: DataFrame, max_len: int) -> DataFrame:
    """One row: ``sequences``, ``slots`` and real ``tokens``, read off the pieces without any token."""
    per = pieces.groupBy("shard", "seq").agg(F.sum(F.col("size") + F.col("eos").cast("int")).alias("tokens"))
    return per.agg(F.count("*").alias("sequences"), (F.count("*") * max_len).alias("slots"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def pack(table: DataFrame, max_len: int, eos_id: int, pad_id: int = -1, id_col: str = "id", ids_col: str = "ids", labels_col: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(``shard``, ``seq``, ``input_ids``, ``document_ids``, and ``labels`` if a column of labels is given).

    Padding is ``pad_id``, document -1, label -100; an end mark carries its document's id and label -100. Ranks and places
    come from ids and lengths alone; each document meets its pieces once, and what is cut goes to its sequence.
    """
    sources = {"ids": ids_col} | ({"labels": labels_col} if labels_col else {})
    base = materialize(table.select(F.col(id_col).alias("id"), F.size(ids_col).alias("n"), *(F.col(c).alias(f"_{k}") for k, c in sources.items())), "tokens", max(1, PORTION // max_len))
    joined = materialize(pieces_of(base, max_len, chunk), "pieces").join(base.drop("n"), "id")
    cut = [F.slice(F.col(f"_{k}"), F.col("start") + 1, F.col("size")).cast("array<int>").alias(k) for k in sources]
    rows = joined.select("shard", "seq", "place", "doc", "eos", *cut).repartition("shard", "seq").sortWithinPartitions("shard", "seq", "place")
    fills = {"input_ids": pad_id, "document_ids": -1} | ({"labels": -100} if labels_col else {})
    kinds = "shard BIGINT, seq BIGINT, " + ", ".join(f"{c} ARRAY<INT>" for c in fills)
    return rows.mapInArrow(_assembled(max_len, eos_id, fills), kinds)


def _assembled(max_len: int, eos_id: int, fills: dict[str, int]):
    """Puts the pieces of each sequence, complete and in order in a partition, into vectors."""

    def batch_of(keys: list[tuple[int, int]], vectors: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * max_len)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else np.zeros(0, np.int32))) for v in vectors.values()]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *lists], ["shard", "seq", *vectors])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        vectors: dict[str, list[np.ndarray]] = {c: [] for c in fills}
        for batch in (part for whole in batches for part in sized_slices(whole, [k for k in ("ids", "labels") if k in whole.schema.names], PORTION)):
            columns = {c: batch.column(c).to_pylist() for c in ("shard", "seq", "place", "doc", "eos")}
            parts = {}
            for k in ("ids", "labels"):
                if k in batch.schema.names:
                    lists = batch.column(k)
                    parts[k] = (np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))))
            for i, key in enumerate(zip(columns["shard"], columns["seq"])):
                if not keys or keys[-1] != key:
                    if len(keys) >= max(1, PORTION // max_len):
                        yield batch_of(keys, vectors)
                        keys, vectors = [], {c: [] for c in fills}
                    keys.append(key)
                    for c, fill in fills.items():
                        vectors[c].append(np.full(max_len, fill, np.int32))
                values, ends = parts["ids"]
                at, size = columns["place"][i], int(ends[i + 1] - ends[i])
                vectors["input_ids"][-1][at : at + size] = values[ends[i] : ends[i + 1]]
                if columns["eos"][i]:
                    vectors["input_ids"][-1][at + size] = eos_id
                vectors["document_ids"][-1][at : at + size + columns["eos"][i]] = columns["doc"][i]
                if "labels" in parts:
                    values, ends = parts["labels"]
                    vectors["labels"][-1][at : at + size] = values[ends[i] : ends[i + 1]]
        if keys:
            yield batch_of(keys, vectors)

    return run


def model_inputs(packed: DataFrame, pad_id: int = -1) -> DataFrame:
    """What a trainer reads: padding as id 0, and as label -100 where no labels came along."""
    labels = F.col("labels") if "labels" in packed.columns else F.transform("input_ids", lambda x: F.when(x == pad_id, -100).otherwise(x))
    ids = F.transform("input_ids", lambda x: F.when(x == pad_id, 0).otherwise(x))
    return packed.select("shard", "seq", ids.alias("input_ids"), labels.alias("labels"), "document_ids")


def packed_counts(packed: DataFrame, pad_id: int = -1) -> DataFrame:
    """One row: ``sequences``, ``slots`` and the real ``tokens`` in them."""
    real = F.size(F.filter("input_ids", lambda x: x != pad_id))
    zero = F.lit(0)
    return packed.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(F.size("input_ids")), zero).cast("bigint").alias("slots"), F.coalesce(F.sum(real), zero).cast("bigint").alias("tokens"))


def may_attend(document_ids: list[int]) -> list[list[bool]]:
    """Mask of one sequence: places of the same document, not later."""
    return [[d == e and j <= i for j, e in enumerate(document_ids)] for i, d in enumerate(document_ids)]

"""Helpers for Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer partitions than the cluster has cores, spread over the cores; others stay where they are.

    A table in few files, or in one row group, would leave all other cores idle in a Python stage. At scale a table has
    more partitions than there are cores, and nothing is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have at most ``limit`` bytes, or are a single row.

    Working memory then depends on the longest text, not on the number of rows in a batch.
    """
    yield from _slices(batch, _filled(pc.binary_length(batch.column(column))), limit)


def sized_slices(batch: pa.RecordBatch, columns: list[str], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same for several columns of texts or of token lists: a slice has at most ``limit`` bytes and tokens in all."""
    of = lambda c: pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
    yield from _slices(batch, sum(_filled(of(batch.column(c))) for c in columns), limit)


def _filled(lengths: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(lengths, 0), dtype=np.int64)


def _slices(batch: pa.RecordBatch, lengths: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    start, used = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if used and used + n > limit:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += n
    if start < batch.num_rows:
        yield batch.slice(start)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as uint32 code points, and the n+1 offsets between them."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer; unsigned arithmetic wraps."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x

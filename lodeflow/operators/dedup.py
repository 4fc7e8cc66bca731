"""Cleaning, gating, exact and near duplicates of a text corpus.

Every input has an explicit row id; "first" always means the smallest id. Rows without text or id are not rows of the
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.text import clean_text, compact_space, digest
from lodeflow.operators.batches import code_points, mix64, spread, text_slices
from lodeflow.operators.skew import join_hot_split
from lodeflow.session import materialize

MIN_CHARS, MAX_CHARS = 32, 100_000
HASHES, BANDS = 64, 16
SHINGLE, MOST_SHINGLES = 5, 4096
#: Multipliers of the family, odd numbers below 2**32 fixed by a rule that SQL can repeat.
MULTIPLIERS = [(k * 2_654_435_769 + 40_503) % (1 << 32) | 1 for k in range(1, HASHES + 1)]
_BASE, _MIX, _LOW = 1_000_003, 73_244_475, (1 << 32) - 1


def gated(table: DataFrame, id_col: str = "row_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(``id``, ``clean``, ``gate``): too_short is tested first, then too_long; NULL for texts that pass."""
    rows = spread(table.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col)))
    clean = rows.select(F.col(id_col).cast("bigint").alias("id"), clean_text(F.col(text_col)).alias("clean"))
    n = F.length("clean")
    return clean.withColumn("gate", F.when(n < min_chars, "too_short").when(n > max_chars, "too_long"))


def _marked(table: DataFrame, id_col: str, text_col: str, min_chars: int, max_chars: int) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``n_chars``, ``digest``, ``gate``, ``clean``) written once, and (``id``, ``digest``) of the exact duplicates.

    Digests are aggregated, not windowed: a text that a third of the rows share is one partial row of each task, and the
    join back splits hot digests. Only repeated digests are joined back.
    """
    n = F.length("clean").cast("bigint")
    rows = gated(table, id_col, text_col, min_chars, max_chars).select("id", n.alias("n_chars"), digest(F.col("clean")).alias("digest"), "gate", "clean")
    rows = materialize(rows, "gated")
    passed = rows.where("gate IS NULL").select("id", "digest")
    repeated = materialize(passed.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "repeated")
    copies = join_hot_split(passed, repeated, ["digest"], "copies", passed.count())
    return rows, materialize(copies.where("id <> first").select("id", "digest").distinct(), "exact-duplicates")


def outcomes(table: DataFrame, id_col: str = "row_id", text_col: str = "text", dedup: bool = True, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(``id``, ``n_chars``, ``digest``, ``outcome``): too_short, too_long, exact_dup or kept, one of them for every row."""
    if not dedup:
        rows = gated(table, id_col, text_col, min_chars, max_chars)
        return rows.select("id", F.length("clean").cast("bigint").alias("n_chars"), digest(F.col("clean")).alias("digest"), F.coalesce("gate", F.lit("kept")).alias("outcome"))
    rows, dups = _marked(table, id_col, text_col, min_chars, max_chars)
    flagged = rows.drop("clean").join(dups.withColumn("dup", F.lit("exact_dup")), ["id", "digest"], "left")
    return flagged.select("id", "n_chars", "digest", F.coalesce("gate", "dup", F.lit("kept")).alias("outcome"))


def outcome_counts(found: DataFrame) -> DataFrame:
    """(``outcome``, ``n_rows``, ``n_chars``)."""
    return found.groupBy("outcome").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


def sketch_texts(texts: list[str], shingle: int = SHINGLE, most: int = MOST_SHINGLES) -> np.ndarray:
    """(n, HASHES) least 32-bit values over a text's strided shingles.

    A shingle's code points make a polynomial modulo 2**32, which is mixed by shifts and multiplications; each of the family
    is a multiplication by an odd number modulo 2**32. All of it is integer arithmetic that SQL can repeat.
    """
    points, offsets = code_points(texts)
    lengths = np.diff(offsets)
    totals = np.maximum(lengths - shingle + 1, 1)
    strides = -(-totals // most)
    taken = -(-totals // strides)
    first = np.cumsum(taken) - taken
    places = np.repeat(offsets[:-1], taken) + (np.arange(taken.sum()) - np.repeat(first, taken)) * np.repeat(strides, taken)
    ends = np.repeat(offsets[1:], taken)
    padded = np.concatenate((points.astype(np.uint32) + np.uint32(1), np.zeros(shingle, np.uint32)))
    h = np.zeros(len(places), np.uint32)
    for k in range(shingle):
        h = h * np.uint32(_BASE) + np.where(places + k < ends, padded[places + k], np.uint32(0))
    for _ in range(2):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(_MIX)
    h ^= h >> np.uint32(16)
    out = np.empty((len(texts), HASHES), np.int64)
    for k, a in enumerate(MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(h * np.uint32(a), first) if len(texts) else 0
    return out


def sketches(table: DataFrame, id_col: str = "id", text_col: str = "clean") -> DataFrame:
    """(``id``, ``sig`` ARRAY<BIGINT> of HASHES values) of the white-space-compacted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1_000_000):
                values = sketch_texts(part.column("text").to_pylist())
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), HASHES).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "sig"])

    rows = table.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), compact_space(F.col(text_col)).alias("text"))
    return spread(rows).mapInArrow(run, "id BIGINT, sig ARRAY<BIGINT>")


def similarity(a: str, b: str) -> float:
    """Estimated from the sketches of two texts."""
    x, y = sketch_texts([a, b])
    return float((x == y).mean())


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = HASHES // BANDS
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column("id"))
        sig = np.asarray(batch.column("sig").flatten()).reshape(len(ids), HASHES)
        keys = np.zeros((len(ids), BANDS), np.uint64)
        for r in range(rows):
            keys = mix64(keys + sig[:, r * BANDS : (r + 1) * BANDS].astype(np.uint64) + np.uint64(r + 1))
        bands = np.tile(np.arange(BANDS, dtype=np.int32), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS))], ["band", "key", "id"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of one bucket in a sorted partition; its first and last row come out too, for the seams."""
    from pyspark import TaskContext

    part, first, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, key, ids = (np.asarray(batch.column(c)) for c in ("band", "key", "id"))
        if last is not None:
            band, key, ids = np.append(last[0], band), np.append(last[1], key), np.append(last[2], ids)
        first = first or (band[0], key[0], ids[0])
        last = (band[-1], key[-1], ids[-1])
        same = np.flatnonzero((band[1:] == band[:-1]) & (key[1:] == key[:-1]))
        n = len(same)
        yield _neighbour_batch([*zip(ids[same].tolist(), ids[same + 1].tolist(), [None] * n, [None] * n, [None] * n, [None] * n)])
    if first is not None:
        yield _neighbour_batch([(None, int(x[2]), part, k, int(x[0]), int(x[1])) for k, x in enumerate((first, last))])


_NEIGHBOURS = "a BIGINT, id BIGINT, part INT, last INT, band INT, key BIGINT"


def _neighbour_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    columns = zip(*out) if out else ((),) * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "id", "part", "last", "band", "key"])


def bands_of(signed: DataFrame) -> DataFrame:
    """(``band``, ``key``, ``id``): the buckets of each row."""
    return signed.mapInArrow(_banded, "band INT, key BIGINT, id BIGINT")


def bucket_pairs(bands: DataFrame) -> DataFrame:
    """(``a`` before ``id``) of all neighbours in a bucket, each pair once.

    A global sort of (band, key, id) puts a bucket's rows side by side, so a bucket of any size is spread over tasks; what is
    left to pair is the last row of a partition with the first of the next, two rows for each partition.
    """
    found = materialize(bands.orderBy("band", "key", "id").mapInArrow(_neighbours, _NEIGHBOURS), "neighbours")
    w = Window.orderBy("part", "last")
    before = [F.lag(c).over(w).alias(f"{c}0") for c in ("id", "band", "key")]
    seams = found.where("part IS NOT NULL").select("id", "last", "band", "key", *before)
    over = seams.where("last = 0 AND band = band0 AND key = key0").select(F.col("id0").alias("a"), "id")
    return found.where("part IS NULL").select("a", "id").unionByName(over).where("a <> id").distinct()


def compared(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(``a``, ``id``, ``similarity`` of their sketches)."""
    sides = pairs.join(signed.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(signed.select("id", F.col("sig").alias("y")), "id")
    equal = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda e: e))
    return sides.select("a", "id", (equal / F.lit(HASHES)).alias("similarity"))


def neighbour_similarities(signed: DataFrame) -> DataFrame:
    """(``a`` before ``id``, ``similarity``) of all neighbours in a bucket. signed: (``id``, ``sig``). The sketches stay out
    of the sort and meet for the pairs found only."""
    return compared(bucket_pairs(bands_of(signed)), signed)


def near_duplicate_drops(signed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(``id``) of the rows to drop: the later of two neighbours at or above the threshold. A dropped row still stands as
    neighbour of the next."""
    return neighbour_similarities(signed).where(F.col("similarity") >= threshold - 1e-9).select("id").distinct()


def corpus_stages(table: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The whole job's (``id``, ``n_chars``, ``digest``, ``outcome``), near_dup among them, and (``id``, ``clean``) of what
    survives. Texts are cleaned once; what is dropped is joined away, so the texts stay where they are if that is little."""
    rows, dups = _marked(table, id_col, text_col, MIN_CHARS, MAX_CHARS)
    texts = rows.where("gate IS NULL").join(dups, ["id", "digest"], "left_anti")
    near = materialize(near_duplicate_drops(materialize(sketches(texts), "sketches"), threshold), "near-duplicates")
    marks = dups.withColumn("mark", F.lit("exact_dup"))
    found = rows.drop("clean").join(marks, ["id", "digest"], "left").join(near.withColumn("near", F.lit("near_dup")), "id", "left")
    found = found.select("id", "n_chars", "digest", F.coalesce("gate", "mark", "near", F.lit("kept")).alias("outcome"))
    return found, texts.join(near, "id", "left_anti").select("id", "clean")


def corpus_outcomes(table: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Those of ``outcomes``, with near_dup for rows that only the near-duplicate stage drops."""
    return corpus_stages(table, id_col, text_col, threshold)[0]


def surviving_texts(table: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.8, near: bool = True) -> DataFrame:
    """(``id``, ``clean``) after cleaning, gates, exact and near duplicates."""
    if near:
        return corpus_stages(table, id_col, text_col, threshold)[1]
    rows, dups = _marked(table, id_col, text_col, MIN_CHARS, MAX_CHARS)
    return rows.where("gate IS NULL").join(dups, ["id", "digest"], "left_anti").select("id", "clean")


def greedy_keep(texts: list[str], threshold: float = 0.8) -> list[int]:
    """Places of the texts kept, each compared with all kept before; for a few hundred texts at most."""
    kept: list[int] = []
    signs = sketch_texts([" ".join(t.split()) for t in texts]) if texts else np.zeros((0, HASHES))
    for i in range(len(texts)):
        if not any((signs[i] == signs[k]).mean() >= threshold for k in kept):
            kept.append(i)
    return kept

"""Near-duplicate records by multi-index hashing.

1. Each record's text is reduced to lower-case letters and digits; its pieces are all 5-character substrings (a shorter
   text is one piece). A fingerprint of 384 bits is drawn from the set of pieces: 384 min-wise samples, one bit of each.
   Two bits differ with probability (1 - J) / 2, where J is the similarity of the sets.
2. The fingerprint is cut into 16 segments of 24 bits, each with a table of its own. A record looks up, in each table,
   every value within Hamming distance 1 of its segment. A pair of similarity 0.8 meets in at least one table with
   probability 0.996, one of 0.84 with 0.9998 and one of 0.9 with more than 0.99999999; unrelated pairs meet once in 42,000.
3. Complete distances of the pairs met are verified (62 of 384 bits at most, four standard deviations above the mean at
   similarity 0.8), then the sets of pieces themselves are compared, so no wrong pair comes out.

A segment's halves of 12 bits are what rows are shuffled by: within distance 1 one half is equal, and the ball around
the other is enumerated inside the task. Rows travel packed, 16 bytes each. The number of records of each group of table
parts is counted first; a group above ``GROUP_ROWS`` is cut into blocks, and each pair of blocks is a task of its own.

Records equal under ``format_dups`` count as one, under the smallest id; pairs are formed between those only. Defined
results: NULL, blank and all-symbol texts and rows without an id take no part; a repeated row makes no pair with itself;
whole texts are used; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm import canon
from lodeflow.llm.format_dups import format_groups, keyed
from lodeflow.operators.batches import mix64, spread, text_slices
from lodeflow.operators.graph import components
from lodeflow.operators.skew import join_hot_split
from lodeflow.session import materialize

PIECE = 5
BITS, SEGMENTS = 384, 16
WIDTH = BITS // SEGMENTS
HALF = WIDTH // 2
#: Complete distance allowed for a threshold of 0.8; the first look is at 32 bits of other segments.
DISTANCE, FIRST_DISTANCE = 62, 10
GROUP_ROWS = 1_000_000
_ROUNDS = 8
_RECORD = np.dtype([("key", "<u4"), ("code", "<u4"), ("id", "<i8")])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def piece_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every piece, and the n+1 offsets of the texts' pieces. Empty texts have no piece."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= PIECE, lengths - PIECE + 1, (lengths > 0).astype(lengths.dtype))
    ends = np.concatenate(([0], np.cumsum(counts)))
    starts = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], counts)
    padded = np.concatenate((points.astype(np.uint64) + np.uint64(1), np.zeros(PIECE, np.uint64)))
    h = np.zeros(len(starts), np.uint64)
    limit = np.repeat(offsets[1:], counts)
    short = np.repeat(lengths < PIECE, counts)
    for k in range(PIECE):
        x = padded[starts + k]
        if short.any():
            x[short & (starts + k >= limit)] = 0
        h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return mix64(h), ends


def fingerprints(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 48 bytes per text.

    Each round throws every piece into a random bin with a random value; a bin keeps its least value of the first round
    that fills it. What is empty after the rounds takes the least of a hash of its own. Bins that agree with probability J
    give one bit each.
    """
    h, ends = piece_hashes(points, offsets)
    n = len(offsets) - 1
    counts = np.diff(ends)
    least = np.full(n * BITS, np.iinfo(np.uint64).max, np.uint64)
    live = counts > 0
    for r in range(_ROUNDS):
        chosen = np.flatnonzero(live)
        if not len(chosen):
            break
        own = np.repeat(live, counts)
        doc = np.repeat(np.arange(n), counts)[own]
        x = mix64(h[own] + np.uint64((r + 1) * int(_STEP) & _MASK))
        place = doc * BITS + ((x >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)
        value = (np.uint64(r) << np.uint64(56)) | (x & np.uint64((1 << 56) - 1))
        np.minimum.at(least, place, value)
        live = live & (least.reshape(n, BITS).max(axis=1) == np.iinfo(np.uint64).max)
    for d in np.flatnonzero(live):
        empty = np.flatnonzero(least[d * BITS : (d + 1) * BITS] == np.iinfo(np.uint64).max)
        own = h[ends[d] : ends[d + 1]]
        for part in np.array_split(empty, max(1, len(empty) * len(own) // 2_000_000 + 1)):
            seeds = (part.astype(np.uint64) + np.uint64(_ROUNDS + 1)) * _STEP
            least[d * BITS + part] = mix64(own[None, :] ^ seeds[:, None]).min(axis=1)
    bits = (mix64(least ^ _STEP) >> np.uint64(17)).astype(np.uint8) & np.uint8(1)
    return np.packbits(bits.reshape(n, BITS), axis=1)


_SIGNED = "id BIGINT, h BINARY, check BIGINT, print BINARY"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text", 1_500_000):
            texts = part.column("text").to_pylist()
            points, offsets = canon.flatten(texts)
            found = canon.digests(texts, points, offsets)
            prints = fingerprints(points, offsets)
            table = pa.table({
                "id": part.column("id"),
                "h": pa.array([d and d[:16] for d in found], pa.binary()),
                "check": pa.array([d and int.from_bytes(d[16:], "little", signed=True) for d in found], pa.int64()),
                "print": pa.array([p.tobytes() for p in prints], pa.binary()),
            })
            yield from table.filter(pc.is_valid(table["h"])).to_batches()


def signed(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``print``) of each distinct record, by its smallest id; the texts are read once and not shuffled."""
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = spread(rows.where("id IS NOT NULL AND text IS NOT NULL")).mapInArrow(_sign, _SIGNED)
    kept = rows.groupBy("h", "check").agg(F.min(F.struct("id", "print")).alias("r")).select("r.*")
    return kept.groupBy("id").agg(F.min("print").alias("print"))


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    """Records of (half's table and value << 12 | other half, code, id): two for each segment of each row."""
    n = batch.num_rows
    prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(n, BITS // 8)
    ids = np.asarray(batch.column("id"))
    out = np.empty((2 * SEGMENTS, n), _RECORD)
    out["id"] = ids[None, :]
    for s in range(SEGMENTS):
        three = prints[:, 3 * s : 3 * s + 3].astype(np.uint32)
        value = three[:, 0] << 16 | three[:, 1] << 8 | three[:, 2]
        high, low = value >> HALF, value & ((1 << HALF) - 1)
        others = np.take(prints, [(3 * s + 3 + k) % (BITS // 8) for k in range(4)], axis=1).astype(np.uint32)
        code = others[:, 0] << 24 | others[:, 1] << 16 | others[:, 2] << 8 | others[:, 3]
        for half, (equal, other) in enumerate(((high, low), (low, high))):
            row = out[2 * s + half]
            row["key"] = (np.uint32(2 * s + half) << np.uint32(HALF) | equal) << np.uint32(HALF) | other
            row["code"] = code
    return out.reshape(-1)


def _group_of(records: np.ndarray, groups: int) -> np.ndarray:
    parts = (2 * SEGMENTS) << HALF
    return ((records["key"] >> np.uint32(HALF)).astype(np.int64) * groups // parts).astype(np.int32)


def _meet(one: np.ndarray, two: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose keys are equal or differ in one bit of the other half, and whose codes are near; in bounded portions.

    Of two keys that differ in a bit the one that has it looks up the one that hasn't. two: None for pairs within ``one``.
    """
    table = one if two is None else two
    table = table[np.argsort(table["key"], kind="stable")]
    keys = np.ascontiguousarray(table["key"])
    sides = [(one, 0)] + [(one, 1 << b) for b in range(HALF)]
    if two is not None:
        sides += [(one, -(1 << b)) for b in range(HALF)]
    for asking, flip in sides:
        if flip > 0:
            asking = asking[(asking["key"] & np.uint32(flip)) != 0]
            probe = asking["key"] ^ np.uint32(flip)
        elif flip < 0:
            asking = asking[(asking["key"] & np.uint32(-flip)) == 0]
            probe = asking["key"] | np.uint32(-flip)
        else:
            probe = asking["key"]
        lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
        sizes = hi - lo
        some = np.flatnonzero(sizes > (1 if flip == 0 and two is None else 0))
        if not len(some):
            continue
        asking, lo, sizes = asking[some], lo[some], sizes[some]
        totals = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(totals, (totals[start - 1] if start else 0) + 4_000_000, "right")))
            size = sizes[start:stop]
            left = np.repeat(np.arange(start, stop), size)
            right = lo[left] + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
            a, b = asking[left], table[right]
            near = (np.bitwise_count(a["code"] ^ b["code"]) <= FIRST_DISTANCE) & (a["id"] != b["id"])
            if flip == 0 and two is None:
                near &= a["id"] < b["id"]
            a, b = a["id"][near], b["id"][near]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b)
            start = stop


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, b1, b2, side, data) of a partition to pairs; a task's group is complete in its partition, in order."""

    def rows() -> Iterator[tuple[tuple[int, int, int], int, bytes]]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("g", "b1", "b2", "side", "data")]
            for g, b1, b2, side, data in zip(*columns):
                yield (g, b1, b2), side, data

    for (_, b1, b2), group in itertools.groupby(rows(), key=lambda r: r[0]):
        sides: tuple[list, list] = ([], [])
        for _, side, data in group:
            sides[side].append(data)
        one, two = (np.frombuffer(b"".join(x), _RECORD) for x in sides)
        seen: list[np.ndarray] = []
        for a, b in _meet(one, None if b1 == b2 else two):
            seen.append(np.stack((a, b), axis=1))
            if sum(map(len, seen)) > 2_000_000:
                yield _pairs(seen)
                seen = []
        if seen:
            yield _pairs(seen)


def _pairs(seen: list[np.ndarray]) -> pa.RecordBatch:
    found = np.unique(np.concatenate(seen), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def candidate_pairs(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(``a`` < ``b``) of records that meet in a table. prints: (``id``, ``print``), each id once."""
    n = prints.count()
    groups = int(min((2 * SEGMENTS) << HALF, max(2 * SEGMENTS, 4 * n * 2 * SEGMENTS // group_rows)))

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_group_of(_packed(batch), groups), minlength=groups)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["g", "n"])

    #: At most 131,072 groups, so what the driver gets is bounded, whatever the number of records.
    sizes = {r.g: r.n for r in prints.mapInArrow(sizes_of, "g INT, n BIGINT").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > group_rows).collect()}
    blocks = np.ones(groups, np.int64)
    for g, size in sizes.items():
        blocks[g] = -(-size // group_rows)
    sent = prints.sparkSession.sparkContext.broadcast(blocks)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            records = _packed(batch)
            group = _group_of(records, groups)
            block = mix64(records["id"].astype(np.uint64)) % blocks[group].astype(np.uint64)
            order = np.lexsort((block, group))
            records, group, block = records[order], group[order], block[order].astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (block[1:] != block[:-1]))))
            out: list[tuple] = []
            for start, stop in zip(cuts, [*cuts[1:], len(records)]):
                g, own, data = int(group[start]), int(block[start]), records[start:stop].tobytes()
                for other in range(int(blocks[g])):
                    out.append((g, min(own, other), max(own, other), int(own > other), data))
                    if len(out) >= 4096:
                        yield _spread_batch(out)
                        out = []
            if out:
                yield _spread_batch(out)

    rows = prints.mapInArrow(spread, "g INT, b1 INT, b2 INT, side INT, data BINARY")
    rows = rows.repartition("g", "b1", "b2").sortWithinPartitions("g", "b1", "b2")
    return rows.mapInArrow(_matches, "a BIGINT, b BIGINT").distinct()


def _spread_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["g", "b1", "b2", "side", "data"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("pa", "pb"))
            near = np.bitwise_count(p ^ q).sum(axis=1) <= DISTANCE
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _similarity(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, frozenset()
        for batch in batches:
            a_ids, b_ids, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, (a, b) in enumerate(zip(a_ids, b_ids)):
                if a != known:
                    known, own = a, pieces(batch.column("ta")[i].as_py())
                other = pieces(batch.column("tb")[i].as_py())
                both = len(own & other)
                j = both / (len(own) + len(other) - both) if own and other else 0.0
                if j >= threshold:
                    out.append((a, b, j))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return compare


def pieces(text: str) -> set[str]:
    t = canon.flat(text)
    return {t[k : k + PIECE] for k in range(max(1, len(t) - PIECE + 1))} if t else set()


def near_duplicate_pairs(table: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(``a`` < ``b``, ``similarity``) of all pairs of distinct records at or above ``threshold`` (0.8 at least)."""
    if threshold < 0.8:
        raise ValueError("the tables are laid out for thresholds of 0.8 and above")
    prints = materialize(signed(table, id_col, text_col), "prints")
    met = candidate_pairs(prints)
    first = met.join(prints.select(F.col("id").alias("a"), F.col("print").alias("pa")), "a").join(prints.select(F.col("id").alias("b"), F.col("print").alias("pb")), "b")
    near = materialize(first.mapInArrow(_near, "a BIGINT, b BIGINT"), "near")
    ids = materialize(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = materialize(rows.join(ids, "id").groupBy("id").agg(F.min("text").alias("text")), "near-texts")
    pairs = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return pairs.select("a", "b", "ta", "tb").mapInArrow(_similarity(threshold), "a BIGINT, b BIGINT, similarity DOUBLE")


def near_duplicate_groups(table: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(``id_col``, ``group_id``, ``record``, ``links``) of every row in a group of near duplicates.

    Groups are the connected components of the pairs, named by their smallest record; ``record`` is the smallest id of the
    row's exact copies, which share its links to different records. Copies are not expanded into pairs.
    """
    pairs = materialize(near_duplicate_pairs(table, id_col, text_col, threshold), "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    keys = materialize(keyed(table, id_col, text_col), "keys")
    named = components(pairs).join(links, "id").join(format_groups(keys).withColumnRenamed("keep", "id"), "id")
    records = materialize(named.select("h", "check", "copies", "links", F.col("id").alias("record"), F.col("label").alias("group_id")), "records")
    return join_hot_split(keys, records, ["h", "check"], "copies", keys.count()).select(F.col("id").alias(id_col), "group_id", "record", "links")

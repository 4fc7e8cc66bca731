"""Test items leaking into a corpus: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are reduced to lower-case letters and digits; shingles are all substrings of 5 characters. A document is cut into
windows of 512 shingles that overlap by half, so a passage of up to 256 shingles lies in one window whole, and a longer
one has 256 in one. Windows are partitioned by size. A partition with at most u shingles has so many MinHash bins that an
item of which ``LEAST`` is contained shares 12 bins with the window on average; 4 shared bins make a candidate. Items of
fewer than ``SHORT`` shingles are looked up by every shingle (see below). Items meet documents inside the tasks: no row is shuffled.

Each candidate is verified on the exact shingles: those on one diagonal of the two texts are laid over the item, and the
best unbroken passage is scored as covered characters less twice those not covered, as a share of the item. A passage of
half the item with a few words changed scores above 0.45; a question of the same form with other particulars scores below,
as what differs is spread all over it. An item of fewer than ``SHORT`` shingles would need about as many bins as a window has
shingles, so that each shingle has a bin of its own: looking up every shingle is that limit of the search.

Defined results: NULL, blank and all-symbol texts on either side match nothing; an item or document that is repeated gives
each pair once; rows without id take no part; whole texts are used; other columns are not read. Items are taken in blocks
of ``BLOCK``, so what a task holds is bounded whatever their number.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm import canon
from lodeflow.llm.near_dups import PIECE, piece_hashes
from lodeflow.operators.batches import mix64, spread, text_slices

WINDOW, STEP = 512, 256
PARTITIONS = (128, 256, WINDOW)
LEAST, SHARED, NEEDED, SHORT = 0.3, 12, 4, 48
SCORE, GAP, BAND = 0.45, 2.0, 16
BLOCK = 20_000
_NONE = np.iinfo(np.uint64).max


def bins_of(limit: int, item: int = 80) -> int:
    """Bins of the partition of windows up to ``limit``: SHARED divided by the least Jaccard similarity of a hit."""
    both = LEAST * item
    return math.ceil(SHARED * (limit + item - both) / both)


def _bin_values(h: np.ndarray, owner: np.ndarray, owners: int, bins: int) -> np.ndarray:
    """(owners, bins) least hash of each bin. A value tells its bin, so equal values mean equal bin and shingle."""
    least = np.full(owners * bins, _NONE, np.uint64)
    np.minimum.at(least, owner * bins + ((h >> np.uint64(43)) % np.uint64(bins)).astype(np.int64), h)
    return least.reshape(owners, bins)


class Items:
    """Test items made ready for the search. texts: question of each item."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        points, offsets = canon.flatten(texts)
        h, ends = piece_hashes(points, offsets)
        h = mix64(h)
        self.ids, self.lengths = ids, np.diff(offsets)
        self.shingles = []
        for i in range(len(ids)):
            own = h[ends[i] : ends[i + 1]]
            order = np.argsort(own, kind="stable")
            self.shingles.append((own[order], order))
        self.distinct = np.array([len(np.unique(s)) for s, _ in self.shingles])
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        short = self.distinct[owner] < SHORT
        self.short = self._table(h[short], owner[short])
        place = np.arange(len(h)) - np.repeat(ends[:-1], np.diff(ends))
        order = np.argsort(h, kind="stable")
        self.all = (np.ascontiguousarray(h[order]), (owner << 32 | place)[order], self._seen(h))
        self.tables = []
        for limit in PARTITIONS:
            least = _bin_values(h[~short], owner[~short], len(ids), bins_of(limit))
            item, _ = np.nonzero(least != _NONE)
            self.tables.append(self._table(least[least != _NONE], item))

    @staticmethod
    def _table(values: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted values, their items, and a filter of 2**20 bits' worth of places in front."""
        pairs = np.unique(np.stack((values, items.astype(np.uint64)), axis=1), axis=0) if len(values) else np.zeros((0, 2), np.uint64)
        return np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int64), Items._seen(values)

    @staticmethod
    def _seen(values: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << 20, bool)
        seen[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return seen

    @staticmethod
    def _look_up(table: tuple, values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, item) of each value found."""
        keys, items, seen = table
        some = seen[(values & np.uint64((1 << 20) - 1)).astype(np.int64)]
        values, owner = values[some], owner[some]
        lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        size = hi - lo
        at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(owner, size), items[at]

    def search(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(place of the text, place of the item, score) of every verified leak."""
        points, offsets = canon.flatten(texts)
        h, ends = piece_hashes(points, offsets)
        h = mix64(h)
        counts = np.diff(ends)
        per = np.where(counts > WINDOW, -(-(counts - WINDOW) // STEP) + 1, (counts > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(texts)), per)
        first = ends[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * STEP
        size = np.minimum(WINDOW, ends[doc + 1] - first)
        met: list[np.ndarray] = []  # text * number of items + item
        for (lower, limit), table in zip(zip((0, *PARTITIONS), PARTITIONS), self.tables):
            chosen = np.flatnonzero((size > lower) & (size <= limit))
            for some in np.array_split(chosen, len(chosen) // 4096 + 1):
                if not len(some):
                    continue
                at = np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
                owner = np.repeat(np.arange(len(some)), size[some])
                if len(table[0]):
                    least = _bin_values(h[at], owner, len(some), bins_of(limit))
                    windows, _ = np.nonzero(least != _NONE)
                    w, item = self._look_up(table, least[least != _NONE], windows)
                    pairs, shared = np.unique(w * len(self.ids) + item, return_counts=True)
                    w, item = np.divmod(pairs[shared >= NEEDED], len(self.ids))
                    met.append(doc[some[w]] * len(self.ids) + item)
                if len(self.short[0]):
                    w, item = self._look_up(self.short, h[at], owner)
                    met.append(np.unique(doc[some[w]] * len(self.ids) + item))
        out: dict[tuple[int, int], float] = {}
        for d, item, lo, hi in self._aligned(h, ends, np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)):
            score = self.verify(item, h[lo:hi])
            if score >= SCORE and score > out.get((d, item), 0):
                out[d, item] = score
        return [(d, i, s) for (d, i), s in out.items()]

    def _aligned(self, h: np.ndarray, ends: np.ndarray, met: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Of the pairs met those that share enough shingles on neighbouring diagonals: (text, item, stretch of h)."""
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        some = np.flatnonzero(np.isin(doc, met // max(1, len(self.ids))))
        p, code = self._look_up(self.all, h[some], some)
        item, k = code >> 32, code & 0xFFFFFFFF
        pair = doc[p] * len(self.ids) + item
        at = np.minimum(np.searchsorted(met, pair), max(0, len(met) - 1))
        kept = met[at] == pair if len(met) else np.zeros(len(pair), bool)
        p, item, k = p[kept], item[kept], k[kept]
        reach = int(self.lengths.max(initial=0)) // BAND + 2
        bands = len(h) // BAND + 2 * reach
        # Bands are counted over the whole batch of texts; a pair's own begin at its text, so texts don't mix.
        key = item * bands + (p - k) // BAND + reach
        order = np.argsort(key, kind="stable")
        key, p, item = key[order], p[order], item[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((starts, [len(key)])))
        keys = key[starts]
        follows = np.concatenate((keys[1:] == keys[:-1] + 1, [False])) if len(keys) else np.zeros(0, bool)
        both = size + np.where(follows, np.concatenate((size[1:], [0])), 0)
        own = item[starts]
        for g in np.flatnonzero(both >= LEAST * 0.8 * self.distinct[own]):
            i, length = int(own[g]), int(self.lengths[own[g]])
            for d in np.unique(doc[p[starts[g] : starts[g] + size[g]]]):
                at = int(keys[g] % bands - reach) * BAND
                yield int(d), i, max(int(ends[d]), at - BAND), min(int(ends[d + 1]), at + length + 3 * BAND)

    def verify(self, item: int, h: np.ndarray) -> float:
        """Score of the item's best unbroken passage in a stretch of a document, given by its shingles in order."""
        own, places = self.shingles[item]
        lo, hi = np.searchsorted(own, h, "left"), np.searchsorted(own, h, "right")
        size = hi - lo
        at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if len(np.unique(own[at])) < LEAST * self.distinct[item]:
            return 0.0
        k = places[at]
        band = (np.repeat(np.arange(len(h)), size) - k) // BAND
        band -= band.min()
        counts = np.bincount(band)
        length, best = int(self.lengths[item]), 0.0
        for b in np.flatnonzero(counts + np.concatenate((counts[1:], [0])) >= LEAST / 2 * self.distinct[item]):
            covered = np.zeros(length + PIECE, np.int64)
            starts = np.unique(k[(band == b) | (band == b + 1)])
            np.add.at(covered, starts, 1)
            np.add.at(covered, np.minimum(starts + PIECE, length), -1)
            gains = np.where(np.cumsum(covered[:length]) > 0, 1.0, -GAP)
            sums = np.concatenate(([0.0], np.cumsum(gains)))
            best = max(best, float((sums - np.minimum.accumulate(sums)).max()) / length)
        return best


@functools.lru_cache(maxsize=4)
def _ready(ids: tuple[int, ...], texts: tuple[str, ...]) -> Items:
    return Items(list(ids), list(texts))


def leaked_items(
    table: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "question"
) -> DataFrame:
    """(``id_col``, ``item_col``, ``score``) of the documents that hold an item or at least half of it."""
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    asked = items.select(F.col(item_col).cast("bigint"), F.col(question_col).cast("string")).where(F.col(item_col).isNotNull() & F.col(question_col).isNotNull())
    spark, parts, block = table.sparkSession, [], []

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast((tuple(i for i, _ in block), tuple(t for _, t in block)))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = _ready(*sent.value)
            for batch in batches:
                for part in text_slices(batch, "text", 1_000_000):
                    ids = part.column("id").to_pylist()
                    found = ready.search(part.column("text").to_pylist())
                    columns = ([ids[d] for d, _, _ in found], [ready.ids[i] for _, i, _ in found], [s for _, _, s in found])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["id", "item", "score"])

        return spread(rows).mapInArrow(search, "id BIGINT, item BIGINT, score DOUBLE")

    for item, text in asked.toLocalIterator():
        if canon.flat(text):
            block.append((item, text))
            if len(block) == BLOCK:
                parts.append(searched(block))
                block = []
    if block or not parts:
        parts.append(searched(block))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.max("score").alias("score"))

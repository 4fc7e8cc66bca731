"""Filling fixed-capacity containers: linear grouping, few-size configurations, substitution, best fit of small items.

What has to be decided depends on the lengths only, so the driver plans on their histogram, which has at most as many rows
as the capacity, whatever the number of items:

1. Lengths above capacity/``LARGE`` are large. In order of length they are cut into ``GROUPS`` groups of equal cardinality,
   each rounded up to its longest.
2. The configurations of these few sizes that cover all groups with the fewest containers are found by a linear program with
   columns generated by a knapsack. Whole numbers of containers are made of each; the few items that are left over follow one
   by one, best fit.
3. The actual items, by rank, take the places of the rounded ones.
4. Small items, longest first, go where they leave the least room.

The plan is a list of runs: items of one length and a range of ranks go to a range of containers. Items are sorted by length
and id in ranges; an item's rank is its ordinal less the number of shorter items, which the histogram tells, so no task holds
all items of a length and nothing but the histogram and the plan is sent round. With few different lengths no rounding is
needed, as groups of one length each lose nothing; it is the same grouping with the finest groups.
An item longer than the capacity fills containers of its own and its rest is packed like an item.

Defined results: NULL and empty items and rows without id take no part. Repeated rows are items of their own. The result
depends on ids and lengths only, not on the order or partitioning of the rows. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.operators.order import ranks, running
from lodeflow.session import materialize

LARGE, GROUPS = 8, 24


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 4_000) -> list[tuple[list[int], float]]:
    """(items of each size, containers) of the linear program's optimum. sizes: each at most ``capacity``.

    A round adds one configuration; a program of 48 sizes ends after a few hundred, and stopping earlier would cost room only.
    """
    m = len(sizes)
    basis = np.zeros((m, m))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    b = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        last = np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if price[i] <= 1e-12:
                continue
            for at in range(s, capacity + 1, s):
                stop = min(at + s, capacity + 1)
                gain = best[at - s : stop - s] + price[i]
                better = gain > best[at:stop] + 1e-12
                best[at:stop][better] = gain[better]
                last[at:stop][better] = i
        c = int(np.argmax(best))
        if best[c] <= 1 + 1e-9:
            break
        column = np.zeros(m)
        while c > 0 and last[c] >= 0:
            column[last[c]] += 1
            c -= sizes[last[c]]
        amount, direction = inverse @ b, inverse @ column
        ratios = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = column
    amount = np.linalg.solve(basis, b)
    return [([int(x) for x in basis[:, k]], float(amount[k])) for k in range(m) if amount[k] > 1e-9]


class Plan:
    """Runs (length, first rank, last rank + 1, first container, items per container), and the number of containers."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        #: residual room -> runs of containers (first, number)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.used: dict[int, int] = defaultdict(int)
        large = sorted(((l, n) for l, n in histogram.items() if l * LARGE > capacity), reverse=True)
        self._large(large)
        for length in sorted((l for l in histogram if l * LARGE <= capacity), reverse=True):
            self._best_fit(length, histogram[length])

    def _free(self, room: int, first: int, number: int) -> None:
        if room and number:
            if room not in self.room:
                bisect.insort(self.rooms, room)
            self.room[room].append((first, number))

    def _large(self, lengths: list[tuple[int, int]]) -> None:
        total = sum(n for _, n in lengths)
        if not total:
            return
        ends = np.cumsum([n for _, n in lengths])
        if len(lengths) <= 2 * GROUPS:  # so few lengths need no rounding
            cuts = np.concatenate(([0], ends))
        else:
            cuts = np.unique(np.linspace(0, total, min(GROUPS, total) + 1).round().astype(int))
        at = lambda rank: lengths[int(np.searchsorted(ends, rank, "right"))][0]
        # places of one group: ranks over all large items, longest first
        sizes = [at(int(c)) for c in cuts[:-1]]
        demand = np.diff(cuts)
        merged: dict[int, list[int]] = defaultdict(list)
        for g, s in enumerate(sizes):
            merged[s].append(g)
        distinct = sorted(merged, reverse=True)
        first = [int(cuts[merged[s][0]]) for s in distinct]
        number = [int(sum(demand[g] for g in merged[s])) for s in distinct]
        taken = [0] * len(distinct)
        for pattern, amount in configurations(distinct, number, self.capacity):
            whole = int(min([amount + 1e-9, *((number[i] - taken[i]) / a for i, a in enumerate(pattern) if a)]))
            if whole < 1:
                continue
            places = [(first[i] + taken[i], a) for i, a in enumerate(pattern) if a]
            self._fill(lengths, ends, places, whole)
            for i, a in enumerate(pattern):
                taken[i] += a * whole
        left = []
        for i in range(len(distinct)):
            for rank in range(first[i] + taken[i], first[i] + number[i]):
                left.append(rank)
        for length, n in self._by_length(lengths, ends, left):
            self._best_fit(length, n)

    def _by_length(self, lengths: list[tuple[int, int]], ends: np.ndarray, ranks: list[int]) -> list[tuple[int, int]]:
        counts: dict[int, int] = defaultdict(int)
        for r in ranks:
            counts[lengths[int(np.searchsorted(ends, r, "right"))][0]] += 1
        return sorted(counts.items(), reverse=True)

    def _fill(self, lengths: list[tuple[int, int]], ends: np.ndarray, places: list[tuple[int, int]], whole: int) -> None:
        """``whole`` containers take ``a`` items each from every place's ranks on, in order."""
        first = self.containers
        self.containers += whole
        steps = {0, whole}
        spans = []
        for start, a in places:
            k = int(np.searchsorted(ends, start, "right"))
            at, rest = start, a * whole
            span = []
            while rest:
                take = min(rest, int(ends[k]) - at)
                span.append((lengths[k][0], at - start, at - start + take))
                at, rest, k = at + take, rest - take, k + 1
            spans.append((a, span))
            for _, lo, hi in span:
                steps.update((lo // a, -(-lo // a), hi // a, -(-hi // a)))
        order = sorted(s for s in steps if s <= whole)
        filled = np.zeros(len(order), np.int64)
        for a, span in spans:
            for length, lo, hi in span:
                # the middle of a span fills whole containers, its ends may share one with another length
                for x, y in ((lo, min(hi, -(-lo // a) * a)), (-(-lo // a) * a, hi // a * a), (max(lo, hi // a * a, -(-lo // a) * a), hi)):
                    if x < y:
                        self._record(length, y - x, first + x // a, a if x % a == 0 and y % a == 0 else y - x)
                        filled[bisect.bisect_left(order, x // a) : bisect.bisect_left(order, -(-y // a))] += length * (a if x % a == 0 and y % a == 0 else y - x)
        for k in range(len(order) - 1):
            self._free(self.capacity - int(filled[k]), first + order[k], order[k + 1] - order[k])

    def _record(self, length: int, n: int, container: int, per: int) -> None:
        rank = self.used[length]
        self.runs.append((length, rank, rank + n, container, per))
        self.used[length] += n

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = self.capacity // length
                number = max(1, n // per)
                self._free(self.capacity, self.containers, number)
                self.containers += number
                continue
            room = self.rooms[k]
            runs = self.room[room]
            first, number = runs.pop()
            if not runs:
                del self.room[room]
                del self.rooms[k]
            per = min(room // length, n)
            whole = min(number, n // per)
            self._record(length, per * whole, first, per)
            n -= per * whole
            self._free(room - per * length, first, whole)
            self._free(room, first + whole, number - whole)

    def arrays(self) -> dict[str, np.ndarray]:
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return {"length": runs[:, 0], "lo": runs[:, 1], "container": runs[:, 3], "per": runs[:, 4]}


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    return Plan({int(l): int(n) for l, n in histogram.items() if n}, capacity)


def pack_items(items: DataFrame, capacity: int, id_col: str = "id", length_col: str = "length") -> DataFrame:
    """(``id_col``, ``part``, ``length``, ``container``) of every item with a length, parts in order from 0.

    Containers are numbered from 0: those filled by whole pieces of over-long items come after all others.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(length_col).cast("bigint").alias("total")).where("id IS NOT NULL AND total > 0")
    cut = rows.withColumn("pieces", F.expr(f"total div {capacity}")).withColumn("length", F.expr(f"total - pieces * {capacity}"))
    base = materialize(cut, "items")
    tails = base.where("length > 0").select("id", F.col("pieces").alias("part"), "length")
    #: At most as many rows as the capacity.
    histogram = {r.length: r.n for r in tails.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_containers(histogram, capacity)
    below = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        below[length + 1 :] += n
    sent = items.sparkSession.sparkContext.broadcast((plan.arrays(), below))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, below = sent.value
        # one sortable key of length and first rank
        span = int(runs["lo"].max(initial=0)) + 1
        keys = runs["length"] * span + runs["lo"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("ordinal")) - below[length]
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            container = runs["container"][at] + (rank - runs["lo"][at]) // runs["per"][at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("length"), pa.array(container)], ["id", "part", "length", "container"])

    ordered = ranks(tails, ["length", "id", "part"], "ordinal").select("id", "part", "length", "ordinal")
    packed = ordered.mapInArrow(place, "id BIGINT, part BIGINT, length BIGINT, container BIGINT")
    done = running(base.where("pieces > 0").select("id", "total", "pieces"), ["id", "total"], "pieces", "done")
    placed = done.select("id", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"), (F.col("done") + plan.containers).alias("start"))
    full = placed.select("id", F.col("part").cast("bigint").alias("part"), F.lit(capacity).cast("bigint").alias("length"), (F.col("start") + F.col("part")).alias("container"))
    return packed.unionByName(full).withColumnRenamed("id", id_col)


def text_lengths(table: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(``id``, ``length``): code points of each text."""
    return table.select(F.col(id_col).alias("id"), F.length(F.col(text_col)).alias("length"))


def conversation_lengths(table: DataFrame, id_col: str, messages_col: str = "conversations") -> DataFrame:
    """(``id``, ``length``): the sum of the contents' code points. A conversation sent twice counts once."""
    total = F.aggregate(F.col(messages_col), F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    return table.select(F.col(id_col).alias("id"), total.alias("length")).groupBy("id").agg(F.max("length").alias("length"))

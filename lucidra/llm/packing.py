"""Filling fixed-capacity containers with items (problem 8).

Shortest-pack-first over the length histogram: only the counts per length (at most one entry per
token of capacity) go to the driver, where lengths are placed longest first into the container
pattern that is shortest so far, whole groups of equal containers at a time. Patterns are then joined
back to the pieces by their rank among the pieces of equal length, which is counted in parts, so that
one very common length never gathers in one task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.util import cut

#: Least number of parts in which ranks are counted, and rows per part beyond which there are more.
PARTS, PART_ROWS = 64, 1_000_000


@dataclass(frozen=True)
class Pattern:
    """``count`` equal containers that hold ``items``: (length, how many of it)."""

    items: tuple[tuple[int, int], ...]
    count: int

    @property
    def used(self) -> int:
        """Tokens in each of the containers."""
        return sum(length * n for length, n in self.items)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every item of the histogram (length -> count, lengths within the capacity).

    Longest first; each goes where most room is left, if it fits there, else into new containers. Groups of
    equal containers are split at most once per placement, so there are never more than about twice as
    many patterns as lengths.
    """
    groups: dict[tuple[int, tuple], int] = defaultdict(int)
    heap: list[tuple[int, tuple]] = []

    def push(used: int, items: tuple, n: int) -> None:
        if (used, items) not in groups:
            heapq.heappush(heap, (used, items))
        groups[used, items] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a capacity of {capacity}")
        while left:
            if heap and heap[0][0] + length <= capacity:
                used, items = heapq.heappop(heap)
                have = groups.pop((used, items))
                taken = min(left, have)
                if have > taken:
                    push(used, items, have - taken)
                more = items[:-1] + ((length, items[-1][1] + 1),) if items and items[-1][0] == length else items + ((length, 1),)
                push(used + length, more, taken)
                left -= taken
            else:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    push(each * length, ((length, each),), full)
                if rest:
                    push(rest * length, ((length, rest),), 1)
                left = 0
    return [Pattern(items, n) for (_, items), n in sorted(groups.items())]


def ranked_within(df: DataFrame, group: list[str], order: str, parts: int = PARTS) -> DataFrame:
    """Adds ``rank``, 0, 1, ... within each group, as a sum of counts of parts and a rank inside the part."""
    part = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
    sizes = part.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = part.withColumn("_r", F.row_number().over(W.partitionBy(*group, "_part").orderBy(order)) - 1)
    return inner.join(offsets, [*group, "_part"]).withColumn("rank", F.col("_before") + F.col("_r")).drop("_part", "_r", "_before")


def pieces_of(df: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """``item, piece, start, length``: items cut into pieces, only where they exceed the capacity; size 0 gives none."""
    n = F.col(size)
    count = F.ceil(n / F.lit(capacity)).cast("int")
    some = df.where(n > 0).select(F.col(item).alias("item"), n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return some.select("item", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("length"))


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, items per container, first container and fill of every pattern that holds it."""
    slots: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    first = 0
    for p in patterns:
        for length, n in p.items:
            slots[length].append((rank[length], n, first, p.used))
            rank[length] += n * p.count
        first += p.count
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in slots.items()}


def pack(df: DataFrame, item: str, size: str, capacity: int) -> tuple[DataFrame, list[Pattern]]:
    """(placement, patterns) of all items of one capacity.

    placement: ``item, piece, start, length, container, used``; every piece is in exactly one container, whose
    used tokens never exceed the capacity. Items with null or zero size have no piece. The patterns (at most
    about twice as many as there are lengths up to the capacity) are broadcast.
    """
    pieces = cut(pieces_of(df, item, size, capacity))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = pack_histogram(histogram, capacity)
    parts = max(PARTS, max(histogram.values(), default=0) // PART_ROWS)
    shared = pieces.sparkSession.sparkContext.broadcast(_slots(patterns))
    kind = pieces.schema["item"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        for pdf in batches:
            container, used = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                at = order[lo:hi]
                if not len(at):
                    continue
                starts, each, first, fill = slots[int(length[at[0]])]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                container[at] = first[k] + (rank[at] - starts[k]) // each[k]
                used[at] = fill[k]
            yield pdf[["item", "piece", "start", "length"]].assign(container=container, used=used)

    ranked = ranked_within(pieces.withColumn("_o", F.struct("item", "piece")), ["length"], "_o", parts).drop("_o")
    placed = ranked.select("item", "piece", "start", "length", "rank").mapInPandas(
        place, f"item {kind}, piece int, start long, length long, container long, used long"
    )
    return placed, patterns

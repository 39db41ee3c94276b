"""Items of varying length filled into fixed-capacity containers with little unused space.

Pattern packing by non-negative least squares: lengths go into a histogram; patterns of a few lengths
that fill a container are enumerated; their repeat counts are fitted to the histogram by non-negative
least squares and rounded down; what the patterns leave over is packed largest first. All of that
works on the histogram (at most `capacity` distinct lengths), so its cost does not depend on the
number of documents. A text longer than a container is cut into full containers and one rest, which is
packed like any other item; no other text is split.

Scale: lengths are counted once and written to the shared checkpoint folder together with their
partition number. The rank of an item among its length is its rank within the partition plus the
partition's offset, so no length, however common, is gathered in one task. Ranks turn into container
numbers by a lookup in the pattern table (a few thousand rows, bounded by capacity).

Defined results: null, empty and blank-to-zero texts have length 0 and share container 0 with whatever
stands there; every other item has exactly one container; repeated ids are items of their own; an
empty table gives an empty result; containers are numbered from 0 without gaps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carbonweave.session import cut, small

CAPACITY = 2048
BUCKETS = 64
DEEPEST = 3


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):  # noqa: ANN201
    """A public byte-level BPE from its rank file; the file's path is a parameter and is read where the work runs."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path, pattern)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_tokens bigint")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient."""
    x = np.zeros(a.shape[1])
    y, t = x.copy(), 1.0
    gram, rhs = a.T @ a, a.T @ b
    step = 1.0 / max(np.linalg.norm(gram, np.inf), 1e-9)
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - step * (gram @ y - rhs))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def patterns(levels: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Sets of up to DEEPEST of the given lengths that fill at least 15/16 of a container."""
    out: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], total: int, first: int) -> None:
        if total >= capacity - capacity // 16:
            out.append(chosen)
        if len(chosen) < DEEPEST:
            for k in range(first, len(levels)):
                if total + levels[k] <= capacity:
                    grow((*chosen, k), total + levels[k], k)

    grow((), 0, 0)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(exact lengths in a container, repeats) that together use up the histogram of lengths 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if 0 < size <= capacity:
            left[size] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def largest(most: int, spare: dict[int, int]) -> int:
        """The largest length up to `most` that is still there beyond what this container has taken; 0 if none."""
        s = most
        while s > 0:
            there = np.flatnonzero(left[1 : s + 1])
            if not len(there):
                return 0
            s = int(there[-1]) + 1
            if left[s] > spare.get(s, 0):
                return s
            s -= 1
        return 0

    def put(wanted: list[tuple[int, int]], repeats: int) -> int:
        """Fills one kind of container: first a length from each wanted range, then the largest that fit. Returns repeats used."""
        used: dict[int, int] = {}
        room = capacity
        for low, high in wanted:
            s = largest(min(high, room), used)
            if s < low:
                return 0
            used[s] = used.get(s, 0) + 1
            room -= s
        while room > 0 and (s := largest(room, used)):
            used[s] = used.get(s, 0) + 1
            room -= s
        times = min([repeats, *(int(left[s]) // k for s, k in used.items())])
        if times <= 0 or not used:
            return 0
        for s, k in used.items():
            left[s] -= k * times
        out.append((tuple(sorted((s for s, k in used.items() for _ in range(k)), reverse=True)), times))
        return times

    width = -(-capacity // BUCKETS)
    tops = [min(capacity, (k + 1) * width) for k in range(BUCKETS)]
    counts = np.array([left[k * width + 1 : tops[k] + 1].sum() for k in range(BUCKETS)], float)
    live = [k for k in range(BUCKETS) if counts[k]]
    mids = [k * width + width // 2 for k in live]
    found = patterns(mids, capacity)
    if found:
        a = np.zeros((len(live), len(found)))
        for j, p in enumerate(found):
            for k in p:
                a[k, j] += 1
        # Short lengths can be filled in anywhere; long ones must fit now.
        weight = np.sqrt(np.array(mids) / capacity)
        scale = counts.sum()
        fitted = nnls(a * weight[:, None], counts[live] / scale * weight) * scale
        for j in np.argsort(-fitted):
            repeats = int(fitted[j])
            ranges = [(live[k] * width + 1, tops[live[k]]) for k in sorted(found[j], reverse=True)]
            while repeats > 0 and (used := put(ranges, repeats)):
                repeats -= used
    total = int(left.sum())
    while total > 0:
        put([], total)
        total = int(left.sum())
    return out


class Slots:
    """Rank of an item among its length -> container number."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], first: int = 0) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        for sizes, repeats in planned:
            for s in set(sizes):
                k = sizes.count(s)
                rows.setdefault(s, []).append((taken.get(s, 0), first, k))
                taken[s] = taken.get(s, 0) + k * repeats
            first += repeats
        self.rows = {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()}
        self.containers = first

    def of(self, size: int, ranks: np.ndarray) -> np.ndarray:
        starts, firsts, per = self.rows[size]
        k = np.searchsorted(starts, ranks, side="right") - 1
        return firsts[k] + (ranks - starts[k]) // per[k]


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, piece_tokens, container for every item; pieces of an over-long item are numbered from 0."""
    kind = sizes.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.maximum(np.asarray(batch.column(1).fill_null(0)), 0)
            count = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(capacity, n[row] - piece * capacity)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(size)], ["doc", "piece", "size"])

    cutup = sizes.select(F.col(id_col).alias("doc"), F.col(size_col).cast("bigint").alias("n")).mapInArrow(pieces, f"doc {kind}, piece int, size bigint")
    items = cut(cutup.withColumn("part", F.spark_partition_id()))
    counts = cut(items.groupBy("part", "size").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("size").agg(F.sum("n")).collect()}  # at most capacity + 1 rows
    slots = Slots(plan(histogram, capacity))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            part, size = np.asarray(batch.column("part")).astype(np.int64), np.asarray(batch.column("size"))
            local = np.zeros(len(size), np.int64)
            order = np.lexsort((np.arange(len(size)), size, part))
            edges = np.flatnonzero(np.diff(part[order]) | np.diff(size[order])) + 1
            for group in np.split(order, edges):
                if len(group):
                    key = (int(part[group[0]]), int(size[group[0]]))
                    at = seen.get(key, 0)
                    local[group] = at + np.arange(len(group))
                    seen[key] = at + len(group)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(local)], ["doc", "piece", "size", "part", "local"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = np.asarray(batch.column("size")), np.asarray(batch.column("rank"))
            container = np.zeros(len(size), np.int64)
            for s in np.unique(size[size > 0]):
                at = size == s
                container[at] = slots.of(int(s), rank[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(container)], ["doc", "piece", "piece_tokens", "container"])

    local = items.mapInArrow(ranked, f"doc {kind}, piece int, size bigint, part int, local bigint")
    side = offsets.select("part", "size", "offset")
    joined = local.join(small(side), ["part", "size"]).select("doc", "piece", "size", (F.col("local") + F.col("offset")).alias("rank"))
    return joined.mapInArrow(placed, f"doc {kind}, piece int, piece_tokens bigint, container bigint").withColumnRenamed("doc", id_col)

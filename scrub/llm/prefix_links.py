"""Links between sets of shingles that another search has missed: an exact join by prefixes (Chaudhuri, Ganti and Kaushik, 2006).

All shingles have one order, common ones last. Two sets of Jaccard similarity t or more share one of the
first |s| - ceil(t |s|) + 1 of their shingles in it, whatever the order. So sets meet by these, dealt by Spark. Sets that
are known to be in one component needn't meet. Two sets that must share o shingles have the first of them at place |s| - o
or before in each (places from 0), so at any later place they don't meet: with rare shingles first, sets that share many but too
few seldom have such a place, however many such sets there are. Pairs are told apart by parities of their
shingles next, which differ in no more bits than the sets in shingles; the rest are compared in full. Nothing is left to chance, and
no group of sets, however large, is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, releasing, sieve, sifted

#: Shingles that are counted at once, the least count that is told, and the common shingles that come last in the order. These
#: settle how many pairs meet, not which links are found.
COUNTED, TOLD, COMMON = 1 << 21, 3, 1 << 17
#: Rows that a task takes up before it looks for pairs, the sets of a shingle up to which these are compared by distance, and the
#: meetings in which a task looks for repeated ones.
HELD, FEW, MET = 1 << 16, 64, 1 << 20
#: Rows that a task sorts: at least, where there are so many, and about.
LEAST_TASK_ROWS, TASK_ROWS = 20_000, 250_000


def _by_key(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, about n of them, dealt by key and sorted; tasks are small, since executors keep the memory of the largest sort."""
    tasks = max(1, min(partitions(rows.sparkSession), n // LEAST_TASK_ROWS), n // TASK_ROWS)
    return rows.repartition(tasks, "key").sortWithinPartitions("key", "place", "node")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """About the COMMON shingles that most sets have, the most common last. COMMON numbers at most come to the driver."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= TOLD]), pa.array(n[n >= TOLD])], ["h", "n"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= COUNTED:
                yield told()
                held = []
        if held:
            yield told()

    most = sets.select("s").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON)
    return most.toArrow().column("h").to_numpy()[::-1]


def first_shingles(sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(key, place, node, label): the first shingles of each set of ``sets`` (node, s ascending, label or null); place is size << 32 | place in the set."""
    common = common_shingles(sets)
    by_hash = np.argsort(common, kind="stable")
    known, rank = common[by_hash], by_hash + 1

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1 << 10):
                part = batch.slice(a, 1 << 10)
                size = pc.list_value_length(part.column("s")).to_numpy(zero_copy_only=False).astype(np.int64)
                h = part.column("s").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(part)), size)
                order = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    order = np.where(known[at] == h, rank[at], 0)
                by = np.argsort(row << 32 | order, kind="stable")
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                first = place <= (size - _least(size, similar))[row]
                row = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[by][first]), pa.array((np.repeat(size, size) << 32 | place)[first]), part.column("node").take(row), part.column("label").take(row)], ["key", "place", "node", "label"]
                )

    return sets.select("node", "s", "label").mapInArrow(run, "key long, place long, node long, label long")


def _least(size: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Shingles that a set shares at least with one of similarity ``similar`` or more: t |s|, rounded up."""
    return -(-similar[0] * size // similar[1])


def _needed(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Shingles that sets of these sizes share at least if their similarity is ``similar``: t / (1 + t) (|a| + |b|), rounded up."""
    return -(-similar[0] * (a + b) // (similar[0] + similar[1]))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of whole keys, many keys at a time, without repeated (key, node), of keys that sets of several labels have. Rows come sorted by key, place and node."""

    def mixed(columns: list[np.ndarray]) -> list[np.ndarray]:
        key, node = columns[0], columns[2]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        columns = [c[new] for c in columns]
        key, label = columns[0], columns[3]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start)
        keep = np.repeat(several, np.diff(np.append(start, len(key))))
        return [c[keep] for c in columns]

    held: list[list[np.ndarray]] = []
    fresh = 0
    for batch in batches:
        if not len(batch):
            continue
        label = pc.coalesce(batch.column("label"), batch.column("node"))
        held.append([c.to_numpy(zero_copy_only=False) for c in (*batch.columns[:3], label)])
        fresh += len(batch)
        if fresh >= HELD:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last:
                yield mixed([c[:last] for c in columns])
            held, fresh = [[c[last:] for c in columns]], 0
    if held:
        yield mixed([np.concatenate(c) for c in zip(*held, strict=True)])


def _pairs(key: np.ndarray, place: np.ndarray, label: np.ndarray, similar: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of one key and different labels, in parts: all where the key may be the first shingle that sets of similarity ``similar`` share.

    Rows come sorted by key and place. Of the sets of a key only those are looked at whose sizes allow for it.
    """
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(key)))
    size, at = place >> 32, place & 0xFFFFFFFF
    bucket = np.repeat(np.arange(len(start)), n) << 32
    largest = np.maximum(similar[1] * size - (similar[0] + similar[1]) * at, 0) // similar[0]  # that a set no larger meets at this place
    end = np.searchsorted(bucket | size, bucket | largest, "right")

    def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        needed = _needed(size[i], size[j], similar)
        first = (label[i] != label[j]) & (at[i] + needed <= size[i]) & (at[j] + needed <= size[j])
        return i[first], j[first]

    i, d = np.flatnonzero(np.repeat(n <= FEW, n)), 1
    while len(i := i[i + d < end[i]]):
        yield may(i, i + d)
        d += 1
    for a, m in zip(start[n > FEW].tolist(), n[n > FEW].tolist(), strict=True):
        of, of_size = label[a : a + m], size[a : a + m]
        names, count = np.unique(of, return_counts=True)
        minor = of != names[np.argmax(count)]  # each row that isn't of the largest label against all others
        low = np.searchsorted(of_size, _least(of_size, similar))
        for x in np.flatnonzero(minor).tolist():
            other = np.arange(low[x], max(x, end[a + x] - a))
            other = other[~minor[other] | (other > x)]
            yield may(np.minimum(other, x) + a, np.maximum(other, x) + a)


def parity(s: np.ndarray) -> bytes:
    """How many hashes, modulo 2, fall to each of a power of two of bits, two for a hash or more."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def parities(named: DataFrame) -> DataFrame:
    """(node, n, p): size and ``parity`` of each set of ``named`` (node, s)."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [parity(s.values.to_numpy(zero_copy_only=False)) for s in batch.column("s")]
            size = pc.list_value_length(batch.column("s")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), size, pa.array(of, pa.binary())], ["node", "n", "p"])

    return named.select("node", "s").mapInArrow(run, "node long, n long, p binary")


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which parities differ; the longer ones are folded to the length of the others."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def nodes_of(pairs: DataFrame) -> DataFrame:
    """(node), each once: the ends of pairs (u, v). Each task first tells its ends apart, so that no row is made for each end of each pair."""
    return pairs.select(F.col("u").alias("node")).distinct().union(pairs.select(F.col("v").alias("node")).distinct()).distinct()


def _near(pairs: DataFrame, marks: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) whose parities, of ``marks`` (node, n, p), don't rule out a similarity of ``similar``."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "n"))
            most = a + b - 2 * _needed(a, b, similar)
            p, q = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("p", "q"))
            near = [_apart(x, y) <= m for x, y, m in zip(p, q, most.tolist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    a, b = marks.select(F.col("node").alias("u"), F.col("n").alias("m"), "p"), marks.select(F.col("node").alias("v"), "n", F.col("p").alias("q"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "m", "n", "p", "q").mapInArrow(sift, "u long, v long")


def missed_links(sets: DataFrame, labels: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(u, v): all pairs of nodes whose sets have a Jaccard similarity of ``similar`` or more and that ``labels`` doesn't have in one component.

    ``sets`` has node and s, distinct shingles in ascending order; a node may come more than once, with one set. ``labels`` has
    node and component; a node that isn't there is a component of its own. Empty sets are linked to one of them.
    """
    several = sieve(labels, F.col("node"))
    alone = sifted(sets, F.col("node"), several, inside=False).withColumn("label", F.lit(None).cast("long"))
    known = sifted(sets, F.col("node"), several, inside=True).join(labels.select("node", F.col("component").alias("label")), "node", "left")
    rows = first_shingles(alone.unionByName(known), similar)
    shingles = sets.agg(F.sum(F.size("s"))).first()[0] or 0

    @releasing
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, place, node, label in _buckets(batches):
            held, n = [], 0

            def told() -> pa.RecordBatch:
                u, v = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.lexsort((v, u))
                u, v = u[order], v[order]
                new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
                return pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new])], ["u", "v"])

            for i, j in _pairs(key, place, label, similar):
                if len(i):
                    held.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
                    n += len(i)
                if n >= MET:
                    yield told()
                    held, n = [], 0
            if held:
                yield told()

    dealt = _by_key(rows, shingles - shingles * similar[0] // similar[1])
    met = materialize(dealt.mapInArrow(meet, "u long, v long").distinct(), "met")
    marks = parities(sifted(sets, F.col("node"), sieve(nodes_of(met), F.col("node")), inside=True))
    pairs = materialize(_near(met, marks.groupBy("node").agg(F.first("n").alias("n"), F.first("p").alias("p")), similar), "pairs")
    named = sifted(sets, F.col("node"), sieve(nodes_of(pairs), F.col("node")), inside=True)
    whole = materialize(named.groupBy("node").agg(F.first("s").alias("s")), "sets")
    a, b = (whole.select(F.col("node").alias(n), F.col("s").alias(s)) for n, s in (("u", "a"), ("v", "b")))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    links = both.filter(F.col("common") * similar[1] >= (F.col("total") - F.col("common")) * similar[0]).select("u", "v")
    empty = sets.filter(F.size("s") == 0).select("node").distinct()
    return materialize(links.union(empty.crossJoin(F.broadcast(empty.agg(F.min("node").alias("v")))).select("node", "v").filter("node <> v")), "links")

"""Near-duplicates by SimHash: fingerprints of word shingles, linked where few bits differ.

Search follows a Gray-order hierarchical index (Tang et al., 2015). A node of the index is a set of
fingerprints that agree on the bits of a mask. Children share more: the bits that still vary are cut
into one more block than bits may differ, so that any two linked fingerprints meet in a child whose
block they have in common. Nodes grow smaller that way until they are leaves. In a leaf fingerprints
are sorted by Gray rank, so that neighbours share most bits; runs of them get masks of their own, whole
runs are passed over once the differences of their shared bits add up to too many, and only the rest
is compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .components import components

SEED = 42
#: Fingerprints of a node that are compared in one task; larger nodes are split.
LEAF = 2_048
#: Fingerprints in a run of a leaf.
RUN = 32
#: Shingles that are hashed at once.
BLOCK = 1 << 16


def shingle_bytes(text: str | None, width: int) -> Iterator[bytes]:
    """The word shingles of a text, repeats included: A-Z in lower case, words joined by single blanks; one of all words where there are fewer than ``width``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True):
        yield joined[s:e]


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint: a bit is set if it is in over half of the hashes of the text's word shingles."""
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    shingles = shingle_bytes(text, width)
    while len(h := np.array([digest(x, SEED) for x in islice(shingles, BLOCK)], ">u8")):
        votes += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null, empty and blank texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order: neighbours there differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def leaf_links(fps: np.ndarray, most: int) -> np.ndarray:
    """Pairs (i, j) of places in ``fps`` that differ in at most ``most`` bits, enough of them to connect all that links connect.

    ``fps`` are distinct. Runs of RUN in Gray order get the mask of bits that they share; run pairs
    whose shared bits differ too much are passed over, level by level for runs of runs.
    """
    order = np.argsort(gray_rank(fps), kind="stable")
    x = fps[order]
    low, high = [np.bitwise_and.reduceat(x, np.arange(0, len(x), RUN))], [np.bitwise_or.reduceat(x, np.arange(0, len(x), RUN))]
    while len(low[-1]) > RUN:
        at = np.arange(0, len(low[-1]), RUN)
        low.append(np.bitwise_and.reduceat(low[-1], at))
        high.append(np.bitwise_or.reduceat(high[-1], at))
    a, b = np.triu_indices(len(low[-1]))
    for level in range(len(low) - 1, -1, -1):
        shared = ~(low[level] ^ high[level])
        near = np.bitwise_count((low[level][a] ^ low[level][b]) & shared[a] & shared[b]) <= most
        a, b = a[near], b[near]
        if level:
            width = len(low[level - 1])
            kids = np.arange(RUN)
            a2 = np.repeat(a[:, None] * RUN + kids, RUN, 1).ravel()
            b2 = np.tile(b[:, None] * RUN + kids, RUN).ravel()
            keep = (a2 <= b2) & (a2 < width) & (b2 < width)
            a, b = a2[keep], b2[keep]
    found = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        u, v = np.nonzero(np.bitwise_count(x[i * RUN : (i + 1) * RUN, None] ^ x[None, j * RUN : (j + 1) * RUN]) <= most)
        keep = (i != j) | (u < v)
        found.append(np.stack([u[keep] + i * RUN, v[keep] + j * RUN], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return order[pairs]


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest node that each of 0 .. n-1 is connected to."""
    label = np.arange(n)
    while len(pairs):
        least = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _solve(fps: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) between ids that connect what a node's links connect: one for each fingerprint at most."""
    if len(fps) == 2:
        return (ids[1:], ids[:1]) if int(np.bitwise_count(fps[0] ^ fps[1])) <= most else (ids[:0], ids[:0])
    label = _forest(len(fps), leaf_links(fps, most))
    other = label != np.arange(len(fps))
    return ids[other], ids[label[other]]


def _leaf_edges(rows: DataFrame, most: int) -> DataFrame:
    """Edges of all leaves; ``rows`` (node, fp, id) is dealt by node and read run by run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            node, fp, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
            cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            many = np.flatnonzero(np.diff(cuts) > 1)
            edges = [_solve(fp[a:b].view(np.uint64), ids[a:b], most) for a, b in zip(cuts[many].tolist(), cuts[many + 1].tolist(), strict=True)]
            if edges:
                u, v = (np.concatenate(c) for c in zip(*edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(batch):
                continue
            if held and held[0][0][-1] != part[0][0]:
                yield from close(held)
                held = []
            last = int(np.argmax(part[0] == part[0][-1]))
            if last:
                held.append([c[:last] for c in part])
                yield from close(held)
                held = []
            held.append([c[last:] for c in part])
        if held:
            yield from close(held)

    return rows.select("node", "fp", "id").repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node").mapInArrow(run, "u long, v long")


def _blocks(vary: Column, n: int) -> Column:
    """Masks of the bits that vary, dealt to n blocks: array of n longs. The k-th varying bit goes to block k modulo n."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", vary, i) == 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.aggregate(
            F.filter(bits, lambda b, i: i % n == k), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
        ),
    )


def link_edges(distinct: DataFrame, most: int = 3, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) of ids that connect all fingerprints which links of at most ``most`` bits connect.

    ``distinct`` has fp (each once) and id. The first level has a node for each value of each of
    most + 1 blocks of 16 bits. A node of over ``leaf`` fingerprints is split on the bits that vary in
    it; if no more than ``most`` vary, all its fingerprints are linked to one another already.
    """
    n = most + 1
    step = 64 // n
    masks = [((1 << (64 if k == n - 1 else step * (k + 1))) - (1 << step * k)) for k in range(n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    blocks = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)))
    rows = distinct.select("fp", "id", F.explode(blocks).alias("b")).select(F.xxhash64("b.k", "b.bits").alias("node"), "fp", "id")
    found = None
    while True:
        rows = materialize(rows, "nodes")
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("vary"), F.min("id").alias("least"))
        large = materialize(nodes.filter(F.col("n") > leaf).drop("n"), "large")
        some = not large.isEmpty()
        edges = _leaf_edges(rows.join(large, "node", "left_anti") if some else rows, most)
        if some:
            inner = rows.join(large, "node")
            dense = F.bit_count("vary") <= most
            edges = edges.union(inner.filter(dense & (F.col("id") != F.col("least"))).select(F.col("id").alias("u"), F.col("least").alias("v")))
            parts = large.filter(~dense).select("node", F.posexplode(_blocks(F.col("vary"), n)).alias("k", "mask"))
        found = edges if found is None else found.union(edges)
        if not some:
            return found
        found = materialize(found, "links")
        rows = rows.join(parts, "node").select(F.xxhash64("node", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"), "fp", "id")


def _groups(prints: DataFrame, most: int, leaf: int) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint; component_id is the smallest id of its component, null if no row there has one.

    Nodes are the fingerprints themselves, so that those of null ids alone are linked like all others.
    """
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    named = materialize(components(link_edges(distinct.select("fp", F.col("fp").alias("id")), most, leaf)), "components")
    least = named.join(distinct, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("id").alias("least"))
    linked = named.join(least, "component").select(F.col("node").alias("fp"), "least", F.lit(True).alias("linked"))
    return distinct.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that can be reached over
    links of at most ``most`` differing bits, itself included. Repeated rows each come back; null
    doc_ids take part as fingerprints but name no component unless nothing else is in it (then null). An
    empty table gives no rows.

    Texts are read once and not shuffled. Equal fingerprints, however many, are one in the index, and
    come together by partial aggregation.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    return prints.join(_groups(prints, most, leaf), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

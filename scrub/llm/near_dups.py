"""One document of each group of near-duplicates: SimHash finds candidates, the shingles themselves decide.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of SIMILAR or more.
Candidates come from the Gray-order index of ``simhash``, here over several views of the fingerprints:
in each view a node holds the fingerprints that share the bits of a random mask, a node is sorted
by Gray rank, and runs of neighbours are searched with their shared bits factored out. Where a run has more candidate pairs than three
for each fingerprint, those of two minimum spanning forests by differing bits, which connect at every radius
what all pairs connect, and each fingerprint's link to the one with most partners are checked, so that
thousands of near copies give thousands of checks, not millions. That finds most links, and joins large groups cheaply,
but not all: ``prefix_links`` then finds every link between texts that aren't in one group yet, so none that matters is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, releasing, sieve, sifted
from .components import components
from .prefix_links import missed_links, nodes_of
from .simhash import BLOCK, SEED, gray_rank, leaf_links, shingle_bytes

#: Words of a shingle, and the similarity of a link as a fraction.
WIDTH, SIMILAR = 5, (4, 5)
#: Bits in which candidates differ at most: of the 64 that are indexed, and of these and 64 more. At similarity 0.8 the
#: means are 9.7 and 19.4, the standard deviations 2.9 and 4.1; unlike texts differ in half of all.
MOST, MOST_OF_BOTH = 15, 28
#: Share of equal bits that views are planned for (one standard deviation below similarity 0.8), and the chance
#: that such a pair meets in a view.
#: 64-bit words of the sketch that candidates are sifted by before their shingles are compared, and the standard deviations above
#: the bits in which texts of just the wanted similarity differ that still pass.
SKETCH, DEVIATIONS = 16, 2.5
AGREE, RECALL = 0.80, 0.97
#: Fingerprints of a node, about, and of a run that is searched at once; runs of larger nodes overlap by a quarter.
NODE, RUN_ROWS = 512, 2_048
#: Rows of the index in a task: at least, where there are so many, and about. A pair on either side of a cut between tasks
#: isn't met in that view, so that small tables are not cut into many.
LEAST_TASK_ROWS, TASK_ROWS = 20_000, 500_000


def plan_views(n: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(masks, turns) for n fingerprints: each view's bits that a node shares, and how far it turns fingerprints before ranking.

    The bits grow with the logarithm of n so that nodes stay small, the views with what these bits cost in recall.
    """
    bits = max(0, math.ceil(math.log2(max(1, n) / NODE)))
    views = 1 if not bits else math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**bits))
    rng = np.random.default_rng(seed)
    masks = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(views)], np.uint64)
    return masks, rng.integers(0, 64, views).astype(np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending; none for a text without words."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s) for s in shingle_bytes(text, width)), np.uint64))


def sketch(shingles: np.ndarray, words: int = SKETCH) -> bytes:
    """SimHash of a set of hashes in ``words`` x 64 bits: each word is voted on by the hashes mixed in another way."""
    votes = np.zeros((words, 64), np.int64)
    for a in range(0, len(shingles), BLOCK):
        for k in range(words):
            h = _mixed(shingles[a : a + BLOCK] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
            votes[k] += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(shingles)).tobytes()


def most_of_sketch(similar: tuple[int, int] = SIMILAR, words: int = SKETCH) -> int:
    """Bits in which sketches of texts of similarity ``similar`` or more differ at most, but for chance (under 1 % at just that similarity)."""
    j = similar[0] / similar[1]
    share = math.acos(2 * j / (1 + j)) / math.pi  # the angle of sets of equal size
    return math.floor(64 * words * share + DEVIATIONS * math.sqrt(64 * words * share * (1 - share)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number spread over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def two_fingerprints(text: str | None, width: int = WIDTH) -> tuple[int, int]:
    """SimHash of a text's shingles, and another one of their hashes mixed anew, as signed 64-bit numbers."""
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros((2, 64), np.int64), 0
    shingles = shingle_bytes(text, width)
    while len(h := np.array([digest(x, SEED) for x in islice(shingles, BLOCK)], np.uint64)):
        for k, part in enumerate((h, _mixed(h))):
            votes[k] += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    first, second = np.packbits(2 * votes > n, axis=1).view(">i8").ravel().tolist()
    return first, second


def minimum_forest(n: int, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Places in ``pairs`` of a minimum spanning forest of 0 .. n-1 (Boruvka); ties go to the earlier pair."""
    label, chosen, left = np.arange(n), [], np.arange(len(pairs))
    size = max(1, len(pairs))
    order = weights.astype(np.int64) * size + left  # no two alike, so that no cycle arises
    far = np.iinfo(np.int64).max
    while len(left):
        a, b = label[pairs[left, 0]], label[pairs[left, 1]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        best = np.full(n, far)
        np.minimum.at(best, a, order[left])
        np.minimum.at(best, b, order[left])
        new = np.unique(best[best < far]) % size
        chosen.append(new)
        while True:  # labels of the trees that the new edges join
            least = np.minimum(label[pairs[new, 0]], label[pairs[new, 1]])
            to = np.arange(n)
            np.minimum.at(to, label[pairs[new, 0]], least)
            np.minimum.at(to, label[pairs[new, 1]], least)
            after = to[label]
            if (after == label).all():
                break
            label = after
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def hub_pairs(n: int, pairs: np.ndarray) -> np.ndarray:
    """Places in ``pairs`` that link each of 0 .. n-1 to the one of its partners that has most partners."""
    ends = np.concatenate([pairs, pairs[:, ::-1]])
    partners = np.bincount(ends[:, 0], minlength=n)
    order = (partners.max() - partners[ends[:, 1]]).astype(np.int64) * len(ends) + np.arange(len(ends))
    best = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(best, ends[:, 0], order)
    return best[partners > 0] % len(ends) % len(pairs)


def chosen_pairs(n: int, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The pairs that are worth an exact check at first, 3 n at most; ``missed_links`` decides about the others. Two forests, one without the other's pairs, and links to hubs.

    A forest alone would lose copies of one original that differ more from it than, by chance, from one another.
    """
    if len(pairs) <= 3 * n:
        return pairs
    first = minimum_forest(n, pairs, weights)
    rest = np.delete(np.arange(len(pairs)), first)
    second = rest[minimum_forest(n, pairs[rest], weights[rest])]
    return pairs[np.unique(np.concatenate([first, second, hub_pairs(n, pairs)]))]


def candidates(distinct: DataFrame, n: int, most: int = MOST, most_of_both: int = MOST_OF_BOTH, seed: int = 13) -> DataFrame:
    """Distinct pairs (u, v), u < v, of nodes of ``distinct`` (node, fp, fp2) whose fingerprints differ in ``most`` bits at most, both together in ``most_of_both``.

    The rows of all views are dealt and sorted by (key, Gray rank, node), so that a large node is spread
    over tasks like any other range, and a task holds one run at a time.
    """
    masks, turns = plan_views(n, seed)

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1 << 14):
                part = batch.slice(at, 1 << 14)
                nodes, seconds, fps = part.column("node"), part.column("fp2"), part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                for k, (mask, turn) in enumerate(zip(masks, turns, strict=True)):
                    turned = fps << turn | fps >> (np.uint64(64) - turn) if turn else fps
                    key = _mixed((fps & mask) ^ _mixed(np.uint64([k + 1])))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(gray_rank(turned).view(np.int64)), nodes, seconds], ["key", "rank", "node", "fp2"])

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(rank: np.ndarray, nodes: np.ndarray, second: np.ndarray) -> pa.RecordBatch | None:
            x = rank.view(np.uint64)
            fps = x ^ (x >> np.uint64(1))
            pairs = leaf_links(fps, most)
            i, j = pairs[:, 0], pairs[:, 1]
            weights = np.bitwise_count(fps[i] ^ fps[j]) + np.bitwise_count((second[i] ^ second[j]).view(np.uint64))
            pairs, weights = pairs[weights <= most_of_both], weights[weights <= most_of_both]
            if not len(pairs):
                return None
            pairs = chosen_pairs(len(fps), pairs, weights)
            u, v = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        held = [np.zeros(0, np.int64)] * 4
        fresh = 0  # rows held that no run had yet
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            fresh += len(batch)
            if fresh < RUN_ROWS:
                continue
            a = 0
            while len(held[0]) - a > RUN_ROWS:
                b = a + int(np.searchsorted(held[0][a : a + RUN_ROWS] != held[0][a], True))
                if b - a > 1 and (out := run(*(h[a:b] for h in held[1:]))):
                    yield out
                a = b if b - a < RUN_ROWS or held[0][b] != held[0][a] else b - RUN_ROWS // 4
            held = [h[a:] for h in held]
            fresh = 0
        a = 0
        while a < len(held[0]):
            b = a + int(np.searchsorted(held[0][a : a + RUN_ROWS] != held[0][a], True))
            if b - a > 1 and (out := run(*(h[a:b] for h in held[1:]))):
                yield out
            a = b if b == len(held[0]) or b - a < RUN_ROWS or held[0][b] != held[0][a] else b - RUN_ROWS // 4

    size = n * len(masks)
    tasks = max(1, min(partitions(distinct.sparkSession), size // LEAST_TASK_ROWS), size // TASK_ROWS)
    rows = distinct.select("node", "fp", "fp2").mapInArrow(view, "key long, rank long, node long, fp2 long")
    dealt = rows.repartitionByRange(tasks, "key", "rank", "node").sortWithinPartitions("key", "rank", "node")
    return dealt.mapInArrow(search, "u long, v long").distinct()


def verified(edges: DataFrame, docs: DataFrame, ids: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Edges (u, v) whose texts have shingle sets of Jaccard similarity ``similar`` or more. ``docs`` has doc_id, node and text, ``ids`` each node's smallest id.

    Only texts that an edge names get their sets; each is made once, from the row of the smallest id, so that its copies,
    however many, are not shuffled. Edges are sifted by sketches of 128 bytes first, and sets move only for those that may pass. Sets hold the lower 32 bits of
    the hashes: in texts of under 100,000 words that changes a similarity by less than 0.0001.
    """
    wanted = materialize(nodes_of(edges).join(ids.select("node", "id"), "node"), "wanted")

    @releasing
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(x.as_py(), width) for x in part.column("text")]
                short = [np.unique(s.astype(np.uint32)).view(np.int32) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in short])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(short)))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([sketch(s) for s in sets], pa.binary()), lists], ["node", "k", "s"])

    few = sifted(docs, F.xxhash64("doc_id", "node"), sieve(wanted, F.xxhash64("id", "node")), inside=True)  # other texts are not shuffled
    texts = few.groupBy("node").agg(F.first("text").alias("text")).join(wanted.select("node"), "node", "left_semi")
    sets = materialize(texts.mapInArrow(make, "node long, k binary, s array<int>"), "shingles")

    def ends(sets: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        return sets.select(F.col("node").alias("u"), F.col(column).alias("a")), sets.select(F.col("node").alias("v"), F.col(column).alias("b"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH) for c in ("a", "b"))
            near = np.bitwise_count(x ^ y).sum(1) <= most
            yield batch.select(["u", "v"]).filter(pa.array(near))

    most = most_of_sketch(similar)
    a, b = ends(sets, "k")
    edges = materialize(edges.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(sift, "u long, v long"), "sifted")
    a, b = ends(sifted(sets, F.col("node"), sieve(nodes_of(edges), F.col("node")), inside=True), "s")
    both = edges.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return both.filter((F.col("common") * similar[1] >= (F.col("total") - F.col("common")) * similar[0]) | (F.col("total") == 0)).select("u", "v")


def shingle_sets(named: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, s): the 64-bit hashes of each text's shingles, ascending, of ``named`` (node, text). No shuffle; copies in one task come once, for the most part."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                if len(seen) > 1 << 16:
                    seen.clear()
                new = [i for i, node in enumerate(part.column(0).to_pylist()) if not (node in seen or seen.add(node))]
                sets = [np.sort(shingle_set(part.column(1)[i].as_py(), width).view(np.int64)) for i in new]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(new, pa.int64())), lists], ["node", "s"])

    return named.select("node", "text").mapInArrow(run, "node long, s array<long>")


def groups(docs: DataFrame, width: int = WIDTH, most: int = MOST, similar: tuple[int, int] = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(rows, least): rows has doc_id and node of each row; least has node and least, the smallest id of its group, or null.

    A node is a text, known by its 64-bit hash (``xxhash64``): equal texts, however many, are one in the
    index. Different texts of one hash would count as copies; among 10**9 texts one such pair has a chance of 3 %.
    Groups are exact: what the index and its checks link, and every link between the groups that these make.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text")

    @releasing
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([two_fingerprints(x.as_py(), width) for x in batch.column(2)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "node", "fp", "fp2"])

    rows = materialize(named.mapInArrow(prints, "doc_id long, node long, fp long, fp2 long"), "prints")
    distinct = materialize(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.min("doc_id").alias("id")), "texts")
    edges = materialize(candidates(distinct, distinct.count(), most), "candidates")
    found = materialize(components(verified(edges, named, distinct, width, similar)), "components")
    missed = missed_links(materialize(shingle_sets(named, width), "sets"), found, similar)
    if missed.isEmpty():
        named_groups = found
    else:
        named_groups = materialize(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(missed)), "components")
    least = named_groups.join(distinct.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    linked = named_groups.join(least, "component").select("node", "least", F.lit(True).alias("linked"))
    out = distinct.join(linked, "node", "left").select("node", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("least"))
    return rows, out


def keep_one(docs: DataFrame, width: int = WIDTH, most: int = MOST, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any other columns) whose id is the smallest of their group, as they are.

    Copies and texts that links connect are a group. Rows that repeat the smallest id with its text all
    stay; of rows with one id and different texts each is judged by its own. A row of null id stays unless
    its group has an id. Null and empty texts are copies of themselves; all texts without words are one
    group. An empty table gives no rows. Texts of fewer words than a shingle are one shingle of all their words.

    Rows that go are joined back by id and text hash; a sieve of bounded size keeps nearly all others out of that join's shuffle.
    """
    rows, least = groups(docs, width, most, similar)
    id_, group = F.col("doc_id"), F.col("least")
    gone = rows.join(least, "node").filter(F.when(id_.isNull(), group.isNotNull()).otherwise(id_ != group))
    own = "_gone" + "_" * max(map(len, docs.columns))  # no column of docs
    gone = materialize(gone.select(F.col("doc_id").alias(f"{own}id"), F.col("node").alias(f"{own}node")).distinct(), "gone")
    hashed = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    bitmap = sieve(gone, F.xxhash64(f"{own}id", f"{own}node"))
    maybe = sifted(docs, hashed, bitmap, inside=True)
    clear = sifted(docs, hashed, bitmap, inside=False)
    return clear.unionByName(maybe.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64("text") == F.col(f"{own}node")), "left_anti"))

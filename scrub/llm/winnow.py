"""Fingerprints of whole texts by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Each k-gram of code points gets a hash that rolls along the text; of each window of w hashes the
smallest is kept, of equal ones the rightmost, with its position. Grams and windows are the same for all
lengths, so that hashes of any two texts can be compared: two texts that share a passage of
w + k - 1 code points share a fingerprint hash, wherever the passage lies, and passages shorter
than k share none but by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_chunks

K = 16
WINDOW = 25
#: Odd base of the rolling hash modulo 2**64 and its inverse there.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Code points that are worked on at once; bounds the memory that a very long text needs.
BLOCK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = _powers(base, max(n, 1 << 14))
    return have[:n]


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each k-gram of code points; one hash of all where there are fewer than k.

    The sum of c[i+j] * BASE**j, from running sums: each hash is the difference of two of them
    times a power of the inverse. A last mix spreads it over all 64 bits.
    """
    if not len(points):
        return np.zeros(0, np.uint64)
    k = min(k, len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(points)), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _power(INVERSE, len(points) - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of each window of w hashes, the rightmost of equal ones, each position once."""
    w = min(w, len(h))
    value, place, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < w:
        step = min(width, w - width)
        right_value, right_place = value[step:], place[step:]
        value, place = value[:-step], place[:-step]
        right = right_value <= value
        value, place = np.where(right, right_value, value), np.where(right, right_place, place)
        width += step
    if not len(place):
        return place
    return place[np.concatenate([[True], place[1:] != place[:-1]])]


def fingerprint(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text, by position. An empty text has none; a shorter text than k one, of all of it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) <= BLOCK:
        h = gram_hashes(points, k)
        at = _window_minima(h, w)
        return h[at], at.astype(np.int64)
    hashes, places = [], []
    for a in range(0, len(points) - k - w + 2, BLOCK):  # blocks overlap so that each window lies whole in one
        h = gram_hashes(points[a : a + BLOCK + k + w - 2], k)
        at = _window_minima(h, w)
        hashes.append(h[at])
        places.append(at.astype(np.int64) + a)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes (Jaccard); two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def as_text(hashes: np.ndarray) -> str:
    """A fingerprint as a string: its distinct hashes' upper 32 bits in ascending order, 8 hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def placed_set(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprint hashes, cut to their upper 32 bits, ascending, and the first position of each."""
    hashes, places = fingerprint(text, k, w)
    distinct, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    return distinct, places[first]


def hash_set(text: str, k: int = K, w: int = WINDOW) -> np.ndarray:
    """The hashes of ``placed_set``."""
    return placed_set(text, k, w)[0]


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each kept hash: doc_id, position (code points from 0), hash. No shuffle.

    Null and empty texts have no rows. Repeated rows give their rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = fingerprint(text or "", k, w)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(h), pa.int64()), pa.array(at, pa.int64()), pa.array(h.view(np.int64))], ["doc_id", "position", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, position long, hash long")


def compare_edited(docs: DataFrame, rows_per_chunk: int = 2_000, k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprint of each text, of the text with its last quarter replaced by the next document's beginning, and likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_hashes, positions (of each hash of ``fingerprint``, in its order, the first place that it was kept at). Order is
    by doc_id, null ids first, ties by the texts' hashes; after the last row comes the first.
    Null texts count as empty; two empty fingerprints have likeness 1. Texts of any length are hashed block by
    block. Other columns are ignored. An empty table gives no rows.

    Texts are shuffled once, to chunks of ascending ids (of hashes, within an id of very many rows), one task
    for each; the first row of each chunk also goes to the end of the chunk before, so that each task knows every row's
    next without other tasks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    chunks = id_chunks(docs, rows_per_chunk)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least (id, hash) of each chunk in each batch."""
        for batch in batches:
            hashes = batch.column("hash").to_numpy()
            frame = pd.DataFrame({"chunk": chunks.of(batch.column("doc_id"), hashes), "id": batch.column("doc_id").fill_null(NULL_ID).to_numpy(), "hash": hashes})
            least = frame.sort_values(["chunk", "id", "hash"], kind="stable").drop_duplicates("chunk")
            yield pa.RecordBatch.from_pandas(least, preserve_index=False)

    # A row for each chunk comes to the driver; chunks without rows have none, and the chunk before such a one takes the next that has.
    least = docs.select("doc_id", "hash").mapInArrow(place, "chunk int, id long, hash long").groupBy("chunk").agg(F.min(F.struct("id", "hash")).alias("m"))
    firsts = [(r.chunk, r.m.id, r.m.hash) for r in least.orderBy("chunk").collect()]
    before = {c: firsts[i - 1][0] for i, (c, _, _) in enumerate(firsts)}
    starts = {(i, h): c for c, i, h in firsts}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = batch.column("hash").to_numpy(), batch.column("doc_id")
            chunk = chunks.of(ids, hashes)
            low = ids.fill_null(NULL_ID).to_numpy()
            maybe = np.flatnonzero(np.isin(hashes, [h for _, h in starts])).tolist()
            again = np.array([r for r in maybe if (int(low[r]), int(hashes[r])) in starts], np.int64)
            rows = pa.array(np.concatenate([np.arange(len(batch)), again]))
            to = np.concatenate([chunk, [before[c] for c in chunk[again].tolist()]]).astype(np.int32)
            copy = np.arange(len(rows)) >= len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(copy), *(batch.column(c).take(rows) for c in ("doc_id", "hash", "text"))], ["chunk", "copy", "doc_id", "hash", "text"])

    chunked = docs.mapInArrow(deal, "chunk int, copy boolean, doc_id long, hash long, text string")
    dealt = chunked.repartitionById(len(chunks), "chunk").sortWithinPartitions("chunk", "copy", "doc_id", "hash", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, positions array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None  # (chunk, (doc_id, text, hashes, positions)) that waits for its next
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes", "positions"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))

        def pair(now: tuple, text: str, hashes: np.ndarray) -> None:
            doc, own, own_hashes, places = now
            n = len(own) // 4
            edited = own[: len(own) - n] + text[:n]
            edited_hashes = hash_set(edited, k, w)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc, len(own), sha, as_text(own_hashes), as_text(edited_hashes), likeness(own_hashes, edited_hashes), likeness(own_hashes, hashes), len(own_hashes), places))

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            cols = (batch.column(c) for c in ("chunk", "copy", "doc_id", "text"))
            chunk, copy, ids, texts = cols
            for i in range(len(batch)):
                c, is_copy, text = chunk[i].as_py(), copy[i].as_py(), texts[i].as_py()
                hashes, places = placed_set(text, k, w)
                if last and last[0] == c:
                    pair(last[1], text, hashes)
                    last = None
                if not is_copy:
                    last = (c, (ids[i].as_py(), text, hashes, places))
                if len(out) >= 256:
                    yield ready()
        if out:
            yield ready()

    return dealt.mapInArrow(run, schema)

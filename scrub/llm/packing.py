"""Pack documents into training sequences of a fixed number of tokens.

What decides a packing is how many pieces there are of each length, a table of at most ``size``
numbers whatever the corpus. The plan is made on that table: combinations of lengths with a number
of sequences each. Pieces then look up their place by (length, rank among pieces of that length).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, releasing
from .tokens import crc32_of, encode_slice, pieces, slices

#: Rows that are ranked together at most, about; ranks of one length are added up over such parts.
ROWS_PER_PART = 1_000_000

Pattern = tuple[list[tuple[int, int]], int]


class ComplementIndex:
    """Tables addressed by the length that is missing: how many pieces have it, and which sums of two and of three lengths are there.

    A sum stays in its table until a search for it fails; counts only fall, so it can't come back.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        there = (self.left > 0).astype(float)
        two = np.convolve(there, there)[: len(there)] > 0.5
        self.pairs, self.triples = two, np.convolve(two.astype(float), there)[: len(there)] > 0.5

    def take(self, lengths: list[int], times: int) -> None:
        for length, k in Counter(lengths).items():
            self.left[length] -= k * times
            assert self.left[length] >= 0

    def single(self, gap: int) -> list[int] | None:
        return [gap] if gap < len(self.left) and self.left[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """Of all pairs that fill the gap the one of which most are there (ties: most unequal)."""
        if gap < 2 or not self.pairs[gap]:
            return None
        a = np.arange(max(1, gap - len(self.left) + 1), gap // 2 + 1)
        there = np.minimum(self.left[a], self.left[gap - a])
        if gap % 2 == 0 and len(there):
            there[-1] = self.left[gap // 2] // 2
        best = int(np.argmax(there)) if len(there) else -1
        if best >= 0 and there[best] > 0:
            return [int(gap - a[best]), int(a[best])]
        self.pairs[gap] = False
        return None

    def triple(self, gap: int) -> list[int] | None:
        """A length and a pair of the pair table that fill the gap, the most frequent lengths tried first."""
        if gap < 3 or not self.triples[gap]:
            return None
        lengths = np.flatnonzero(self.left[:gap])
        lengths = lengths[self.pairs[gap - lengths]]
        for a in lengths[np.argsort(-self.left[lengths], kind="stable")].tolist():
            self.left[a] -= 1
            known = self.pairs[gap - a]
            found = self.pair(gap - a)
            self.left[a] += 1
            self.pairs[gap - a] = known  # it was searched without one piece that is there
            if found:
                return [a, *found]
        self.triples[gap] = False
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def largest(self, limit: int) -> int | None:
        there = np.flatnonzero(self.left[: limit + 1])
        return int(there[-1]) if len(there) else None


def plan(counts: np.ndarray, size: int) -> list[Pattern]:
    """Patterns ([(length, times in a sequence), ...], number of sequences) that use up all counts.

    From the longest piece on: fill its gap exactly by one, two or three lengths, as many sequences
    alike as the counts allow; where nothing fills it exactly, put in the longest that fits (best
    fit) and try again with the smaller gap.
    """
    index, patterns = ComplementIndex(counts), []
    while (first := index.largest(size)) is not None:
        used, gap = [first], size - first
        index.take([first], 1)
        while gap:
            if gap <= 3 * (index.largest(gap) or 0) and (more := index.exact(gap)):
                pass
            elif (one := index.largest(gap)) is not None:
                more = [one]
            else:
                break
            index.take(more, 1)
            used, gap = used + more, gap - sum(more)
        parts = sorted(Counter(used).items(), reverse=True)
        again = min(int(index.left[length]) // k for length, k in parts)
        index.take(used, again)
        patterns.append((parts, 1 + again))
    return patterns


def segments(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences: sorted by (length, first rank)."""
    rows, next_rank, sequence = [], Counter(), 0
    for parts, times in patterns:
        offset = 0
        for length, k in parts:
            rows.append((length, next_rank[length], k, sequence, offset))
            next_rank[length] += k * times
            offset += k * length
        sequence += times
    rows.sort()
    names = ("length", "first", "k", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def cut_documents(docs: DataFrame, tokenizer: str, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", forget: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids_crc32. The ids stay behind.

    With ``forget``, workers drop what they remember of encoded words after each task: less memory, more encoding.
    """

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer)
        for batch in slices(batches, "text"):
            ids, at = encode_slice(batch.column("text"), known)
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                for piece, start in enumerate(range(0, b - a, size)):
                    end = min(b - a, start + size)
                    rows.append((doc, piece, start, end - start, crc32_of(ids[a + start : a + end])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            known.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(cut: DataFrame, size: int = 4096) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` from 1 to ``size``; all other columns stay, whatever
    their names; columns sequence_id and offset are replaced.

    Offsets in a sequence are gapless from 0. Rows of equal length, repeated rows among them, take places in the order
    of a row number that is written with them, so that a task that runs again gives the same places. Nulls
    in other columns do no harm. An empty table gives no rows.
    """
    cut = cut.drop("sequence_id", "offset")
    inner = "_" + "_" * max(map(len, cut.columns))  # begins no column's name
    row, part, rank, first = (inner + x for x in ("row", "part", "rank", "base"))
    stored = materialize(cut.withColumn(row, F.monotonically_increasing_id()), "pieces")
    parts = -(-stored.count() // ROWS_PER_PART)
    placed = stored.withColumn(part, F.pmod(F.xxhash64(row), F.lit(max(1, parts))))
    counts = materialize(placed.groupBy("length", part).agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        histogram[length] = n
    table = segments(plan(histogram, size))
    before = W.partitionBy("length").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    ranked = placed.join(base, ["length", part]).withColumn(rank, F.col(first) + F.row_number().over(W.partitionBy("length", part).orderBy(row)) - 1)
    names = cut.columns
    keys = table["length"] << 44 | table["first"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ranks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", rank))
            at = np.searchsorted(keys, length << 44 | ranks, "right") - 1
            seq, place = np.divmod(ranks - table["first"][at], table["k"][at])
            seq, place = table["sequence"][at] + seq, table["offset"][at] + place * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(place)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return ranked.select(*names, rank).mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, forget: bool = False) -> DataFrame:
    """Cut and pack all documents. Null and empty texts are a document of the end id alone (length 1). Rows of null id and
    repeated rows are documents of their own; texts of any length are cut, none is left out; other columns are ignored.
    ``forget`` as in ``cut_documents``."""
    return pack_pieces(cut_documents(docs, tokenizer, size, forget=forget), size)

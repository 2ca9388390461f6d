"""How quality filters interact: who survives which subset of filters, in which order a filter removes what.

A document that fails the filters of the set f survives a subset s of filters if s and f share none. The
32 answers for five filters are one 32-bit word, bit s for subset s. Adding words column by column gives
the survivors of all subsets at once: a carry-save adder turns three words into a word of sums and a word
of carries, for all 32 places in a few bit operations, so a column of n words takes about n additions.
Everything that the audit reports, for each of the 120 orders, follows from the survivors of the 32 subsets.

Nulls, repeats and ties. A null text is empty. A null id is no smaller than any id and has none that is smaller, so such a row never
fails as a copy, and has no label. Rows that repeat an id and its text don't fail by one another. An id with several labels has
quality 1 (toxic 1) if one of them has. Null parts are the empty string. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import slices

#: In the order of their bits; the last is the one that needs the whole table.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
#: Groups whose counts a task holds before it hands them on.
HELD_GROUPS = 4_096

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"


def truth_words() -> np.ndarray:
    """For each set of failed filters the 32-bit word of the subsets that such a document survives."""
    subsets = np.arange(SUBSETS, dtype=np.uint32)
    bits = np.uint32(1) << subsets
    return np.array([np.bitwise_or.reduce(bits[(subsets & f) == 0]) for f in range(SUBSETS)], np.uint32)


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and carries of three words, in each of their 32 places: a + b + c = sum + 2 * carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits set.

    Words of one weight are added by threes until one is left; their carries are the words of the next weight.
    """
    counts, weight, level = np.zeros(32, np.int64), 1, words.astype(np.uint32, copy=False)
    while len(level):
        carries = []
        while len(level) > 1:
            third = max(1, len(level) // 3)
            a, b = level[:third], level[third : 2 * third]
            c = level[2 * third : 3 * third] if len(level) > 2 else np.zeros_like(a)
            total, carry = carry_save(a, b, c)
            carries.append(carry)
            level = np.concatenate([total, level[3 * third :]])
        counts += weight * ((level[0] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def failed_alone(text: bytes, n_chars: int) -> int:
    """The filters A to D that a text fails by itself, as bits. Words are parted by ASCII white space only, as ``bytes.split`` does."""
    words = text.split()
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _UPPER))) > 10 * n_chars) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "")
        chars = pc.utf8_length(texts).to_pylist()
        raw = texts.cast(pa.binary()).to_pylist()
        fails = pa.array([failed_alone(t, n) for t, n in zip(raw, chars, strict=True)], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), digests, fails], ["id", "part", "digest", "fails"])


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest of the text, fails: bits of A to D) of each row; one pass over whole texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_marks, "id long, part string, digest binary, fails int")


def mark_copies(marks: DataFrame) -> DataFrame:
    """The marks with bit E for rows whose text has a smaller id.

    Each text's smallest id is found by a grouping that combines rows before the shuffle. It meets the rows by (text, id),
    not by text alone: copies of one text, however many, spread over all tasks. Null ids stay out of both.
    """
    known = marks.filter(F.col("id").isNotNull())
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = known.join(first, ["digest", "id"], "left")
    fails = F.when(F.col("first"), F.col("fails")).otherwise(F.col("fails").bitwiseOR(F.lit(COPY)))
    return known.select("id", "part", fails.alias("fails")).unionByName(marks.filter(F.col("id").isNull()).select("id", "part", "fails"))


def with_labels(marks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The marks with label: 1 for quality 1, plus 2 for toxic 1, else 0. Null ids meet no label and no shuffle."""
    yes = (F.max(F.col("quality") == 1).cast("int"), F.max(F.col("toxic") == 1).cast("int"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.coalesce(yes[0], F.lit(0)) + 2 * F.coalesce(yes[1], F.lit(0))).alias("label"))
    found = marks.filter(F.col("id").isNotNull()).join(known, "id", "left").select("part", "fails", F.coalesce("label", F.lit(0)).alias("label"))
    return found.unionByName(marks.filter(F.col("id").isNull()).select("part", "fails", F.lit(0).alias("label")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    truth, held = truth_words(), {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["part", "label", "counts"]
        )

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        words = truth[batch.column("fails").to_numpy()]
        groups = parts.indices.to_numpy().astype(np.int64) * 4 + batch.column("label").to_numpy()
        order = np.argsort(groups, kind="stable")
        cuts = np.flatnonzero(np.diff(groups[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            part, label = divmod(int(groups[rows[0]]), 4)
            key = (parts.dictionary[part].as_py(), label)
            held[key] = held.get(key, 0) + positional_counts(words[rows])
        if len(held) > HELD_GROUPS:
            yield out()
            held.clear()
    if held:
        yield out()


def survivors(marks: DataFrame) -> DataFrame:
    """(part, n, good, toxic): survivors of each of the 32 subsets, of all, of those of quality 1, of those of toxic 1."""
    counted = marks.select("part", "label", "fails").mapInArrow(_count, "part string, label int, counts array<long>")
    flat = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    good, toxic = F.col("label").bitwiseAND(F.lit(1)) > 0, F.col("label").bitwiseAND(F.lit(2)) > 0
    sums = flat.groupBy("part", "subset").agg(F.sum("n").alias("n"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"))
    # 32 rows a part
    listed = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    return listed.select("part", *(F.col(f"s.{c}").alias(c) for c in ("n", "good", "toxic")))


def steps_of(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> pd.DataFrame:
    """One part's rows (filter_order, step, ...) from the survivors of its subsets."""
    full, rows, removed_in_all = SUBSETS - 1, [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            after = before | bit
            removed = int(n[before] - n[after])
            removed_in_all[name] += removed
            rows.append(("".join(order), step, name, int(n[after]), removed, int(n[0] - n[bit]) - removed, int(n[full ^ bit] - n[full]), int(good[before] - good[after]), int(toxic[before] - toxic[after])))
            before = after
    out = pd.DataFrame(rows, columns=["filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    out["shapley"] = out["filter"].map(removed_in_all)
    return out


def _report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            out = steps_of(np.asarray(row.n), np.asarray(row.good), np.asarray(row.toxic))
            out.insert(0, "part", row.part)
            yield out


REPORT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step. Texts are read once; what is kept of a row is some 60 bytes."""
    marks = mark_copies(materialize(mark(docs, id_col, text_col, part_col), "audit"))
    return survivors(with_labels(marks, labels, id_col)).mapInPandas(_report, REPORT)



"""The first rows of each group and how many it has, in one pass: tasks keep no more of a group than is asked for before anything is moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task holds before it hands them on, of however many groups.
HELD_ROWS = 50_000


def shrink(rows: pa.Table, by: list[str], order: list[str], keep: int, count: str) -> pa.Table:
    """The first ``keep`` rows of each group; the first of them takes the group's sum of ``count``, the others nought. Nulls are a group, and first in order."""
    group = np.zeros(rows.num_rows, np.int64)
    for c in by:
        codes = pc.dictionary_encode(rows[c].combine_chunks(), null_encoding="encode")
        group = np.unique(group * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_inverse=True)[1].astype(np.int64)
    ranks = [pc.rank(rows[c].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy() for c in order]
    at = np.lexsort([*reversed(ranks), group])
    begins = np.flatnonzero(np.diff(group[at], prepend=-1))
    sizes = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, sizes)
    counts = np.zeros(len(at), np.int64)
    counts[begins] = np.add.reduceat(rows[count].to_numpy()[at], begins) if len(at) else 0
    kept = place < max(keep, 1)  # a group's count needs a row
    i = rows.column_names.index(count)
    return rows.take(pa.array(at[kept])).set_column(i, rows.schema.field(i), pa.array(counts[kept]))


def first_with_total(rows: DataFrame, by: list[str], order: list[str], keep: int, total: str = "total") -> DataFrame:
    """The first ``keep`` rows of each group, with rank (from 1) and ``total``, the rows of the whole group.

    ``by`` and ``order`` are columns of numbers or texts. The rows are read once; a task hands on ``keep`` rows of a group for each
    HELD_ROWS that it met at most, so a group of any size is no burden to the task that puts it together.
    """
    own = "_n" + "_" * max(map(len, rows.columns))  # no column of rows

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = shrink(fresh if held is None else pa.concat_tables([held, fresh]), by, order, keep, own)
            if held.num_rows > HELD_ROWS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    counted = rows.withColumn(own, F.lit(1).cast("long"))
    group = W.partitionBy(*by)
    some = counted.mapInArrow(part, counted.schema).withColumn("rank", F.row_number().over(group.orderBy(*order))).withColumn(total, F.sum(own).over(group))
    return some.filter(F.col("rank") <= keep).drop(own)

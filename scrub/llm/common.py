"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs on one
    machine, as in tests, a temporary folder is made; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return root.rstrip("/")


@lru_cache
def _dropped_at_exit(app: str, folder: str) -> None:
    """Have the application's folder deleted when Python ends, if Spark is still there."""

    def drop() -> None:
        with contextlib.suppress(Exception):
            spark = SparkSession.getActiveSession()
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; everything of one application lies in one folder there."""
    app = spark.sparkContext.applicationId
    folder = f"{scratch_root(spark)}/scrub-{app}"
    _dropped_at_exit(app, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that neither later jobs nor a lost executor run the work before it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that ``small_batches`` lets pass to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session pass at most BATCH_ROWS rows, of BATCH_BYTES or one row, to Python workers at once from now on.

    Each running task holds a batch of texts in the JVM, off its heap, and again in its worker; of Spark's usual 10,000
    rows that is tens of MB each, which neither gives back. A session that asks for fewer rows keeps its number.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        if spark.conf.isModifiable(size):  # Spark knows it from version 4 on
            spark.conf.set(size, str(BATCH_BYTES))


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving what it freed back to the operating system at the end of each task.

    Spark keeps Python workers for the tasks of later stages; without this each holds on to the most memory that any stage needed.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # of the GNU C library only
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Stands for a null id where ids are ordered.
NULL_ID = -(1 << 63)
#: More chunks than this are not made; a chunk then holds more rows, which its task streams.
MOST_CHUNKS = 8_192


@dataclass(frozen=True)
class IdChunks:
    """Cuts of a table into chunks of ascending (id, hash of the row). Null ids go first.

    ``bounds`` are ids in ascending order, a null as the lowest long. An id that is there m times is one of
    so many rows that they fill chunks of their own: these are cut into m even ranges of their hashes.
    """

    bounds: np.ndarray

    def of(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Chunks of rows by their ids and 64-bit hashes (signed; they order rows of one id)."""
        low = pc.fill_null(ids, NULL_ID).to_numpy(zero_copy_only=False)
        first, times = np.searchsorted(self.bounds, low, "left"), np.searchsorted(self.bounds, low, "right")
        times -= first
        upper = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of the signed hashes
        return (first + (times > 0) * (1 + (upper * times.astype(np.uint64) >> np.uint64(32)).astype(np.int64))).astype(np.int32)

    def __len__(self) -> int:
        return len(self.bounds) + 1


def id_chunks(docs: DataFrame, rows_per_chunk: int, id_col: str = "doc_id") -> IdChunks:
    """Chunks of about ``rows_per_chunk`` rows. Reads the id column only; one number for each chunk comes to the driver."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    chunks = min(MOST_CHUNKS, -(-docs.count() // rows_per_chunk))
    cuts: list[int] = []
    if chunks > 1:
        cuts = docs.select(F.percentile_approx(ids, [i / chunks for i in range(1, chunks)], max(10_000, 20 * chunks))).first()[0]
    return IdChunks(np.array(sorted(cuts), np.int64))


#: Bits of a sieve: 2**20 words of 64, 16 MB, whatever the number of keys.
SIEVE_BITS = 1 << 26


def sieve(keys: DataFrame, key: Column) -> DataFrame:
    """(word, bits): a bitmap of the keys' places, a 64-bit hash modulo SIEVE_BITS. At most 2**20 rows, so that it may be broadcast."""
    at = F.pmod(key, F.lit(SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    return materialize(keys.groupBy(F.floor(at / 64).alias("word")).agg(F.bit_or(bit).alias("bits")), "sieve")


def sifted(df: DataFrame, key: Column, bitmap: DataFrame, inside: bool) -> DataFrame:
    """Rows of ``df`` whose key is (perhaps) among the sieve's, or else those whose key surely isn't. Nothing is shuffled.

    The more keys there are, the more others pass as well: a join with the keys themselves decides about those inside.
    """
    at, own = F.pmod(key, F.lit(SIEVE_BITS)), "_sieve" + "_" * max(map(len, df.columns))  # no column of df
    small = F.broadcast(bitmap.select(F.col("word").alias(f"{own}word"), F.col("bits").alias(f"{own}bits")))
    found = df.join(small, F.floor(at / 64) == F.col(f"{own}word"), "left")
    hit = F.coalesce(F.call_function("getbit", F.col(f"{own}bits"), F.pmod(at, F.lit(64)).cast("int")) == 1, F.lit(False))
    return found.filter(hit if inside else ~hit).select(*df.columns)


#: Groups of more than one row in so many are joined by broadcast.
HOT_SHARE = 1_024


def join_back(rows: DataFrame, groups: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` (read twice) with the columns of their group: ``groups`` has one row for each key, with its number of rows in ``copies``.

    Groups of more than one row in HOT_SHARE are at most HOT_SHARE groups whatever the size of the table; those are broadcast, so
    their rows are not moved. The others meet in a join by key, where none is large. Rows without a group are dropped.
    """
    hot = materialize(groups.filter(F.col(copies) * HOT_SHARE > rows.count()), "hot")
    few = F.broadcast(hot)
    cold = groups.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(cold, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Assign rows to shards by jump consistent hashing, with DataFrame functions only.

Law ``key``: a row's shard depends on its key and the number of shards alone. When one shard
is appended, 1/(n+1) of the rows move, and all of them into the new shard. No ring table is
kept anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Fixed values of the published algorithm (Lamping and Veach, 2014): its 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
MASK32 = 0xFFFFFFFF


def _step_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64, in 32-bit halves whose products fit a signed long (ANSI mode raises on overflow)."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & MASK32

    def low32(x: Column, y: int) -> Column:
        """x * y modulo 2**32."""
        a, b = F.shiftright(x, 16), x.bitwiseAND(F.lit(0xFFFF))
        return (b * F.lit(y) + F.shiftleft((a * F.lit(y)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))

    a, b = F.shiftright(lo, 16) * F.lit(m_lo), lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_lo)
    t = b + F.shiftleft(a.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(t, 32) + F.shiftright(a, 16)
    new_hi = (carry.bitwiseAND(F.lit(MASK32)) + low32(lo, m_hi) + low32(hi, m_lo)).bitwiseAND(F.lit(MASK32))
    return new_hi, t.bitwiseAND(F.lit(MASK32))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a 64-bit integer key. A null key counts as 0.

    Each step of the walk moves on by one shard at least, so that ``shards`` steps always end it;
    on average it takes ln(shards). The steps run inside one expression on the row.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK32)).alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _step_key(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    few = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, 32))), start, step, lambda s: s)
    if shards <= 32:
        return few["b"].cast("int")
    rest = F.aggregate(F.sequence(F.lit(33), F.lit(shards)), few, step, lambda s: s["b"])
    return F.when(few["j"] >= F.lit(shards), few["b"]).otherwise(rest).cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, place in the shard, and shard after one is appended, for each row.

    Returns the id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (unsigned; null
    text: 0), law, shard, slot (0, 1, ... in each shard, by id, ties by crc and size) and grown_shard.
    Repeated rows each get a slot of their own. An empty table gives no rows. Other columns are ignored.

    The text is read once and never shuffled: a table of digests is written, ranged by id, and each
    range counts its rows for each shard; a slot is the count in earlier ranges plus the rank within
    its own, so that no shard has to pass through one task.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    digest = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        jump_hash(F.col(id_col), shards).alias("shard"),
        jump_hash(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    digest = materialize(digest, "digest")
    ranged = digest.repartitionByRange(partitions(spark), "doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        ranged.withColumn("rank", rank)
        .join(base, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )

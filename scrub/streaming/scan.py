"""Scanning and redacting streams: the row-wise operators keep no state, so they run on streams as they are.

Blobs that come again within the watermark are scanned once, by state that Spark keeps of their hashes. Protected names need the hits of a line side by side, which
all come from one row: they are found in each micro-batch by itself, against the stored hashes as they are by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQuery

from ..operators.content import findings_of
from ..operators.names import scan_protected
from ..operators.patterns import scan_patterns
from ..operators.redaction import redact
from ..operators.terms import scan_terms


def scan_stream(stream: DataFrame, id_col: str, text: str) -> DataFrame:
    """Findings of a streaming table; append mode."""
    return scan_patterns(stream, id_col, text)


def redact_stream(stream: DataFrame, text: str) -> DataFrame:
    return redact(stream, text)


def findings_per_window(stream: DataFrame, time: str, text: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Findings by category and window of event time; rows later than ``late`` are dropped, windows close after that."""
    found = stream.withWatermark(time, late).select(time, F.explode(findings_of(F.col(text))).alias("f"))
    return found.groupBy(F.window(time, width).alias("window"), F.col("f.category").alias("category")).agg(F.count("*").alias("findings"))


def once_per_blob(stream: DataFrame, time: str, sha: str = "sha", late: str = "30 minutes") -> DataFrame:
    """The stream with each blob once: repeats by its hash are dropped while the watermark, ``late`` behind the newest event time, hasn't passed the first."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([sha])


def scan_terms_stream(stream: DataFrame, terms: DataFrame, id_col: str, text: str, key: bytes | None = None) -> DataFrame:
    """Confidential terms in a streaming table; append mode, no state. The terms are those at the start of the query."""
    return scan_terms(stream, terms, id_col, text, key)


def all_findings(texts: DataFrame, terms: DataFrame | None, hashes: DataFrame | None, key: bytes | None) -> DataFrame:
    """(id, line, category) of patterns, terms and protected names in texts (id, text)."""
    out = scan_patterns(texts).select("id", "line", "category")
    if terms is not None:
        out = out.unionByName(scan_terms(texts, terms, key=key).select("id", "line", "category"))
    if hashes is not None:
        out = out.unionByName(scan_protected(texts, hashes, key).select("id", "line", F.lit("protected_name").alias("category")))
    return out


def start_scan(
    stream: DataFrame, time: str, out: str, checkpoint: str, terms: Callable[[], DataFrame] | None = None, hashes: Callable[[], DataFrame] | None = None, key: bytes | None = None, late: str = "30 minutes", trigger: dict | None = None,
) -> StreamingQuery:
    """Start to scan a stream of blobs (sha, text and an event time), each blob once; findings go to ``out``, a folder for each micro-batch.

    ``terms`` and ``hashes`` are called for each micro-batch, so lists that change count from the next one on. A batch that is
    run again after a failure replaces its own folder, so no finding is written twice.
    """
    if hashes is not None and not key:
        raise ValueError("protected names can't be matched without their key")

    def scan(batch: DataFrame, number: int) -> None:
        texts = batch.select(F.col("sha").alias("id"), "text")
        found = all_findings(texts, terms() if terms else None, hashes() if hashes else None, key)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = once_per_blob(stream, time, late=late).writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""The four workflows: inventory, verify and gate, protected names, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import LABELS
from ..functions.text import to_text
from ..operators import audits, content, media, names, redaction, snapshots
from ..operators.paths import classify_name, path_parts, prune_ignored_dirs
from ..operators.terms import scan_terms


def extra_findings(files: DataFrame, terms: DataFrame | None = None, hashes: DataFrame | None = None, key: bytes | None = None, allow: DataFrame | None = None) -> DataFrame:
    """(path, line, category, snippet, source) of confidential terms, protected names and image metadata in files that may be read.

    Name hashes without their key are an error: nothing could be found.
    """
    named = files.filter(~classify_name(F.col("path"))["status"].eqNullSafe("EXCLUDE"))
    scanned = named.filter(content.content_gate(F.col("content"), F.lit(None).cast("string"))["scan"])
    texts = scanned.select(F.col("path").alias("id"), to_text(F.col("content")).alias("text"))
    images = named.filter(path_parts(F.col("path"))["ext"].isin(*snapshots.IMAGE_EXTENSIONS))
    found = [media.scan_image_metadata(images).select("path", F.explode("findings").alias("f")).select("path", "f.line", "f.category", "f.snippet", "f.source")]
    if terms is not None:
        found.append(scan_terms(texts, terms, key=key).select(F.col("id").alias("path"), "line", "category", "snippet", F.lit("term").alias("source")))
    if hashes is not None:
        hits = names.scan_protected(texts, hashes, key, allow)
        found.append(hits.select(F.col("id").alias("path"), "line", F.lit("protected_name").alias("category"), F.lit(LABELS["protected_name"]).alias("snippet"), F.lit("name").alias("source")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def inventory(
    files: DataFrame, approved: DataFrame | None = None, skipped: DataFrame | None = None, terms: DataFrame | None = None, hashes: DataFrame | None = None, key: bytes | None = None, allow: DataFrame | None = None,
    registry: DataFrame | None = None, now: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Files (path, content; optional size, mtime_ns, is_symlink, ocr_text) -> plan, ignored folders, summary and copy plan.

    The plan holds findings of patterns, terms, protected names, image metadata and images' text, and registered
    synthetic files; ``now`` (path, size, mtime_ns) keeps files that changed since from being copied.
    """
    kept, dirs = prune_ignored_dirs(files)
    plan = content.inventory(kept, extra=extra_findings(kept, terms, hashes, key, allow))
    if registry is not None:
        plan = snapshots.apply_synthetic(plan, registry)
    none = plan.select("path").limit(0)
    copies = snapshots.copy_plan(plan, approved if approved is not None else none, skipped if skipped is not None else none, now)
    return {"plan": plan, "dirs": dirs, "by_status": content.status_summary(plan), "copies": copies}


def redact_and_verify(files: DataFrame, accepted: DataFrame) -> DataFrame:
    """Files (path, text) redacted, scanned again and judged: adds status, total_findings and releasable."""
    clean = redaction.redact(files)
    plan = content.inventory(clean.select("path", F.encode("text", "UTF-8").alias("content")))
    ok = accepted.select("path", F.lit(True).alias("_ok")).distinct()
    ext = path_parts(F.col("path"))["ext"]
    return plan.join(ok, "path", "left").withColumn("releasable", snapshots.is_releasable(F.col("status"), F.col("total_findings"), F.col("_ok"), F.col("sha256"), ext, F.lit(None))).drop("_ok")


def protect_and_find(name_table: DataFrame, texts: DataFrame, key: bytes, allow: DataFrame | None = None) -> DataFrame:
    """Names -> keyed hashes -> their hits in texts (id, text)."""
    hashes, _ = names.build_protected(name_table, key)
    return names.scan_protected(texts, hashes, key, allow)


def audit_history(commits: DataFrame, blobs: DataFrame, blob_paths: DataFrame) -> DataFrame:
    """Distinct (repo_id, alert) of all commits, messages, paths and blobs."""
    alerts = [
        audits.audit_commit_emails(commits).select("repo_id", F.concat_ws(" ", F.lit("commit"), "commit", F.concat("role", F.lit(" e-mail is no no-reply address"))).alias("alert")),
        audits.scan_commit_messages(commits).select("repo_id", F.concat_ws(" ", F.lit("commit"), "commit", F.lit("message holds"), "category").alias("alert")),
        audits.audit_blob_paths(blob_paths).select("repo_id", F.concat_ws(" ", F.lit("history has excluded file"), "path").alias("alert")),
        audits.scan_blobs(blobs, blob_paths).select("repo_id", F.concat_ws(" ", F.lit("history:"), "path", F.lit("holds"), "category").alias("alert")),
    ]
    out = alerts[0]
    for a in alerts[1:]:
        out = out.union(a)
    return out.distinct()

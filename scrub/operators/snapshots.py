"""Compare snapshots, plan copies and decide what may be released."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp")


def diff_snapshot(plan: DataFrame, now: DataFrame, report_new: bool = False) -> DataFrame:
    """(path, change) of planned files that changed since: missing, or other size or mtime_ns. New files are named only if asked for."""
    old = plan.filter("mtime_ns is not null").select("path", "size", "mtime_ns")
    new = now.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.lit(True).alias("_there"))
    both = old.join(new, "path", "left")
    change = F.when(F.col("_there").isNull(), "missing").when((F.col("size") != F.col("_size")) | (F.col("mtime_ns") != F.col("_mtime")), "changed")
    out = both.withColumn("change", change).filter("change is not null").select("path", "change")
    return out.unionByName(now.join(plan, "path", "left_anti").select("path", F.lit("new").alias("change"))) if report_new else out


def diff_verified(released: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, problem) where verified files and those on disk differ: unverified, changed (hash), vanished. One full outer join on path."""
    a = released.select("path", F.col("sha256").alias("a"), F.lit(True).alias("in_a"))
    b = disk.select("path", F.col("sha256").alias("b"), F.lit(True).alias("in_b"))
    problem = F.when(F.col("in_a").isNull(), "unverified").when(F.col("in_b").isNull(), "vanished").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full_outer").withColumn("problem", problem).filter("problem is not null").select("path", "problem")


def verified_problems(released: DataFrame, disk: DataFrame, clean: bool, same_root: bool) -> DataFrame:
    """(path, problem): what stands between a verification and the files on disk, and, with null paths, that it isn't clean or is of another folder."""
    of_run = [("verification isn't clean", not clean), ("verification is of another folder", not same_root)]
    rows = released.sparkSession.createDataFrame([(None, problem) for problem, holds in of_run if holds], "path string, problem string")
    return diff_verified(released, disk).unionByName(rows)


def apply_synthetic(plan: DataFrame, registry: DataFrame) -> DataFrame:
    """Plan with registered synthetic files: an equal hash lifts a review for name or folder, but none for the extension.

    ``plan`` has path, sha256, status and review_kind (name, folder, extension or null); a registered path with another hash goes to
    review. Adds synthetic and synthetic_note.
    """
    r = registry.select("path", F.col("sha256").alias("_hash"))
    j = plan.join(r, "path", "left")
    listed, same = F.col("_hash").isNotNull(), F.coalesce(F.col("_hash") == F.col("sha256"), F.lit(False))
    lifted = same & (F.col("status") == "REVIEW") & F.col("review_kind").isin("name", "folder")
    changed = listed & ~same & (F.col("status") != "EXCLUDE")
    return j.withColumns({
        "synthetic": same, "synthetic_note": F.when(changed, "registered as synthetic, but changed"),
        "status": F.when(lifted, "COPY").when(changed, "REVIEW").otherwise(F.col("status")),
    }).drop("_hash")


def register_synthetic(wanted: DataFrame, copied_paths: DataFrame, source_hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registered rows, rejected rows with reason). A file copied from the source, by path or by content, isn't synthetic."""
    j = wanted.join(copied_paths.select("path", F.lit(True).alias("_path")).distinct(), "path", "left").join(source_hashes.select("sha256", F.lit(True).alias("_hash")).distinct(), "sha256", "left")
    reason = F.when(F.col("_path"), "copied from the source").when(F.col("_hash"), "same content as a source file")
    j = j.withColumn("reason", reason).select("path", "sha256", "reason")
    return j.filter("reason is null").drop("reason"), j.filter("reason is not null")


def invalid_approvals(plan: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved paths that aren't up for review."""
    return approved.select("path").distinct().join(plan.filter("status = 'REVIEW'"), "path", "left_anti")


def copy_plan(plan: DataFrame, approved: DataFrame, skipped: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """(path, decision, to_sanitize, reason) of every planned file: copy or leave; raises if an approval is not for a file under review."""
    if not invalid_approvals(plan, approved).isEmpty():
        raise ValueError("only files under review can be approved")
    j = plan.join(approved.select("path", F.lit(True).alias("_ok")).distinct(), "path", "left").join(skipped.select("path", F.lit(True).alias("_skip")).distinct(), "path", "left")
    changed = F.lit(None).cast("string")
    if now is not None:
        j = j.join(diff_snapshot(plan, now).withColumnRenamed("change", "_change"), "path", "left")
        changed = F.col("_change")
    found = F.coalesce(F.col("total_findings"), F.lit(0)) > 0
    allowed = F.col("status").isin("COPY", "SANITIZE") | ((F.col("status") == "REVIEW") & F.coalesce("_ok", F.lit(False)))
    reason = F.when(F.coalesce("_skip", F.lit(False)), "skipped").when(~allowed, F.concat(F.lit("status "), "status")).when(changed.isNotNull(), F.concat(F.lit("since the scan: "), changed))
    copy = reason.isNull()
    return j.select("path", F.when(copy, "copy").otherwise("leave").alias("decision"), (copy & ((F.col("status") == "SANITIZE") | ((F.col("status") == "REVIEW") & found))).alias("to_sanitize"), reason.alias("reason"))


def is_releasable(status: Column, total: Column, accepted: Column, sha256: Column, ext: Column, ocr_chars: Column) -> Column:
    """Whether a verified file may leave: clean copies; clean notebooks; accepted, hashed reviews without findings, images only with their text read."""
    none = F.coalesce(total, F.lit(0)) == 0
    image = ext.isin(*IMAGE_EXTENSIONS)
    return F.coalesce(
        F.when(status == "COPY", True)
        .when(status == "SANITIZE", total.isNotNull() & (total == 0))
        .when(status == "REVIEW", F.coalesce(accepted, F.lit(False)) & none & sha256.isNotNull() & (~image | ocr_chars.isNotNull()))
        .otherwise(False),
        F.lit(False),
    )


def dataset_clean(plan: DataFrame, ignored_dirs: DataFrame) -> DataFrame:
    """One row: pending files, ignored folders other than the root's .git, clean."""
    files = plan.agg(F.count_if(~F.coalesce("releasable", F.lit(False))).alias("pending"))
    dirs = ignored_dirs.agg(F.count_if(F.col("dir") != ".git").alias("dirs"))
    return files.crossJoin(dirs).withColumn("clean", (F.col("pending") == 0) & (F.col("dirs") == 0))


def sensitive_categories(plan: DataFrame, history_alerts: DataFrame | None = None) -> DataFrame:
    """Distinct categories of findings in files that may not leave, and ``history`` if there are alerts from there."""
    out = plan.filter(~F.coalesce("releasable", F.lit(False))).select(F.explode("findings.category").alias("category")).distinct()
    return out if history_alerts is None else out.union(history_alerts.limit(1).select(F.lit("history"))).distinct()


def unverified_additions(to_add: DataFrame, released: DataFrame) -> DataFrame:
    """Paths that would be added but weren't verified for release."""
    return to_add.select("path").distinct().join(released, "path", "left_anti")


def left_out(released: DataFrame, to_add: DataFrame, tracked: DataFrame) -> DataFrame:
    """Released paths that are neither added nor tracked: something ignores them."""
    return released.select("path").distinct().join(to_add, "path", "left_anti").join(tracked, "path", "left_anti")


def gate_report(clean: DataFrame, intact: bool, identity_ok: DataFrame, policy_problems: DataFrame, history_alerts: DataFrame, categories: DataFrame, visibility: str, has_commit: bool, tree_clean: bool) -> DataFrame:
    """One row with all that a release hangs on, and the verdict."""
    one = clean.select("pending", "dirs", "clean")
    one = one.crossJoin(identity_ok.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("identity_ok")))
    one = one.crossJoin(policy_problems.agg(F.count("*").alias("policy_problems"))).crossJoin(history_alerts.agg(F.count("*").alias("history_alerts")))
    one = one.crossJoin(categories.agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("sensitive")))
    return one.select(
        F.lit(intact).alias("intact"), "pending", "dirs", "identity_ok", "policy_problems", "history_alerts", "sensitive", F.lit(visibility).alias("visibility"),
        (F.lit(intact & has_commit & tree_clean) & F.col("clean") & F.col("identity_ok") & (F.col("policy_problems") == 0) & (F.col("history_alerts") == 0)).alias("passed"),
    )

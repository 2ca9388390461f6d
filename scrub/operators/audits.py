"""Audits of repositories: commits, blobs, policy files, identity, visibility, and the gate before a push. Many repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_text
from .bounded import first_with_total
from .content import BINARY_PROBE
from .media import is_image, scan_image_metadata
from .paths import classify_name
from .patterns import scan_patterns
from .terms import scan_terms

NOREPLY = r"^[0-9]+\+[A-Za-z0-9][A-Za-z0-9-]{0,38}@users\.noreply\.github\.com$"
#: What a policy asks for; parameters of ``audit_policy``, fixed values.
IGNORE_ENTRIES = (".env", ".env.*", "!.env.example", "*.pem", "*.key", "*.pfx", "*.p12", "*.db", "*.sqlite*", "*.log", "credentials*", "secrets*", "cookies*")
NOTICE_WORDS = ("fictício", "sanitizad")
USAGE_TITLE = "## Uso"
USAGE_LINES = (
    "Este repositório é disponibilizado como portfólio e demonstração técnica.",
    "Não é concedida permissão para copiar, modificar, distribuir ou reutilizar este código sem autorização do autor.",
)


def is_noreply_email(email: Column) -> Column:
    return F.coalesce(email.rlike(NOREPLY), F.lit(False))


def normalize_remote_url(url: Column) -> Column:
    """https form in lower case, without final slashes and ``.git``."""
    https = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/"), "/+$", "")
    return F.lower(F.regexp_replace(https, r"(?i)\.git$", ""))


def repo_of_url(url: Column) -> Column:
    """``owner/name`` of a remote; null if it has none."""
    return F.nullif(F.regexp_extract(normalize_remote_url(url), r"^https?://[^/]+/([^/]+/[^/]+)$", 1), F.lit(""))


def audit_commit_emails(commits: DataFrame) -> DataFrame:
    """(repo_id, commit, role) where an author's or committer's e-mail isn't a no-reply address; commit cut to 7."""
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_email").alias("email")) for r in ("author", "committer")))
    return commits.select("repo_id", F.left("commit", F.lit(7)).alias("commit"), F.explode(roles).alias("r")).filter(~is_noreply_email(F.col("r.email"))).select("repo_id", "commit", "r.role")


def _scan(texts: DataFrame, terms: DataFrame | None) -> DataFrame:
    """(id, category, snippet) of patterns and, if given, of confidential terms (term, category) in texts (id, text)."""
    found = scan_patterns(texts).select("id", "category", "snippet")
    return found if terms is None else found.union(scan_terms(texts, terms).select("id", "category", "snippet"))


def scan_commit_messages(commits: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(repo_id, commit, category) found in messages."""
    found = _scan(commits.select(F.struct("repo_id", "commit").alias("id"), F.col("message").alias("text")), terms)
    return found.select("id.repo_id", F.left("id.commit", F.lit(7)).alias("commit"), "category").distinct()


def audit_blob_paths(blob_paths: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of paths that were ever committed though their name excludes them."""
    named = blob_paths.select("repo_id", "path").distinct().withColumn("n", classify_name(F.col("path")))
    return named.filter("n.status = 'EXCLUDE'").select("repo_id", "path", F.col("n.reason").alias("reason"))


def scan_blobs(blobs: DataFrame, blob_paths: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, category, snippet) found in blobs. Each distinct blob is scanned once, whatever the repositories and paths that
    have it; of binary ones only images are looked at, for their metadata and its text. Per repository the smallest path names a blob."""
    once = blobs.select("sha", "content").dropDuplicates(["sha"]).withColumn("binary", F.contains(F.substring("content", 1, BINARY_PROBE), F.lit(b"\0")))
    texts = once.filter(~F.col("binary")).select(F.col("sha").alias("id"), to_text(F.col("content")).alias("text"))
    # What is an image its first bytes say; a path can't be trusted to.
    images = scan_image_metadata(once.filter(is_image(F.col("content"))).select(F.col("sha").alias("path"), "content"))
    seen = images.select(F.col("path").alias("sha"), F.explode("findings").alias("f")).select("sha", "f.category", "f.snippet")
    found = _scan(texts, terms).select(F.col("id").alias("sha"), "category", "snippet").union(seen).distinct()
    names = blob_paths.groupBy("repo_id", "sha").agg(F.min("path").alias("path"))
    return found.join(names, "sha").select("repo_id", "path", "category", "snippet").distinct()


def first_alerts(alerts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(kind, alert, rank, remaining): the first alerts of each kind in order, as many as ``limits`` says, and how many of the kind remain.

    Distinct alerts count. Kinds without a limit are given whole, without ranks. A task hands on no more of a kind than its limit.
    """
    once = alerts.select("kind", "alert").distinct()
    limit = F.when(F.lit(False), F.lit(0))
    for kind, most in limits.items():
        limit = limit.when(F.col("kind") == kind, most)
    first = first_with_total(once.filter(F.col("kind").isin(*limits)), ["kind"], ["alert"], max(limits.values(), default=0)).filter(F.col("rank") <= limit)
    free = once.filter(~F.coalesce(F.col("kind").isin(*limits), F.lit(False))).select("kind", "alert", F.lit(None).cast("int").alias("rank"), F.lit(0).cast("long").alias("remaining"))
    return first.select("kind", "alert", "rank", F.greatest(F.col("total") - limit, F.lit(0)).alias("remaining")).unionByName(free)


def audit_policy(files: DataFrame, usage_lines: tuple[str, ...] = USAGE_LINES, entries: tuple[str, ...] = IGNORE_ENTRIES, words: tuple[str, ...] = NOTICE_WORDS, title: str = USAGE_TITLE) -> DataFrame:
    """(repo_id, problem) by the root files of each repository (repo_id, path, text). One aggregation, on conditions."""
    upper = F.upper("path")
    licence = ~F.col("path").contains("/") & (upper.startswith("LICENSE") | upper.startswith("LICENCE") | upper.startswith("COPYING"))
    root = files.groupBy("repo_id").agg(
        F.max(licence).alias("licence"), F.max(F.when(F.col("path") == "README.md", F.coalesce("text", F.lit("")))).alias("readme"), F.max(F.when(F.col("path") == ".gitignore", F.coalesce("text", F.lit("")))).alias("ignore"),
    )
    readme, low = F.col("readme"), F.lower("readme")
    titles = F.filter(F.split(readme, "\r?\n"), lambda x: x.startswith("## "))
    notice = F.lit(True)
    for w in words:
        notice = notice & low.contains(w)
    have = F.transform(F.split(F.col("ignore"), "\r?\n"), F.trim)
    lacking = F.array_except(F.array(*(F.lit(e) for e in entries)), have)
    problems = [
        F.when(F.col("licence"), "licence file present"),
        F.when(readme.isNull(), "README.md missing"),
        F.when(readme.isNotNull() & ~notice, "README lacks the notice"),
        F.when(readme.isNotNull() & ~F.coalesce(F.trim(F.get(titles, F.size(titles) - 1)) == title, F.lit(False)), "README does not end with the usage section"),
        *(F.when(readme.isNotNull() & ~readme.contains(line), f"README lacks a required line ({i + 1})") for i, line in enumerate(usage_lines)),
        F.when(F.col("ignore").isNull(), ".gitignore missing"),
        F.when(F.size(lacking) > 0, F.concat(F.lit(".gitignore lacks "), F.array_join(lacking, ", "))),
    ]
    return root.select("repo_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def audit_identity(identities: DataFrame) -> DataFrame:
    """(repo_id, ok, problems) of (repo_id, user_name, user_email, expected_name, env_overrides ARRAY<STRING>)."""
    problems = F.array_compact(F.array(
        F.when(~is_noreply_email(F.col("user_email")), "e-mail is no no-reply address"),
        F.when(F.col("expected_name").isNotNull() & ~F.col("user_name").eqNullSafe(F.col("expected_name")), "name differs from the expected one"),
        F.when(F.size("env_overrides") > 0, F.concat(F.lit("environment overrides: "), F.array_join("env_overrides", ", "))),
    ))
    return identities.select("repo_id", (F.size(problems) == 0).alias("ok"), problems.alias("problems"))


def visibility(has_remote: Column, is_github: Column, authenticated: Column, private: Column, http_status: Column) -> Column:
    """What fetched answers say of a remote: only an authenticated answer proves that it is private."""
    return (
        F.when(~has_remote, "NOT SET")
        .when(~is_github, "UNKNOWN")
        .when(authenticated & (private == True), "PRIVATE")  # noqa: E712
        .when(private == False, "PUBLIC")  # noqa: E712
        .when(authenticated & (http_status == 404), "MISSING")
        .when(http_status == 404, "UNCONFIRMED")
        .otherwise("UNKNOWN")
    )


def gate_push(requests: DataFrame) -> DataFrame:
    """(repo_id, allowed, reasons): verdicts on wishes to push; nothing is pushed.

    Columns: report_passed, remote_url, expected_url, visibility, branch, approval, expected_approval.
    """
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce("report_passed", F.lit(False)), "report not passed"),
        F.when(~normalize_remote_url(F.col("remote_url")).eqNullSafe(normalize_remote_url(F.col("expected_url"))), "other remote than expected"),
        F.when(~F.col("visibility").eqNullSafe("PRIVATE"), F.concat(F.lit("visibility "), F.coalesce("visibility", F.lit("UNKNOWN")))),
        F.when(~F.col("branch").eqNullSafe("main"), "branch is not main"),
        F.when(~F.col("approval").eqNullSafe(F.col("expected_approval")), "not approved literally"),
    ))
    return requests.select("repo_id", (F.size(reasons) == 0).alias("allowed"), reasons.alias("reasons"))


def check_message(messages: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(id, ok, problems) of commit messages (id, message): missing, with a co-author trailer, or with findings."""
    found = _scan(messages.select("id", F.col("message").alias("text")), terms).groupBy("id").agg(F.array_sort(F.collect_set("category")).alias("found"))
    problems = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("message", F.lit(""))) == "", "message missing"),
        F.when(F.col("message").rlike(r"(?im)^\s*co-authored-by:"), "co-author trailer"),
        F.when(F.col("found").isNotNull(), F.concat(F.lit("holds "), F.array_join("found", ", "))),
    ))
    return messages.join(found, "id", "left").select("id", (F.size(problems) == 0).alias("ok"), problems.alias("problems"))

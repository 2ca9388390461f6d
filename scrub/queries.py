"""Registered queries: each applies an operator to whole given tables, or to what Spark derives from them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.masking import mask_value
from .functions.text import bind, normalize_words, slugify, split_lines
from .operators import audits, content, media, names, paths, patterns, redaction, snapshots, terms
from .oracles import KEY, PERSONAL_CATEGORIES, SECRET_CATEGORIES, URL_CATEGORIES
from .plans import workflows
from .sources.files import spread
from .sources.sinks import decrypt_terms, encrypt_terms
from .views import BEFORE, COMMITS, NOW, PATHS, PERSONAL, SECRETS, SPELLINGS, dialect

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that texts are made of and has fewer splits than there are cores is dealt out to them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages", "orders", "customer") else table


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in ("customer", "orders", "documents"):
        if f"FROM {t}" in sql:
            _table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(dialect(sql, "spark"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")


def _secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).unionByName(_view(spark, sf_dir, SECRETS).select("id", "text"))


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).unionByName(_view(spark, sf_dir, PERSONAL).select("id", "text"))


def _grouped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty customers' values in one text each, a line for each value."""
    p = _view(spark, sf_dir, PERSONAL).withColumn("n", F.substring("id", 2, 20).cast("long"))
    lines = F.array_sort(F.collect_list(F.struct("n", "text")))
    return p.groupBy(F.concat(F.lit("g"), F.floor(F.col("n") / 50).cast("string")).alias("id")).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def _only(categories: tuple[str, ...]) -> list[patterns.Pattern]:
    return [p for p in patterns.PATTERNS if p.category in categories]


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.inventory(_view(spark, sf_dir, PATHS).select("path", F.encode("text", "UTF-8").alias("content")))


def _releasable(plan: DataFrame) -> DataFrame:
    ext = paths.path_parts(F.col("path"))["ext"]
    return plan.withColumn("releasable", snapshots.is_releasable(F.col("status"), F.col("total_findings"), F.col("path").contains("7"), F.col("sha256"), ext, F.lit(None).cast("int")))


@query
def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.scan_patterns(_secret_texts(spark, sf_dir), patterns=_only(SECRET_CATEGORIES)).select("id", "line", "category", "snippet")


@query
def scan_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.scan_patterns(_personal_texts(spark, sf_dir), patterns=_only(PERSONAL_CATEGORIES)).select("id", "line", "category", "snippet")


@query
def scan_urls_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return patterns.scan_patterns(pages.unionByName(_secret_texts(spark, sf_dir)), patterns=_only(URL_CATEGORIES)).select("id", "line", "category", "snippet")


@query
def scan_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted values of all categories in uncommon spellings; the SQL names each value, without expressions."""
    return patterns.scan_patterns(_view(spark, sf_dir, SPELLINGS)).select("id", "line", "category", "snippet")


@query
def placeholder_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["cpf", "cnpj", "court_case", "court_case_bare", "phone", "cep", "email", "private_ip"]
    category = F.get(F.array(*(F.lit(k) for k in kinds)), F.col("kind").cast("int"))
    return _view(spark, sf_dir, PERSONAL).select("id", patterns.is_placeholder(category, F.col("value")).alias("is_placeholder"))


@query
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("kind") == 12, "local_path").when(F.col("kind") == 9, "email").otherwise("github_token")
    return _view(spark, sf_dir, SECRETS).select("id", mask_value(category, F.col("value")).alias("masked"))


@query
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.category_summary(patterns.scan_patterns(_personal_texts(spark, sf_dir)))


@query
def file_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content.file_category_counts(patterns.scan_patterns(_grouped_texts(spark, sf_dir)))
    return found.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query
def cap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.cap_findings(patterns.scan_patterns(_grouped_texts(spark, sf_dir)), 10).select("id", "line", "category", "rank", "total_findings")


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.path_parts(F.col("path"))
    return _view(spark, sf_dir, PATHS).select("doc_id", p["name"].alias("name"), p["ext"].alias("ext"), F.array_join(p["dirs"], "/").alias("dirs"))


@query
def prune_ignored_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.prune_ignored_dirs(_view(spark, sf_dir, PATHS))[1]


@query
def classify_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PATHS).select("doc_id", paths.classify_name(F.col("path")).alias("n")).select("doc_id", "n.status", "n.reason")


@query
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("path", "status", "total_findings")


@query
def content_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is scanned of contents made from all documents: as they are, with a zero byte early or late, or very large."""
    n = F.col("doc_id")
    odd = F.when(n % 97 == 0, F.rpad("text", content.MAX_TEXT + 1, "x")).when(n % 3 == 0, F.concat(F.left("text", F.lit(50)), F.lit("\0"), F.col("text"))).when(n % 3 == 1, F.concat(F.repeat(F.lit("a"), content.BINARY_PROBE), F.lit("\0")))
    gate = content.content_gate(F.encode(F.coalesce(odd, F.col("text")), "UTF-8"), F.when(n % 2 == 0, "REVIEW"))
    return _table(spark, sf_dir, "documents").select("doc_id", gate.alias("g")).select("doc_id", "g.scan", "g.status", "g.reason")


@query
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.status_summary(_plan(spark, sf_dir))


@query
def top_k_per_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.top_k_per_status(_plan(spark, sf_dir)).select("path", "status", "rank", "remaining")


@query
def scan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chosen = docs.filter((F.col("doc_id") % 50 == 0) & F.col("text").rlike("^[A-Za-z]+ [A-Za-z]{5,} "))  # makes the term list; all documents are scanned
    term_list = chosen.select(F.lower(F.get(F.split("text", "[ \n]+"), F.lit(1))).alias("term"), F.lit("sensitive_term").alias("category"))
    return terms.scan_terms(docs, terms.merge_terms(term_list), "doc_id", key=KEY).select("id", "line", "term_key")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").filter(F.col("text").rlike("^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"))
    return docs.select("doc_id", F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 3), " ").alias("name"), F.lit("person").alias("kind"))


@query
def person_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.build_variants(_people(spark, sf_dir)).select("variant").distinct()


@query
def company_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").filter(F.col("text").rlike("^[A-Za-z]+ [A-Za-z]+"))
    firms = docs.select(F.concat(F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 2), " "), F.lit(" S.A.")).alias("name"), F.lit("company").alias("kind"))
    return names.build_variants(firms).select("variant").distinct()


@query
def protected_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.build_protected(_people(spark, sf_dir), KEY)[0].select("hash")


@query
def protected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.build_protected(_people(spark, sf_dir), KEY)[1]


@query
def scan_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all people in all documents."""
    hashes, _ = names.build_protected(_people(spark, sf_dir), KEY)
    return names.scan_protected(_table(spark, sf_dir, "documents"), hashes, KEY, id_col="doc_id")


@query
def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    hashes, _ = names.build_protected(people, KEY)
    return names.lookup_names(people.select("name").distinct(), hashes, KEY)


@query
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redact(_view(spark, sf_dir, SECRETS)).select("id", "text")


@query
def redact_all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and planted values of all kinds, redacted. No SQL: it can't express where matches overlap or are stand-ins."""
    return redaction.redact(_secret_texts(spark, sf_dir)).select("id", "text")


#: Stand for confidential terms; found whatever their accents and case.
REDACTED_TERMS = ("que", "de la", "fur")


@query
def redact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without REDACTED_TERMS; the hash of the text, its length, and how many placeholders it has."""
    text = F.col("text")
    out = redaction.redact_terms(_table(spark, sf_dir, "documents").select("doc_id", "text"), list(REDACTED_TERMS))
    return out.select("doc_id", F.sha2(text, 256).alias("hash"), F.length(text).alias("chars"), F.regexp_count(text, F.lit("EXEMPLO_TERMO")).cast("long").alias("replaced"))


@query
def redaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.redaction_log(_personal_texts(spark, sf_dir))


@query
def redaction_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _secret_texts(spark, sf_dir).unionByName(_view(spark, sf_dir, PERSONAL).select("id", "text"))
    return redaction.redaction_residual(both).select("id", "line", "category")


@query
def synthetic_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _view(spark, sf_dir, BEFORE)
    ok, rejected = snapshots.register_synthetic(_view(spark, sf_dir, NOW), before.filter("mtime_ns % 3000 = 0"), before)
    return ok.select("path", F.lit("registered").alias("outcome")).unionByName(rejected.select("path", F.col("reason").alias("outcome")))


@query
def synthetic_waiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _view(spark, sf_dir, BEFORE).select(
        "path", "sha256", F.when(F.col("size") % 3 == 0, "REVIEW").when(F.col("size") % 3 == 1, "COPY").otherwise("EXCLUDE").alias("status"),
        F.when(F.col("size") % 4 == 0, "name").when(F.col("size") % 4 == 1, "folder").when(F.col("size") % 4 == 2, "extension").alias("review_kind"),
    )
    return snapshots.apply_synthetic(plan, _view(spark, sf_dir, NOW)).select("path", "status", "synthetic")


@query
def diff_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff_snapshot(_view(spark, sf_dir, BEFORE), _view(spark, sf_dir, NOW))


@query
def diff_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff_verified(_view(spark, sf_dir, BEFORE), _view(spark, sf_dir, NOW))


@query
def valid_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    return snapshots.invalid_approvals(plan, plan.filter(F.col("path").contains("7")))


@query
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    wanted = plan.filter((F.col("status") == "REVIEW") & F.col("path").contains("7"))
    return snapshots.copy_plan(plan, wanted, plan.filter(F.col("path").contains("9"))).select("path", "decision", "to_sanitize")


@query
def releasable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _releasable(_plan(spark, sf_dir)).select("path", "releasable")


@query
def dataset_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = paths.prune_ignored_dirs(_view(spark, sf_dir, PATHS))[1]
    return snapshots.dataset_clean(_releasable(_plan(spark, sf_dir)), dirs)


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, COMMITS)


@query
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's report on the real plan, folders, snapshots, policy problems, findings, commits and answers about the remote."""
    alerts, plan = audits.audit_commit_emails(_commits(spark, sf_dir)), _releasable(_plan(spark, sf_dir))
    clean = snapshots.dataset_clean(plan, paths.prune_ignored_dirs(_view(spark, sf_dir, PATHS))[1])
    intact, tree_clean = diff_snapshot(spark, sf_dir).isEmpty(), diff_verified(spark, sf_dir).isEmpty()
    remote = visibility(spark, sf_dir).agg(F.min_by("visibility", "id")).first()[0]
    categories = snapshots.sensitive_categories(plan, alerts)
    return snapshots.gate_report(clean, intact, audits.audit_identity(_identities(spark, sf_dir)), policy_audit(spark, sf_dir), alerts, categories, remote, not _commits(spark, sf_dir).isEmpty(), tree_clean)


@query
def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report by its earlier name."""
    return gate_report(spark, sf_dir)


@query
def alert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alerts of each kind: 10 changes of the source, 20 pending files, 30 of the history, all folders."""
    history = audits.audit_commit_emails(_commits(spark, sf_dir)).select(F.lit("history").alias("kind"), F.concat_ws(" ", "repo_id", "commit", "role").alias("alert"))
    plan = _releasable(_plan(spark, sf_dir)).filter(~F.coalesce("releasable", F.lit(False)))
    source = diff_snapshot(spark, sf_dir).select(F.lit("source").alias("kind"), F.concat_ws(" ", "path", "change").alias("alert"))
    folders = paths.prune_ignored_dirs(_view(spark, sf_dir, PATHS))[1].select(F.lit("folder").alias("kind"), F.col("dir").alias("alert"))
    pending = plan.select(F.lit("pending").alias("kind"), F.concat_ws(" ", "path", "status").alias("alert"))
    return audits.first_alerts(history.unionByName(source).unionByName(folders).unionByName(pending), {"source": 10, "pending": 20, "history": 30})


@query
def commit_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit_commit_emails(_commits(spark, sf_dir))


@query
def commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.scan_commit_messages(_commits(spark, sf_dir))


@query
def check_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.check_message(_commits(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "message"))
    return found.select("id", F.array_join("problems", ";").alias("problems"))


@query
def blob_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _view(spark, sf_dir, PATHS).select(F.concat(F.lit("r"), (F.col("doc_id") % 20).cast("string")).alias("repo_id"), "path")
    return audits.audit_blob_paths(p)


@query
def blob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _secret_texts(spark, sf_dir).select(F.concat(F.lit("r"), F.length("id").cast("string")).alias("repo_id"), F.sha2("text", 256).alias("sha"), F.concat(F.lit("f/"), "id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return audits.scan_blobs(texts, texts)


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).select(F.col("o_orderkey").alias("repo_id"), F.col("repo_id").alias("user_name"), F.col("author_email").alias("user_email"), F.lit("r1").alias("expected_name"), F.array().cast("array<string>").alias("env_overrides"))


@query
def identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit_identity(_identities(spark, sf_dir)).select(F.col("repo_id").alias("id"), "ok")


@query
def remote_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, repo = F.concat(F.lit("Owner"), F.col("c_nationkey").cast("string")), F.concat(F.lit("Repo"), F.col("c_custkey").cast("string"))
    url = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("git@github.com:"), owner, F.lit("/"), repo, F.lit(".git"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("https://GitHub.com/"), owner, F.lit("/"), repo, F.lit("/"))).otherwise(F.concat(F.lit(" ssh://git@github.com/"), owner, F.lit("/"), repo))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), audits.normalize_remote_url(url).alias("url"), audits.repo_of_url(url).alias("repo"))


@query
def policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    usage = F.concat_ws("\n", F.lit("## Uso"), F.lit(audits.USAGE_LINES[0]), F.when(n % 5 != 0, audits.USAGE_LINES[1]), F.lit(""))
    readme = F.concat(F.lit("# x\n"), F.when(n % 2 != 0, "Dados fictícios e sanitizados\n").otherwise("\n"), usage, F.when(n % 3 == 1, "## Mais\n").otherwise(""))
    entries = F.array(*(F.lit(e) for e in audits.IGNORE_ENTRIES))
    ignore = F.array_join(F.when(n % 3 == 0, entries).otherwise(F.slice(entries, 1, 10)), "\r\n")
    rows = F.array_compact(F.array(
        F.struct(F.lit("src/a.py").alias("path"), F.lit("").alias("text")),
        F.when(n % 4 == 0, F.struct(F.lit("License.txt").alias("path"), F.lit("").alias("text"))),
        F.when(n % 7 != 0, F.struct(F.lit("README.md").alias("path"), readme.alias("text"))),
        F.when(n % 5 != 4, F.struct(F.lit(".gitignore").alias("path"), ignore.alias("text"))),
    ))
    return audits.audit_policy(_table(spark, sf_dir, "supplier").select(n.alias("repo_id"), F.explode(rows).alias("f")).select("repo_id", "f.path", "f.text"))


@query
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    private = F.when(n % 5 == 0, True).when(n % 5 == 1, False)
    status = F.when(n % 3 == 0, 404).otherwise(200)
    return _table(spark, sf_dir, "orders").select(n.alias("id"), audits.visibility(n % 9 != 0, n % 8 != 0, n % 2 == 0, private, status).alias("visibility"))


@query
def gate_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    wishes = _table(spark, sf_dir, "orders").select(
        n.alias("repo_id"), (n % 2 != 0).alias("report_passed"), F.when(n % 3 == 0, "https://github.com/a/b").otherwise("git@github.com:A/c.git").alias("remote_url"), F.lit("https://github.com/a/C/").alias("expected_url"),
        F.when(n % 5 == 0, "PUBLIC").otherwise("PRIVATE").alias("visibility"), F.when(n % 7 == 0, "dev").otherwise("main").alias("branch"), F.when(n % 11 == 0, "approve").otherwise("APPROVE").alias("approval"), F.lit("APPROVE").alias("expected_approval"),
    )
    return audits.gate_push(wishes).select(F.col("repo_id").alias("id"), F.array_join("reasons", ";").alias("reasons"))


LISTS = ("people", "firms", "internal")


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    new = c.select(F.when(n % 3 == 0, "people").when(n % 3 == 1, "firms").otherwise("unknown").alias("list"), F.when(n % 2 == 0, F.concat(F.lit("  "), F.lower("c_name"))).otherwise(F.concat("c_mktsegment", (n % 50).cast("string"))).alias("value"))
    return c.select(F.lit("people").alias("list"), F.col("c_name").alias("value")).distinct(), new


@query
def term_store_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.add_terms(*_store(spark, sf_dir), ("people", "firms"))


@query
def term_store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.merge_backup(*_store(spark, sf_dir), ("people", "firms"))[1]


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every third customer in other case and with more blanks, and of lists that don't have them."""
    c, n = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.filter(n % 3 == 0).select(F.when(n % 2 == 0, "people").otherwise("firms").alias("list"), F.concat(F.lit(" "), F.lower("c_name"), F.lit("  ")).alias("value"))


@query
def term_store_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the store, and how much went from each list."""
    store, gone = _store(spark, sf_dir)[0], _gone(spark, sf_dir)
    left = terms.remove_terms(store, gone).select("list", "value", F.lit(0).cast("long").alias("removed"))
    return left.unionByName(terms.removed_count(store, gone).select("list", F.lit(None).cast("string").alias("value"), "removed"))


@query
def term_store_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.contains_terms(_gone(spark, sf_dir), _store(spark, sf_dir)[0])


@query
def term_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.store_counts(_store(spark, sf_dir)[0], LISTS)


@query
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms encrypted and decrypted again, with their own list's name and with another."""
    store, _ = _store(spark, sf_dir)
    key = F.lit(KEY * 2)
    sealed = encrypt_terms(store, key)
    good = decrypt_terms(sealed, key).select("value", F.lit(True).alias("own_list"))
    return good.unionByName(decrypt_terms(sealed.withColumn("list", F.lit("other")), key).select("value", F.lit(False).alias("own_list")))


def _png(text: Column) -> Column:
    """A small picture with the text as its comment."""

    @F.pandas_udf("binary")
    def make(s: pd.Series) -> pd.Series:
        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        end = chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
        head = media.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
        return s.map(lambda x: head + chunk(b"tEXt", b"Comment\0" + x.encode()) + end)

    return make(text)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PERSONAL).select(F.concat("id", F.lit(".png")).alias("path"), _png(F.col("text")).alias("content"))


@query
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.scan_image_metadata(_images(spark, sf_dir)).select("path", F.explode("findings").alias("f"))
    return found.select("path", "f.line", "f.category", "f.snippet", "f.source")


@query
def blob_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the history's image blobs hold; equal ones are one blob, named by its smallest path."""
    blobs = _images(spark, sf_dir).select(F.lit("r").alias("repo_id"), F.sha2("content", 256).alias("sha"), "path", "content")
    return audits.scan_blobs(blobs, blobs)


@query
def strip_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = media.image_metadata(media.strip_image_metadata(_images(spark, sf_dir)))
    return left.select("path", F.size("kinds").alias("kinds_left"))


@query
def notebook_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notebooks whose outputs hold the text; cleaned and scanned again."""
    cell = F.struct(F.lit("code").alias("cell_type"), F.array("text").alias("outputs"), F.lit(3).alias("execution_count"), F.array(F.lit("x = 1")).alias("source"))
    books = _view(spark, sf_dir, PERSONAL).select("id", F.to_json(F.struct(F.array(cell).alias("cells"), F.lit(4).alias("nbformat"))).alias("text"))
    return books.select("id", redaction.clean_notebook("text").alias("text"))


@query
def history_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _secret_texts(spark, sf_dir).select(F.lit("r0").alias("repo_id"), F.sha2("text", 256).alias("sha"), F.concat(F.lit("f/"), "id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return workflows.audit_history(_commits(spark, sf_dir), texts, texts)


@query
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = split_lines(F.col("text"))
    longest = F.coalesce(F.array_max(F.transform(lines, lambda x: F.length(x))), F.lit(0))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("lines"), longest.alias("longest"))


@query
def word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each document's normalised words, and their number."""
    words = normalize_words(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", bind(words, lambda w: F.struct(F.size(w).alias("words"), F.sha2(F.array_join(w, " "), 256).alias("hash"))).alias("n")).select("doc_id", "n.words", "n.hash")


@query
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("doc_id", slugify(F.col("name")).alias("slug"))


@query
def sensitive_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = content.inventory(_view(spark, sf_dir, PERSONAL).select(F.concat("id", F.lit(".py")).alias("path"), F.encode("text", "UTF-8").alias("content")))
    return snapshots.sensitive_categories(_releasable(plan), audits.audit_commit_emails(_commits(spark, sf_dir)))


@query
def unverified_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.unverified_additions(_view(spark, sf_dir, NOW), _view(spark, sf_dir, BEFORE))


@query
def release_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _view(spark, sf_dir, NOW)
    return snapshots.left_out(_view(spark, sf_dir, BEFORE), now.filter("size % 2 = 0"), now.filter("size % 3 = 0"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all findings of documents and planted values, counted by category."""
    return content.category_summary(patterns.scan_patterns(_personal_texts(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)

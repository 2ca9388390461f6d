"""Registered queries of sources, sinks and streams, each with its SQL beside it. Files are made from the given tables by Spark, in the shared folder, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as O
from .functions.scratch import shared_folder, written
from .operators import content, formats, media, names, patterns, redaction
from .operators.redaction import PLACEHOLDERS
from .queries import Query, _people, _table, _view
from .sources import files, lists, sinks
from .streaming import scan
from .views import BEFORE, PATHS, PERSONAL, SPELLINGS, dialect

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _new(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_folder(spark)}/scrub-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _written_lines(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = _new(spark, name)
    rows.write.text(path)
    return path


# Trees of files.

#: 29 documents in a row share a folder: paths that repeat are of ids 29 or more apart.
_FOLDER = "concat(cast(cast(floor(doc_id / 29) AS bigint) % 1000 AS {S}), '/', cast(cast(floor(doc_id / 29) AS bigint) AS {S}), '/', path)"
_TREE = f"SELECT {_FOLDER} AS path, text FROM ({PATHS}) p"


def _tree(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    root = _new(spark, "files")
    rows = _view(spark, sf_dir, _TREE).select("path", F.encode("text", "UTF-8").alias("content"))
    return root, sinks.write_tree(rows, root)


@query(f"SELECT path, octet_length(encode(text)) AS size, sha256(text) AS sha256, CAST(NULL AS varchar) AS problem FROM ({O.view(_TREE)}) t WHERE text IS NOT NULL")
def tree_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files: what the sink says of each."""
    return _tree(spark, sf_dir)[1]


@query(f"SELECT path, octet_length(encode(text)) AS size, false AS is_symlink, CAST(NULL AS varchar) AS problem FROM ({O.view(_TREE)}) t WHERE text IS NOT NULL")
def tree_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files, and listed folder by folder, hidden ones too."""
    return files.list_files(spark, _tree(spark, sf_dir)[0]).select("path", "size", "is_symlink", "problem")


@query(
    f"""SELECT {O.view(_FOLDER)} AS path, CASE WHEN verdict LIKE 'EXCLUDE%' THEN NULL ELSE sha256(text) END AS sha256,
    CASE WHEN verdict LIKE 'EXCLUDE%' THEN NULL ELSE length(text) END AS chars FROM ({O.CLASSIFIED}) c WHERE path NOT IN (SELECT path FROM ({O.IGNORED}) i) AND text IS NOT NULL"""
)
def tree_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files, and read outside ignored folders: hash and length of what may be read, nothing of what its name excludes."""
    read, _ = files.read_tree(spark, _tree(spark, sf_dir)[0])
    return read.select("path", "sha256", F.length(F.decode("content", "UTF-8")).cast("long").alias("chars"))


@query(f"SELECT path, row_number() OVER (ORDER BY lower(path), path) AS place FROM ({O.view(PATHS)}) p")
def ordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of paths in files written in order: rows before in the same part, after those of all parts before."""
    rows = written(content.order_files(_view(spark, sf_dir, PATHS).select("path")), "ordered").select("path", F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("path", (F.col("before") + F.col("row") + 1).alias("place"))


# Releases and tables of plans.


@query(f"SELECT path, sha256, v AS version FROM ({O.view(BEFORE)}) b, (VALUES ('release'), ('release-v2'), ('release-v3')) n(v) WHERE size % 3 <> 0")
def release_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release written three times, each to the next free version of its place."""
    before, out = _view(spark, sf_dir, BEFORE), None
    copies = before.select("path", F.when(F.col("size") % 3 == 0, "leave").otherwise("copy").alias("decision"))
    folder = _new(spark, "releases")
    for _ in range(3):
        to = sinks.next_free_version(spark, f"{folder}/release")
        sinks.write_release(copies, before.select("path", "sha256"), f"{folder}/source", to)
        read = spark.read.parquet(to).withColumn("version", F.lit(to.rpartition("/")[2]))
        out = read if out is None else out.unionByName(read)
    return out


@query(
    f"""{O._SCANNED} SELECT 'file' AS kind, path, status FROM plan WHERE path NOT IN (SELECT path FROM ({O.IGNORED}) i)
    UNION ALL SELECT DISTINCT 'folder', dir, reason FROM ({O.IGNORED}) j UNION ALL SELECT 'run', 'tree', 'false'"""
)
def written_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of all files outside ignored folders, written as its three tables and read back."""
    kept, dirs = files.prune_ignored_dirs(_view(spark, sf_dir, PATHS))
    plan = content.inventory(kept.select("path", F.encode("text", "UTF-8").alias("content")))
    out = _new(spark, "plan")
    sinks.write_plan(plan, dirs, sinks.run_record(spark, "tree", "inventory", clean=False), out, "tree")
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    folders = read("dirs").select(F.lit("folder").alias("kind"), F.col(dirs.columns[0]).alias("path"), F.col("reason").alias("status"))
    return read("files").select(F.lit("file").alias("kind"), "path", "status").unionByName(folders).unionByName(read("run").select(F.lit("run").alias("kind"), F.col("root").alias("path"), F.col("clean").cast("string").alias("status")))


@query(f"WITH names AS ({O._PERSON_NAMES}), {O._variants('person')} SELECT DISTINCT {O.hmac20('variant')} AS hash FROM variants")
def written_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hashes of all people, written and read back."""
    out = _new(spark, "protected")
    sinks.write_protected(*names.build_protected(_people(spark, sf_dir), O.KEY), out)
    return spark.read.parquet(f"{out}/hashes").select("hash")


# Lists.

_TERM_LINES = "SELECT CASE WHEN c_custkey % 7 = 0 THEN concat(' # note ', cast(c_custkey AS {S})) WHEN c_custkey % 10 = 0 THEN '  ' ELSE concat('  ', c_mktsegment, '-Ação ', cast(c_custkey % 50 AS {S}), ' ') END AS line FROM customer"
_NAME_LINES = "SELECT CASE WHEN c_custkey % 7 = 0 THEN concat('# ', c_name) WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN concat('  # ', c_name) ELSE concat(' ', c_name, ' ') END AS line FROM customer"
_KEPT_TERMS = f"SELECT DISTINCT trim(line) AS name FROM ({O.view(_TERM_LINES)}) t WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')"


@query(f"SELECT name AS term, 'internal' AS category FROM ({_KEPT_TERMS}) k")
def read_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.read_terms(spark, _written_lines(spark, _view(spark, sf_dir, _TERM_LINES), "terms"), "internal")


@query(f"SELECT DISTINCT array_to_string({O._WORDS}, ' ') AS sequence FROM ({_KEPT_TERMS}) k")
def read_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.read_allowlist(spark, _written_lines(spark, _view(spark, sf_dir, _TERM_LINES), "allowed"))


@query(f"SELECT trim(line) AS name, 'person' AS kind FROM ({O.view(_NAME_LINES)}) n WHERE NOT starts_with(line, '#') AND trim(line) <> ''")
def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.read_names_text(spark, _written_lines(spark, _view(spark, sf_dir, _NAME_LINES), "names"))


@query("SELECT c_name AS name, 'company' AS kind FROM customer WHERE c_custkey % 5 < 3")
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from exported records, a hundred of them a file: by field id, by field name where the former is empty or missing; numbers and other fields don't count."""
    named = lambda holder: F.concat(F.lit(f'{{"{holder}":{{"f1":"'), F.col("c_name"), F.lit(' "}}'))
    kind = F.col("c_custkey") % 5
    other = F.when(kind == 3, F.lit('{"fields":{"f1":17}}')).otherwise(F.lit('{"cellValuesByFieldId":{"f2":"x"},"fields":{"f1":"y"}}'))
    record = F.when(kind == 0, named("cellValuesByFieldId")).when(kind == 1, named("fields")).when(kind == 2, F.concat(F.lit('{"cellValuesByFieldId":{},'), F.substring(named("fields"), 2, 1 << 20))).otherwise(other)
    by = F.floor(F.col("c_custkey") / 100).alias("part")
    exports = _table(spark, sf_dir, "customer").groupBy(by).agg(F.concat(F.lit('{"records":['), F.array_join(F.collect_list(record), ","), F.lit("]}")).alias("value"))  # 100 keys a group
    path = _new(spark, "records")
    exports.write.partitionBy("part").text(path)
    return lists.read_names_records(spark, path, "f1")


@query(f"SELECT 'made/' || path AS path, sha256 FROM ({O.view(BEFORE)}) b WHERE sha256 IS NOT NULL")
def read_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of synthetic files, in one file for each hundred documents."""
    entry = F.concat(F.lit('"made\\\\'), F.col("path"), F.lit('":"'), F.col("sha256"), F.lit('"'))
    by = F.floor(F.substring("path", 2, 20).cast("long") / 100).alias("part")
    parts = _view(spark, sf_dir, BEFORE).groupBy(by).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))  # 100 ids a group
    path = _new(spark, "registry")
    parts.write.partitionBy("part").text(path)
    return lists.read_synthetic_registry(spark, path)


# Plans of what isn't plain text, and formats that a user brings.


@query(
    f"""{O._SCANNED} SELECT path, CASE WHEN path LIKE '%3%' OR status = 'EXCLUDE' THEN 'EXCLUDE' WHEN path LIKE '%5.%' THEN 'REVIEW' ELSE status END AS status,
    CASE WHEN path NOT LIKE '%3%' AND path NOT LIKE '%5.%' THEN total_findings END AS total_findings FROM plan"""
)
def links_and_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan where some files are links, and others couldn't be read."""
    path = F.col("path")
    rows = _view(spark, sf_dir, PATHS).select("path", path.contains("3").alias("is_symlink"), F.when(~path.contains("5."), F.encode("text", "UTF-8")).alias("content"))
    return content.inventory(rows).select("path", "status", F.col("total_findings").cast("long").alias("total_findings"))


@query(
    f"""{O.found(f"SELECT id, text FROM ({O.view(PERSONAL)}) p WHERE kind <> 3")}, n AS (SELECT id, count(*) AS n FROM found GROUP BY id)
    SELECT p.id, CASE WHEN kind <> 3 THEN length(trim(text)) END AS ocr_chars, coalesce(n, 0) AS findings, CASE WHEN kind = 3 THEN 'image text not read' END AS reason FROM ({O.view(PERSONAL)}) p LEFT JOIN n ON n.id = p.id"""
)
def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted values as the texts of images; those of one kind weren't read."""
    rows = _view(spark, sf_dir, PERSONAL).select("id", media.scan_ocr_text(F.when(F.col("kind") != 3, F.col("text"))).alias("o"))
    return rows.select("id", F.col("o.ocr_chars").cast("long").alias("ocr_chars"), F.size("o.findings").cast("long").alias("findings"), "o.reason")


_OWN_FORMATS = [("order_tag", ["ord_", "ordx_"], "a-f0-9", 20, 20), ("batch_tag", ["XQ"], "A-F0-9-", 8, None)]
_TAGGED = """SELECT id, kind, value, concat('see ', value, ' end') AS text FROM (SELECT concat('o', cast(o_orderkey AS {S})) AS id, o_orderkey % 6 AS kind,
    CASE o_orderkey % 6 WHEN 0 THEN concat('ord_', substr(h, 1, 20)) WHEN 1 THEN concat('ordx_', substr(h, 1, 20)) WHEN 2 THEN concat('ord_', substr(h, 1, 19)) WHEN 3 THEN concat('XQ', upper(substr(h, 1, 6)), '-', upper(substr(h, 7, 30)))
      WHEN 4 THEN concat('pre', 'ord_', substr(h, 1, 20)) ELSE concat('XQ', upper(substr(h, 1, 7))) END AS value FROM (SELECT o_orderkey, {H:cast(o_orderkey AS {S}):H} AS h FROM orders) a) b"""


@query(f"SELECT id, 1 AS line, CASE WHEN kind < 2 THEN 'order_tag' ELSE 'batch_tag' END AS category, {O.mask("'order_tag'", 'value')} AS snippet FROM ({O.view(_TAGGED)}) t WHERE kind IN (0, 1, 3)")
def formats_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats that a table brings, in planted values of all orders: whole ones, too short ones, ones within a word."""
    table = spark.createDataFrame(_OWN_FORMATS, "category string, starts array<string>, alphabet string, least int, most int")
    return patterns.scan_patterns(_view(spark, sf_dir, _TAGGED), patterns=formats.token_formats(table)).select("id", "line", "category", "snippet")


# Redaction of each kind of value.

_PLACES = "CASE category " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in PLACEHOLDERS.items()) + " END"


@query(f"SELECT id, concat('valor ', {_PLACES}, ' fim') AS text FROM ({O.view(SPELLINGS)}) s")
def redact_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted values of all categories in uncommon spellings, redacted."""
    return redaction.redact(_view(spark, sf_dir, SPELLINGS)).select("id", "text")


_KINDS = ("cpf", "cnpj", "court_case", "court_case_bare", "phone", "cep", "email", "private_ip")


_REDACTED_PERSONAL = f"""SELECT id, CASE WHEN {O.placeholder('category', 'value')} THEN text ELSE concat(label, ' ', {_PLACES}, ' fim') END AS text
    FROM (SELECT *, CASE kind {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS category FROM ({O.view(PERSONAL)}) p) x"""


@query(_REDACTED_PERSONAL)
def redact_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted personal data redacted; stand-ins stay."""
    return redaction.redact(_view(spark, sf_dir, PERSONAL)).select("id", "text")


# Streams: the given tables read as streams, to their end, with their state and results in the shared folder.


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")  # as a pattern it may be a file as well as a folder


def _to_end(rows: DataFrame, name: str) -> DataFrame:
    spark, out = rows.sparkSession, _new(rows.sparkSession, name)
    rows.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _planted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stream(spark, sf_dir, "customer").createOrReplaceTempView("customer_stream")
    return spark.sql(dialect(PERSONAL, "spark").replace("FROM customer", "FROM customer_stream"))


@query(f"{O.found(O.PERSONAL_TEXTS)} SELECT id, line, category, {O.mask('category', 'shown')} AS snippet FROM found")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents and planted values, read as a stream."""
    docs = _stream(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    texts = docs.unionByName(_planted_stream(spark, sf_dir).select("id", "text"))
    return _to_end(scan.scan_stream(texts, "id", "text").select("id", "line", "category", "snippet"), "found")


@query(_REDACTED_PERSONAL)
def stream_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted personal data, redacted as a stream."""
    return _to_end(scan.redact_stream(_planted_stream(spark, sf_dir), "text").select("id", "text"), "redacted")


@query(f"{O.found('SELECT doc_id AS id, text FROM documents')} SELECT id * 60 // 600 * 600 AS start_s, category, count(*) AS findings FROM found GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents, a minute apart, by category and ten minutes; the last batch's totals."""
    docs = _stream(spark, sf_dir, "documents").select(F.timestamp_seconds(F.col("doc_id") * 60).alias("at"), "text")
    out = _new(spark, "windows")
    totals = scan.findings_per_window(docs, "at", "text").select(F.unix_timestamp("window.start").alias("start_s"), "category", "findings")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(totals.schema).parquet(out)


@query(f"{O.found('SELECT DISTINCT sha256(text) AS id, text FROM documents')} SELECT id, line, category FROM found")
def stream_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each distinct text of a stream of documents, scanned once though copies come again."""
    docs = _stream(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), "text", F.timestamp_seconds(F.lit(1_600_000_000)).alias("at"))
    out = _new(spark, "blobs")
    scan.start_scan(docs, "at", out, f"{out}-state", trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema("id string, line int, category string").parquet(f"{out}/batch=*")

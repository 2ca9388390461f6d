"""Queries over the given tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to token files of 16 bits an id, read back from the files."""
    from .token_files import encode_to_files
    from .tokens import vocabulary_of

    return encode_to_files(_table(spark, sf_dir, "documents"), word_tokenizer(), vocabulary_of(word_tokenizer()))


def capture_log(pages: DataFrame) -> DataFrame:
    """Archive records made from the pages: each page's response, two "not modified" revisits of its URL, and one of an identical payload.

    A page was captured at a time that its id gives, with an entity tag (three of four pages) or a
    modification date as validator. The first revisit carries the page's own validators, the second,
    some weeks later, those of an older state for one page in five and none for one in seven. One page
    in eleven has a header twice, in names of different case.
    """
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") * 7919 % 8_640_000)
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))

    def headers(tag: Column, modified: Column, more: list[Column]) -> Column:
        pairs = [F.struct(F.lit("ETag").alias("key"), tag.alias("value")), F.struct(F.lit("Last-Modified").alias("key"), modified.alias("value")), *more]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    own_tag, own_day = F.when(F.col("page_id") % 4 != 0, tag), F.when(F.col("page_id") % 3 != 0, day)
    old = F.col("page_id") % 5 == 0
    none = F.col("page_id") % 7 == 0
    kinds = [
        ("response", None, 200, 0, headers(own_tag, own_day, [pair("Content-Type", F.lit("text/html")), pair("Cache-Control", F.lit("max-age=60"))])),
        ("revisit", "http://netpreserve.org/warc/1.1/revisit/server-not-modified", 304, 86_400 * 3, headers(F.concat(F.lit("W/"), own_tag), own_day, [pair("Cache-Control", F.lit("max-age=600")), pair("cache-control", F.when(F.col("page_id") % 11 == 0, "no-transform")), pair("Content-Type", F.lit("text/plain"))])),
        ("revisit", None, 304, 86_400 * 25, headers(F.when(~none, F.when(old, F.lit('"old"')).otherwise(own_tag)), F.when(~none, own_day), [pair("Expires", day)])),
        ("revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", 200, 86_400 * 26, headers(own_tag, own_day, [])),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("type"), F.lit(p).cast("string").alias("profile"), F.lit(s).alias("status"), F.lit(d).alias("delay"), h.alias("headers")) for i, (k, p, s, d, h) in enumerate(kinds)))
    return pages.select("page_id", "url", at.alias("at"), digest.alias("digest"), F.explode(rows).alias("r")).select(
        F.concat(F.format_string("%012d", "page_id"), F.lit("-"), F.col("r.i").cast("string")).alias("record_id"), "r.type", F.col("url").alias("uri"),
        (F.col("at") + F.make_dt_interval(secs=F.col("r.delay").cast("decimal(18,6)"))).alias("date"), "r.profile", "r.status", "r.headers", F.when(F.col("r.status") == 200, F.col("digest")).alias("payload_digest"),
    )


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisits of the capture log made from the pages, resolved to earlier responses."""
    from .revisits import resolve

    found = resolve(capture_log(_table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select(
        F.substring("record_id", 1, 12).cast("long").alias("page_id"), "record_id", "canonical_url", "verdict", "match_id",
        F.unix_seconds("date").alias("date_s"), F.unix_seconds("match_date").alias("match_s"), "payload_digest", F.array_join(entries, "\n").alias("headers"),
    )


#: Shares of languages and topics, and the exponent that shares of sources are raised to.
MIX = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": {"prose": 0.8, "contact": 0.06, "legal": 0.05, "table": 0.05, "code": 0.04}}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and drawn uses of all documents for half of their tokens, raked to MIX."""
    from .common import materialize
    from .mixing import mix, topic_of, words_of

    # Topics and words are found in one scan; the rest works on the small table of them.
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), words_of(F.col("text")).alias("tokens"))
    found = mix(materialize(docs, "mix"), MIX, budget=0.5, tokens_col="tokens")
    return found.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), "tokens", *(F.col(f"mix_{c}").alias(c) for c in ("weight", "copies", "residual")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer(), 4096)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and components of those within 3 bits."""
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents, of their edited texts, and likenesses."""
    from .winnow import compare_edited

    return compare_edited(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of all documents and the verdict of the isolation forest."""
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to 8 shards by their id."""
    from .sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), shards=8)


def op9_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of all documents, by a network trained on all of them."""
    from .pseudo_lm import pseudo_likelihood

    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labelled ones that aren't held out."""
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in each of their 120 orders, by language."""
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents and where to cut those of more than 4096, read off indexes of all their prefixes."""
    from ..sources.files import spread
    from .prefix_counts import token_budget

    return token_budget(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), piece_model(), 4096)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of all embeddings."""
    from .whitening import components_of, whiten

    return components_of(*whiten(_table(spark, sf_dir, "embeddings"), 8))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bitpack": op1_bitpack,
        "op2_revisits": op2_revisits,
        "op3_mixing": op3_mixing,
        "op4_packing": op4_packing,
        "op5_simhash": op5_simhash,
        "op6_winnow": op6_winnow,
        "op7_quality": op7_quality,
        "op8_sharding": op8_sharding,
        "op9_pseudo_lm": op9_pseudo_lm,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_prefix_counts": op12_prefix_counts,
        "op13_whitening": op13_whitening,
    }


#: DuckDB SQL of op2 and op11. The others learn, tokenize, or take checksums and hashes that SQL lacks; tests hold them against plain versions.
OP2_SQL = r"""
WITH log AS (
  SELECT page_id, i, lpad(cast(page_id AS varchar), 12, '0') || '-' || i AS record_id, url AS uri, 1600000000 + page_id * 7919 % 8640000 + CASE i WHEN 0 THEN 0 WHEN 1 THEN 259200 WHEN 2 THEN 2160000 ELSE 2246400 END AS date_s, sha256(coalesce(html, '')) AS digest,
    CASE WHEN page_id % 4 <> 0 THEN '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' END AS tag, CASE WHEN page_id % 3 <> 0 THEN 'day ' || (page_id % 365) END AS lm
  FROM pages, (VALUES (0), (1), (2), (3)) v(i)),
parts AS (
  SELECT *, regexp_replace(trim(uri), '#.*$', '') AS bare,
    CASE WHEN i = 2 AND page_id % 7 = 0 THEN NULL WHEN i = 2 AND page_id % 5 = 0 THEN '"old"' WHEN i = 1 THEN 'W/' || tag ELSE tag END AS etag, CASE WHEN i = 2 AND page_id % 7 = 0 THEN NULL ELSE lm END AS modified FROM log),
canon AS (
  SELECT *, 'https://' || regexp_replace(regexp_replace(lower(regexp_extract(bare, '(?i)^https?://([^/?]+)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '(?i)^https?://[^/?]+([^?]*)', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept FROM parts) x),
full_ AS (SELECT canonical_url, date_s, max(record_id) AS record_id FROM canon WHERE i = 0 GROUP BY ALL),
near AS (
  SELECT r.*, f.record_id AS match_id, f.date_s AS match_s FROM (SELECT * FROM canon WHERE i IN (1, 2)) r ASOF LEFT JOIN full_ f ON r.canonical_url = f.canonical_url AND r.date_s > f.date_s),
judged AS (
  SELECT n.*, m.etag AS m_etag, m.modified AS m_modified, m.digest AS m_digest, CASE WHEN match_id IS NULL THEN 'missing'
    WHEN n.etag IS NOT NULL AND m.etag IS NOT NULL THEN CASE WHEN regexp_replace(n.etag, '^W/', '') = m.etag THEN 'etag' ELSE 'changed' END
    WHEN n.modified IS NOT NULL AND m.modified IS NOT NULL THEN CASE WHEN n.modified = m.modified THEN 'last-modified' ELSE 'changed' END ELSE 'unchecked' END AS verdict
  FROM near n LEFT JOIN (SELECT * FROM canon WHERE i = 0) m ON m.record_id = n.match_id)
SELECT page_id, record_id, canonical_url, verdict, match_id, date_s, match_s, CASE WHEN verdict NOT IN ('missing', 'changed') THEN m_digest END AS payload_digest,
  CASE WHEN verdict NOT IN ('missing', 'changed') THEN array_to_string(list_filter(['cache-control: ' || CASE WHEN i = 2 THEN 'max-age=60' WHEN page_id % 11 = 0 THEN 'max-age=600, no-transform' ELSE 'max-age=600' END, 'content-type: text/html', 'etag: ' || coalesce(etag, m_etag),
    CASE WHEN i = 2 THEN 'expires: day ' || (page_id % 365) END, 'last-modified: ' || m_modified], lambda h: h IS NOT NULL), chr(10)) END AS headers
FROM judged
UNION ALL SELECT page_id, record_id, canonical_url, 'other', NULL, date_s, NULL, digest, array_to_string(list_filter(['etag: ' || etag, 'last-modified: ' || modified], lambda h: h IS NOT NULL), chr(10)) FROM canon WHERE i = 3
"""


#: Counts documents for each order and step directly, without subsets.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
yes AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN yes ON yes.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT i, substr('ABCDE', i, 1) AS c FROM range(1, 6) r(i)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT g.part, filter_order, step, o[step] AS mine, g.n, g.good, g.toxic, fails[o[step]] AS fails_mine, list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])) AS gone,
    len(list_filter(fails, lambda x: x)) AS failed
  FROM g, orders, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, any_value(mine) AS mine, coalesce(sum(n) FILTER (WHERE NOT coalesce(gone, false) AND NOT fails_mine), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT coalesce(gone, false) AND fails_mine), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE coalesce(gone, false) AND fails_mine), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails_mine AND failed = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT coalesce(gone, false) AND fails_mine), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT coalesce(gone, false) AND fails_mine), 0) AS toxic_lost
  FROM s GROUP BY part, filter_order, step)
SELECT part, filter_order, cast(step AS integer) AS step, substr('ABCDE', mine, 1) AS filter, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, mine) AS bigint) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_revisits": OP2_SQL, "op11_filter_audit": OP11_SQL}

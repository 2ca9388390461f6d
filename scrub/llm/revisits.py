"""Resolve "not modified" revisit records of web archives to the full responses they stand for.

A crawler that got status 304 writes a revisit record without a body. What the server meant is the
latest full response of that URL before it, if its validators still hold. Resolving is an as-of join
by canonical URL; headers that a 304 may update replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers that a 304 response updates (RFC 9110, section 15.4.5). Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change what is served. A parameter; fixed values.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: Ending of the profile of revisits that a 304 response made (WARC 1.0 and 1.1). A fixed value.
NOT_MODIFIED = "/revisit/server-not-modified"


def canonical_url(url: Column) -> Column:
    """Canonical form: https, lower-case host without ``www.``, ``m.`` and default port, no fragment, no tracking
    parameters, other parameters in order, no final slash. Null stays null; what isn't http(s) is only trimmed."""
    url = F.trim(url)
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"(?i)^https?://([^/?]+)", 1)), r"^(www|m)\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?i)^https?://[^/?]+([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i)({TRACKING})(=|$)")))
    return F.when(url.rlike(r"(?i)^https?://[^/?]"), F.concat(F.lit("https://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))).otherwise(url)


def strong(etag: Column) -> Column:
    """An entity tag for weak comparison: without ``W/`` and blanks; null if empty."""
    return F.nullif(F.regexp_replace(F.trim(etag), "^W/", ""), F.lit(""))


def low_headers(m: Column) -> Column:
    """Headers with names in lower case; distinct values of names that differ in case only are joined by ``, ``, in
    the order of their names, as RFC 9110 joins repeated fields. Null gives an empty map; null values don't count."""
    entries = F.array_sort(F.filter(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = F.transform(names, lambda n: F.array_join(F.array_distinct(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])), ", "))
    return F.map_from_arrays(names, values)


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers, with those of PERMITTED that the 304 has; names in lower case."""
    allowed = F.map_filter(low_headers(update), lambda k, _: k.isin(*PERMITTED))
    rest = F.map_filter(low_headers(stored), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def resolve(records: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """One row for each revisit record: what it resolves to, and why or why not.

    ``records``: record_id (string), type (``response`` or ``revisit``), uri, date (timestamp), status (int),
    headers (map), payload_digest, optional profile. Other columns are ignored. Full responses are those of status
    200; other responses and types are ignored. A revisit means "not modified" if its profile says so or, where it has
    none, its status is 304 or null; others (of an identical payload, for one) are not resolved: verdict
    ``other``, with their own digest and headers. The match is the full response of the same canonical URL with the latest date before the
    revisit's, of equal dates the greatest record_id. verdict: ``etag`` or ``last-modified`` (that
    validator agrees; the entity tag decides where both records have one), ``unchecked`` (no validator in
    common), ``changed`` (validators differ: not resolved), ``missing`` (no earlier response). A null URL or
    date never matches; a null record_id is a value like others. Repeated revisits each come back. Header names that
    differ in case only are one (``low_headers``). An empty table gives no rows.

    Bodies stay out of the join. A URL's history is cut into buckets of time, each ordered on its
    own; the last response of each bucket is then carried on along the buckets of a URL, so
    that a URL that a third of all records have is no single task.
    """
    profile = F.col("profile") if "profile" in records.columns else F.lit(None).cast("string")
    unmodified = F.when(profile.isNotNull(), profile.endswith(NOT_MODIFIED)).otherwise(F.coalesce(F.col("status") == 304, F.lit(True)))
    full = (F.col("type") == "response") & (F.col("status") == 200)
    kept = records.filter(full | (F.col("type") == "revisit")).select(
        "record_id", canonical_url(F.col("uri")).alias("url"), "date", F.coalesce(full, F.lit(False)).alias("full"), "headers", "payload_digest", (full | unmodified).alias("joins"),
        F.expr(f"timestamp_seconds(floor(unix_seconds(date) / {_seconds(bucket)}) * {_seconds(bucket)})").alias("bucket"),
    )
    held = F.when(F.col("full"), F.struct("record_id", "date", "headers", "payload_digest"))
    joinable = kept.filter("joins and url is not null and date is not null")
    order = W.partitionBy("url", "bucket").orderBy("date", "full", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = joinable.withColumn("near", F.last(held, ignorenulls=True).over(order)).filter(~F.col("full"))
    last = joinable.filter("full").groupBy("url", "bucket").agg(F.max_by(held, F.struct("date", "record_id")).alias("last"))
    # Buckets that have revisits or responses, and for each the last response of the buckets before it.
    buckets = joinable.select("url", "bucket").distinct().join(last, ["url", "bucket"], "left")
    before = W.partitionBy("url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.select("url", "bucket", F.last("last", ignorenulls=True).over(before).alias("far"))
    found = near.join(carried, ["url", "bucket"], "left").withColumn("match", F.coalesce("near", "far"))
    outside = kept.filter(~F.col("full") & (~F.col("joins") | F.col("url").isNull() | F.col("date").isNull())).withColumn("match", F.lit(None))
    parts = ["record_id", "url", "date", "headers", "payload_digest", "joins", "match"]
    found = found.select(*parts).unionByName(outside.select(*parts))

    def first_header(m: str, name: str) -> Column:
        return F.try_element_at(low_headers(F.col(m)), F.lit(name))

    tags = strong(first_header("headers", "etag")), strong(first_header("match.headers", "etag"))
    dates = first_header("headers", "last-modified"), first_header("match.headers", "last-modified")
    verdict = (
        F.when(~F.col("joins"), "other")
        .when(F.col("match").isNull(), "missing")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "etag").otherwise("changed"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "last-modified").otherwise("changed"))
        .otherwise("unchecked")
    )
    ok = F.col("verdict").isin("etag", "last-modified", "unchecked")
    other = F.col("verdict") == "other"
    return found.withColumn("verdict", verdict).select(
        "record_id", F.col("url").alias("canonical_url"), "date", "verdict",
        F.col("match.record_id").alias("match_id"), F.col("match.date").alias("match_date"),
        F.when(ok, F.col("match.payload_digest")).when(other, F.col("payload_digest")).alias("payload_digest"),
        F.when(ok, merged_headers(F.col("match.headers"), F.col("headers"))).when(other, low_headers(F.col("headers"))).alias("headers"),
    )


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]

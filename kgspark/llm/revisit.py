"""WARC revisit resolution: an as-of join of not-modified records to the latest earlier full response of their URL.

The records are range-partitioned by (canonical URL, time), so a URL with any
share of all rows spreads over many partitions. Within a partition a window
carries the last full response forward; from partition to partition one row a
URL is carried by a window over partition numbers. Payloads take no part: only
ids, validators and headers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.session import materialise

#: Header fields that a 304 response may bring up to date (lower case); the others stay as the full response had them.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that only track visits.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="

RECORD = "record_id long, url string, at long, kind string, status int, headers map<string,string>, digest string"


def canonical(url: Column) -> Column:
    """A URL's canonical form: no scheme, user, www. or m. label, default port, fragment, tracking parameters or closing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:80|:443|\.)$", "")
    host = F.regexp_replace(host, r"^(www[0-9]*|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)?", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; a null map counts as empty, a name given twice keeps its last value."""
    return F.map_from_entries(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def etag(headers: Column) -> Column:
    """An entity tag for weak comparison: without W/ and outer spaces."""
    return F.regexp_replace(F.trim(F.element_at(headers, "etag")), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, source_id, check, status, headers.

    records: RECORD (other columns are ignored). kind "response" with status
    200 is a full response, kind "revisit" a not-modified one; other rows are
    no sources and give no rows. source_id is the latest full response of the
    same canonical URL that is earlier (by at, then record_id), null if there
    is none, and then check is "no-source". check is "etag" or "last-modified" by the
    validator that both name and that agrees, "mismatch" if the first one that both name
    differs, "unchecked" if they name none in common, with "digest" where payload digests agree instead. Headers
    are the source's, brought up to date by permitted ones of the revisit; a
    mismatch merges nothing and keeps the revisit's own. Null URLs count as
    the empty one; null times come first.
    """
    spark = records.sparkSession
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    source = F.when(full, F.struct("record_id", "headers", "digest"))
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical(F.coalesce("url", F.lit(""))).alias("url_key"), F.coalesce(F.col("at").cast("long"), F.lit(-(2**63))).alias("at"),
        F.coalesce("kind", F.lit("")).alias("kind"), F.col("status").cast("int").alias("status"), lower_keys(F.col("headers")).alias("headers"), "digest",
    ).where(full | (F.col("kind") == "revisit"))
    rows = rows.withColumn("source", source)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialise(rows.repartitionByRange(n, "url_key", "at", "record_id").withColumn("slice", F.spark_partition_id()), "revisits")
    order = [F.col("at"), F.col("record_id"), F.col("kind")]
    inside = Window.partitionBy("slice", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("source", ignorenulls=True).over(inside)
    # the last source of each slice and URL, then the last one of earlier slices: a URL has a row a slice at most
    lasts = sliced.where("source is not null").groupBy("slice", "url_key").agg(F.max_by("source", F.struct(*order)).alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = sliced.select("slice", "url_key").distinct().join(lasts, ["slice", "url_key"], "left").withColumn("before", F.last("last", ignorenulls=True).over(earlier)).where("before is not null").select("slice", "url_key", "before")
    got = sliced.withColumn("near", carried).where("kind = 'revisit'").join(spans, ["slice", "url_key"], "left")
    got = got.withColumn("found", F.coalesce("near", "before"))
    theirs, ours = F.col("found.headers"), F.col("headers")
    tags = etag(theirs), etag(ours)
    dates = F.trim(F.element_at(theirs, "last-modified")), F.trim(F.element_at(ours, "last-modified"))
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    check = (
        F.when(F.col("found").isNull(), "no-source")
        .when(both(tags), F.when(tags[0] == tags[1], "etag").otherwise("mismatch"))
        .when(both(dates), F.when(dates[0] == dates[1], "last-modified").otherwise("mismatch"))
        .when(F.col("found.digest").isNotNull() & F.col("digest").isNotNull(), F.when(F.col("found.digest") == F.col("digest"), "digest").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    fresh = F.map_filter(ours, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    good = F.col("check").isin("etag", "last-modified", "digest", "unchecked")
    return got.withColumn("check", check).select(
        "record_id", "url_key", F.col("found.record_id").alias("source_id"), "check",
        F.when(good, F.lit(200)).otherwise(F.col("status")).alias("status"), F.when(good, merged).otherwise(ours).alias("headers"),
    )


#: Clock ticks from a capture to the request for it; odd, so no two records are at one time.
LATER = 2001


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC-like records (RECORD) of a pages table: each capture as a full response, and each asked for again afterwards.

    page_id gives the order in time: capture k is a response at 2k, and a
    conditional request at 2k + LATER with the validators of that capture is a
    revisit. The etag is the digest of the page, so where another capture of the
    same canonical URL came between, that one is the source and the check tells whether it was the same.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", digest.alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    both = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n").cast("string"), F.lit("Date"), (F.col("page_id") * 2).cast("string")).alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"), F.lit("Set-Cookie"), F.lit("visit=1"), F.lit("Date"), (F.col("page_id") * 2 + LATER).cast("string")).alias("headers")),
    )
    return base.select("url", "digest", F.explode(both).alias("r")).select("r.record_id", "url", F.when(F.col("r.kind") == "revisit", F.col("r.record_id") - 1 + LATER).otherwise(F.col("r.record_id")).alias("at"), "r.kind", "r.status", "r.headers", "digest")


def written(headers: Column) -> Column:
    """name=value, sorted by name, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")

"""Resolution of not-modified revisits in web captures.

A revisit record has no body. Its content is the latest earlier full response of the same canonical URL,
if the validators agree; the headers that a 304 response may carry replace those of the stored one.

The as-of join goes in two steps, so that a URL with very many captures is not one task: within (URL,
time bucket) a running window finds the last full response, and what each bucket ends with, a row for
URL and bucket, is carried forward to later buckets. Bodies never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: The header fields that a 304 response may send to replace stored ones (RFC 9110, 15.4.5, with Last-Modified).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that track visitors and do not choose content.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref|session|sid"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme-less host without `www.`, `m.` or default port, path without a last slash, sorted
    query without tracking parameters, no fragment. Null and blank stay null.
    """
    u = F.trim(url)
    bare = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&", -1)
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)")))
    return F.when(F.length(u) > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(captures: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per revisit: rec_id, canonical_url, ts, source_id, status and merged headers (a map).

    `captures`: rec_id long, url, ts long, is_revisit boolean, etag, last_modified, headers map (names in lower case).
    status: resolved; mismatch (an entity tag or, without tags on both sides, a date differs); unchecked (nothing to
    compare; resolved nowhere); no_response (no earlier full response); no_key (null URL or time).
    Earlier is strictly less in `ts`; of full responses at one time that with the largest rec_id counts. A null
    is_revisit is a full response. source_id and headers are null unless resolved. Revisits that are repeated
    rows are each resolved. Null headers are empty. Other columns are not read.
    """
    none = F.create_map().cast("map<string,string>")
    c = captures.select("rec_id", canonical_url(F.col("url")).alias("url"), "ts", F.coalesce("is_revisit", F.lit(False)).alias("again"), "etag", "last_modified", F.coalesce("headers", none).alias("headers"))
    no_key = F.col("url").isNull() | F.col("ts").isNull()
    lost = c.where(no_key & F.col("again")).select("rec_id", F.col("url").alias("canonical_url"), "ts", F.lit(None).cast("long").alias("source_id"), F.lit("no_key").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"))
    c = c.where(~no_key)
    low, high = captures.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    full = F.when(~F.col("again"), F.struct("ts", "rec_id", "etag", "last_modified", "headers"))
    c = c.withColumns({"bucket": F.floor((F.col("ts") - F.lit(low or 0)) / width), "full": full})
    # At one time revisits come first, so a full response of the same time is not earlier.
    order = Window.partitionBy("url", "bucket").orderBy("ts", F.when(F.col("again"), 0).otherwise(1), "rec_id")
    inside = c.withColumn("near", F.last("full", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("again")
    ends = c.groupBy("url", "bucket").agg(F.max_by("full", F.when(~F.col("again"), F.struct("ts", "rec_id"))).alias("end"))
    carried = ends.select("url", "bucket", F.last("end", ignorenulls=True).over(Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    j = inside.join(carried, ["url", "bucket"]).withColumn("found", F.coalesce("near", "carried"))
    f = F.col("found")
    tags, dates = F.col("etag").isNotNull() & f["etag"].isNotNull(), F.col("last_modified").isNotNull() & f["last_modified"].isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(f["etag"])).when(dates, F.col("last_modified") == f["last_modified"])
    status = F.when(f.isNull(), "no_response").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    sent = F.map_filter("headers", lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(f["headers"], lambda k, v: ~F.array_contains(F.map_keys(F.col("sent")), k)), F.col("sent"))
    out = j.withColumns({"status": status, "sent": sent}).select(
        "rec_id", F.col("url").alias("canonical_url"), "ts", F.when(F.col("status") == "resolved", f["rec_id"]).alias("source_id"), "status", F.when(F.col("status") == "resolved", merged).alias("headers")
    )
    return out.unionByName(lost)


def with_bodies(resolved: DataFrame, captures: DataFrame, body_col: str) -> DataFrame:
    """The resolved revisits with the body of their source, joined by record id."""
    bodies = captures.select(F.col("rec_id").alias("source_id"), F.col(body_col).alias("body"))
    return resolved.join(bodies, "source_id", "left")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made from the `pages` table, which holds full responses only.

    Each page is a full response at time 10 page_id, tagged with the MD5 of its body; pages with page_id
    not divisible by 3 were asked for again, under another spelling of their URL, at 10 page_id + 5: those
    divisible by 7 with an outdated tag, those divisible by 5 with a date alone, those divisible by 11 with neither.
    Every 13th page has a revisit before its first response.
    """
    i, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    date = F.concat(F.lit("day "), (i % 365).cast("string"))
    full = pages.select(
        (2 * i).alias("rec_id"), "url", (10 * i).alias("ts"), F.lit(False).alias("is_revisit"), tag.alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    bare = i % 11 == 0
    sent = F.when(bare | (i % 5 == 0), F.lit(None)).when(i % 7 == 0, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), tag))
    again = pages.where(i % 3 != 0).select(
        (2 * i + 1).alias("rec_id"), F.concat("url", F.lit("#again")).alias("url"), F.when(i % 13 == 0, 10 * i - 5).otherwise(10 * i + 5).alias("ts"), F.lit(True).alias("is_revisit"), sent.alias("etag"), F.when(~bare, date).alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), (i % 100).cast("string")), F.lit("server"), F.lit("cache")).alias("headers"),
    )
    return full.unionByName(again)

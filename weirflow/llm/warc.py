"""Not-modified revisits of WARC files, resolved by an as-of join.

A revisit record (status 304) names no payload. It is given that of the latest earlier full response of the same canonical
URL, if the validators agree: entity tags where the revisit has one (compared weakly), else its Last-Modified date, else
nothing speaks against it. Headers are the response's, updated by those of the revisit that a 304 response may change.

The join is two running windows, not a join of rows with rows: within a stretch of time of one URL, and over the stretches
of the URL. So a URL that has a third of all records is many tasks. Bodies stay out of it; the records carry digests.

Defined results (status): "full" for responses; for revisits "resolved", "mismatch" (validators disagree) or "unresolved"
(no earlier response, no URL or no time). Earlier is by time and then record id, so of equal times the smaller id is the
earlier one; of repeated rows each stands for itself and none precedes the other. Null headers count as none. Columns of
records beyond the named ones are dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, stage, text_of

#: Query parameters that don't select content.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid|sid)(=|$)"
#: Headers by which a 304 response updates the stored one (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Records in one stretch of time, about, and the most stretches: their bounds stand in the plan. A stretch of more than
#: STRETCH_ROWS records (beyond 1.3 billion of them) is sorted with spilling.
STRETCH_ROWS, MOST_STRETCHES = 20_000, 65_536


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, default port, leading www or m, closing slashes and fragment; parameters sorted, without tracking ones."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    raw = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(raw), r"^(www|m)\.", ""), r":(80|443)$", "")
    rest = F.substring(bare, F.length(raw) + 1, F.lit(2**31 - 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.when(F.contains(rest, F.lit("?")), F.substring(rest, F.instr(rest, "?") + 1, F.lit(2**31 - 1))).otherwise("")
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, url, ts, kind ("response" or "revisit"), headers map<string,string>, payload_digest.

    Returns record_id, canonical_url, kind, status, source_id, headers, payload_digest. Header names that differ in case alone must not repeat.
    """
    rows = records.select("record_id", canonical_url(F.col("url").cast("string")).alias("url"), "ts", "kind", _lower_keys(F.col("headers")).alias("headers"), "payload_digest")
    rows = stage(rows, "warc-records")
    n = rows.count()
    cuts = min(MOST_STRETCHES, n // STRETCH_ROWS)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    shares = F.from_json(F.lit(json.dumps([i / (cuts + 1) for i in range(1, cuts + 1)])), "array<double>")
    bounds = sorted(set(rows.agg(F.percentile_approx(at, shares, F.lit(max(10_000, 8 * cuts)))).head()[0] or [])) if cuts else []
    rows, table, step = rows.withColumn("stretch", F.lit(0)), F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), 1 << max(0, len(bounds).bit_length() - 1)
    while bounds and step:  # a binary search: the number of bounds that are not after the record
        reached = F.coalesce(at >= F.get(table, F.col("stretch") + (step - 1)), F.lit(False))
        rows, step = rows.withColumn("stretch", F.col("stretch") + F.when(reached, step).otherwise(0)), step >> 1
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull()
    offer = F.when(F.col("kind") == "response", F.struct("record_id", "headers", "payload_digest"))
    near = Window.partitionBy("url", "stretch").orderBy("ts", "record_id")
    known, lost = rows.where(usable), rows.where(~usable).withColumn("found", F.lit(None).cast(rows.select(offer.alias("o")).schema["o"].dataType))
    here = known.withColumn("found", F.last(offer, ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, -1)))
    ends = known.where("kind = 'response'").groupBy("url", "stretch").agg(F.max_by(F.struct("record_id", "headers", "payload_digest"), F.struct("ts", "record_id")).alias("end"))
    every = known.groupBy("url", "stretch").agg(F.lit(1).alias("one")).join(ends, ["url", "stretch"], "left")
    before = every.select("url", "stretch", F.last("end", ignorenulls=True).over(Window.partitionBy("url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where("before is not null")
    here = here.join(before, ["url", "stretch"], "left").withColumn("found", F.coalesce("found", "before")).drop("before")
    rows = here.unionByName(lost)
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    own, old = F.col("headers"), F.col("found.headers")
    agree = F.when(own["etag"].isNotNull(), F.coalesce(weak(own["etag"]) == weak(old["etag"]), F.lit(False))).when(own["last-modified"].isNotNull(), F.coalesce(own["last-modified"] == old["last-modified"], F.lit(False))).otherwise(True)
    status = F.when(F.col("kind") == "response", "full").when(F.col("found").isNull(), "unresolved").when(agree, "resolved").otherwise("mismatch")
    rows = rows.withColumn("status", status)
    done = F.col("status") == "resolved"
    update = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(update, k))
    return rows.select("record_id", F.col("url").alias("canonical_url"), "kind", "status", F.when(done, F.col("found.record_id")).alias("source_id"), F.when(done, F.map_concat(kept, update)).otherwise(own).alias("headers"), F.when(F.col("kind") == "response", F.col("payload_digest")).when(done, F.col("found.payload_digest")).alias("payload_digest"))


def page_records(pages: DataFrame) -> DataFrame:
    """The pages table as a crawl. Page p is fetched at second p (record 2p) and asked for again 5000 seconds later, when it answers 304 (record 2p + 1). Entity tags are those of the URL and its version, which changes every 5000 pages; where page p isn't divisible by 3, the 304 names the tag of the version that is current then."""
    tag = lambda more: F.md5(F.concat(canonical_url(F.col("url").cast("string")), F.lit(":"), (F.floor(F.col("page_id") / 5000) + more).cast("string")).cast("binary"))
    both = lambda at, tag: [F.lit("etag"), F.coalesce(tag, F.lit("")), F.lit("date"), id_text(at)]
    first, again = F.col("page_id"), F.col("page_id") + 5000
    full = F.create_map(*both(first, tag(F.lit(0))), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(text_of(F.col("html"))).cast("string"), F.lit("server"), F.lit("origin"))
    short = F.create_map(*both(again, tag(F.when(F.col("page_id") % 3 == 0, 0).otherwise(1))), F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"), F.lit("0"), F.lit("server"), F.lit("edge"))
    stamp = lambda at: F.timestamp_seconds(F.lit(1_700_000_000) + at).alias("ts")
    fetched = pages.select((first * 2).alias("record_id"), "url", stamp(first), F.lit("response").alias("kind"), full.alias("headers"), F.md5(text_of(F.col("html")).cast("binary")).alias("payload_digest"))
    revisits = pages.select((first * 2 + 1).alias("record_id"), "url", stamp(again), F.lit("revisit").alias("kind"), short.alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return fetched.unionByName(revisits)


def op2_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", F.floor(F.col("record_id") / 2).alias("page_id"), "canonical_url", "kind", "status", F.floor(F.col("source_id") / 2).alias("source_page_id"), headers.alias("headers"), "payload_digest")


ORACLE = r"""
WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
h AS (SELECT *, regexp_extract(bare, '^([^/?]*)', 1) AS raw FROM b),
p AS (SELECT *, substr(bare, length(raw) + 1) AS rest FROM h),
q AS (SELECT *, list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN substr(rest, instr(rest, '?') + 1) ELSE '' END, '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid|sessionid|sid)(=|$)'))) AS params FROM p),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(raw), '^(www|m)\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '')
        || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url
        FROM q),
t AS (SELECT *, md5(canonical_url || ':' || floor(page_id / 5000)::BIGINT) AS tag, md5(canonical_url || ':' || (floor(page_id / 5000)::BIGINT + CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END)) AS later FROM c),
r AS (SELECT * EXCLUDE (later), FALSE AS revisit, page_id * 2 AS record_id, page_id AS sec, {'id': page_id, 'tag': tag, 'n': octet_length(encode(html)), 'digest': md5(html)} AS offer FROM t
  UNION ALL SELECT * EXCLUDE (later) REPLACE (later AS tag), TRUE, page_id * 2 + 1, page_id + 5000, NULL FROM t),
f AS (SELECT *, last_value(offer IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY sec, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM r),
s AS (SELECT *, CASE WHEN NOT revisit THEN 'full' WHEN found IS NULL THEN 'unresolved' WHEN found.tag = tag THEN 'resolved' ELSE 'mismatch' END AS status FROM f)
SELECT record_id, page_id, canonical_url, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS kind, status,
  CASE WHEN status = 'resolved' THEN found.id END AS source_page_id,
  'cache-control: max-age=' || CASE WHEN revisit THEN '120' ELSE '60' END
    || chr(10) || 'content-length: ' || CASE status WHEN 'full' THEN octet_length(encode(html)) WHEN 'resolved' THEN found.n ELSE 0 END
    || CASE WHEN status IN ('full', 'resolved') THEN chr(10) || 'content-type: text/html' ELSE '' END
    || chr(10) || 'date: ' || sec || chr(10) || 'etag: ' || tag
    || chr(10) || 'server: ' || CASE WHEN status IN ('full', 'resolved') THEN 'origin' ELSE 'edge' END AS headers,
  CASE WHEN NOT revisit THEN md5(html) WHEN status = 'resolved' THEN found.digest END AS payload_digest
FROM s
"""

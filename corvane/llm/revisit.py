"""WARC: resolution of not-modified revisit records.

A crawl that asks "changed since?" and hears 304 writes a revisit record without
a payload. It stands for the latest earlier full response of the same canonical
URL, if the validators agree: the entity tags (weak comparison) if both records
have one, else the payload digests if both have one, else the modification dates
if both have one; a revisit with none of these in common with the response is
taken at its word ("unvalidated"). The resolved capture has the response's
payload and its headers, updated by those of the 304 that a 304 may change:
all but the ones that describe the stored bytes (RFC 9111, section 3.2) and
hop-by-hop ones.

The as-of join is a running last over (canonical URL, time) on rows without
payload; payloads join by record id afterwards, once.

A full response is one of status 200 or 203; a partial (206) or empty (204) one
is none.

Defined cases: header names are compared in lower case, and null values are no
headers; of names that differ in case only, the one that sorts last counts. A response at the same time as the revisit counts as earlier; of several,
the one of the largest record id. A record with a null URL or time is in no
lineage: such a revisit is an "orphan", as is one without an earlier response.
Records that repeat a record_id with a response status count once, by the largest
payload; payloads may be null, empty or long. Extra columns are ignored; an empty table gives an empty result.

Scale: two shuffles, one of narrow rows by canonical URL and one of payloads by
record id. A URL captured n times is one window group of n narrow rows; groups
of more than a task's memory spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import table

#: Not taken from a 304: they describe the stored bytes, or a single connection.
FIXED_HEADERS = ("content-length", "content-type", "content-encoding", "content-range", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authorization", "proxy-connection")


#: Parameters that tell where a click came from, never what page is asked for.
TRACKING = "utm_[a-z]+|fbclid|gclid"
FULL = (200, 203)


def canonical_url(url: Column, tracking: str = TRACKING) -> Column:
    """Scheme dropped, host in lower case without "www.", no default port, fragment, tracking parameter or last slash; parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(f"^({tracking})="))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def _folded(headers: Column) -> Column:
    """Headers by names in lower case."""
    entries = F.array_sort(F.map_entries(F.map_filter(headers, lambda k, v: v.isNotNull())))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda x: x["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def resolve_revisits(records: DataFrame, *, tracking: str = TRACKING) -> DataFrame:
    """Each revisit of (record_id, url, ts, status, headers, digest, payload) records, resolved.

    Columns: record_id, canonical, response_id, state, headers, payload; state is resolved, unvalidated, changed or orphan,
    and only the first two have a payload and merged headers.
    """
    low = _folded(F.col("headers"))
    narrow = records.select("record_id", canonical_url(F.col("url"), tracking).alias("canonical"), "ts", (F.col("status") == 304).alias("revisit"), F.col("status"), low.alias("headers"), "digest")
    narrow = narrow.where(F.col("revisit") | F.col("status").isin(*FULL))
    full = F.when(~F.col("revisit"), F.struct("record_id", "headers", "digest"))
    lineage = Window.partitionBy("canonical").orderBy(F.col("ts"), F.col("revisit"), F.col("record_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = narrow.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull()).withColumn("base", F.last(full, ignorenulls=True).over(lineage)).where("revisit")
    stray = narrow.where(F.col("revisit") & (F.col("canonical").isNull() | F.col("ts").isNull())).withColumn("base", F.lit(None).cast(known.schema["base"].dataType))
    both = known.unionByName(stray)
    mine, theirs = F.col("headers"), F.col("base.headers")
    agree = F.coalesce(
        _weak(mine["etag"]) == _weak(theirs["etag"]),
        F.col("digest") == F.col("base.digest"),
        mine["last-modified"] == theirs["last-modified"],
    )
    state = F.when(F.col("base").isNull(), "orphan").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("changed")
    fresh = F.map_filter(mine, lambda k, v: ~k.isin(*FIXED_HEADERS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    found = both.withColumn("state", state).withColumn("ok", F.col("state").isin("resolved", "unvalidated"))
    found = found.select(
        "record_id", "canonical", F.col("base.record_id").alias("response_id"), "state",
        F.when(F.col("ok"), F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")).alias("headers"), "ok",
    )
    payloads = records.where(F.col("status").isin(*FULL)).select(F.col("record_id").alias("pid"), "payload").groupBy("pid").agg(F.max("payload").alias("payload"))
    return found.join(payloads, F.col("ok") & (F.col("response_id") == F.col("pid")), "left").select("record_id", "canonical", "response_id", "state", "headers", "payload")


def capture_log(pages: DataFrame) -> DataFrame:
    """Capture records made of the pages table: each page as a response and a 304 of its URL.

    Pages are captured in order of page_id, one a minute, and asked for again 20000 minutes later; where another page of the
    same canonical URL came in between, the validators differ. By page_id modulo 5 a page has an entity tag (0, 4), a digest (1), a
    modification date (2) or no validator (3). One page in ten is asked for a minute before its response, and one response
    in eleven is partial (206).
    """
    mark = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(mark, 1, 16), F.lit('"'))
    pid = F.col("page_id")
    kind = F.pmod(pid, F.lit(5))
    early, part = F.pmod(pid, F.lit(10)) == 9, F.pmod(pid, F.lit(11)) == 10
    ts, later = pid * 60, F.when(early, pid - 1).otherwise(pid + 20000)
    minute = lambda m: F.concat(F.lit("minute "), m.cast("string"))
    modified = F.when(kind == 2, F.concat(F.lit("day "), F.substring(mark, 1, 2)))
    first = pages.select(
        (pid * 2).alias("record_id"), "url", ts.alias("ts"), F.when(part, 206).otherwise(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("ETag"), F.when(kind.isin(0, 4), tag), F.lit("Last-Modified"), modified,
                     F.lit("Date"), minute(pid), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.when(kind == 1, mark).alias("digest"), F.col("html").alias("payload"),
    )
    again = pages.select(
        (pid * 2 + 1).alias("record_id"), "url", (later * 60).alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("ETag"), F.when(kind.isin(0, 4), F.concat(F.lit("W/"), tag)), F.lit("last-modified"), modified, F.lit("Date"), minute(later), F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), minute(later)).alias("headers"),
        F.when(kind == 1, mark).alias("digest"), F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)


def op8_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    """Every revisit of the pages' capture log with its payload and merged headers."""
    return resolve_revisits(capture_log(table(spark, sf_dir, "pages")))


#: In DuckDB by its own as-of join.
ORACLE = r"""
WITH c AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u, md5(coalesce(html, '')) AS mark FROM pages),
k AS (
  SELECT page_id, html, CASE WHEN page_id % 5 IN (0, 4) THEN '"' || substring(mark, 1, 16) || '"' END AS tag, CASE WHEN page_id % 5 = 1 THEN mark END AS digest,
    CASE WHEN page_id % 5 = 2 THEN 'day ' || substring(mark, 1, 2) END AS modified,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid)='))) AS q FROM c),
p AS (SELECT *, stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical, page_id * 60 AS ts FROM k),
r AS (SELECT page_id, tag, digest, modified, canonical, CASE WHEN page_id % 10 = 9 THEN page_id - 1 ELSE page_id + 20000 END AS minute FROM p),
b AS (SELECT * FROM p WHERE page_id % 11 <> 10),
j AS (
  SELECT r.*, b.page_id AS bid, b.html, b.tag AS btag, b.modified AS bmodified, coalesce(r.tag = b.tag, r.digest = b.digest, r.modified = b.modified) AS agree
  FROM r ASOF LEFT JOIN b ON r.canonical = b.canonical AND r.minute * 60 >= b.ts),
s AS (SELECT *, bid IS NOT NULL AND coalesce(agree, true) AS ok FROM j)
SELECT page_id * 2 + 1 AS record_id, canonical, bid * 2 AS response_id,
  CASE WHEN bid IS NULL THEN 'orphan' WHEN agree IS NULL THEN 'unvalidated' WHEN agree THEN 'resolved' ELSE 'changed' END AS state,
  CASE WHEN ok THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || length(html), 'content-type: text/html', 'date: minute ' || minute,
    'etag: ' || coalesce('W/' || tag, btag), 'expires: minute ' || minute, 'last-modified: ' || coalesce(modified, bmodified)) END AS headers,
  CASE WHEN ok THEN html END AS payload
FROM s
"""

"""Resolves WARC revisit records to the full response that they stand for.

A revisit says that a server answered "not modified". It refers to the latest earlier full response
of its canonical URL: an as-of join. The match counts only if the validators agree: the payload
digests, else the entity tags (weakly compared), else the modification dates. The resolved headers
are the response's, with those of the revisit that such an answer may update laid over them.

The as-of join shuffles no bodies and keeps hot URLs apart: captures are reduced to one row for each
(URL, time); a URL's times are cut into spans of ``span`` seconds, and the latest response before a
time is looked for in its span, else in the latest earlier span that has one. Only (URL, span) pairs
meet in a URL's window; only a span's times meet in a span's.

Defined cases: of responses at one time, the one with the largest record id counts; a response at
the revisit's own time is not earlier; a revisit without URL, time or earlier response is an
``orphan`` with its own headers; one whose validators differ is a ``mismatch`` (it names the response,
and keeps its own headers); without a common validator it is ``unvalidated``, and resolved; null
headers are none; repeated revisits are resolved each; of responses that share a record id the latest counts;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import written

#: The headers that a "not modified" answer may update (RFC 9110, 15.4.5, and RFC 9111).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name a campaign and not a resource.
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port, leading ``www.``, fragment, tracking
    parameters and the path's last slash, with sorted parameters and one scheme for http and https."""
    bare = F.trim(F.regexp_replace(url, "#.*$", ""))
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.when(bare.contains("://"), F.concat(F.lit("http://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve(records: DataFrame, span: int = 86_400) -> DataFrame:
    """One row a revisit: record_id, url_key, status, refers_to (a record id) and headers.

    ``records``: record_id, kind (``response`` or ``revisit``), url, at (seconds), digest and
    headers (a map with lower-case names)."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long").alias("at"), F.col("digest").cast("string").alias("digest"), F.coalesce("headers", none).alias("headers"))
    rows = rows.withColumn("span", F.floor(F.col("at") / span))
    revisits = rows.filter("kind = 'revisit'").drop("kind")
    responses = rows.filter("kind = 'response' AND url_key IS NOT NULL AND at IS NOT NULL")
    # one row for each time of a URL: the id of its response, if it has one
    keys = responses.select("url_key", "span", "at", F.col("record_id").alias("has")).union(revisits.filter("url_key IS NOT NULL AND at IS NOT NULL").select("url_key", "span", "at", F.lit(None).cast(responses.schema["record_id"].dataType)))
    keys = written(keys.groupBy("url_key", "span", "at").agg(F.max("has").alias("has")), "revisit-times")
    spans = keys.filter("has IS NOT NULL").groupBy("url_key", "span").agg(F.max(F.struct("at", "has")).alias("last"))
    asked = keys.select("url_key", "span").distinct().join(spans, ["url_key", "span"], "left")
    before = F.last("last.has", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    asked = written(asked.select("url_key", "span", before.alias("earlier")), "revisit-spans")
    within = F.last("has", ignorenulls=True).over(Window.partitionBy("url_key", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    found = keys.select("url_key", "span", "at", within.alias("near"))
    found = written(found.join(asked, ["url_key", "span"]).select("url_key", "at", F.coalesce("near", "earlier").alias("refers_to")).filter("refers_to IS NOT NULL"), "revisit-found")
    # of responses that share a record id, the latest counts, then the one with the largest digest and headers
    latest = F.max_by(F.struct("digest", "headers"), F.struct("at", "digest", F.array_sort(F.map_entries("headers"))))
    of = responses.groupBy(F.col("record_id").alias("refers_to")).agg(latest.alias("r")).select("refers_to", F.col("r.digest").alias("was_digest"), F.col("r.headers").alias("was"))
    # the revisits are the side with hot keys, the other has a row for each; rows without a key, which find nothing, are spread
    spread = lambda c: F.when(F.col(c).isNull(), F.xxhash64("record_id")).otherwise(0)
    df = revisits.withColumn("spread", spread("url_key")).join(found.withColumn("spread", F.lit(0).cast("long")), ["url_key", "at", "spread"], "left").drop("spread")
    df = df.withColumn("spread", spread("refers_to")).join(written(of, "revisit-responses").withColumn("spread", F.lit(0).cast("long")), ["refers_to", "spread"], "left")
    tag = lambda h: F.regexp_replace(F.col(h)["etag"], "^W/", "")
    same = F.coalesce(F.col("digest") == F.col("was_digest"), tag("headers") == tag("was"), F.col("headers")["last-modified"] == F.col("was")["last-modified"])
    status = F.when(F.col("refers_to").isNull(), "orphan").when(same, "resolved").when(~same, "mismatch").otherwise("unvalidated")
    updates = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("was", lambda k, _: ~F.map_contains_key(updates, k)), updates)
    return df.withColumn("status", status).select("record_id", "url_key", "status", "refers_to", F.when(F.col("status").isin("resolved", "unvalidated"), merged).otherwise(F.col("headers")).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log of pages (page_id, url, html): each page is a full response at hour 2 * page_id,
    and a revisit an hour and a half later (for every 11th page half an hour before, when nothing of it is known).
    The revisit carries a digest on even ids; that and its entity tag are another page's on ids that 5 divides."""
    page = F.col("page_id")
    text = lambda c: c.cast("string")
    digest = F.md5(F.coalesce("html", F.lit("")))
    response = pages.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 7200).alias("at"), digest.alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.concat(F.lit('"'), digest, F.lit('"')), F.lit("date"), text(page * 7200), F.lit("server"), F.lit("s")).alias("headers"),
    )
    other = F.when(page % 5 == 0, F.md5(text(page))).otherwise(digest)
    when = page * 7200 + F.when(page % 11 == 0, -1800).otherwise(5400)
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", when.alias("at"), F.when(page % 2 == 0, other).alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), F.concat(F.lit('W/"'), other, F.lit('"')), F.lit("date"), text(when), F.lit("server"), F.lit("t")).alias("headers"),
    )
    return response.union(revisit)


def op2_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url_key, status, refers_to (the page whose response it is) and headers as sorted text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve(written(records_of_pages(pages), "revisit-records"))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(F.expr("(record_id - 1) div 2").alias("page_id"), "url_key", "status", F.expr("refers_to div 2").alias("refers_to"), F.array_join(lines, ";").alias("headers"))


_DROP = ", ".join(f"'{t}'" for t in TRACKING)
ORACLE = f"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest,
         CASE WHEN page_id % 5 = 0 THEN md5(CAST(page_id AS VARCHAR)) ELSE md5(coalesce(html, '')) END AS other,
         page_id * 7200 + CASE WHEN page_id % 11 = 0 THEN -1800 ELSE 5400 END AS asked_at,
         trim(regexp_replace(url, '#.*$', '')) AS bare
  FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '') AS host,
         regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({_DROP}))), '&') AS query
  FROM p),
c AS (SELECT *, CASE WHEN contains(bare, '://') THEN 'http://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key FROM q),
r AS (
  SELECT a.page_id, a.url_key, a.digest, a.other, a.asked_at, b.page_id AS refers_to, b.digest AS was,
         row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id DESC NULLS LAST) AS n
  FROM c a LEFT JOIN c b ON a.url_key = b.url_key AND b.page_id * 7200 < a.asked_at),
s AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'orphan' WHEN other = was THEN 'resolved' ELSE 'mismatch' END AS status
  FROM r WHERE n = 1)
SELECT page_id, url_key, status, refers_to,
       CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=' || CAST(asked_at AS VARCHAR) || ';etag=W/"' || other || '";server=s'
            ELSE 'content-length=0;date=' || CAST(asked_at AS VARCHAR) || ';etag=W/"' || other || '";server=t' END AS headers
FROM s
"""

QUERIES = {"op2_revisit": op2_revisit}
ORACLES = {"op2_revisit": ORACLE}

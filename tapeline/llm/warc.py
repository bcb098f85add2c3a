"""Not-modified revisits of a web archive, resolved by an as-of join on canonical URLs.

A 304 record holds no body: its content is that of the latest earlier full response of the same
canonical URL, if the record's validators agree with that response. Its permitted headers replace
the response's own.

The as-of join is a window over the time-ordered records of a URL. Records are cut into buckets of
`bucket` time units: inside a bucket the window sees only the bucket's records, and what earlier
buckets hand on is one record a bucket. So a URL with a third of all records makes many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name no content.
TRACKING = r"^(utm_[a-z]*|ref)="
RECORD = "url string, at long, record_id long, full boolean, etag string, last_modified string, headers array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www. and default port; no fragment, trailing slash or
    tracking parameters; the other parameters sorted. Null and '' are ''."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    plain = F.regexp_replace(plain, "^[hH][tT][tT][pP][sS]?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(plain, "\\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merge_headers(own: Column, update: Column) -> Column:
    """The response's headers with the permitted ones of the revisit in place, whatever the case of
    their names; sorted by name."""
    allowed = F.filter(update, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    rest = F.filter(own, lambda h: ~F.exists(allowed, lambda u: F.lower(u["name"]) == F.lower(h["name"])))
    return F.array_sort(F.concat(rest, allowed))


def resolve(records: DataFrame, bucket: int = 1 << 13) -> DataFrame:
    """One row for each revisit: record_id, url, refers_to, verdict, headers.

    records: url (canonical), at, record_id, full (a response with a body, or else a revisit), etag,
    last_modified, headers; other columns are ignored. refers_to is the latest full response with a
    smaller `at`; of several at one time the one with the largest record_id. verdict: `no response`
    if there is none; `matched` if the ETags agree (weakly), or without ETags on both sides the
    Last-Modified dates; `mismatch` if they differ; `unchecked` if no validator is on both sides.
    Headers are merged for matched and null for others. A null or empty URL (given as '') names no
    page, so its revisits have no response; nor have those with null times. Repeated revisits each have
    a row.
    """
    rows = records.select(
        F.coalesce("url", F.lit("")).alias("url"), "at", "record_id", F.coalesce("full", F.lit(False)).alias("full"), "etag", "last_modified",
        F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")).alias("headers"),
    )
    response = F.struct("at", "record_id", "etag", "last_modified", "headers")
    rows = rows.withColumn("response", F.when(F.col("full") & F.col("at").isNotNull() & (F.col("url") != ""), response))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / bucket))
    # one row a bucket: the response that it hands on
    last = rows.groupBy("url", "bucket").agg(F.max("response").alias("last"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(F.col("url").alias("u"), F.col("bucket").alias("b"), F.last("last", ignorenulls=True).over(before).alias("handed"))
    # at equal times revisits stand first: their response is an earlier one
    inside = Window.partitionBy("url", "bucket").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last("response", ignorenulls=True).over(inside)).filter(~F.col("full"))
    rows = rows.join(handed, (F.col("url") == F.col("u")) & F.col("bucket").eqNullSafe(F.col("b")), "left")
    rows = rows.withColumn("r", F.when(F.col("at").isNotNull(), F.coalesce("near", "handed")))
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    agree = F.coalesce(weak(F.col("etag")) == weak(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"))
    verdict = (
        F.when(F.col("r").isNull(), "no response").when(agree.isNull(), "unchecked").when(agree, "matched").otherwise("mismatch")
    )
    rows = rows.withColumn("verdict", verdict)
    return rows.select(
        "record_id", "url", F.col("r.record_id").alias("refers_to"), "verdict",
        F.when(F.col("verdict") == "matched", merge_headers(F.col("r.headers"), F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame, delay: int = 40) -> DataFrame:
    """Records of an archive that fetched each page once and asked again `delay` fetches later.

    A page is fetched at the time 2 * page_id; the second request, at 2 * (page_id + delay) + 1, got
    304 with the validators of the first. Every fifth server sends no ETag, every second no date.
    """
    pid, n = F.col("page_id"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    etag = F.when(pid % 5 != 0, F.concat(F.when(pid % 3 == 0, F.lit("W/")).otherwise(""), F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')))
    date = F.when(pid % 2 == 0, F.concat(F.lit("day "), F.floor(pid / 100).cast("string")))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    kept = lambda *h: F.filter(F.array(*h), lambda x: x["value"].isNotNull())
    both = [pair("etag", etag), pair("last-modified", date)]
    first = kept(*both, pair("content-length", n), pair("content-type", F.lit("text/html")), pair("date", (2 * pid).cast("string")))
    again = kept(*both, pair("content-length", F.lit("0")), pair("expires", (pid + 9 * delay).cast("string")), pair("date", (2 * (pid + delay) + 1).cast("string")))
    record = lambda full, at, headers: F.struct(F.lit(full).alias("full"), at.alias("at"), headers.alias("headers"))
    events = F.explode(F.array(record(True, 2 * pid, first), record(False, 2 * (pid + delay) + 1, again)))
    rows = pages.select(canonical_url(F.col("url")).alias("url"), pid.alias("record_id"), etag.alias("etag"), date.alias("last_modified"), events.alias("x"))
    return rows.select("url", "record_id", "etag", "last_modified", "x.*")

"""Not-modified captures resolved to the full response they stand for.

Records of one canonical URL are put in order of time; a revisit belongs to the latest full response before it. The records are
range-sorted by URL and time, so a URL with very many captures lies over several ranges: within a range the response
before a record comes from a window, and the last response of earlier ranges is carried over for the one URL that a
range may share with those before it. Validators are compared, and the headers a not-modified answer may change are
merged into the stored ones (RFC 9111, sections 3.2 and 4.3.4). DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwell.llm.common import written

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Headers that a not-modified answer does not change: those about its own (empty) body or connection.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www``, port unless it is the scheme's own, path without a slash at its end, query in order of
    its parts. Scheme, user and fragment are left out. What is no URL with a scheme stays as it is, without blanks around."""
    text = F.trim(url)
    part = lambda i: F.regexp_extract(text, URL, i)
    scheme, host, port = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^www[0-9]*\.", ""), part(3)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path, query = F.regexp_replace(part(4), "/+$", ""), F.array_join(F.array_sort(F.split(part(5), "&")), "&")
    joined = F.concat(host, F.when(own, "").otherwise(F.concat(F.lit(":"), port)), path, F.lit("/"), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(text.rlike(URL), joined).otherwise(text)


def lowered(headers: Column) -> Column:
    """Header entries with names in lower case, the last of each name."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.coalesce(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names) + 1), e["key"])), F.array().cast("array<struct<key:string,value:string>>"))


def header(entries: Column, name: str) -> Column:
    found = F.filter(entries, lambda e: e["key"] == name)
    return F.get(found, F.lit(0))["value"]


def merged(stored: Column, fresh: Column) -> Column:
    """Stored header entries, changed by those of the not-modified answer that may change them, by name."""
    allowed = F.filter(fresh, lambda e: ~e["key"].isin(*KEPT_HEADERS))
    names = F.transform(allowed, lambda e: e["key"])
    return F.array_sort(F.concat(F.filter(stored, lambda e: ~F.array_contains(names, e["key"])), allowed))


def resolved(records: DataFrame) -> DataFrame:
    """``record_id, url_key, refers_to, outcome, headers`` of every revisit.

    ``records`` has ``record_id, url, ts, status, headers`` (a map). Status 200 is a full response, 304 a revisit; other records
    are not looked at, nor other columns. The response is the latest with a smaller ``ts``, of equal ones that of the largest
    id. Outcomes: ``resolved``; ``unchecked`` where the two share no validator; ``mismatch`` where entity tags (weakly
    compared), or else modification times, differ; ``missing`` without an earlier response, or without URL or time.
    ``headers`` (entries by name) are those to use, null for the last two. Repeated records are each resolved.
    """
    kept = records.where(F.col("status").isin(200, 304)).select(
        canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("status") == 200).cast("int").alias("full"), "record_id", lowered(F.col("headers")).alias("headers"),
    )
    placed = kept.where("url_key IS NOT NULL AND ts IS NOT NULL")
    ranged = written(placed.repartitionByRange("url_key", "ts", "full", "record_id").withColumn("part", F.spark_partition_id()), "captures")
    response = F.struct("record_id", "headers")
    here = Window.partitionBy("part", "url_key").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ranged.withColumn("near", F.last(F.when(F.col("full") == 1, response), ignorenulls=True).over(here)).where("full = 0")

    # one row for each url and range; a url has more than one only where a boundary between ranges cuts it
    ends = ranged.groupBy("url_key", "part").agg(F.max_by(response, F.when(F.col("full") == 1, F.struct("ts", "record_id"))).alias("end"))
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "part", F.last("end", ignorenulls=True).over(earlier).alias("far")).where("far IS NOT NULL")

    found = before.join(carried, ["url_key", "part"], "left").select("record_id", "url_key", "headers", F.coalesce("near", "far").alias("of"))
    lost = kept.where("full = 0 AND (url_key IS NULL OR ts IS NULL)").select("record_id", "url_key", "headers", F.lit(None).cast(found.schema["of"].dataType).alias("of"))
    every = found.unionByName(lost)
    tag = lambda entries: F.regexp_replace(header(entries, "etag"), "^W/", "")
    own_tag, old_tag = tag(F.col("headers")), tag(F.col("of.headers"))
    own_time, old_time = header(F.col("headers"), "last-modified"), header(F.col("of.headers"), "last-modified")
    outcome = (
        F.when(F.col("of").isNull(), "missing")
        .when(own_tag.isNotNull() & old_tag.isNotNull(), F.when(own_tag == old_tag, "resolved").otherwise("mismatch"))
        .when(own_time.isNotNull() & old_time.isNotNull(), F.when(own_time == old_time, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    usable = F.col("outcome").isin("resolved", "unchecked")
    return every.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.col("of.record_id").alias("refers_to"), "outcome",
        F.when(usable, merged(F.col("of.headers"), F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made from pages: of each a full response, a revisit after it under another spelling of its URL, one
    before it, and a capture of its host's root, full for every tenth page."""
    page, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    at = F.lit(1_700_000_000) + (page * 7919) % 1_000_000
    text = lambda c: F.concat(F.lit("t"), c.cast("string"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    root = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/"))

    def record(number: int, url, ts, status, headers) -> Column:
        return F.struct((page * 4 + number).alias("record_id"), url.alias("url"), ts.alias("ts"), status.alias("status"), headers.alias("headers"))

    full = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Date"), text(at),
        F.when(page % 5 != 0, F.lit("ETag")).otherwise(F.lit("X-Age")), tag, F.lit("Last-Modified"), text(page),
    )
    later = F.create_map(
        F.lit("Content-Length"), F.lit("0"), F.lit("date"), text(at + 9), F.lit("Cache-Control"), F.lit("max-age=60"),
        F.lit("etag"), F.when(page % 7 == 0, F.concat(F.lit('"x'), tag)).otherwise(F.concat(F.lit("W/"), tag)), F.lit("last-modified"), text(page),
    )
    bare = F.create_map(F.lit("Date"), text(at), F.lit("Server"), F.concat(F.lit("s"), (page % 3).cast("string")))
    spelled = F.concat(F.regexp_replace("url", "^http", "HTTP"), F.when(F.contains("url", F.lit("#")), "").otherwise("#later"))
    status = F.when(page % 10 == 0, 200).otherwise(304)
    return pages.select(F.explode(F.array(
        record(0, F.col("url"), at, F.lit(200), full), record(1, spelled, at + 1 + page % 50_000, F.lit(304), later),
        record(2, F.col("url"), at - 500, F.lit(304), bare), record(3, root, at, status, bare),
    )).alias("r")).select("r.*")

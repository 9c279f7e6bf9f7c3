"""Revisit resolution on cases written out, and over ranges that cut a URL."""

from askwell.llm.revisits import canonical_url, resolved
from pyspark.sql import functions as F

KIND = "record_id bigint, url string, ts bigint, status int, headers map<string,string>, near string"


def test_canonical_url(spark):
    cases = {
        "HTTP://user@WWW2.Example.com:80/a/b/?z=1&a=2#x": "example.com/a/b/?a=2&z=1", "https://example.com": "example.com/", "https://example.com:443/": "example.com/",
        "https://example.com:8080/x": "example.com:8080/x/", " not a url ": "not a url", "": "", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", canonical_url(F.col("url")).alias("key"))
    assert {r["url"]: r["key"] for r in df.collect()} == cases


def test_cases(spark):
    a = "http://a.example/"
    rows = [
        (1, a, 10, 200, {"ETag": '"1"', "Content-Type": "text/html", "Date": "d1", "Content-Length": "5"}, "x"),
        (2, a, 20, 200, {"etag": '"2"', "Date": "d2"}, "x"), (3, a, 20, 200, {"ETag": '"3"', "etag": '"4"', "A": "1"}, "x"),
        (11, a, 10, 304, {}, "x"), (12, a, 15, 304, {"ETag": 'W/"1"', "Date": "new", "Content-Length": "0", "Content-Type": "no"}, "x"),
        (13, a + "#f", 21, 304, {"etag": '"4"'}, "x"), (14, a, 22, 304, {"etag": '"2"'}, "x"), (15, a, 23, 304, None, "x"),
        (16, None, 23, 304, {}, "x"), (17, a, None, 304, {}, "x"), (18, "http://b.example/", 5, 304, {}, "x"), (19, a, 30, 404, {}, "x"),
        (15, a, 23, 304, None, "x"),
    ]
    got = resolved(spark.createDataFrame(rows, KIND)).collect()
    by = {r["record_id"]: r for r in got}
    assert (by[11]["outcome"], by[12]["refers_to"], by[13]["refers_to"], by[14]["outcome"], by[15]["outcome"]) == ("missing", 1, 3, "mismatch", "unchecked")
    assert {by[i]["outcome"] for i in (16, 17, 18)} == {"missing"} and 19 not in by and len(got) == 9
    assert [tuple(h) for h in by[12]["headers"]] == [("content-length", "5"), ("content-type", "text/html"), ("date", "new"), ("etag", 'W/"1"')]
    assert by[14]["headers"] is None
    assert resolved(spark.createDataFrame([], KIND)).count() == 0


def test_one_url_over_many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(
            F.col("id").alias("record_id"), F.when(F.col("id") % 9 == 0, "http://rare.example/").otherwise("http://hot.example/").alias("url"), F.col("id").alias("ts"),
            F.when(F.col("id") % 900 == 1, 200).otherwise(304).alias("status"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"),
        )
        got = {r["record_id"]: r["refers_to"] for r in resolved(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for i, refers in got.items():
        assert refers == (None if i % 9 == 0 or i == 0 else (i - 1) // 900 * 900 + 1)

"""What near-duplicate search costs where texts are of one form but not alike, and that it still finds links."""

import numpy as np
from pyspark.sql import functions as F

from askwell.llm import minhash

FORM = " ".join(f"form{i}" for i in range(36))


def one_form(spark, n):
    """Texts of which every two have a similarity of about 0.35."""
    rng = np.random.default_rng(4)
    rows = [(i, FORM + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 32))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)


def test_texts_of_one_form_meet_in_buckets_only(spark, monkeypatch):
    seen = {}

    def counted(docs, rows, words, percent):
        seen["pairs"] = minhash.meetings(rows).groupBy("family", "one", "two").count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0))).first()[0]
        return across(docs, rows, words, percent)

    across = minhash.across
    monkeypatch.setattr(minhash, "across", counted)
    costs = {}
    for n in (600, 1200):
        got = minhash.near_duplicates(one_form(spark, n), 2, 80).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == n
        costs[n] = seen.pop("pairs", 0.0) / (n * (n - 1) / 2)
    assert max(costs.values()) < 0.2, costs  # of all pairs


def test_links_among_texts_of_one_form_are_found(spark):
    docs = one_form(spark, 300)
    copies = docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" and more"))).toDF("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs.unionByName(copies), 2, 80).collect()}
    assert all(got[i + 1000] == got[i] == i for i in range(300))

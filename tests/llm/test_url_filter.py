"""Verdicts on URLs against plain Python: rules, levels of shrinking, awkward rows, empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from askwell.llm import url_filter as uf

PAGES, LABELS = "page_id bigint, url string", "doc_id bigint, quality int, toxic int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:].split("?")[0].split("#")[0]


def best_rule(host, path, rules):
    found = []
    for action, rule in rules:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            found.append((-len(rule), rule, action != "block", action))
    return min(found)[1::2] if found else (None, None)


def strength(units):
    excess = sum((y - n * m) ** 2 - n * m * (1 - m) for n, y, m in units)
    scale = sum((n - 1) * n * m * (1 - m) for n, y, m in units)
    return 1 / min(max(excess / scale, 1 / 1001), 1 / 2) - 1 if scale else 1000.0


def bounds(counts):
    """``counts``: host to (labelled, bad); names of three labels only."""
    def up(level):
        out = {}
        for host, (n, y) in counts.items():
            key = ".".join(host.split(".")[-level:])
            out[key] = (out.get(key, (0, 0))[0] + n, out.get(key, (0, 0))[1] + y)
        return out
    total = (sum(y for _, y in counts.values()) + 1) / (sum(n for n, _ in counts.values()) + 2)
    means, prior = {}, lambda key: total
    for level in (1, 2):
        units = {key: (n, y, prior(key)) for key, (n, y) in up(level).items()}
        k = strength(units.values())
        means = {key: (k * m + y) / (k + n) for key, (n, y, m) in units.items()}
        prior = lambda key, means=means, level=level: means[".".join(key.split(".")[-level:])]
    units = {host: (n, y, prior(host)) for host, (n, y) in counts.items()}
    k = strength(units.values())
    out = {}
    for host, (n, y, m) in units.items():
        mean = (k * m + y) / (k + n)
        out[host] = mean - uf.DEVIATIONS * math.sqrt(mean * (1 - mean) / (k + n + 1))
    return out


def test_hosts_are_judged_by_their_labelled_pages(spark):
    hosts = {"a.one.com": (30, 30), "b.one.com": (30, 3), "c.one.com": (0, 0), "d.two.com": (40, 4), "e.two.org": (25, 1), "f.bad.org": (20, 20), "g.bad.org": (0, 0)}
    pages, labels, doc = [], [], 0
    for host, (n, bad) in hosts.items():
        for i in range(max(n, 2)):
            pages.append((doc, f"https://{host}/x/{doc}" + ("", "/", ".html", "?a=1", "#top")[i % 5]))
            if i < n:
                labels.append((doc, int(i >= bad), 0))
            doc += 1
    got = uf.url_verdicts(spark.createDataFrame(pages, PAGES), uf.outcomes_of(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)),
                          uf.rule_table(spark, [])).collect()
    want = bounds(hosts)
    assert len(got) == len(pages)
    for row in got:
        assert row.n_labels == hosts[row.host][0]
        assert row.bad_bound == pytest.approx(want[row.host], abs=2e-6)
        assert row.verdict == ("block" if want[row.host] > 0.5 else "allow") and row.rule is None
    assert {r.host for r in got if r.verdict == "block"} >= {"a.one.com", "f.bad.org"}


def test_longest_rule_wins_on_awkward_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://EXAMPLE.net/en/1", "http://example.net/de/1", "http://x.example.net/en/", "http://notexample.net/en/",
            "http://a.example.com/de/x?y#z", "http://a.example.com/DE/x", "http://example.com:80/de/", "ftp://q.org/fr/1://2", "http://org/fr/", "http://É.ORG/fr/\nx", "http://a.b.org?/fr/",
            "http://" + "a." * 50_000 + "net/x", "http://net/", "http://user@h.net/p", "http://1.2.3.4/p", "http://x.co.uk/p/5"]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], PAGES).unionByName(spark.createDataFrame([(4, urls[4])], PAGES))
    for name in ("host", "path", "rule", "verdict", "rules", "n", "bad", "prior", "fits"):
        pages = pages.withColumn(name, F.lit("clash"))
    outcomes = uf.outcomes_of(pages, spark.createDataFrame([], LABELS))
    got = uf.url_verdicts(pages, outcomes, uf.rule_table(spark, uf.RULES))
    rows = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in got.collect())
    want = []
    for i, url in [*enumerate(urls), (4, urls[4])]:
        rule, action = best_rule(*split(url), uf.RULES)
        want.append((i, *split(url), rule, action or "allow"))
    assert rows == sorted(want, key=lambda r: r[:3])


def test_rules_of_one_length_and_empty_tables(spark):
    rules = [("allow", "a.net/x"), ("block", "net/x/yz"), ("block", "a.net/q"), ("allow", "a.net/q")]
    pages = spark.createDataFrame([(1, "http://a.net/x/yz"), (2, "http://a.net/q")], PAGES)
    none = uf.outcomes_of(pages, spark.createDataFrame([], LABELS))
    got = {r.page_id: (r.rule, r.verdict) for r in uf.url_verdicts(pages, none, uf.rule_table(spark, rules)).collect()}
    assert got == {1: ("net/x/yz", "block"), 2: ("a.net/q", "block")}
    empty = pages.limit(0)
    assert uf.url_verdicts(empty, uf.outcomes_of(empty, spark.createDataFrame([(1, 0, None)], LABELS)), uf.rule_table(spark, rules)).collect() == []


def test_outcomes_of_labels_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://h.net/1"), (2, "http://h.net/2"), (3, "http://h.net/3"), (4, "http://h.net/x"), (5, "http://h.net/1/")], PAGES)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (2, None, None), (3, None, 1), (None, 0, 0)], LABELS)
    assert sorted(map(tuple, uf.outcomes_of(pages, labels).collect())) == [("http://h.net/1", True), ("http://h.net/1/", True), ("http://h.net/3", True)]

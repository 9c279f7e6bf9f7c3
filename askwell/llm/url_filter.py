"""Verdicts on URLs: by rules where one fits, else by the reputation of the host.

A host's share of bad pages is estimated from labelled pages by empirical Bayes. All labelled pages give the prior of a suffix
(``com``), a suffix the prior of its registered domains, a domain the prior of its hosts: each level's counts are shrunk towards
the level above by a beta-binomial prior whose strength is fitted to how much the level's shares differ (moments). A host
is blocked where the lower bound of its posterior lies above ``most_bad``: little evidence never blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import join_skewed, written

#: Fixed by the contract of the query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Suffixes of two labels under which domains are registered.
SECOND_LEVEL = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.tr", "co.in", "co.kr", "co.za", "com.mx"]
#: The strength of a prior, in pages, is at least and at most this.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: Standard deviations of the posterior below its mean: one-sided 95 %.
DEVIATIONS = 1.645
MOST_BAD = 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def suffix_of(host: Column) -> Column:
    """The part of a name under which domains are registered; a number address or a bare name is its own."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")
    two, one = F.regexp_extract(name, r"([^.]+\.[^.]+)\.?\z", 1), F.regexp_extract(name, r"([^.]+)\.?\z", 1)
    return F.when(name.rlike(r"^[0-9.]+\z|^\[") | (one == ""), name).when(two.isin(SECOND_LEVEL), two).otherwise(one)


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")
    three, two = F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)\.?\z", 1), F.regexp_extract(name, r"([^.]+\.[^.]+)\.?\z", 1)
    return F.when(name.rlike(r"^[0-9.]+\z|^\[") | (two == ""), name).when(two.isin(SECOND_LEVEL) & (three != ""), three).otherwise(two)


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages (``url``, ``bad``): the last number of a page's path is the document it shows. A document is bad if any
    of its labels says low quality or toxic; one without a value has no outcome."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?\z", 1)
    shown = pages.select("url", F.when(number != "", number.cast("bigint")).alias("doc_id")).filter("doc_id IS NOT NULL")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    told = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return join_skewed(written(shown, "shown-documents"), told, ["doc_id"], "inner").select("url", "bad")


def strength(units: DataFrame) -> float:
    """How many pages a prior is worth. ``units``: pages ``n``, bad ones ``bad``, prior mean ``prior``. The excess of their squared
    errors over that of binomial counts gives the correlation of two pages of one unit, 1 / (strength + 1)."""
    spread = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    errors = F.pow(F.col("bad") - F.col("n") * F.col("prior"), F.lit(2.0))
    excess, scale = units.agg(F.sum(errors - spread), F.sum((F.col("n") - 1) * spread)).first()
    if not scale:
        return MOST_STRENGTH
    least, most = 1 / (MOST_STRENGTH + 1), 1 / (LEAST_STRENGTH + 1)
    return 1 / min(max(excess / scale, least), most) - 1


def shrunk(units: DataFrame, k: float) -> Column:
    """Posterior mean."""
    return (F.lit(k) * F.col("prior") + F.col("bad")) / (F.lit(k) + F.col("n"))


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each ``host``: its labelled pages ``n_labels`` and ``bad_bound``, the lower bound of its share of bad pages. Hosts
    without labelled pages have their domain's share, domains without any their suffix's, those their prior."""
    own = outcomes.groupBy(host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    own = hosts.join(own, "host", "left").select(
        "host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"),
        domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    own = written(own, "host-outcomes")
    domains = written(own.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domain-outcomes")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffix-outcomes")
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    suffixes = suffixes.withColumn("prior", F.lit((bad + 1) / (n + 2)))
    suffixes = suffixes.select("suffix", shrunk(suffixes, strength(suffixes)).alias("prior"))
    domains = written(join_skewed(domains, suffixes, ["suffix"]), "domain-priors")
    domains = domains.select("domain", shrunk(domains, strength(domains)).alias("prior"))
    own = written(join_skewed(own, domains, ["domain"]), "host-priors")
    k = strength(own)
    mean = shrunk(own, k)
    deviation = F.sqrt(mean * (1 - mean) / (F.lit(k) + F.col("n") + 1))
    return own.select("host", F.col("n").alias("n_labels"), (mean - F.lit(DEVIATIONS) * deviation).alias("bad_bound"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (action, host and path) as rows."""
    rows = [(rule, action, rule.partition("/")[0], "/" + rule.partition("/")[2]) for action, rule in rules]
    return spark.createDataFrame(rows, "rule string, action string, rule_host string, rule_path string")


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each host with the rules of its name and of the names it lies under, longest first. Only as many labels of a
    host are tried as the rules' hosts have. Of two rules of one length the first in order counts, block before allow."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    by_host = rules.groupBy("rule_host").agg(F.collect_set(F.struct(
        (-F.length("rule")).alias("size"), "rule", (F.col("action") != "block").alias("allow"), F.col("rule_path").alias("start"))).alias("found"))
    ends = [F.substring_index("host", ".", -(i + 1)) for i in range(labels)]
    names = F.array_distinct(F.array(*ends)) if ends else F.array().cast("array<string>")
    tried = written(hosts.select("host", F.explode(names).alias("rule_host")), "names-of-hosts")
    found = join_skewed(tried, by_host, ["rule_host"], "inner")
    return found.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("rules"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, most_bad: float = MOST_BAD) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (the longest one that fits, or null) and ``verdict`` of each row of ``pages``; also
    ``n_labels`` and ``bad_bound`` of its host.

    A URL that is null or has no ``://`` has an empty host and path, which no rule fits. Repeated rows and rows without an id
    are judged like others. Without outcomes every prior is a half, and nothing is blocked but by rules. Other columns,
    also such of the names made here, are not read.
    """
    urls = written(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    hosts = written(urls.select("host").distinct(), "hosts")
    known = reputations(hosts, outcomes).join(fitting(hosts, rules), "host", "left")
    judged = join_skewed(urls, written(known, "known-hosts"), ["host"])
    fits = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    judged = judged.withColumn("fits", fits)
    blocked = F.coalesce(~F.col("fits.allow"), F.col("bad_bound") > most_bad)
    return judged.select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"),
        F.col("n_labels"), F.round("bad_bound", 6).alias("bad_bound"))

"""Quality rules whose cutoffs come from the data: quantile sketches of each metric by language and source.

A sketch is a histogram whose buckets keep a value's seven leading bits: counts of buckets add up, so sketches of parts merge
into those of the whole in any order, and a quantile is off by less than 1/64. A metric's cutoff is its third quartile
and a multiple of the distance to the median. Groups too small for a cutoff of their own take that of the language, or of
everything, whose sketches are merged from the groups'. Thresholds are joined to the documents' metrics.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import BLANKS, written

LEADING_BITS = 7
#: Metrics in thousandths: the base of each, and the least cutoff, below which no text is odd.
METRICS = {"symbols": ("n_words", 100), "dup_lines": ("n_lines", 500), "repeats": ("n_words", 400), "capitals": ("word_chars", 200), "word_length": ("n_words", 9000)}
#: Distances between median and third quartile that a value may lie above the latter.
SPREADS = 6
LEAST_ROWS = 100


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed`` to the row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("words", F.filter(F.split(F.translate(whole, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != ""))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint"))
    n = F.size("words")
    shifted = [F.slice("words", F.lit(k), F.greatest(n - 2, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3)]
    at = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", F.sort_array(F.arrays_zip(*shifted, at.alias("at"))))
    rows = rows.withColumn("again", F.arrays_zip(F.col("windows").alias("x"), F.slice("windows", F.lit(2), F.greatest(F.size("windows"), F.lit(0))).alias("y")))
    equal = lambda p: (p["x"]["w1"] == p["y"]["w1"]) & (p["x"]["w2"] == p["y"]["w2"]) & (p["x"]["w3"] == p["y"]["w3"])
    twice = F.transform(F.filter("again", equal), lambda p: F.array(p["x"]["at"], p["y"]["at"]))
    rows = rows.withColumn("covered", F.flatten(F.transform(F.array_distinct(F.flatten(twice)), lambda i: F.array(i, i + 1, i + 2))))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    bare = F.translate(whole, BLANKS, "")
    return rows.select(
        *docs.columns, "n_words", F.length(bare).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("covered")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]", ""))).cast("bigint").alias("n_capitals"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def thousandths() -> list[Column]:
    """The metrics that have cutoffs, in whole thousandths of their base; 0 where the base is 0."""
    counts = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "capitals": "n_capitals", "word_length": "word_chars"}
    return [F.when(F.col(base) > 0, F.expr(f"1000 * {counts[m]} div {base}")).otherwise(0).cast("bigint").alias(m) for m, (base, _) in METRICS.items()]


def bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared: the bucket's lower edge."""
    shift = F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def cutoffs(measured: DataFrame) -> DataFrame:
    """``grouping, lang, source, metric, cutoff`` from rows of ``lang, source`` and metrics, for groups large enough.

    ``grouping`` is 0 for a language and source, 1 for a language, 2 for everything.
    """
    each = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("edge")) for m in METRICS))
    sketch = measured.select("lang", "source", F.explode(each).alias("x")).groupBy("lang", "source", "x.metric", "x.edge").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    levels = F.array(*(
        F.struct(F.lit(level).alias("grouping"), of_lang.alias("l"), of_source.alias("s"))
        for level, of_lang, of_source in ((0, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (2, none, none))
    ))
    merged = sketch.select(F.explode(levels).alias("g"), "metric", "edge", "n").groupBy("g", "metric", "edge").agg(F.sum("n").alias("n"))
    # a group's histogram of one metric is one small row: 64 buckets at most for each power of two
    whole = merged.groupBy("g", "metric").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("edge", "n"))).alias("bins")).where(F.col("total") >= LEAST_ROWS)
    running = F.aggregate(
        "bins", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("half"), F.lit(None).cast("bigint").alias("most")),
        lambda a, b: F.struct(
            (a["seen"] + b["n"]).alias("seen"),
            F.coalesce(a["half"], F.when(2 * (a["seen"] + b["n"]) >= F.col("total"), b["edge"])).alias("half"),
            F.coalesce(a["most"], F.when(4 * (a["seen"] + b["n"]) >= 3 * F.col("total"), b["edge"])).alias("most"),
        ),
    )
    found = whole.select("g", "metric", running.alias("q"))
    least = F.element_at(F.create_map(*(F.lit(x) for m, (_, low) in METRICS.items() for x in (m, low))), F.col("metric")).cast("bigint")
    cutoff = F.greatest(least, F.col("q.most") + SPREADS * (F.col("q.most") - F.col("q.half")))
    return found.select("g.grouping", F.col("g.l").alias("lang"), F.col("g.s").alias("source"), "metric", cutoff.alias("cutoff"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``rule`` (the first metric above its cutoff) of every document.

    Null text counts as empty, and fails. A null language or source is a group like any other. Repeated rows count each;
    an empty table gives no row. In a table of fewer than ``LEAST_ROWS`` rows no group is large enough, not even everything: the
    least cutoffs of ``METRICS`` hold then. Columns other than ``doc_id, text, lang, source`` are not looked at.
    """
    rows = written(metrics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "metrics")
    measured = rows.select("*", *thousandths())
    limits = cutoffs(measured.select("lang", "source", *METRICS)).groupBy("grouping", "lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", "cutoff"))).alias("limits"))
    joined = measured
    for level, keys in ((0, ("lang", "source")), (1, ("lang",)), (2, ())):
        side = limits.where(F.col("grouping") == level).select(*(F.col(k).alias(f"{k}_{level}") for k in keys), F.col("limits").alias(f"limits_{level}"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_{level}"))
        joined = joined.join(side, on, "left") if keys else joined.join(F.broadcast(side), F.lit(True), "left")  # one row at most
    least = F.create_map(*(F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for m, (_, low) in METRICS.items() for x in (m, low)))
    limit = F.coalesce("limits_0", "limits_1", "limits_2", least)
    rule = F.coalesce(*(F.when(F.col(m) > limit[m], F.lit(m)) for m in METRICS))
    return joined.withColumn("rule", rule).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )

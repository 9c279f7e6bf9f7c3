"""Content-defined line chunks: chunks of several lines that are found elsewhere already are removed.

A rolling hash covers each pair of neighbouring line hashes; a chunk starts where it is smaller than its neighbours. A
boundary so depends on four lines only and moves along when lines are put in before it, and such a chunk has two lines or
more. A line of many words is a passage by itself and always a chunk of its own, whatever stands around it. Everything is
a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "\n"
WITH_WORD = r"[^\x20\x09-\x0D]"
#: A line with as many spaces, and so of more words, is a chunk of its own.
LINE_SPACES = 50


def is_long(line) -> Column:
    """``LINE_SPACES`` spaces or more in over twice as many characters. Spaces are counted by what is left without them:
    a regular expression takes half as much time again for the whole operator."""
    line = F.col(line) if isinstance(line, str) else line
    without = F.replace(line, F.lit(" "), F.lit(""))
    return (F.length(line) > 2 * LINE_SPACES) & (F.length(line) - F.length(without) >= LINE_SPACES)


def with_chunks(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``chunks``: the texts of the row's chunks in order, which joined by line breaks give the text.

    No lambda looks at a whole array of the row, so the work is linear in the text: each line is marked B where a
    chunk begins and C elsewhere, the marked lines are joined, cut before each B, and the marks taken off again.
    """
    none = F.array(F.lit(None).cast("string"))
    lined = docs.withColumn("lines", F.split(text, BREAK, -1))
    hashed = lined.withColumn("hashes", F.transform("lines", F.md5))
    less = F.greatest(F.size("hashes") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("hashes", F.lit(1), less).alias("a"), F.slice("hashes", F.lit(2), less).alias("b"))
    rolled = hashed.withColumn("rolled", F.transform(pairs, lambda p: F.md5(F.concat(p["a"], p["b"]))))
    rolled = rolled.withColumn("long", F.transform("lines", is_long))
    beside = F.arrays_zip(
        F.col("lines").alias("line"), F.col("long").alias("long"), F.concat(F.array(F.lit(False)), "long").alias("after_long"),
        F.concat("rolled", none).alias("here"), F.concat(none, "rolled").alias("before"),
        F.concat(F.slice("rolled", F.lit(2), F.greatest(F.size("rolled"), F.lit(0))), none, none).alias("after"),
    )
    low = lambda x: (x["here"] < x["before"]) & F.coalesce(x["here"] <= x["after"], F.lit(True))
    begins = lambda x, i: (i == 0) | x["long"] | x["after_long"] | ((i >= 2) & low(x))
    mark = lambda x, i: F.concat(F.when(begins(x, i), "B").otherwise("C"), x["line"])
    marked = rolled.withColumn("marked", F.array_join(F.transform(beside, mark), BREAK))
    bare = lambda c: F.regexp_replace(c, r"(\A|\n)[BC]", "$1")
    return marked.withColumn("chunks", F.transform(F.split("marked", r"\n(?=B)", -1), bare)).drop(
        "lines", "hashes", "rolled", "long", "marked"
    )


def occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """Every chunk that may be removed: ``doc_id, version, no, digest, chunk``. ``version`` tells apart rows of one id."""
    rows = docs.select("doc_id", F.md5("text").alias("version"), "text").where(F.col("text").isNotNull())
    # the outer form: for the inner one the optimizer tests that there are chunks, by making them once more at the scan
    exploded = with_chunks(rows, "text").select("doc_id", "version", F.posexplode_outer("chunks").alias("no", "chunk"))
    fit = (F.contains("chunk", F.lit(BREAK)) | is_long("chunk")) & (F.length("chunk") >= least_chars) & F.col("chunk").rlike(WITH_WORD)
    return exploded.where(fit).withColumn("digest", F.unhex(F.sha2("chunk", 256)))


def repeated(docs: DataFrame, least_chars: int = 32) -> DataFrame:
    """``digest, first`` of chunks found twice or more. ``first`` is the occurrence that stays: smallest id, then version and
    place. Within the aggregate the smallest and the largest text are compared byte by byte; a digest that stood for two
    texts would fail the job, so equal digests are equal bytes."""
    grouped = occurrences(docs, least_chars).groupBy("digest").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "no")).alias("first"),
        F.min("chunk").alias("low"), F.max("chunk").alias("high"),
    )
    same = F.when(F.col("low") == F.col("high"), F.col("digest")).otherwise(F.raise_error(F.lit("two texts with one digest")).cast("binary"))
    return grouped.where("n > 1").select(same.alias("digest"), "first")


def removals(docs: DataFrame, least_chars: int = 32) -> DataFrame:
    """``doc_id, version, removed``: places of the chunks to take out of each document that has any."""
    found = occurrences(docs, least_chars).drop("chunk").join(repeated(docs, least_chars), "digest")
    later = ~F.struct("doc_id", "version", "no").eqNullSafe(F.col("first"))
    return found.where(later).groupBy("doc_id", "version").agg(F.collect_set("no").alias("removed"))


def without_repeats(docs: DataFrame, least_chars: int = 32) -> DataFrame:
    """All rows and columns of ``docs`` as ``row``, with ``kept_text``, ``n_chunks``, ``n_removed`` and ``n_removed_lines``.

    The first occurrence of a chunk stays, all later ones go, in other documents and in the same. Null text stays null;
    empty text and one line that is not long stay as they are. Rows that repeat both id and text share their fate: all keep what the
    first occurrence keeps. Other columns may have any name.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keyed = row.withColumn("version", F.md5("row.text"))
    gone = removals(docs, least_chars).withColumnRenamed("version", "of")
    joined = keyed.join(gone, F.col("row.doc_id").eqNullSafe(gone["doc_id"]) & (keyed["version"] == gone["of"]), "left").select("row", "removed")
    chunked = joined.withColumn("text", F.when(F.col("removed").isNotNull(), F.col("row.text")))
    chunked = with_chunks(chunked, "text")
    stays = F.filter("chunks", lambda c, i: ~F.array_contains("removed", i))
    goes = F.filter("chunks", lambda c, i: F.array_contains("removed", i))
    n_lines = F.aggregate(goes, F.lit(0).cast("bigint"), lambda a, c: a + F.regexp_count(c, F.lit(BREAK)) + 1)
    return chunked.select(
        "row", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(stays, BREAK)).alias("kept_text"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(n_lines, F.lit(0).cast("bigint")).alias("n_removed_lines"),
    )


def line_dedup(docs: DataFrame, least_chars: int = 32) -> DataFrame:
    """``doc_id, n_removed, n_removed_lines, text`` of every document."""
    return without_repeats(docs, least_chars).select("row.doc_id", "n_removed", "n_removed_lines", F.col("kept_text").alias("text"))


def deduplicated(docs: DataFrame, least_chars: int = 32) -> DataFrame:
    """The documents without their repeated chunks, columns as given (``n_chars`` counted anew where lines went). A
    document of which nothing but blanks is left goes."""
    done = without_repeats(docs, least_chars)
    changed = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == "text":
            old = F.col("kept_text")
        elif c == "n_chars":
            old = F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return done.where(~changed | F.col("kept_text").rlike(WITH_WORD)).select(*columns)

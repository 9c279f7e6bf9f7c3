"""One query per operator, over its whole table, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwell.llm import oracles
from askwell.llm.alignment import cross_tokenizer
from askwell.llm.decontaminate import contaminations
from askwell.llm.language import languages
from askwell.llm.line_dedup import line_dedup
from askwell.llm.minhash import near_duplicates
from askwell.llm.packing import packed
from askwell.llm.prefix_trie import prefix_trie
from askwell.llm.quality_model import quality_scores
from askwell.llm.quality_rules import quality_rules
from askwell.llm.revisits import captures, resolved
from askwell.llm.secret_scan import secrets
from askwell.llm.token_counts import token_counts
from askwell.llm.url_filter import RULES, outcomes_of, rule_table, url_verdicts
from askwell.plans.inputs import table
from askwell.plans.registry import query


@query("op9_language_mixture")
def op9_language_mixture(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


@query("op7_line_chunks", oracles.OP7)
def op7_line_chunks(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


@query("op5_hilbert_packing")
def op5_hilbert_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


@query("op8_fast_minhash", oracles.OP8)
def op8_fast_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op2_template_decontamination")
def op2_template_decontamination(spark, sf_dir):
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_quality_rules", oracles.OP1)
def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    return secrets(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@query("op10_revisits", oracles.OP10)
def op10_revisits(spark, sf_dir):
    found = resolved(captures(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))


@query("op11_prefix_trie", oracles.OP11)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("k1", "k2")


@query("op13_host_reputation", oracles.OP13)
def op13_host_reputation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, outcomes_of(pages, table(spark, sf_dir, "labels")), rule_table(spark, RULES))


@query("op12_cross_tokenizer")
def op12_cross_tokenizer(spark, sf_dir):
    return cross_tokenizer(table(spark, sf_dir, "documents"))

"""Column expressions against Python's own."""

import hashlib
import json
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askwell.functions import sqltext, text
from askwell.functions.ids import content_id, kind_from_id
from askwell.functions.vectors import cosine, dot, l2

# Texts without lone surrogates, which are not UTF-8
TEXTS = st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=30)
QUICK = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column(F.col("t"))).collect())]


@QUICK
@given(TEXTS)
def test_ids_are_version_five_uuids_of_the_hash(spark, texts):
    want = [str(uuid.uuid5(uuid.UUID(int=0), hashlib.sha256(t.encode()).hexdigest())) + "-sql" for t in texts]
    assert values(spark, texts, lambda c: content_id(c, "sql")) == want


@QUICK
@given(TEXTS)
def test_json_text_is_pythons(spark, texts):
    texts = [*texts, '\x0b\x1f "\\u001F" \\\x0e', "\x1b\x1b\\\x1a"]
    assert values(spark, texts, text.json_string) == [json.dumps(t, ensure_ascii=False) for t in texts]
    pairs = values(spark, texts, lambda c: text.pair_json(c, c))
    assert pairs == [json.dumps({"question": t, "sql": t}, ensure_ascii=False) for t in texts]


FENCE = "```"

# response: what the last, the first and the simple way take out of it
EXTRACTED = {
    "SELECT a; then SELECT b;": ("SELECT b;", "SELECT a", "SELECT a;"),
    "WITH x AS (SELECT 1) SELECT * FROM x; done": ("WITH x AS (SELECT 1) SELECT * FROM x;", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT 1) SELECT * FROM x;"),
    f"Sure:\n{FENCE}sql\nselect a from t\n{FENCE} ok": ("select a from t\n", "select a from t\n", "select a from t\n"),
    f"{FENCE}\nplain\n{FENCE}": ("\nplain\n", f"{FENCE}\nplain\n{FENCE}", ""),
    "nothing to see": ("nothing to see", "nothing to see", ""),
    "select a\\_b from t [x]": ("select a\\_b from t [x]", "select a_b from t ", "select a\\_b from t [x]"),
    "SELECT é\nFROM t": ("SELECT é\nFROM t", "SELECT é\nFROM t", "SELECT é\nFROM t"),
    "": ("", "", ""),
}


def test_extraction(spark):
    for place, mode in enumerate(("last", "first", "simple")):
        got = values(spark, list(EXTRACTED), lambda c: sqltext.extract_sql(c, mode))
        assert got == [want[place] for want in EXTRACTED.values()], mode


def test_select_statements(spark):
    yes = [
        "SELECT 1", "  select 1", "/* a */ SELECT 1", "-- a\nSELECT 1", "DROP TABLE t; SELECT 1", "SELECT ';' ; x",
        "WITH a AS (SELECT 1) SELECT * FROM a", "with a as (select (1)), b as (insert) select 2", "SELECT",
        "WITH a AS (SELECT ')') SELECT 1", "UPDATE t SET x = 1; WITH q AS (SELECT 1) SELECT 2",
    ]
    no = [
        "", "hello", "UPDATE t SET a = 1", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) DELETE FROM t", "selection 1",
        "-- SELECT 1", "/* SELECT 1; */", "DELETE FROM t WHERE a = '; SELECT 1'", "I would select a thing", "(1)",
        "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", None,
    ]
    assert values(spark, yes, sqltext.is_select) == [True] * len(yes)
    assert values(spark, no, sqltext.is_select) == [False] * len(no)


def test_code_fences(spark):
    cases = {
        "```python\nx = 1\n```": "x = 1",
        "a ```Some Python\nfig = 1\nfig.show()\n``` b ```other```": "fig = 1\n",
        "```\ny\n```": "y",
        "  plain fig.show() ": "plain ",
    }
    assert values(spark, list(cases), sqltext.extract_code) == list(cases.values())


def test_follow_up_numbers(spark):
    assert values(spark, ["1. a\n22.b\nno 3. c"], sqltext.without_numbers) == ["a\nb\nno 3. c"]


def test_names_and_statements(spark):
    cases = {"My  Model_X (v2)": "my-model-x-v2", "a_b": "a_b", "_x-": "x", "--": None, "": None, "Ü b!": "b", "a - _ b": "a---b"}
    assert values(spark, list(cases), text.sanitize_name) == list(cases.values())
    assert values(spark, ["a; ", "a;;\n", "a"], text.strip_semicolon) == ["a", "a;", "a"]
    assert values(spark, ["[varchar]", "int", "[[x]"], text.strip_brackets) == ["varchar", "int", "x"]


def test_kinds(spark):
    assert values(spark, ["a-sql", "b-doc", "c-ddl", "d-x", "sql"], kind_from_id) == ["sql", "documentation", "ddl", None, "sql"]


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(l2(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("b")), dot(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(5.0, 1.0, 0.0), (5 ** 0.5, 1.0, 0.0)]

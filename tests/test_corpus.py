"""Corpus, store, bootstrap and sources on tiny tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from askwell import schemas
from askwell.operators import bootstrap, corpus as c
from askwell.operators.ranking import joined_text, previous, top_k
from askwell.sources import readers, sinks
from askwell.sources.store import CorpusStore


def docs(spark, *texts, day=1):
    df = spark.createDataFrame([(t, dt.datetime(2024, 1, day)) for t in texts], "documentation string, created_at timestamp")
    return c.add_documentation(df)


def contents(df):
    return sorted(r["content"] for r in df.select("content").collect())


def test_rows_of_each_kind(spark):
    pair = spark.createDataFrame([("How many?", "SELECT 1", None)], "question string, sql string, tag string")
    row = c.add_pairs(pair, form="qa").first()
    assert row["id"].endswith("-sql") and row["tag"] == c.DEFAULT_TAG and row["embed_text"] == "Question: How many?\n\nSQL: SELECT 1"
    assert c.add_pairs(pair).first()["id"] == row["id"]
    ddl = c.add_ddl(spark.createDataFrame([("CREATE TABLE t (x int)",)], "ddl string")).first()
    assert ddl["id"].endswith("-ddl") and ddl["question"] is None


def test_merging(spark):
    old, new = docs(spark, "a", "b"), docs(spark, "b", "c", "c", day=2)
    day = F.dayofmonth("created_at")
    assert sorted(tuple(r) for r in c.merge(old, new).select("content", day).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert sorted(tuple(r) for r in c.merge(old, new, "upsert").select("content", day).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    with pytest.raises(ValueError):
        c.merge(old, new, "other")


def test_removal_and_update(spark):
    stored = docs(spark, "a", "b")
    ids = stored.filter("content = 'a'").select("id").unionByName(spark.createDataFrame([("x-doc",)], "id string"))
    assert contents(c.remove(stored, ids)) == ["b"]
    assert sorted(r["existed"] for r in c.removal_report(stored, ids).collect()) == [False, True]
    changes = stored.filter("content = 'a'").select("id", F.lit("A").alias("content"), F.lit(None).cast("string").alias("tag"))
    rows = {r["content"]: (r["needs_embedding"], r["tag"]) for r in c.update(stored, changes).collect()}
    assert rows == {"A": (True, None), "b": (False, None)}
    with pytest.raises(ValueError):
        c.remove_kind(stored, "doc")


def test_stored_json(spark):
    rows = [('{"question": "q", "sql": "s"}',), ('{"question": "q"}',), ("not json",), ('{"question": "q", "sql": "s',), ('{"sql": "s", "question": null}',)]
    good, bad = c.parse_pairs(spark.createDataFrame(rows, "content string"))
    assert [tuple(r) for r in good.select("question", "sql").collect()] == [("q", "s")] and bad.count() == 4


def test_training_requests(spark):
    rows = [("q", "s", None, None), ("q", None, "d", None), (None, "s", "d", "x"), (None, "s", None, None), (None, None, "d", None), (None,) * 4, ("q", "s", None, "x")]
    df = spark.createDataFrame(rows, "question string, sql string, ddl string, documentation string").coalesce(1)
    got = [(r["route"], r["content"], r["needs_question"]) for r in c.route_training(df).collect()]
    assert got == [
        ("sql", "s", False), ("reject", None, False), ("documentation", "x", False), ("sql", "s", True), ("ddl", "d", False),
        ("plan", None, False), ("documentation", "x", False),
    ]


def test_plan(spark):
    rows = [("sql", "g", "n", "v1"), ("sql", "g", "n", "v2"), ("sql", "g", "n", "v1"), ("ddl", "", "t", "x"), ("is", "d.s", "t", "y"), ("odd", "", "", "")]
    plan = spark.createDataFrame(rows, schemas.PLAN)
    assert "Train on SQL: g n" in [r["summary"] for r in c.plan_summary(plan).collect()]
    left = c.remove_plan_item(plan, "Train on SQL: g n")
    assert sorted(r["item_value"] for r in left.collect()) == ["", "v1", "v2", "x", "y"]
    assert c.remove_plan_item(plan, "nothing").count() == 6
    applied = c.apply_plan(plan)
    assert sorted(r["training_data_type"] for r in applied.collect()) == ["ddl", "documentation", "sql", "sql", "sql"]
    pair = c.add_pairs(spark.createDataFrame([("n", "v2")], "question string, sql string")).first()["id"]
    assert pair in [r["id"] for r in applied.collect()]


def files(path):
    return {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_store(spark, tmp_path):
    store = CorpusStore(spark, f"{tmp_path}/c", schemas.CORPUS)
    assert store.read().count() == 0
    store.append_new(docs(spark, "a", "b"))
    store.append_new(docs(spark, "b", "c"))
    before = files(tmp_path)
    store.append_new(docs(spark, "a", "b", "c", "c"))  # nothing new, nothing written
    assert contents(store.read()) == ["a", "b", "c"] and files(tmp_path) == before
    store.replace(c.remove(store.read(), docs(spark, "a").select("id")))
    assert contents(store.read()) == ["b", "c"]
    store.upsert(docs(spark, "c", "d", day=3))
    store.compact()
    assert contents(store.read()) == ["b", "c", "d"]
    again = CorpusStore(spark, f"{tmp_path}/c", schemas.CORPUS)
    for text in ("e", "f", "g"):
        again.append_new(docs(spark, text))
    again.compact()
    assert contents(store.read()) == contents(again.read()) == ["b", "c", "d", "e", "f", "g"]
    again.replace(again.read().filter("content in ('b', 'c', 'd')"))
    assert contents(again.read().filter("training_data_type = 'documentation'")) == ["b", "c", "d"]


def test_an_unfinished_write_is_not_seen(spark, tmp_path):
    store = CorpusStore(spark, f"{tmp_path}/c", schemas.CORPUS)
    store.append_new(docs(spark, "a"))
    broken = docs(spark, "b", "c").withColumn("content", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.append_new(broken)
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken)
    assert contents(store.read()) == ["a"]
    store.append_new(docs(spark, "b", "c"))  # later writers are not held up
    assert contents(store.read()) == ["a", "b", "c"]


def test_two_appends_of_one_id_are_read_once(spark, tmp_path):
    store = CorpusStore(spark, f"{tmp_path}/c", schemas.CORPUS)
    late = store.new_rows(docs(spark, "a", "b"))  # looked before the other one wrote
    late.write.parquet(f"{tmp_path}/late")
    store.append_new(docs(spark, "a"))
    spark.read.schema(schemas.CORPUS).parquet(f"{tmp_path}/late").withColumn("bucket", store._bucket()).write.insertInto(store.name)
    assert contents(store.read()) == ["a", "b"]
    store.compact()
    assert store._table().count() == 2


def test_stored_rows_stay_where_they_lie(spark, tmp_path):
    """No exchange on the stored side of an append, none to read; a change writes its own buckets only."""
    store = CorpusStore(spark, f"{tmp_path}/c", schemas.CORPUS)
    store.append_new(docs(spark, *[f"text {i}" for i in range(200)]))
    plan = store.new_rows(docs(spark, "text 3", "new"))._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):].splitlines()
    right = next(i for i, line in enumerate(join[1:], 1) if line.lstrip(" :").startswith("+- ") and line.index("+- ") == min(x.index("+- ") for x in join[1:] if "+- " in x))
    assert not any("Exchange" in x for x in join[right:]) and any("Bucketed: true" in x for x in join[right:])
    assert plan.count("Exchange hashpartitioning(id") == 1  # the new rows
    assert "Exchange" not in store.read()._jdf.queryExecution().executedPlan().toString()
    before = files(tmp_path)
    store.upsert(docs(spark, "text 7", day=3))
    after = files(tmp_path)
    gone = {p.split("/")[1] for p in before if p not in after}
    assert len(gone) == 1 and {p for p in before if p.split("/")[1] not in gone} <= set(after)
    assert store.read().count() == 200
    store.remove(store.read().select("id"))
    assert store.read().count() == 0


def test_store_changes(spark, tmp_path):
    store = CorpusStore(spark, f"{tmp_path}/s", schemas.CORPUS)
    store.append_new(docs(spark, "a", "b"))
    store.append_new(c.add_ddl(spark.createDataFrame([("CREATE TABLE t (x int)",)], "ddl string")))
    changes = docs(spark, "a").select("id", F.lit("A new").alias("content"))
    store.update(changes.unionByName(changes))
    rows = {r["content"]: r["embed_text"] for r in store.read().collect()}
    assert rows == {"A new": "A new", "b": "b", "CREATE TABLE t (x int)": "CREATE TABLE t (x int)"}
    store.remove(docs(spark, "b"))
    store.remove_kind("ddl")
    assert [r["content"] for r in store.read().collect()] == ["A new"]


def test_rows_without_a_time(spark):
    rows = docs(spark, "a").withColumn("created_at", F.lit(None).cast("timestamp"))
    assert [r["content"] for r in c.one_per_id(rows).collect()] == ["a"]
    merged = c.merge(docs(spark, "a", "b"), rows.withColumn("tag", F.lit("new")), "upsert").collect()
    assert sorted((r["content"], r["tag"]) for r in merged) == [("a", "new"), ("b", None)]
    both = rows.unionByName(rows.withColumn("tag", F.lit("t")))
    assert c.one_per_id(both).collect() == c.one_per_id(both.orderBy("tag", ascending=False)).collect()


def test_training_is_found(spark, tmp_path):
    from askwell.operators import training
    from askwell.operators.embedding import embed
    from askwell.operators.nearest import knn

    store = CorpusStore(spark, f"{tmp_path}/t", schemas.CORPUS_VECTORS)
    kind = "question string, sql string, ddl string, documentation string"
    requests = spark.createDataFrame([("How many?", "SELECT 1", None, None), (None, "SELECT 2", None, None), (None, "SELECT 3", None, None),
                                      (None, None, "CREATE TABLE t (x int)", None), (None, None, None, "Sales are in t."), ("Lost?", None, None, None)], kind)
    made = spark.createDataFrame([("SELECT 2", "Which two?")], "sql string, question string")
    rejects = training.train(store, requests, questions=made)
    assert sorted((r["question"] or "", r["sql"] or "") for r in rejects.collect()) == [("", "SELECT 3"), ("Lost?", "")]
    training.train(store, requests, questions=made)
    stored = store.read()
    assert stored.count() == 4 and stored.filter("embedding IS NULL").count() == 0
    asked = embed(stored.select(F.col("id").alias("question_id"), "embed_text").drop("embedding"), "embed_text", task="question")
    assert all(r["question_id"] == r["id"] for r in knn(asked, stored, 1).collect())


def test_updated_rows_are_found(spark, tmp_path):
    from askwell.operators import training
    from askwell.operators.embedding import embed
    from askwell.operators.nearest import knn

    store = CorpusStore(spark, f"{tmp_path}/u", schemas.CORPUS_VECTORS)
    training.learn(store, docs(spark, "a first text", "quite another one"))
    before = {r["id"]: r["embedding"] for r in store.read().collect()}
    changed = docs(spark, "a first text").first()["id"]
    store.update(spark.createDataFrame([(changed, "sales by month")], "id string, content string"))
    stored = store.read()
    asked = embed(spark.createDataFrame([(1, "sales by month")], "question_id int, question string"), "question", task="question")
    assert [r["id"] for r in knn(asked, stored, 1).collect()] == [changed]
    after = {r["id"]: r["embedding"] for r in stored.collect()}
    assert {i for i in before if before[i] != after[i]} == {changed} and None not in after.values()


def test_descriptions(spark, tmp_path):
    fields = "table_name string, column_name string, data_type string, description string, usage string"
    rows = spark.createDataFrame([("t", "z", "[int]", "nan", None), ("t", "a", "[text]", "d", "u"), ("gone", "x", None, "d", "u"), ("gone", "y", "int", "d", "u")], fields)
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "one.json").write_text("[\n" + ",\n".join(rows.toJSON().collect()) + "\n]")
    read = readers.read_column_descriptions(spark, f"{tmp_path}/up")
    ddl = {r["table_name"]: r["ddl"] for r in bootstrap.create_ddl(read).collect()}
    assert list(ddl) == ["t"] and ddl["t"].index("z int") < ddl["t"].index("a text")
    assert bootstrap.create_ddl(rows).count() == 1 and bootstrap.described(rows)[1].count() == 1


def test_metadata_columns():
    found = bootstrap.schema_columns(["My_Database_Name", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE", "COMMENT", "other"])
    assert found == {"database": "My_Database_Name", "schema": "TABLE_SCHEMA", "table": "TABLE_NAME", "details": ["COLUMN_NAME", "DATA_TYPE", "COMMENT"]}
    with pytest.raises(ValueError):
        bootstrap.schema_columns(["TABLE_NAME"])


def test_one_document_per_table(spark):
    rows = [("db", s, t, f"c{i}", "INT", None, i) for s, t in (("s1", "t1"), ("s1", "t2"), ("s2", "t1")) for i in range(600)]
    info = spark.createDataFrame(rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, COMMENT string, ORDINAL_POSITION int")
    plan = bootstrap.table_docs(info.repartition(7)).collect()
    assert sorted((r["item_group"], r["item_name"]) for r in plan) == [("db.s1", "t1"), ("db.s1", "t2"), ("db.s2", "t1")]
    lines = plan[0]["item_value"].split("\n")[4:]
    assert [line.split(" | ")[3] for line in lines] == [f"c{i}" for i in range(600)]


def test_column_descriptions_from_json(spark, tmp_path):
    upload = [
        {"table_name": "t", "column_name": "a", "data_type": "[varchar]", "description": "it's", "usage": "nan"},
        {"table_name": "t", "column_name": "b", "data_type": "int", "description": "nan", "usage": "key"},
    ]
    (tmp_path / "up.json").write_text(json.dumps(upload, indent=2))
    rows = readers.read_column_descriptions(spark, str(tmp_path / "up.json"))
    assert sorted(r["ddl"] for r in bootstrap.alter_ddl(rows).collect()) == [
        "ALTER TABLE t ADD COLUMN a varchar COMMENT 'Description:it's,';", "ALTER TABLE t ADD COLUMN b int COMMENT ',Usage:key';",
    ]
    numbered = rows.withColumn("ordinal", F.when(F.col("column_name") == "a", 0).otherwise(1))
    assert bootstrap.create_ddl(numbered).first()["ddl"] == (
        "CREATE TABLE t (\n  a varchar COMMENT 'Description:it's,',\n  b int COMMENT ',Usage:key'\n);"
    )


def test_question_answer_corpus(spark, tmp_path):
    from askwell.operators.model import clean_corpus

    records = [
        {"question": "one", "answer": "Try this:\r\n```sql\nselect 1\n```\nIt counts."}, {"question": "two", "answer": "I have no access to the data."},
        {"question": "three", "answer": " SELECT a,\tb FROM t WHERE n = 'O''Hara';;"}, {"question": "four", "answer": "with x as (select 1) select * from x"},
    ]
    (tmp_path / "qa.json").write_text(json.dumps(records, indent=1))
    kept, rejected = clean_corpus(readers.read_qa(spark, str(tmp_path / "qa.json")))
    assert {r["question"]: r["sql"] for r in kept.collect()} == {
        "one": "select 1\n", "three": "SELECT a,\tb FROM t WHERE n = 'O''Hara';", "four": "with x as (select 1) select * from x",
    }
    assert [r["question"] for r in rejected.collect()] == ["two"]


def test_history(spark):
    rows = [(f"select {i} from Sales.x", i, i) for i in range(30)] + [("select 99 from other", 9, 99)]
    log = spark.createDataFrame(rows, "QUERY_TEXT string, ROWS_PRODUCED int, QUERY_ID int").withColumn("START_TIME", F.col("QUERY_ID"))
    mined = [r[0] for r in bootstrap.mine_history(log, ["SALES"], None).collect()]
    assert len(mined) == 28 and all("Sales" in q for q in mined)
    draw = lambda: sorted(r[0] for r in bootstrap.mine_history(log, ["SALES"], None, sample=10).collect())
    assert len(draw()) == 10 and draw() == draw()
    assert bootstrap.mine_history(log, ["sales"], ["nowhere"]).count() == 0
    assert bootstrap.mine_history(log, None, None, sample=100).count() == 29
    assert [r["QUERY_ID"] for r in readers.read_history(log, 3).collect()] == [28, 29, 99]


def test_source_options(monkeypatch):
    access = {"host": "h", "database": "d", "user": "u", "password": "p", "port": 1234}
    fmt, options = readers.source_options("postgres", access, "SELECT 1")
    assert (fmt, options["url"], options["query"]) == ("jdbc", "jdbc:postgresql://h:1234/d", "SELECT 1")
    assert readers.source_options("mssql", {"url": "jdbc:sqlserver://x"}, "SELECT 1")[1]["url"] == "jdbc:sqlserver://x"
    monkeypatch.delenv("PORT", raising=False)
    with pytest.raises(readers.NotConfigured, match="port"):
        readers.source_options("postgres", {**access, "port": None}, "SELECT 1")
    _, split = readers.source_options("mysql", {**access, "partitionColumn": "id",
                                               "lowerBound": 0, "upperBound": 9, "numPartitions": 3}, "SELECT * FROM t")
    assert split["dbtable"] == "(SELECT * FROM t) q" and split["numPartitions"] == "3" and "query" not in split
    _, oracle = readers.source_options("oracle", {"dsn": "h/x", "user": "u", "password": "p"}, "SELECT 1 FROM dual; ")
    assert oracle["query"] == "SELECT 1 FROM dual" and oracle["url"] == "jdbc:oracle:thin:@h/x"
    fmt, snow = readers.source_options("snowflake", {"account": "a", "user": "u", "password": "p", "database": "d", "role": "r"}, "SELECT 1")
    assert fmt == "snowflake" and snow["sfRole"] == "r" and "sfWarehouse" not in snow
    assert readers.source_options("bigquery", {"project": "p"}, "SELECT 1")[1]["parentProject"] == "p"
    assert readers.source_options("duckdb", {"path": "x.db", "init_sql": "SET a = 1"}, "SELECT 1")[1]["sessionInitStatement"] == "SET a = 1"
    monkeypatch.delenv("DSN", raising=False)
    with pytest.raises(readers.NotConfigured, match="dsn"):
        readers.source_options("oracle", {"user": "u", "password": "p"}, "x")
    monkeypatch.setenv("DSN", "from-env")
    assert readers.source_options("oracle", {"user": "u", "password": "p"}, "x")[1]["url"].endswith("from-env")
    with pytest.raises(readers.NotConfigured):
        readers.source_options("paper", {}, "x")
    for kind in readers.SOURCES:
        settings = {n: "v" for n in readers.SOURCES[kind].needs}
        assert readers.source_options(kind, settings, "SELECT 1")[1]


def test_catalog_and_sinks(spark, tmp_path):
    assert "default" in [r["database"] for r in readers.databases(spark).collect()]
    assert readers.read_source(spark, "hive", {}, "SELECT 1 AS x").first()["x"] == 1
    df = spark.createDataFrame([(1, 'a "b"\n', None)], "n int, t string, x string")
    sinks.write_csv(df.select("n", "t"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv").first()["t"] == 'a "b"\n'
    sinks.write_json(df, f"{tmp_path}/json")
    assert json.loads(spark.read.text(f"{tmp_path}/json").first()[0]) == {"n": 1, "t": 'a "b"\n', "x": None}


def test_catalog_as_information_schema(spark):
    spark.createDataFrame([(1, "a")], "n int, t string").createOrReplaceTempView("listed_view")
    rows = bootstrap.info_schema(spark)
    found = [(r["COLUMN_NAME"], r["DATA_TYPE"], r["ORDINAL_POSITION"]) for r in rows.filter("TABLE_NAME = 'listed_view'").collect()]
    assert sorted(found) == [("n", "int", 1), ("t", "string", 2)]
    docs = bootstrap.table_docs(rows).filter("item_name = 'listed_view'").first()["item_value"]
    assert "| listed_view | n | int |" in docs


def test_ordered_text_and_previous_rows(spark):
    rows = [("hot", i, f"v{i}") for i in range(0, 5000, 3)] + [("cold", 7, "x"), ("cold", 9000, None), ("cold", 9001, "z")]
    df = spark.createDataFrame(rows, "k string, p long, v string").repartition(6)
    texts = {r["k"]: r["t"] for r in joined_text(df.filter("v is not null"), ["k"], "p", "v", ",", "t").collect()}
    assert texts == {"hot": ",".join(f"v{i}" for i in range(0, 5000, 3)), "cold": "x,z"}
    before = {(r["k"], r["p"]): r["b"] for r in previous(df, "k", "p", "v", "b", stretch=100).collect()}
    hot = [f"v{i}" for i in range(0, 5000, 3)]
    assert [before["hot", i] for i in range(0, 5000, 3)] == [None, *hot[:-1]]
    assert (before["cold", 7], before["cold", 9000], before["cold", 9001]) == (None, "x", None)
    best = top_k(df.filter("k = 'hot'"), ["k"], [F.desc("p")], 2)
    assert [r["p"] for r in best.orderBy("rank").collect()] == [4998, 4995]


def test_statement_templates(spark):
    texts = ["SELECT a FROM t WHERE x = 'it''s' AND y IN (1, 2,3)", "select  a from T where x = 'b' and y in (7)", "SELECT a FROM t2 WHERE z = 1.5", "SELECT a FROM t2 WHERE z = 99", "SELECT 1"]
    log = spark.createDataFrame([(x, 2 if x != "SELECT 1" else 1, i) for i, x in enumerate(texts * 40)], "QUERY_TEXT string, ROWS_PRODUCED int, QUERY_ID int").repartition(4)
    got = bootstrap.statement_templates(log, per_template=3, seed="7").collect()
    assert {(r["template"], r["queries"]) for r in got} == {("select a from t where x = ? and y in (?)", 80), ("select a from t2 where z = ?", 80)}
    assert len(got) == 6 and got[0].asDict().keys() >= {"QUERY_ID", "QUERY_TEXT"}
    again = bootstrap.statement_templates(log.repartition(2), per_template=3, seed="7").collect()
    assert sorted(r["QUERY_ID"] for r in again) == sorted(r["QUERY_ID"] for r in got)
    assert bootstrap.statement_templates(log, ["nowhere"]).count() == 0

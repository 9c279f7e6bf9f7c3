"""Running, two-step answers, profiles, scoring, relational patterns and streams on tiny tables."""

import datetime as dt
import sys

import numpy as np
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from askwell import schemas
from askwell.operators import context as ctx
from askwell.operators import evaluation, model, profile, relational, run
from askwell.operators.corpus import add_pairs
from askwell.plans.ask import ask_batch
from askwell.sources.store import CorpusStore
from askwell.streaming import jobs

register_pickle_by_value(sys.modules[__name__])  # the model below runs in tasks

ITEM = "array<struct<id:string,question:string,content:string>>"
CONTEXT = f"question_id string, question string, pairs {ITEM}, ddl {ITEM}, documentation {ITEM}"


def pack_loop(prompt, header, items, limit):
    if items:
        prompt += header
        for cost, text in items:
            if len(prompt) / 4 + len(cost) / 4 < limit:
                prompt += text + "\n\n"
    return prompt


def test_packing_skips_and_goes_on(spark):
    rng = np.random.default_rng(1)
    cases = []
    for i in range(40):
        texts = ["".join("abcé"[j % 4] for j in range(int(n))) for n in rng.integers(0, 200, size=int(rng.integers(0, 8)))]
        cases.append((str(i), "start" * int(rng.integers(0, 9)), texts))
    df = spark.createDataFrame(cases, "i string, p string, items array<string>")
    limit = 80
    got = {r["i"]: r for r in df.select("i", ctx.pack_ddl(F.col("p"), F.col("items"), limit).alias("d"), ctx.pack_pairs(
        F.col("p"), F.transform("items", lambda x: F.struct(F.lit("q").alias("question"), x.alias("content"))), limit).alias("s")).collect()}
    for i, prompt, texts in cases:
        assert got[i]["d"] == pack_loop(prompt, "\n===Tables \n", [(t, t) for t in texts], limit)
        assert got[i]["s"] == pack_loop(prompt, "\n===Question-SQL Pairs\n\n", [(t, f"q\n{t}") for t in texts], limit)


def test_prompt_without_context(spark):
    df = spark.createDataFrame([("1", "How?", [], [], [])], CONTEXT)
    messages = ctx.build_prompts(df, dialect="Spark SQL").first()["messages"]
    assert [m["role"] for m in messages] == ["user"] and messages[0]["content"].endswith("How?") and "===Tables" not in messages[0]["content"]
    with pytest.raises(ValueError):
        ctx.build_prompts(df, "other")


def test_failing_calls_mark_their_rows(spark):
    def factory():
        def call(messages):
            if "bad" in messages[-1]["content"]:
                raise RuntimeError("no")
            return messages[-1]["content"].upper()

        return call

    prompts = spark.createDataFrame([("1", "good"), ("2", "bad")], "question_id string, t string").select(
        "question_id", F.array(ctx.message("user", F.col("t"))).alias("messages"))
    rows = {r["question_id"]: (r["response"], r["error"]) for r in model.generate_responses(prompts, factory).collect()}
    assert rows == {"1": ("GOOD", None), "2": (None, "RuntimeError: no")}


def looking():
    def call(messages):
        said = messages[-1]["content"]
        if "Result of the intermediate query" in said:
            return "SELECT 'seen';" if "| a |" in said else "SELECT 'blind';"
        return {"look": "-- intermediate_sql\nSELECT t FROM seen_things;", "fail": "-- intermediate_sql\nSELECT nope FROM seen_things;",
                "bad": "-- intermediate_sql\nDROP TABLE seen_things;"}.get(said.split()[-1], "SELECT 1;")

    return call


def test_looking_into_the_data(spark):
    spark.createDataFrame([("a",)], "t string").createOrReplaceTempView("seen_things")
    context = spark.createDataFrame([(q, f"please {q}", [], [], []) for q in ("look", "fail", "bad", "plain")], CONTEXT)
    previews = lambda s: run.previews(spark, s)
    rows = {r["question_id"]: r["response"] for r in model.two_step(context, looking, ctx.build_prompts, previews, allow_data=True).collect()}
    assert rows["look"] == "SELECT 'seen';" and rows["plain"] == "SELECT 1;"
    assert rows["fail"].startswith("The look into the data failed: ") and "nope" in rows["fail"]
    assert rows["bad"] == "The look into the data failed: not a statement that reads data"
    refused = {r["question_id"]: r["response"] for r in model.two_step(context, looking, ctx.build_prompts, previews).collect()}
    assert refused["look"] == model.NO_DATA_ACCESS and refused["plain"] == "SELECT 1;"


def test_runs(spark):
    spark.range(5).createOrReplaceTempView("five")
    made = spark.createDataFrame(
        [("1", "q1", "SELECT id, id AS id FROM five;", True), ("2", "q2", "SELECT 1 / 0", True), ("3", "q3", "DROP TABLE five", False), ("4", "q4", "SELECT id, id AS id FROM five;", True),
         ("5", "q5", "SELECT * FROM five WHERE id > 9", True)], "question_id string, question string, sql string, is_valid boolean")
    runs = run.run_results(made, run.run_statements(spark, made)).cache()
    rows = {r["question_id"]: r for r in runs.collect()}
    assert [rows[q]["status"] for q in "12345"] == [schemas.SQL_RAN, schemas.SQL_UNABLE_TO_RUN, schemas.NO_SQL_GENERATED, schemas.SQL_RAN, schemas.SQL_RAN]
    assert (rows["1"]["row_count"], rows["5"]["row_count"]) == (5, 0) and "ZERO" in rows["2"]["error"]
    assert spark.read.parquet(rows["1"]["result_path"]).columns == ["id_0", "id_1", "_position"]
    assert sorted(r["question"] for r in run.auto_train(runs).collect()) == ["q1", "q4"]
    none = run.run_statements(spark, made.filter("not is_valid"))
    assert none.count() == 0


def test_asking_learns(spark, tmp_path):
    spark.range(7).createOrReplaceTempView("seven")
    stored = add_pairs(spark.createDataFrame([("how many", "SELECT * FROM seven;")], "question string, sql string"))
    corpus = stored.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    asked = spark.createDataFrame([("a", "count them", [1.0, 0.1]), ("b", "chat", [0.0, 1.0])], "question_id string, question string, embedding array<double>")

    def factory():
        return lambda messages: "Hello." if messages[-1]["content"].endswith("chat") else f"Use {messages[1]['content']}"

    store = CorpusStore(spark, f"{tmp_path}/c", schemas.CORPUS)
    runs = {r["question_id"]: (r["status"], r["row_count"]) for r in ask_batch(spark, asked, corpus, factory, store=store).collect()}
    assert runs == {"a": (schemas.SQL_RAN, 7), "b": (schemas.NO_SQL_GENERATED, None)}
    assert [(r["question"], r["content"]) for r in store.read().collect()] == [("count them", "SELECT * FROM seven;")]


def test_charts(spark):
    def spec(df):
        return tuple(profile.chart_spec(df).first())

    two, one = spark.createDataFrame([("a", 1, 2.0)] * 3, "t string, x int, y double"), spark.createDataFrame([("a", 1)], "t string, x int")
    few, many = (spark.createDataFrame([(f"v{i % n}",) for i in range(100)], "t string").repartition(4) for n in (9, 10))
    assert spec(two) == ("scatter", "x", "y") and spec(one) == ("bar", "t", "x")
    assert spec(few) == ("pie", "t", None) and spec(many) == ("line", None, None)
    assert [profile.should_chart(d).first()[0] for d in (two, one, few, two.limit(0))] == [True, False, False, False]
    assert profile.schema_text(one) == "t string\nx int"


def test_previews(spark):
    df = spark.createDataFrame([(i, None if i % 2 else dt.datetime(2024, 1, 1, i)) for i in range(12)], "n int, at timestamp")
    rows = [r[0] for r in profile.preview_json(df.orderBy(F.desc("n")), ["n"]).collect()]
    assert rows[:2] == ['{"n":0,"at":"2024-01-01T00:00:00.000"}', '{"n":1,"at":null}'] and len(rows) == 10
    assert profile.markdown(df.select("n"), ["n"], 2).first()[0] == "| n |\n|:--|\n| 0 |\n| 1 |"


def test_templates(spark):
    template = {"name": "t", "sql": "SELECT :a || 'x' AS v WHERE :n > 1", "arguments": [{"name": "a", "available": ["p", "q'; --"]}, {"name": "n", "type": "integer"}]}
    assert profile.run_template(spark, template, {"a": "q'; --", "n": "2"}).first()["v"] == "q'; --x"
    for values in ({"a": "z", "n": 2}, {"a": "p"}, {"a": "p", "n": 2, "o": 1}):
        with pytest.raises(ValueError):
            profile.run_template(spark, template, values)


def test_comparing_results(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2), (1, 0.3), (2, None)], "x int, y double")
    assert evaluation.result_diff(a, spark.createDataFrame([(1, 0.3), (1, 0.3), (2, None)], "p int, q double")).count() == 0
    rows = evaluation.result_diff(a, spark.createDataFrame([(1, 0.3), (3, 0.0)], "p int, q double")).collect()
    assert sorted((r["side"], r["c0"], r["n"]) for r in rows) == [("expected", 3, 1), ("got", 1, 1), ("got", 2, 1)]
    assert evaluation.same_row_count(a, 3).first()["passed"] is True
    with pytest.raises(ValueError):
        evaluation.result_diff(a, a.select("x"))


def test_trials(spark):
    trials = spark.createDataFrame([(m, s, int((q + len(m)) % 2)) for m in ("m1", "mm2") for s in evaluation.STRATEGIES for q in range(20)], "model string, strategy string, correct int")
    rows = {(r["model"], r["strategy"], r["level"]): (r["trials"], r["accuracy"]) for r in evaluation.accuracy_cube(trials).collect()}
    assert len(rows) == 12 and rows[None, None, 3] == (120, 0.5) and rows["m1", "static", 0] == (20, 0.5)


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(2,), (2,)], "b int")
    for values, want in ((right, [1]), (right.union(spark.createDataFrame([(None,)], "b int")), []), (right.limit(0), [None, 1, 2])):
        got = relational.not_in(left, "a", values, "b").collect()
        assert sorted((r["a"] for r in got), key=lambda x: (x is not None, x)) == want


def test_global_ranks(spark):
    values = [float(i % 700) for i in range(3000)] + [5.0] * 1500
    rows = [(v,) for v in [*values, float("nan"), float("nan"), None]]
    ranks = {str(r["v"]): (r["r"], r["n"]) for r in relational.global_rank(spark.createDataFrame(rows, "v double"), "v", "r").collect()}
    assert ranks.pop("nan") == (len(values) + 1, 2)
    assert ranks == {str(v): (sum(x < v for x in values) + 1, values.count(v)) for v in set(values)}


@pytest.mark.parametrize("small,digit,few", [(20_000, 16, 100_000), (0, 16, 100_000), (50, 8, 0)])
def test_percentiles(spark, small, digit, few, monkeypatch):
    for name, size in (("SMALL", small), ("DIGIT", digit), ("FEW_PLACES", few)):
        monkeypatch.setattr(relational, name, size)
    rng = np.random.default_rng(3)
    groups = {"hot": np.concatenate([rng.lognormal(size=60_000), np.full(20_000, 1.5)]), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    groups |= {"signs": np.array([-1e300, -2.5, -0.0, 0.0, 1e-310, 7.0, 1e300]), "same": np.full(5_000, -7.25), None: np.arange(9.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    fractions = {"lo": 0.0, "mid": 0.5, "hi": 0.95, "top": 0.999, "max": 1.0}
    found = relational.percentiles(df.unionByName(df.select("g", F.lit(None).cast("double").alias("v"))), ["g"], "v", fractions).collect()
    assert len(found) == len(groups)
    for r in found:
        for name, f in fractions.items():
            assert r[name] == pytest.approx(np.quantile(groups[r["g"]], f), rel=1e-12), (r["g"], name)
    total = relational.percentiles(df, [], "v", {"mid": 0.5}).first()["mid"]
    assert total == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
    assert relational.percentiles(df.limit(0), [], "v", {"mid": 0.5}).collect()[0]["mid"] is None
    assert relational.percentiles(df.limit(0), ["g"], "v", {"mid": 0.5}).collect() == []


def test_percentiles_of_a_hot_key_stay_in_bounded_tasks(spark):
    """Ten million rows of one key: no task gets more than its histogram."""
    rows = spark.range(0, 10_000_000, numPartitions=16).select(F.lit("hot").alias("k"), (F.col("id") % 1_000_003 / 7).alias("v"))
    got = relational.percentiles(rows, ["k"], "v", {"p50": 0.5, "p999": 0.999}).first()
    values = np.arange(10_000_000) % 1_000_003 / 7
    assert got["p50"] == pytest.approx(np.quantile(values, 0.5), rel=1e-12) and got["p999"] == pytest.approx(np.quantile(values, 0.999), rel=1e-12)
    plan = relational.percentiles(rows.limit(100), ["k"], "v", {"p50": 0.5})._jdf.queryExecution().toString()
    assert "Window" not in plan


def log_rows(first, n):
    start = dt.datetime(2024, 1, 1)
    return [(f"q{i % 7}", f"SELECT {i % 7}", schemas.SQL_RAN if i % 3 else schemas.SQL_UNABLE_TO_RUN, i % 4, start + dt.timedelta(minutes=30 * i)) for i in range(first, first + n)]


def test_streams(spark, tmp_path):
    schema = "question string, sql string, status string, row_count long, ts timestamp"
    source, store = f"{tmp_path}/log", CorpusStore(spark, f"{tmp_path}/c", schemas.CORPUS)
    for first in (0, 40):  # the second batch repeats most pairs after the watermark forgot them
        spark.createDataFrame(log_rows(first, 40), schema).write.mode("append").parquet(source)
        jobs.start_auto_train(spark.readStream.schema(schema).parquet(source), store, f"{tmp_path}/check").awaitTermination(60)
    batch = run.auto_train(spark.read.schema(schema).parquet(source))
    ids = [r["id"] for r in store.read().collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r["id"] for r in batch.select("id").distinct().collect()}

    stream = jobs.outcome_windows(spark.readStream.schema(schema).parquet(source).withColumnRenamed("status", "category"))
    sink = stream.writeStream.outputMode("complete").format("memory").queryName("outcome_counts").trigger(availableNow=True)
    sink.option("checkpointLocation", f"{tmp_path}/check2").start().awaitTermination()
    whole = jobs.outcome_windows(spark.read.schema(schema).parquet(source).withColumnRenamed("status", "category"))
    assert sorted(map(tuple, spark.table("outcome_counts").collect())) == sorted(map(tuple, whole.collect()))


def test_a_pair_is_sent_once(spark, tmp_path):
    """Over micro-batches and restarts, with repeats that come long after and runs that come late."""
    schema = "question string, sql string, status string, row_count long, ts timestamp"
    source, sent = f"{tmp_path}/log", f"{tmp_path}/sent"

    def go(check, **options):
        rows = jobs.training_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), **options)
        writer = rows.writeStream.format("parquet").option("path", sent + check).option("checkpointLocation", f"{tmp_path}/check{check}")
        assert jobs.start_once(spark, writer).awaitTermination(60)
        return [r["id"] for r in spark.read.parquet(sent + check).collect()]

    late = [(f"late {i}", f"SELECT {i}", schemas.SQL_RAN, 1, dt.datetime(2020, 1, 1)) for i in range(3)]
    hot = [("q1", "SELECT 1", schemas.SQL_RAN, 1, dt.datetime(2024, 5, 1))] * 300
    spark.createDataFrame(log_rows(0, 40), schema).repartition(3).write.parquet(source)
    first = go("a")
    spark.createDataFrame(log_rows(4000, 40) + late + hot, schema).repartition(3).write.mode("append").parquet(source)
    ids = go("a")
    batch = {r["id"] for r in run.auto_train(spark.read.schema(schema).parquet(source)).collect()}
    assert 0 < len(first) < len(ids) == len(set(ids)) and set(ids) == batch
    assert sorted(go("b")) == sorted(ids)  # in one go
    assert sorted(go("c", remember_days=None)) == sorted(ids)
    go("d", remember_days=1e-9)
    spark.createDataFrame(hot, schema).write.mode("append").parquet(source)
    assert len(go("d", remember_days=1e-9)) > len(ids)  # forgotten, so sent again


def test_a_look_into_the_data_shows_all_rows(spark):
    spark.range(60).select(F.col("id").alias("n"), F.lit("x" * 20).alias("t")).coalesce(1).createOrReplaceTempView("sixty")
    statements = spark.createDataFrame([("SELECT n, t FROM sixty ORDER BY n",)], "sql string")
    whole = run.previews(spark, statements).first()["preview"]
    assert whole.splitlines()[2:] == [f"| {i} | {'x' * 20} |" for i in range(60)]
    some = run.previews(spark, statements, tokens=100).first()["preview"]
    shown = some.splitlines()[2:-1]
    assert shown == whole.splitlines()[2 : 2 + len(shown)] and 5 < len(shown) < 60
    assert some.splitlines()[-1] == f"({60 - len(shown)} of 60 rows are not shown)" and len(some) <= 460
    assert len(run.previews(spark, statements, 25).first()["preview"].splitlines()) == 27


def prompts_of(spark, texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "question_id string, t string")
    message = F.when(F.col("t").isNotNull(), F.array(ctx.message("user", F.col("t"))))
    return rows.select("question_id", message.alias("messages"))


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    log, broken = tmp_path / "calls", tmp_path / "broken"
    log.mkdir()
    broken.touch()

    def factory():
        import os
        import time
        import uuid

        def call(messages):
            said = messages[-1]["content"]
            (log / uuid.uuid4().hex).write_text(said)
            if said == "p31" and broken.exists():
                time.sleep(3)  # the others end first
                os._exit(1)  # the worker dies
            return said.upper()

        return call

    texts = [f"p{i}" for i in range(40)] + ["p3"] * 20 + [None]
    kept = f"{tmp_path}/answers"
    with pytest.raises(Exception):
        model.ask_once(prompts_of(spark, texts), factory, kept, per_task=1).collect()
    broken.unlink()
    rows = {r["question_id"]: (r["response"], r["error"]) for r in model.ask_once(prompts_of(spark, texts), factory, kept, per_task=1).collect()}
    assert rows == {str(i): (t.upper() if t else None, None if t else "ValueError: empty prompt") for i, t in enumerate(texts)}
    calls = [p.read_text() for p in log.iterdir()]
    asked_twice = {t for t in calls if calls.count(t) > 1}
    assert asked_twice <= {"p31"} and set(calls) == set(filter(None, texts))  # only the call that died
    again = len(calls)
    model.ask_once(prompts_of(spark, texts), factory, kept).collect()
    assert len(list(log.iterdir())) == again


def test_calls_are_tried_again_and_go_together(spark, tmp_path):
    def flaky():
        seen = {}

        def call(messages):
            said = messages[-1]["content"]
            seen[said] = seen.get(said, 0) + 1
            if seen[said] < 3:
                raise TimeoutError(said)
            return f"{said} {seen[said]}"

        return call

    prompts = prompts_of(spark, ["a", "b", "c", None])
    found = {r["question_id"]: (r["response"], r["error"]) for r in model.generate_responses(prompts, flaky, retries=2, wait=0.01, in_flight=3).collect()}
    assert found == {"0": ("a 3", None), "1": ("b 3", None), "2": ("c 3", None), "3": (None, "ValueError: empty prompt")}
    kept = f"{tmp_path}/kept"
    once = {r["question_id"]: r["error"] for r in model.generate_responses(prompts, flaky, answers=kept, retries=1, wait=0.01).collect()}
    assert once["0"] == "TimeoutError: a"
    later = {r["question_id"]: r["response"] for r in model.generate_responses(prompts, flaky, answers=kept, retries=2, wait=0.01).collect()}
    assert later == {"0": "a 3", "1": "b 3", "2": "c 3", "3": None}  # what failed is asked again

    def lists():
        return lambda group: [f"{len(group)} {m[-1]['content']}" for m in group] if group[0][-1]["content"] != "x" else ["too few"]

    some = prompts_of(spark, ["a", "b", None, "c", "d", "e"]).coalesce(1)
    together = {r["question_id"]: r["response"] for r in model.generate_responses(some, lists, tasks=1, together=3).collect()}
    assert sorted(x[0] for x in together.values() if x) == ["2", "2", "3", "3", "3"] and together["2"] is None
    wrong = model.generate_responses(prompts_of(spark, ["x", "y"]).coalesce(1).sortWithinPartitions("question_id"), lists, tasks=1, together=2)
    assert {r["error"] for r in wrong.collect()} <= {"ValueError: 1 responses to 2 prompts", None}

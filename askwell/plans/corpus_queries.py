"""Checks of the corpus operators and of its bootstrap from metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwell.functions.ids import content_id
from askwell.functions.text import pair_json, pair_text, sanitize_name
from askwell.operators import bootstrap, corpus as c
from askwell.operators.ranking import joined_text
from askwell.plans import inputs
from askwell.plans.oracle_parts import COLUMNS, HISTORY, INFO_SCHEMA, PAIRS, sql_id, sql_pair, table_docs
from askwell.plans.registry import query
from askwell.session import shared_folder
from askwell.sources import readers, sinks
from askwell.sources.store import CorpusStore
from askwell.schemas import CORPUS


@query("corpus_ids", f"SELECT doc_id, {sql_id('text', 'documentation')} AS id FROM documents")
def corpus_ids(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", content_id(F.col("text"), "documentation").alias("id"))


@query("add_pairs", f"""
    WITH {PAIRS} SELECT {sql_id(sql_pair('question', 'sql'), 'sql')} AS id, 'sql' AS training_data_type, question, sql AS content,
      {sql_pair('question', 'sql')} AS embed_text, 'Manually Trained' AS tag FROM pairs""")
def add_pairs(spark, sf_dir):
    return c.add_pairs(inputs.pairs(spark, sf_dir)).drop("created_at")


@query("tag_pairs", f"""
    WITH {PAIRS} SELECT {sql_id(sql_pair('question', 'sql'), 'sql')} AS id,
      coalesce(CASE WHEN turn > 0 THEN 'follow-up ' || turn END, 'Manually Trained') AS tag FROM pairs""")
def tag_pairs(spark, sf_dir):
    tagged = inputs.pairs(spark, sf_dir).withColumn("tag", F.when(F.col("turn") > 0, F.concat(F.lit("follow-up "), F.col("turn"))))
    return c.add_pairs(tagged).select("id", "tag")


@query("pair_text_forms", f"""
    WITH {PAIRS} SELECT conv_id, turn, {sql_pair('question', 'sql')} AS json, 'Question: ' || question || chr(10) || chr(10) || 'SQL: ' || sql AS qa,
      question || ' ' || sql AS concat, question FROM pairs""")
def pair_text_forms(spark, sf_dir):
    q, s = F.col("question"), F.col("sql")
    forms = [pair_text(q, s, form).alias(form) for form in ("json", "qa", "concat", "question")]
    return inputs.pairs(spark, sf_dir).select("conv_id", "turn", *forms)


@query("reject_empty", """
    SELECT doc_id, count(CASE WHEN length(line) > 0 THEN 1 END) AS kept, count(CASE WHEN length(line) = 0 THEN 1 END) AS rejected
    FROM (SELECT doc_id, unnest(string_split(text, '.')) AS line FROM documents) GROUP BY doc_id""")
def reject_empty(spark, sf_dir):
    """Sentences as documentation; what follows the last full stop is often empty."""
    lines = inputs.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\.")).alias("content"))
    kept, rejected = c.split_empty(lines)
    both = kept.withColumn("k", F.lit(1)).unionByName(rejected.withColumn("k", F.lit(0)))
    return both.groupBy("doc_id").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("rejected"))


def _stored_and_new(spark, sf_dir):
    """English and French documents stored in January, all documents coming in February."""
    texts = inputs.text_corpus(spark, sf_dir).withColumnRenamed("content", "documentation")
    january, february = (F.to_timestamp(F.lit(d)) for d in ("2024-01-01", "2024-02-01"))
    stored = c.add_documentation(texts.filter(F.col("lang").isin("en", "fr")).withColumn("created_at", january))
    return stored.dropDuplicates(["id"]), c.add_documentation(texts.withColumn("created_at", february))


_STORED = f"""
texts AS (SELECT {sql_id('text', 'documentation')} AS id, text AS content, lang FROM documents),
stored AS (SELECT DISTINCT id, content, '2024-01-01' AS day FROM texts WHERE lang IN ('en', 'fr')),
news AS (SELECT DISTINCT id, content, '2024-02-01' AS day FROM texts)"""


def _shown(df):
    return df.select("id", "content", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("merge_skip", f"""
    WITH {_STORED} SELECT * FROM stored UNION ALL SELECT * FROM news WHERE id NOT IN (SELECT id FROM stored)""")
def merge_skip(spark, sf_dir):
    return _shown(c.merge(*_stored_and_new(spark, sf_dir), "skip"))


@query("merge_upsert", f"""
    WITH {_STORED} SELECT id, content, max(day) AS day FROM (FROM stored UNION ALL FROM news) GROUP BY id, content""")
def merge_upsert(spark, sf_dir):
    return _shown(c.merge(*_stored_and_new(spark, sf_dir), "upsert"))


@query("corpus_store", f"""
    WITH {_STORED} SELECT id, training_data_type, content, day FROM (
      SELECT *, 'documentation' AS training_data_type FROM stored
      UNION ALL SELECT *, 'documentation' FROM news WHERE id NOT IN (SELECT id FROM stored))""")
def corpus_store(spark, sf_dir):
    """The same skip-merge through the stored corpus, done twice: the second time adds nothing."""
    stored, new = _stored_and_new(spark, sf_dir)
    store = CorpusStore(spark, shared_folder(spark, "corpus"), CORPUS)
    for rows in (stored, new, new):
        store.append_new(rows)
    shown = store.read()
    return shown.select("id", "training_data_type", "content", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


_LISTING = f"""
listing AS (SELECT {sql_id(sql_pair('question', 'sql'), 'sql')} AS id, question, sql AS content, 'sql' AS training_data_type FROM pairs
  UNION ALL SELECT {sql_id('ddl', 'ddl')}, NULL, ddl, 'ddl' FROM creates
  UNION ALL SELECT {sql_id('text', 'documentation')}, NULL, text, 'documentation' FROM documents)"""


def _listing(spark, sf_dir):
    ddl = bootstrap.create_ddl(inputs.column_descriptions(spark, sf_dir))
    texts = inputs.text_corpus(spark, sf_dir).withColumnRenamed("content", "documentation")
    return c.listing(inputs.pairs(spark, sf_dir), ddl, texts)


@query("training_data", f"WITH {PAIRS}, {COLUMNS}, {_LISTING} SELECT * FROM listing")
def training_data(spark, sf_dir):
    return c.training_data(_listing(spark, sf_dir))


@query("remove_collection", f"WITH {PAIRS}, {COLUMNS}, {_LISTING} SELECT * FROM listing WHERE training_data_type <> 'documentation'")
def remove_collection(spark, sf_dir):
    return c.remove_kind(_listing(spark, sf_dir), "documentation")


@query("kind_from_id", """
    SELECT * FROM (SELECT doc_id || '-' || suffix AS id,
      CASE suffix WHEN 'sql' THEN 'sql' WHEN 'ddl' THEN 'ddl' WHEN 'doc' THEN 'documentation' END AS training_data_type
      FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'doc' WHEN 'fr' THEN 'sql' WHEN 'de' THEN 'ddl' ELSE lang END AS suffix FROM documents))
    WHERE training_data_type IS NOT NULL""")
def kind_query(spark, sf_dir):
    suffix = F.when(F.col("lang") == "en", "doc").when(F.col("lang") == "fr", "sql").when(F.col("lang") == "de", "ddl").otherwise(F.col("lang"))
    ids = inputs.table(spark, sf_dir, "documents").select(F.concat_ws("-", "doc_id", suffix).alias("id"))
    return c.with_kind(ids)


@query("parse_pairs", f"""
    WITH {PAIRS}, stored AS (SELECT conv_id, turn, CASE WHEN turn = 2 THEN rtrim({sql_pair('question', 'sql')}, '}}') ELSE {sql_pair('question', 'sql')} END AS content,
      question, sql, turn <> 2 AS good FROM pairs)
    SELECT conv_id, turn, CASE WHEN good THEN question END AS question, CASE WHEN good THEN sql END AS sql,
      CASE WHEN good THEN 'parsed' ELSE 'rejected' END AS status FROM stored""")
def parse_pairs(spark, sf_dir):
    """Stored JSON read back; that of every second question lost its end and is rejected."""
    stored = inputs.pairs(spark, sf_dir).select("conv_id", "turn", pair_json(F.col("question"), F.col("sql")).alias("content"))
    broken = F.when(F.col("turn") == 2, F.rtrim(F.col("content"), F.lit("}"))).otherwise(F.col("content"))
    good, bad = c.parse_pairs(stored.withColumn("content", broken))
    nothing = F.lit(None).cast("string")
    return good.select("conv_id", "turn", "question", "sql", F.lit("parsed").alias("status")).unionByName(
        bad.select("conv_id", "turn", nothing.alias("question"), nothing.alias("sql"), F.lit("rejected").alias("status"))
    )


_TOXIC = f"""
texts AS (SELECT {sql_id("CAST(doc_id AS VARCHAR)", 'documentation')} AS id, doc_id, text AS content FROM documents),
gone AS (SELECT {sql_id("CAST(doc_id AS VARCHAR)", 'documentation')} AS id FROM labels WHERE toxic = 1
  UNION SELECT {sql_id("CAST(conv_id AS VARCHAR) || 'x'", 'documentation')} FROM conversations)"""


def _toxic(spark, sf_dir):
    texts = inputs.table(spark, sf_dir, "documents").select(
        content_id(F.col("doc_id").cast("string"), "documentation").alias("id"), "doc_id", F.col("text").alias("content"))
    toxic = inputs.table(spark, sf_dir, "labels").filter("toxic = 1").select(content_id(F.col("doc_id").cast("string"), "documentation").alias("id"))
    unknown = inputs.table(spark, sf_dir, "conversations").select(
        content_id(F.concat(F.col("conv_id").cast("string"), F.lit("x")), "documentation").alias("id"))
    return texts, toxic.unionByName(unknown)


@query("remove_ids", f"WITH {_TOXIC} SELECT id, doc_id, content FROM texts WHERE id NOT IN (SELECT id FROM gone)")
def remove_ids(spark, sf_dir):
    return c.remove(*_toxic(spark, sf_dir))


@query("removal_report", f"WITH {_TOXIC} SELECT id, id IN (SELECT id FROM texts) AS existed FROM gone")
def removal_report(spark, sf_dir):
    return c.removal_report(*_toxic(spark, sf_dir))


@query("update_rows", """
    SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.quality = 1 THEN 'Checked: ' || d.text ELSE d.text END AS content,
      CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.source END AS tag,
      coalesce(l.quality = 1, false) AS needs_embedding
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def update_rows(spark, sf_dir):
    stored = inputs.text_corpus(spark, sf_dir).select("id", "content", F.col("source").alias("tag"))
    marked = stored.join(inputs.table(spark, sf_dir, "labels").withColumn("id", F.col("doc_id").cast("string")), "id")
    changes = marked.select(
        "id", F.when(F.col("quality") == 1, F.concat(F.lit("Checked: "), "content")).alias("content"), F.when(F.col("toxic") == 1, "toxic").alias("tag")
    )
    return c.update(stored, changes)


def _requests(spark, sf_dir):
    """Training requests of every shape, from documents: what is given depends on language and source."""
    texts = inputs.table(spark, sf_dir, "documents")
    lang, source, text = F.col("lang"), F.col("source"), F.col("text")
    return texts.select(
        "doc_id", F.when(lang.isin("en", "fr"), F.concat(F.lit("What does "), source, F.lit(" say?"))).alias("question"),
        F.when(source.isin("src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8"), text).alias("sql"),
        F.when(lang.isin("de", "en"), text).alias("ddl"),
        F.when(source.isin("src8", "src9", "src10"), text).alias("documentation"),
    )


@query("route_training", """
    WITH r AS (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'What does ' || source || ' say?' END AS question,
      CASE WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8') THEN text END AS sql,
      CASE WHEN lang IN ('de', 'en') THEN text END AS ddl,
      CASE WHEN source IN ('src8', 'src9', 'src10') THEN text END AS documentation FROM documents),
    s AS (SELECT *, CASE WHEN question IS NOT NULL AND coalesce(sql, '') = '' THEN 'reject' WHEN documentation <> '' THEN 'documentation'
      WHEN sql <> '' THEN 'sql' WHEN ddl <> '' THEN 'ddl' ELSE 'plan' END AS route FROM r)
    SELECT doc_id, route, CASE route WHEN 'documentation' THEN documentation WHEN 'sql' THEN sql WHEN 'ddl' THEN ddl END AS content,
      CASE WHEN route = 'reject' THEN 'a question needs its sql' END AS error, route = 'sql' AND question IS NULL AS needs_question FROM s""")
def route_training(spark, sf_dir):
    return c.route_training(_requests(spark, sf_dir)).select("doc_id", "route", "content", "error", "needs_question")


_PLAN = f"""
{INFO_SCHEMA}, {table_docs()}, {COLUMNS}, {PAIRS},
plan AS (SELECT * FROM docs UNION ALL SELECT 'ddl', 'main', table_name, ddl FROM creates
  UNION ALL SELECT 'sql', '', question, sql FROM pairs)"""


def _plan(spark, sf_dir):
    docs = bootstrap.table_docs(inputs.info_schema_rows(spark, sf_dir))
    ddl = bootstrap.create_ddl(inputs.column_descriptions(spark, sf_dir)).select(
        F.lit("ddl").alias("item_type"), F.lit("main").alias("item_group"), F.col("table_name").alias("item_name"), F.col("ddl").alias("item_value"))
    pairs = inputs.pairs(spark, sf_dir).select(
        F.lit("sql").alias("item_type"), F.lit("").alias("item_group"), F.col("question").alias("item_name"), F.col("sql").alias("item_value"))
    return docs.unionByName(ddl).unionByName(pairs)


@query("apply_plan", f"""
    WITH {_PLAN} SELECT CASE item_type WHEN 'ddl' THEN {sql_id('item_value', 'ddl')} WHEN 'is' THEN {sql_id('item_value', 'documentation')}
      ELSE {sql_id(sql_pair('item_name', 'item_value'), 'sql')} END AS id,
      CASE item_type WHEN 'is' THEN 'documentation' ELSE item_type END AS training_data_type,
      CASE WHEN item_type = 'sql' THEN item_name END AS question, item_value AS content FROM plan""")
def apply_plan(spark, sf_dir):
    return c.apply_plan(_plan(spark, sf_dir)).select("id", "training_data_type", "question", "content")


_SUMMARY = "CASE item_type WHEN 'sql' THEN 'Train on SQL: ' WHEN 'ddl' THEN 'Train on DDL: ' ELSE 'Train on Information Schema: ' END || item_group || ' ' || item_name"


@query("plan_summary", f"WITH {_PLAN} SELECT {_SUMMARY} AS summary FROM plan")
def plan_summary(spark, sf_dir):
    return c.plan_summary(_plan(spark, sf_dir)).select("summary")


@query("remove_plan_item", f"""
    WITH {_PLAN}, numbered AS (SELECT *, {_SUMMARY} AS summary, row_number() OVER (PARTITION BY {_SUMMARY} ORDER BY item_value) AS n FROM plan)
    SELECT item_type, item_group, item_name, item_value FROM numbered WHERE NOT (summary = 'Train on DDL: main t_3' AND n = 1)""")
def remove_plan_item(spark, sf_dir):
    return c.remove_plan_item(_plan(spark, sf_dir), "Train on DDL: main t_3")


@query("question_sample", f"""
    WITH {PAIRS} SELECT id, question FROM (SELECT DISTINCT {sql_id(sql_pair('question', 'sql'), 'sql')} AS id, question FROM pairs)
    ORDER BY md5(id || '42'), id LIMIT 5""")
def question_sample(spark, sf_dir):
    return c.question_sample(c.add_pairs(inputs.pairs(spark, sf_dir)).select("id", "question").distinct(), "42")


@query("all_embeddings", """
    SELECT CAST(vec_id AS VARCHAR) AS id, CASE label % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'ddl' ELSE 'documentation' END AS training_data_type,
      CAST(len(embedding) AS INT) AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings""")
def all_embeddings(spark, sf_dir):
    from askwell.functions.vectors import norm

    rows = c.embeddings(inputs.vectors(spark, sf_dir))
    return rows.select("id", "training_data_type", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("length"))


@query("dim_check", """
    SELECT vec_id, CASE WHEN len(e) = 64 THEN 'kept' ELSE 'rejected' END AS status
    FROM (SELECT vec_id, CASE WHEN label = 3 THEN embedding[:32] ELSE embedding END AS e FROM embeddings)""")
def dim_check(spark, sf_dir):
    """Vectors of label 3 are cut to half and must be rejected."""
    e = F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    kept, rejected = c.dim_check(inputs.table(spark, sf_dir, "embeddings").withColumn("embedding", e), 64)
    return kept.select("vec_id", F.lit("kept").alias("status")).unionByName(rejected.select("vec_id", F.lit("rejected").alias("status")))


@query("table_docs", f"WITH {INFO_SCHEMA}, {table_docs()} SELECT * FROM docs")
def table_docs_query(spark, sf_dir):
    return bootstrap.table_docs(inputs.info_schema_rows(spark, sf_dir))


_WANTED = "cat IN ('small', 'promo') AND sch IN ('Brand_1', 'Brand_2', 'Brand_3', 'INFORMATION_SCHEMA') AND sch <> 'INFORMATION_SCHEMA'"


@query("table_docs_filtered", f"WITH {INFO_SCHEMA}, {table_docs(_WANTED)} SELECT * FROM docs")
def table_docs_filtered(spark, sf_dir):
    return bootstrap.training_plan(
        inputs.info_schema_rows(spark, sf_dir), databases=["small", "promo"],
        schemas=["Brand_1", "Brand_2", "Brand_3", "INFORMATION_SCHEMA"],
    )


@query("query_history", f"""
    WITH {HISTORY} SELECT query_id, query_text, rows_produced FROM (SELECT * FROM history ORDER BY start_time DESC, query_id DESC LIMIT 5000)""")
def query_history(spark, sf_dir):
    newest = readers.read_history(inputs.query_history(spark, sf_dir), 5000)
    return newest.select(F.col("QUERY_ID").alias("query_id"), F.col("QUERY_TEXT").alias("query_text"), F.col("ROWS_PRODUCED").alias("rows_produced"))


@query("history_mining", f"""
    WITH {HISTORY}, kept AS (SELECT *, lower(regexp_replace(query_text, '\\b[0-9]+\\b', '?', 'g')) AS template FROM history WHERE rows_produced > 1
      AND (contains(lower(query_text), 'sales_1') OR contains(lower(query_text), 'sales_2'))
      AND (contains(lower(query_text), 'schema_click') OR contains(lower(query_text), 'schema_view'))),
    drawn AS (SELECT template, count(*) AS queries, arg_min(query_text, md5(query_id || '7')) AS query_text FROM kept GROUP BY template)
    SELECT 'sql' AS item_type, '' AS item_group, 'What has ' || length(query_text) || ' characters?' AS item_name, query_text AS item_value, template, queries FROM drawn""")
def history_mining(spark, sf_dir):
    """A query of every template of the log, with a question that a model made for it."""
    from askwell.operators.model import questions_for_sql
    from askwell.plans.context_queries import echo_model

    mined = bootstrap.statement_templates(inputs.query_history(spark, sf_dir), ["SALES_1", "Sales_2"], ["Schema_click", "schema_VIEW"], 1, "7")
    path = shared_folder(spark, "mined")
    mined.write.parquet(path)
    mined = spark.read.parquet(path)
    asked = questions_for_sql(mined, echo_model, key="template", sql="QUERY_TEXT").select("template", "question")
    named = mined.join(asked, "template")
    plan = bootstrap.history_plan(named, F.col("question"))
    return plan.join(named.select(F.col("QUERY_TEXT").alias("item_value"), "template", "queries"), "item_value")


@query("alter_ddl", f"WITH {COLUMNS} SELECT table_name, column_name, 'ALTER TABLE ' || table_name || ' ADD COLUMN ' || line || ';' AS ddl FROM collines")
def alter_ddl(spark, sf_dir):
    return bootstrap.alter_ddl(inputs.column_descriptions(spark, sf_dir))


@query("create_ddl", f"WITH {COLUMNS} SELECT * FROM creates")
def create_ddl(spark, sf_dir):
    return bootstrap.create_ddl(inputs.column_descriptions(spark, sf_dir))


@query("sanitize_name", """
    WITH a AS (SELECT p_partkey, replace(lower(p_name || ' _' || p_type || '- (' || p_brand || ')'), ' ', '-') AS s FROM part),
    b AS (SELECT p_partkey, CASE WHEN contains(s, '-') THEN replace(regexp_replace(s, '-+', '-', 'g'), '_', '-') ELSE s END AS s FROM a),
    c AS (SELECT p_partkey, regexp_replace(s, '[^a-z0-9_-]', '', 'g') AS s FROM b)
    SELECT p_partkey, regexp_replace(regexp_replace(s, '[-_]$', ''), '^[-_]', '') AS name FROM c""")
def sanitize_query(spark, sf_dir):
    messy = F.concat("p_name", F.lit(" _"), "p_type", F.lit("- ("), "p_brand", F.lit(")"))
    return inputs.table(spark, sf_dir, "part").select("p_partkey", sanitize_name(messy).alias("name"))


_STAR = ("customer", "supplier", "part", "orders", "lineitem")


@query("info_schema", """
    WITH t AS (""" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count" for t in _STAR) + """)
    SELECT 'spark' AS "TABLE_CATALOG", 'default' AS "TABLE_SCHEMA", c.table_name AS "TABLE_NAME", c.column_name AS "COLUMN_NAME",
      CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
        ELSE 'timestamp_ntz' END AS "DATA_TYPE",
      c.column_index AS "ORDINAL_POSITION", CAST(0 AS BIGINT) AS "NULL_COUNT", t.row_count AS "ROW_COUNT"
    FROM duckdb_columns() c JOIN t ON c.table_name = t.table_name""")
def info_schema(spark, sf_dir):
    return bootstrap.column_catalog(spark, {t: inputs.table(spark, sf_dir, t) for t in _STAR})


@query("catalog_ddl", """
    WITH t AS (""" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count" for t in _STAR) + """),
    c AS (SELECT table_name, column_name, column_index, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
      WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS typ FROM duckdb_columns())
    SELECT c.table_name, 'CREATE TABLE ' || c.table_name || ' (' || chr(10) || '  '
      || string_agg(column_name || ' ' || typ, ',' || chr(10) || '  ' ORDER BY column_index) || chr(10) || ');' AS ddl,
      any_value(row_count) AS row_count
    FROM c JOIN t ON c.table_name = t.table_name GROUP BY c.table_name""")
def catalog_ddl(spark, sf_dir):
    """Statements from the tables' schemas, with the size of each table next to them."""
    tables = {t: inputs.table(spark, sf_dir, t) for t in _STAR}
    rows = bootstrap.column_catalog(spark, tables).select(F.col("TABLE_NAME").alias("table_name"), "ROW_COUNT").distinct()
    return bootstrap.catalog_ddl(spark, tables).join(rows, "table_name").withColumnRenamed("ROW_COUNT", "row_count")


@query("qa_round_trip", f"WITH {PAIRS} SELECT question, sql AS answer FROM pairs")
def qa_round_trip(spark, sf_dir):
    """Pairs written as corpora, one JSON array per turn and thousand conversations, and read back."""
    path = shared_folder(spark, "qa")
    record = F.to_json(F.struct("question", F.col("sql").alias("answer")))
    records = inputs.pairs(spark, sf_dir).select("conv_id", F.floor(F.col("conv_id") / 1000).alias("corpus"), "turn", record.alias("record"))
    arrays = joined_text(records, ["corpus", "turn"], "conv_id", "record", ",\n", "body")
    arrays.select("corpus", "turn", F.concat(F.lit("[\n"), "body", F.lit("\n]")).alias("value")).write.partitionBy("corpus", "turn").text(path)
    return readers.read_qa(spark, f"{path}/*/*").select("question", "answer")


@query("column_json", f"WITH {COLUMNS} SELECT table_name, column_name, data_type, description, usage FROM coldesc")
def column_json(spark, sf_dir):
    """Column descriptions written one JSON array per file, as uploads come, and read back."""
    path = shared_folder(spark, "columns")
    fields = ("table_name", "column_name", "data_type", "description", "usage")
    records = inputs.column_descriptions(spark, sf_dir).select("table_name", "ordinal", F.to_json(F.struct(*fields)).alias("record"))
    arrays = joined_text(records, ["table_name"], "ordinal", "record", ",", "body")
    upload = arrays.select("table_name", F.concat(F.lit("[\n"), "body", F.lit("\n]")).alias("value"))
    upload.write.partitionBy("table_name").text(path)
    return readers.read_column_descriptions(spark, path).drop("ordinal")


@query("csv_download", "SELECT * FROM orders")
def csv_download(spark, sf_dir):
    path = shared_folder(spark, "csv")
    result = inputs.table(spark, sf_dir, "orders")
    sinks.write_csv(result, path)
    return spark.read.schema(result.schema).option("header", True).csv(path)


@query("clean_corpus", f"""
    WITH {PAIRS}, answers AS (SELECT question, CASE WHEN turn = 0
      THEN 'Here it is:' || chr(10) || '```sql' || chr(10) || 'SELECT ''' || replace(sql, ';', ',') || ''' AS answer;' || chr(10) || '```'
      ELSE sql END AS answer, turn, sql FROM pairs)
    SELECT question, CASE WHEN turn = 0 THEN 'SELECT ''' || replace(sql, ';', ',') || ''' AS answer;' END AS sql,
      CASE WHEN turn = 0 THEN 'kept' ELSE 'rejected' END AS status FROM answers""")
def clean_corpus(spark, sf_dir):
    """Answers of which some hold fenced SQL in prose and the rest none."""
    from askwell.operators.model import clean_corpus as clean

    fenced = F.concat(
        F.lit("Here it is:\n```sql\nSELECT '"), F.replace("sql", F.lit(";"), F.lit(",")), F.lit("' AS answer;\n```")
    )
    answers = inputs.pairs(spark, sf_dir).select("question", F.when(F.col("turn") == 0, fenced).otherwise(F.col("sql")).alias("answer"))
    kept, rejected = clean(answers)
    return kept.select("question", "sql", F.lit("kept").alias("status")).unionByName(
        rejected.select("question", F.lit(None).cast("string").alias("sql"), F.lit("rejected").alias("status"))
    )

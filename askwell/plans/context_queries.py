"""Checks of prompts, model calls and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwell.functions.sqltext import extract_code, extract_sql, is_select, unescape
from askwell.functions.text import approx_tokens, strip_semicolon
from askwell.operators import context as ctx
from askwell.operators import model as m
from askwell.operators import retrieval
from askwell.operators.evaluation import context_strategies
from askwell.operators.run import previews
from askwell.plans import inputs
from askwell.plans.oracle_parts import L2, PAIRS, VECTORS, knn
from askwell.plans.registry import query

BUDGET = 1500


def text(value: str) -> str:
    """A SQL literal, line ends as chr(10)."""
    return "('" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def _context(spark, sf_dir):
    return retrieval.retrieve_context(inputs.topic_questions(spark, sf_dir), inputs.embedded_corpus(spark, sf_dir), 6)


def packed(prompt: str, items: str, kind: str, budget: int = BUDGET) -> str:
    header = text(ctx.HEADERS[kind])
    return f"""CASE WHEN coalesce(len({items}), 0) > 0 THEN list_reduce({items},
      lambda acc, x: CASE WHEN (length(acc) + length(x)) / 4.0 < {budget} THEN acc || x || chr(10) || chr(10) ELSE acc END,
      {prompt} || {header}) ELSE {prompt} END"""


def packed_pairs(prompt: str, budget: int = BUDGET) -> str:
    return f"""CASE WHEN coalesce(len(pq), 0) > 0 THEN struct_extract(list_reduce(pq,
      lambda acc, x: CASE WHEN (length(acc.q) + length(x.s)) / 4.0 < {budget}
        THEN {{'q': acc.q || x.q || chr(10) || x.s || chr(10) || chr(10), 's': ''}} ELSE acc END,
      {{'q': {prompt} || {text(ctx.HEADERS['pairs'])}, 's': ''}}), 'q') ELSE {prompt} END"""


_CONTEXT = f"""{VECTORS}, {knn(L2, "6", "question_id, training_data_type", rows='corpus')},
found AS (SELECT h.question_id, h.training_data_type AS kind, h.rank, c.question AS q, c.content AS s FROM hits h JOIN corpus c ON c.id = h.id),
lists AS (SELECT question_id, list(s ORDER BY rank) FILTER (WHERE kind = 'ddl') AS ddl,
  list(s ORDER BY rank) FILTER (WHERE kind = 'documentation') AS docs,
  list({{'q': q, 's': s}} ORDER BY rank) FILTER (WHERE kind = 'sql') AS pq FROM found GROUP BY question_id),
context AS (SELECT t.question_id, t.question, ddl, docs, pq FROM topics t LEFT JOIN lists l ON l.question_id = t.question_id)"""


@query("token_estimate", "SELECT doc_id, length(text) / 4.0 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens"))


@query("pack_context", f"""
    WITH {_CONTEXT}, a AS (SELECT question_id, pq, docs, {packed("question", "ddl", "ddl")} AS p FROM context),
    b AS (SELECT question_id, pq, {packed("p", "docs", "documentation")} AS p FROM a)
    SELECT question_id, {packed_pairs("p")} AS prompt FROM b""")
def pack_context(spark, sf_dir):
    found = _context(spark, sf_dir)
    ddl, docs = (F.transform(c, lambda x: x["content"]) for c in ("ddl", "documentation"))
    head = ctx.pack_documentation(ctx.pack_ddl(F.col("question"), ddl, BUDGET), docs, BUDGET)
    return found.select("question_id", ctx.pack_pairs(head, F.col("pairs"), BUDGET).alias("prompt"))


def _shown(prompts):
    return prompts.select("question_id", F.posexplode("messages").alias("position", "m")).select("question_id", "position", "m.*")


_INTRO, _RULES = text(ctx.TEMPLATES["intro"].format(dialect="SQL")), text(ctx.TEMPLATES["rules"].format(dialect="SQL"))


@query("build_prompts", f"""
    WITH {_CONTEXT}, a AS (SELECT question_id, question, pq, docs, {packed(_INTRO, "ddl", "ddl")} AS p FROM context),
    b AS (SELECT question_id, question, coalesce(len(pq), 0) AS n, {packed("p", "list_append(docs, 'Amounts are in cents.')", "documentation")} AS p FROM a),
    pos AS (SELECT question_id, q, s, row_number() OVER (PARTITION BY question_id ORDER BY rank) - 1 AS i FROM found WHERE kind = 'sql')
    SELECT question_id, CAST(2 * i AS INT) AS position, 'user' AS role, q AS content FROM pos
    UNION ALL SELECT question_id, CAST(2 * i + 1 AS INT), 'assistant', s FROM pos
    UNION ALL SELECT question_id, CAST(2 * n AS INT), 'user', p || {_RULES} || question || chr(10) || 'Write the answer in German.' FROM b""")
def build_prompts(spark, sf_dir):
    return _shown(ctx.build_prompts(
        _context(spark, sf_dir), max_tokens=BUDGET, static_documentation="Amounts are in cents.", language="German"
    ))


_DDL_BEFORE, _DDL_AFTER = ctx.TEMPLATES["ddl_only"].split("{question}")
_DDL_MIDDLE, _DDL_END = _DDL_AFTER.split("{ddl}")


@query("ddl_only_prompts", f"""
    WITH {_CONTEXT} SELECT question_id, 0 AS position, 'user' AS role, {text(_DDL_BEFORE)} || question || {text(_DDL_MIDDLE)}
      || coalesce(array_to_string(ddl, ''), '') || {text(_DDL_END)} AS content FROM context""")
def ddl_only_prompts(spark, sf_dir):
    return _shown(ctx.build_prompts(_context(spark, sf_dir), "ddl_only"))


@query("followup_prompts", f"""
    WITH {_CONTEXT}, z AS (SELECT *, 'The user asked: ''' || question || '''' || chr(10) || chr(10) AS start FROM context),
    a AS (SELECT question_id, pq, docs, {packed("start", "ddl", "ddl")} AS p FROM z),
    b AS (SELECT question_id, pq, {packed("p", "docs", "documentation")} AS p FROM a)
    SELECT question_id, 0 AS position, 'system' AS role, {packed_pairs("p")} AS content FROM b
    UNION ALL SELECT question_id, 1, 'user', {text(ctx.TEMPLATES['followup'])} FROM context""")
def followup_prompts(spark, sf_dir):
    return _shown(ctx.build_prompts(_context(spark, sf_dir), "followup", max_tokens=BUDGET))


@query("context_strategies", f"""
    WITH {_CONTEXT}, crossed AS (SELECT question_id, 'schema' AS strategy, ddl, [] AS pq, [] AS docs FROM context
      UNION ALL SELECT question_id, 'static', ddl, [{{'q': 'How many?', 's': 'SELECT count(*) FROM t'}}], [] FROM context
      UNION ALL SELECT question_id, 'retrieved', ddl, pq, docs FROM context)
    SELECT question_id, strategy, CAST(coalesce(len(ddl), 0) AS INT) AS tables, CAST(coalesce(len(pq), 0) AS INT) AS examples,
      CAST(coalesce(len(docs), 0) AS INT) AS documents, CAST(2 * coalesce(len(pq), 0) + 1 AS INT) AS messages FROM crossed""")
def strategies(spark, sf_dir):
    crossed = context_strategies(_context(spark, sf_dir), [("How many?", "SELECT count(*) FROM t")])
    keyed = crossed.withColumn("question_id", F.concat_ws("/", "question_id", "strategy"))
    messages = ctx.build_prompts(keyed).select("question_id", F.size("messages").alias("messages"))
    return keyed.join(messages, "question_id").select(
        F.substring_index("question_id", "/", 1).alias("question_id"), "strategy", F.size("ddl").alias("tables"),
        F.size("pairs").alias("examples"), F.size("documentation").alias("documents"), "messages",
    )


_MESSAGES = f"""{PAIRS}, prompts AS (SELECT conv_id || '-' || turn AS question_id, turn, question, sql,
  'Conversation ' || conv_id AS first_system, CASE WHEN turn NOT IN (0, 4) THEN 'Turn ' || turn END AS last_system FROM pairs)"""


@query("prompt_routing", f"""
    WITH {_MESSAGES}, t AS (SELECT question_id, turn, CASE WHEN turn = 4 THEN 0 ELSE (length(first_system) + length(question) + length(sql)
      + coalesce(length(last_system), 0)) / 4.0 END AS tokens FROM prompts)
    SELECT question_id, tokens, CASE WHEN turn = 4 THEN NULL WHEN tokens > 150 THEN 'large' ELSE 'small' END AS model,
      CASE WHEN turn = 4 THEN 'empty prompt' END AS error FROM t""")
def prompt_routing(spark, sf_dir):
    return ctx.prompt_routing(inputs.messages(spark, sf_dir), "small", "large", 150).drop("messages")


@query("split_system", f"""
    WITH {_MESSAGES} SELECT question_id, CASE WHEN turn <> 4 THEN coalesce(last_system, first_system) END AS system,
      CASE WHEN turn = 4 THEN 0 ELSE 2 END AS others, CASE WHEN turn <> 4 THEN question END AS first_other FROM prompts""")
def split_system(spark, sf_dir):
    parts = ctx.split_system(inputs.messages(spark, sf_dir))
    return parts.select("question_id", "system", F.size("messages").alias("others"),
                        F.try_element_at("messages", F.lit(1))["content"].alias("first_other"))


@query("rewrite_inputs", """
    WITH u AS (SELECT conv_id, turn, text AS question, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last_question
      FROM conversations WHERE role = 'user')
    SELECT *, last_question IS NOT NULL AS needs_model,
      coalesce('Asked before: ' || last_question || chr(10) || 'Asked now: ' || question, question) AS text FROM u""")
def rewrite_inputs(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return ctx.rewrite_inputs(turns)


@query("followup_lines", """
    WITH r AS (SELECT conv_id || '-' || turn AS question_id, regexp_replace('1. ' || replace(text, '. ', '.' || chr(10) || '12.  '),
      '(?m)^\\d+\\.\\s*', '', 'g') AS r FROM conversations),
    l AS (SELECT question_id, string_split(r, chr(10))[1:5] AS lines FROM r)
    SELECT question_id, unnest(range(len(lines)))::INT AS position, unnest(lines) AS followup FROM l""")
def followup_lines(spark, sf_dir):
    """Every sentence of a turn as a numbered line."""
    numbered = F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit(".\n12.  ")))
    said = inputs.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), numbered.alias("response"))
    return m.followup_lines(said)


def _runs(spark, sf_dir):
    """Runs of which the first in each conversation failed."""
    return inputs.pairs(spark, sf_dir).select(
        "conv_id", "turn", "question", "sql", F.when(F.col("turn") == 0, F.concat(F.lit("no such column: c"), F.col("conv_id"))).alias("error"),
        F.when(F.col("conv_id") % 2 == 0, 1).alias("attempts"),
    )


@query("fix_inputs", f"""
    WITH {PAIRS} SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS attempts,
      'Question: ' || question || chr(10) || 'SQL: ' || sql || chr(10) || 'Error: no such column: c' || conv_id AS system,
      {text(ctx.TEMPLATES['fix'])} AS ask FROM pairs WHERE turn = 0""")
def fix_inputs(spark, sf_dir):
    failed = ctx.fix_inputs(_runs(spark, sf_dir))
    return failed.select("conv_id", "attempts", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("ask"))


@query("task_prompts", f"""
    WITH {PAIRS}, t(task, ask) AS (VALUES ('summary', {text(ctx.TEMPLATES['summary'])} || chr(10) || 'Write the answer in French.'),
      ('chart', {text(ctx.TEMPLATES['chart'])}), ('question', ''))
    SELECT conv_id, turn, task, CASE WHEN task = 'question' THEN {text(ctx.TEMPLATES['question'])} ELSE sql END AS system,
      CASE WHEN task = 'question' THEN sql ELSE ask END AS ask FROM pairs, t""")
def task_prompts(spark, sf_dir):
    runs = inputs.pairs(spark, sf_dir)
    made = None
    for task, language in (("summary", "French"), ("chart", None), ("question", None)):
        part = ctx.task_prompt(runs, task, F.col("sql"), language).withColumn("task", F.lit(task))
        made = part if made is None else made.unionByName(part)
    return made.select("conv_id", "turn", "task", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("ask"))


def counting_model():
    """A stand-in model: says how many messages and characters it got."""
    def call(messages):
        return f"{len(messages)} messages, {sum(len(x['content']) for x in messages)} characters"

    return call


@query("generate_responses", f"""
    WITH {_MESSAGES} SELECT question_id, CASE WHEN turn <> 4 THEN CASE WHEN last_system IS NULL THEN 3 ELSE 4 END || ' messages, '
      || (length(first_system) + length(question) + length(sql) + coalesce(length(last_system), 0)) || ' characters' END AS response,
      CASE WHEN turn = 4 THEN 'ValueError: empty prompt' END AS error FROM prompts""")
def generate_responses(spark, sf_dir):
    return m.generate_responses(inputs.messages(spark, sf_dir), counting_model)


def words_model():
    """A stand-in model: suggests the question's words."""
    return lambda messages: "\n".join(messages[-1]["content"].split("Question: ")[1].split())


@query("suggest_columns", """
    WITH w AS (SELECT CAST(item_id AS VARCHAR) AS question_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)
    SELECT question_id, unnest(range(len(w)))::INT AS i, unnest(w) AS hint, question_id || '#' || unnest(range(len(w))) AS suggestion_id FROM w""")
def suggest_columns(spark, sf_dir):
    return m.suggest_columns(inputs.benchmark_questions(spark, sf_dir), words_model).select("question_id", "i", "hint", "suggestion_id")


def echo_model():
    """A stand-in model: repeats the start of the last message's length."""
    return lambda messages: f"What has {len(messages[-1]['content'])} characters?"


@query("questions_for_sql", f"""
    WITH {PAIRS} SELECT conv_id || '-' || turn AS id, 'What has ' || length(sql) || ' characters?' AS question, CAST(NULL AS VARCHAR) AS error FROM pairs""")
def questions_for_sql(spark, sf_dir):
    stored = inputs.pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "sql")
    return m.questions_for_sql(stored, echo_model)


def looking_model():
    """A stand-in model: looks into the line items first, then repeats the rows it was shown."""
    def call(messages):
        said = messages[-1]["content"]
        shown = [line for line in said.split("\n") if line.startswith("| ")]
        if shown:
            return " ".join(shown)
        flag = said.split("flag ")[-1].split("?")[0]
        if flag == "N":
            return "SELECT 1;"
        return f"-- intermediate_sql\nSELECT l_linestatus, count(*) AS n FROM askwell_lineitem WHERE l_returnflag = '{flag}' GROUP BY l_linestatus;"

    return call


@query("two_step", """
    WITH n AS (SELECT l_returnflag AS flag, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT flag AS question_id, CASE WHEN flag = 'N' THEN 'SELECT 1;' ELSE '| l_linestatus | n | ' || string_agg('| ' || s || ' | ' || n || ' |', ' ' ORDER BY s) END AS response
    FROM n GROUP BY flag""")
def two_step(spark, sf_dir):
    """Questions about each return flag; all but one need a look into the line items."""
    inputs.views(spark, sf_dir, "lineitem")
    none = "cast(array() as array<struct<id:string,question:string,content:string>>)"
    asked = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("question_id")).distinct().select(
        "question_id", F.concat(F.lit("What about flag "), "question_id", F.lit("?")).alias("question"),
        F.expr(none).alias("pairs"), F.expr(none).alias("ddl"), F.expr(none).alias("documentation"),
    )
    answered = m.two_step(asked, looking_model, ctx.build_prompts, lambda s: previews(spark, s), allow_data=True)
    return answered.select("question_id", "response")


_F = "```"
RESPONSES = f"""
responses AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN text || ' WITH a AS (SELECT 1) SELECT * FROM a; done'
  WHEN 1 THEN 'Sure. SELECT x FROM t WHERE y = 1; and SELECT ''' || text || ''';'
  WHEN 2 THEN '{_F}sql' || chr(10) || 'select a\\_b from t [x]' || chr(10) || '{_F}' || text
  WHEN 3 THEN '{_F}sql' || chr(10) || 'select 1' || chr(10) || '{_F}' || text || '{_F}sql' || chr(10) || 'select 2' || chr(10) || '{_F}'
  WHEN 4 THEN 'no query: ' || text WHEN 5 THEN '{_F}' || text || '{_F}' WHEN 6 THEN text || chr(10) || 'select lower from t' || chr(10)
  ELSE 'With x as (select 1) select 2; ' || text END AS r FROM conversations)"""


@query("extract_sql_last", f"""
    WITH {RESPONSES} SELECT conv_id, turn, coalesce(regexp_extract_all(r, '(?s)\\bWITH\\b .*?;')[-1], regexp_extract_all(r, '(?s)SELECT.*?;')[-1],
      regexp_extract_all(r, '(?s){_F}sql\\n(.*){_F}', 1)[-1], regexp_extract_all(r, '(?s){_F}(.*){_F}', 1)[-1], r) AS sql FROM responses""")
def extract_last(spark, sf_dir):
    return inputs.responses(spark, sf_dir).select("conv_id", "turn", extract_sql(F.col("response")).alias("sql"))


@query("extract_sql_first", f"""
    WITH {RESPONSES}, c AS (SELECT conv_id, turn, replace(replace(r, '\\_', '_'), '\\', '') AS r FROM responses)
    SELECT conv_id, turn, CASE WHEN regexp_matches(r, '(?s){_F}sql\\n.*?(;|\\[|{_F})') THEN regexp_extract(r, '(?s){_F}sql\\n(.*?)(;|\\[|{_F})', 1)
      WHEN regexp_matches(r, '(?is)(select|with.*?as \\().*?(;|\\[|{_F})') THEN regexp_extract(r, '(?is)((select|with.*?as \\().*?)(;|\\[|{_F})', 1)
      ELSE r END AS sql FROM c""")
def extract_first(spark, sf_dir):
    return inputs.responses(spark, sf_dir).select("conv_id", "turn", extract_sql(F.col("response"), "first").alias("sql"))


@query("extract_sql_simple", f"""
    WITH {RESPONSES} SELECT conv_id, turn, replace(regexp_extract(regexp_replace(r, '\\n$', ''), '(?is)select.*?(;|{_F}|$)'), '{_F}', '') AS sql FROM responses""")
def extract_simple(spark, sf_dir):
    return inputs.responses(spark, sf_dir).select("conv_id", "turn", extract_sql(F.col("response"), "simple").alias("sql"))


@query("unescape", f"""
    WITH {RESPONSES} SELECT conv_id, turn, replace(r, '\\_', '_') AS underscores, replace(replace(r, '\\_', '_'), '\\', '') AS plain FROM responses""")
def unescape_query(spark, sf_dir):
    r = F.col("response")
    return inputs.responses(spark, sf_dir).select("conv_id", "turn", unescape(r, False).alias("underscores"), unescape(r).alias("plain"))


@query("is_select", "SELECT conv_id, turn, turn IN (0, 2, 4, 6) AS is_valid FROM conversations")
def is_select_query(spark, sf_dir):
    """Known answers: statements made so that those of even turns read data and the others do not."""
    return inputs.statements(spark, sf_dir).select("conv_id", "turn", is_select(F.col("sql")).alias("is_valid"))


@query("extract_code", f"""
    WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Here: {_F}Python' || chr(10) || ' x = ''' || text || '''' || chr(10) || 'fig.show()' || chr(10) || '{_F} more {_F}y{_F}'
      WHEN 1 THEN '{_F}' || text || '{_F}' WHEN 2 THEN '  ' || text || ' fig.show() ' ELSE 'see {_F}plotly python' || chr(10) || text || '{_F}' END AS r,
      text FROM conversations)
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'x = ''' || text || '''' || chr(10) WHEN 2 THEN regexp_replace(text, '^\\s+', '') || ' '
      ELSE regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') END AS code FROM r""")
def extract_code_query(spark, sf_dir):
    body = F.col("text")
    form = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit(f"Here: {_F}Python\n x = '"), body, F.lit(f"'\nfig.show()\n{_F} more {_F}y{_F}")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit(_F), body, F.lit(_F)))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("  "), body, F.lit(" fig.show() ")))
        .otherwise(F.concat(F.lit(f"see {_F}plotly python\n"), body, F.lit(_F)))
    )
    return inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", extract_code(form).alias("code"))


@query("strip_semicolon", """
    SELECT conv_id, turn, regexp_replace(regexp_replace(text || CASE turn % 3 WHEN 0 THEN ';' || chr(10) WHEN 1 THEN ';;  ' ELSE ' ' END, '\\s+$', ''), ';$', '') AS sql
    FROM conversations""")
def strip_query(spark, sf_dir):
    ending = F.when(F.col("turn") % 3 == 0, ";\n").when(F.col("turn") % 3 == 1, ";;  ").otherwise(" ")
    return inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", strip_semicolon(F.concat("text", ending)).alias("sql"))


_SHOWN = "'Question: ' || question || chr(10) || 'SQL: ' || sql || chr(10) || 'Result:' || chr(10) || '| n |'"


def _shown_runs(spark, sf_dir):
    return inputs.pairs(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), "question", "sql", F.lit("| n |").alias("preview"),
        F.lit("n int").alias("schema"),
    )


def numbering_model():
    """A stand-in model: numbered lines about the length of what it was told."""
    def call(messages):
        size = len(messages[0]["content"])
        return "\n".join(f"{i}. Why {size + i}?" for i in range(1, 8))

    return call


@query("followup_questions", f"""
    WITH {PAIRS}, t AS (SELECT conv_id || '-' || turn AS question_id, length({_SHOWN}) AS n FROM pairs)
    SELECT question_id, CAST(i AS INT) AS position, 'Why ' || (n + i + 1) || '?' AS followup FROM t, range(0, 5) r(i)""")
def followup_questions(spark, sf_dir):
    return m.followup_questions(_shown_runs(spark, sf_dir), numbering_model)


@query("summaries", f"""
    WITH {PAIRS} SELECT conv_id || '-' || turn AS question_id,
      '2 messages, ' || (length({_SHOWN}) + length({text(ctx.TEMPLATES['summary'])})) || ' characters' AS summary, CAST(NULL AS VARCHAR) AS error FROM pairs""")
def summaries(spark, sf_dir):
    return m.summarize(_shown_runs(spark, sf_dir), counting_model)


@query("summaries_of_results", f"""
    WITH r AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2),
    shown AS (SELECT p, '| s | n |' || chr(10) || '|:--|:--|' || chr(10) || string_agg('| ' || s || ' | ' || n || ' |', chr(10) ORDER BY s) AS preview FROM r GROUP BY p),
    told AS (SELECT p, length('Question: How many of ' || p || '?' || chr(10) || 'SQL: SELECT o_orderstatus AS s, count(*) AS n FROM askwell_orders WHERE o_orderpriority = ' || chr(39) || p
      || chr(39) || ' GROUP BY o_orderstatus ORDER BY s' || chr(10) || 'Result:' || chr(10) || preview) AS n FROM shown)
    SELECT p AS question_id, '2 messages, ' || (n + length({text(ctx.TEMPLATES['summary'])})) || ' characters' AS summary, CAST(NULL AS VARCHAR) AS error FROM told""")
def summaries_of_results(spark, sf_dir):
    """Summaries of what statements gave, all rows of it: a statement for each order priority."""
    inputs.views(spark, sf_dir, "orders")
    sql = F.concat(F.lit("SELECT o_orderstatus AS s, count(*) AS n FROM askwell_orders WHERE o_orderpriority = '"), "p", F.lit("' GROUP BY o_orderstatus ORDER BY s"))
    asked = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p")).distinct().select(
        F.col("p").alias("question_id"), F.concat(F.lit("How many of "), "p", F.lit("?")).alias("question"), sql.alias("sql"))
    seen = previews(spark, asked.select("sql")).select("sql", "preview")
    return m.summarize(asked.join(seen, "sql"), counting_model)


def plotting_model():
    """A stand-in model: fenced code naming the length of what it was told."""
    return lambda messages: f"Sure:\n```python\nfig = {len(messages[0]['content'])}\nfig.show()\n```"


@query("chart_code", f"""
    WITH {PAIRS} SELECT conv_id || '-' || turn AS question_id, 'fig = ' || length('Question: ' || question || chr(10) || 'SQL: ' || sql || chr(10)
      || 'Columns of df:' || chr(10) || 'n int') || chr(10) AS code, CAST(NULL AS VARCHAR) AS error FROM pairs""")
def chart_code(spark, sf_dir):
    return m.chart_code(_shown_runs(spark, sf_dir), plotting_model)


@query("rewrite_questions", f"""
    WITH u AS (SELECT conv_id, turn, text AS question, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, question, CASE WHEN last IS NULL THEN question ELSE '2 messages, ' || (length({text(ctx.TEMPLATES['rewrite'])})
      + length('Asked before: ' || last || chr(10) || 'Asked now: ' || question)) || ' characters' END AS rewritten, CAST(NULL AS VARCHAR) AS error FROM u""")
def rewrite_questions(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return m.rewrite_questions(turns, counting_model)


def correcting_model():
    """A stand-in model: selects the column it was told is missing."""
    return lambda messages: f"```sql\nselect '{messages[0]['content'].split('column: ')[-1]}'\n```"


@query("fix_sql", f"""
    WITH {PAIRS} SELECT conv_id || '-' || turn AS question_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS attempts,
      'select ''c' || conv_id || '''' || chr(10) AS sql, true AS is_valid FROM pairs WHERE turn = 0""")
def fix_sql(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("question_id", F.concat_ws("-", "conv_id", "turn"))
    return m.fix_sql(runs, correcting_model).select("question_id", "attempts", "sql", "is_valid")

"""Prompts: packing retrieved context under a token budget, message lists, checks before the call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import approx_tokens
from askwell.operators.ranking import previous

MAX_TOKENS = 14000  # fixed value
# Section headers of a packed prompt (fixed values)
HEADERS = {
    "ddl": "\n===Tables \n",
    "documentation": "\n===Additional Context \n\n",
    "pairs": "\n===Question-SQL Pairs\n\n",
}
LARGE_MODEL_TOKENS = 3500  # fixed value

MESSAGE = "struct<role:string,content:string>"

# Own wording of the prompts
TEMPLATES = {
    "intro": "You write {dialect} queries that answer questions about a database. Read the context below first.\n",
    "rules": (
        "\n===Rules\n"
        "Reply with one {dialect} SELECT statement and nothing else when the context is enough.\n"
        "When a value in a column must be looked up first, reply with a query marked -- intermediate_sql.\n"
        "Say what is missing when the context is not enough. Use only the tables given.\n"
        "Refuse anything that changes data.\n\n"
    ),
    "ddl_only": "Answer the question with SQL over the tables given here and no others.\nQuestion: {question}\nTables:\n{ddl}\nSQL:\n",
    "followup": "Write follow-up questions a user could ask next about this data, one per line, with nothing else.",
    "summary": "Sum up the data for the question in a few sentences, with nothing else.",
    "chart": "Write Python plotting code for the result, held in a data frame named df, with nothing else.",
    "question": "You get a SQL statement. Reply with the business question it answers, naming no table.",
    "rewrite": "Make one question of the two if they belong together, else repeat the second. Reply with the question only.",
    "columns": "Name the columns needed to answer the question, one per line, with nothing else.\nQuestion: ",
    "fix": "The statement below failed. Reply with a corrected one.",
}


def pack(prompt: Column, items: Column, header: str, max_tokens: int = MAX_TOKENS, cost=None, text=None) -> Column:
    """``items`` appended to ``prompt`` in order, under ``header``, while the budget holds.

    An item too long for what is left is skipped and later ones may still fit. ``cost`` and ``text`` say
    what of an item is weighed and what is added; both default to the item.
    """
    weighed = cost or (lambda x: x)
    added = text or (lambda x: x)
    start = F.concat(prompt, F.lit(header))
    packed = F.aggregate(
        items, start,
        lambda p, x: F.when(
            approx_tokens(p) + approx_tokens(weighed(x)) < F.lit(float(max_tokens)), F.concat(p, added(x), F.lit("\n\n"))
        ).otherwise(p),
    )
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, packed).otherwise(prompt)


def pack_ddl(prompt: Column, ddl: Column, max_tokens: int = MAX_TOKENS) -> Column:
    return pack(prompt, ddl, HEADERS["ddl"], max_tokens)


def pack_documentation(prompt: Column, documentation: Column, max_tokens: int = MAX_TOKENS) -> Column:
    return pack(prompt, documentation, HEADERS["documentation"], max_tokens)


def pack_pairs(prompt: Column, pairs: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Only the SQL of a pair is weighed; question and SQL are added."""
    return pack(
        prompt, pairs, HEADERS["pairs"], max_tokens,
        cost=lambda x: x["content"], text=lambda x: F.concat(x["question"], F.lit("\n"), x["content"]),
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _with_language(text: Column, language: Column | None) -> Column:
    if language is None:
        return text
    suffix = F.when(language.isNotNull(), F.concat(F.lit("\nWrite the answer in "), language, F.lit("."))).otherwise("")
    return F.concat(text, suffix)


def build_prompts(
    context: DataFrame, mode: str = "full", *, dialect: str = "SQL", max_tokens: int = MAX_TOKENS,
    static_documentation: str = "", language: str | None = None,
) -> DataFrame:
    """Retrieved context (question_id, question, pairs, ddl, documentation) to prompts: question_id, messages.

    ``full`` packs tables and documentation, adds rules, gives the pairs as earlier turns and asks last.
    ``ddl_only`` gives the tables whole. ``followup`` packs all three kinds and asks for further questions.
    """
    ddl = F.transform("ddl", lambda x: x["content"])
    docs = F.transform("documentation", lambda x: x["content"])
    if mode == "ddl_only":
        before, after = TEMPLATES["ddl_only"].split("{question}")
        middle, end = after.split("{ddl}")
        text = F.concat(F.lit(before), F.col("question"), F.lit(middle), F.array_join(ddl, ""), F.lit(end))
        return context.select("question_id", F.array(message("user", text)).alias("messages"))
    if mode == "followup":
        text = F.concat(F.lit("The user asked: '"), F.col("question"), F.lit("'\n\n"))
        text = pack_pairs(pack_documentation(pack_ddl(text, ddl, max_tokens), docs, max_tokens), F.col("pairs"), max_tokens)
        ask = _with_language(F.lit(TEMPLATES["followup"]), None if language is None else F.lit(language))
        return context.select("question_id", F.array(message("system", text), message("user", ask)).alias("messages"))
    if mode != "full":
        raise ValueError(f"unknown prompt mode {mode!r}; full, ddl_only or followup")
    if static_documentation:
        docs = F.concat(docs, F.array(F.lit(static_documentation)))
    head = pack_ddl(F.lit(TEMPLATES["intro"].format(dialect=dialect)), ddl, max_tokens)
    head = pack_documentation(head, docs, max_tokens)
    ask = F.concat(head, F.lit(TEMPLATES["rules"].format(dialect=dialect)), F.col("question"))
    examples = F.flatten(F.transform(
        F.filter("pairs", lambda p: p["question"].isNotNull() & p["content"].isNotNull()),
        lambda p: F.array(message("user", p["question"]), message("assistant", p["content"])),
    ))
    last = message("user", _with_language(ask, None if language is None else F.lit(language)))
    return context.select("question_id", F.concat(examples, F.array(last)).alias("messages"))


def task_prompt(df: DataFrame, task: str, content: Column, language: str | None = None) -> DataFrame:
    """Two-message prompts for ``summary``, ``followup``, ``chart``, ``question`` and ``fix``."""
    if task == "question":
        messages = F.array(message("system", F.lit(TEMPLATES[task])), message("user", content))
    else:
        ask = _with_language(F.lit(TEMPLATES[task]), None if language is None else F.lit(language))
        messages = F.array(message("system", content), message("user", ask))
    return df.withColumn("messages", messages)


def rewrite_inputs(turns: DataFrame) -> DataFrame:
    """User turns (conv_id, turn, question) with the question before; the first one needs no model call."""
    joined = previous(turns, "conv_id", "turn", "question", "last_question")
    combined = F.concat(
        F.lit("Asked before: "), F.col("last_question"), F.lit("\nAsked now: "), F.col("question")
    )
    return joined.select(
        "conv_id", "turn", "question", "last_question", F.col("last_question").isNotNull().alias("needs_model"),
        F.coalesce(combined, F.col("question")).alias("text"),
    )


def fix_inputs(runs: DataFrame) -> DataFrame:
    """Failed runs (question, sql, error, attempts) as prompts for a correction."""
    text = F.concat(
        F.lit("Question: "), F.col("question"), F.lit("\nSQL: "), F.col("sql"), F.lit("\nError: "), F.col("error")
    )
    failed = runs.filter(F.col("error").isNotNull())
    return task_prompt(failed.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1), "fix", text)


def prompt_routing(prompts: DataFrame, small: str, large: str, limit: float = LARGE_MODEL_TOKENS) -> DataFrame:
    """Tokens of every prompt, the model it goes to, and an error for an empty one."""
    tokens = F.aggregate("messages", F.lit(0.0), lambda acc, m: acc + approx_tokens(m["content"]))
    empty = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    return prompts.withColumns({
        "tokens": F.when(empty, 0.0).otherwise(tokens),
        "model": F.when(empty, None).when(tokens > limit, large).otherwise(small),
        "error": F.when(empty, "empty prompt"),
    })


def split_system(prompts: DataFrame) -> DataFrame:
    """The last system text apart from the other messages."""
    system = F.filter("messages", lambda m: m["role"] == "system")
    return prompts.withColumns({
        "system": F.try_element_at(system, F.lit(-1))["content"],
        "messages": F.filter("messages", lambda m: m["role"] != "system"),
    })

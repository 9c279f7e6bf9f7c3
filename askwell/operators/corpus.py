"""The corpus: adding, merging, listing, changing and removing training data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.ids import content_id, kind_from_id
from askwell.functions.text import pair_json, pair_text
from askwell.operators.ranking import latest
from askwell.schemas import KINDS, PAIR

DEFAULT_TAG = "Manually Trained"
LISTING = ("id", "question", "content", "training_data_type")


def _rows(df: DataFrame, kind: str, question, content, embed_text, id_text, tag) -> DataFrame:
    created = F.col("created_at").cast("timestamp") if "created_at" in df.columns else F.current_timestamp()
    return df.select(
        content_id(id_text, kind).alias("id"),
        F.lit(kind).alias("training_data_type"),
        question.cast("string").alias("question"),
        content.alias("content"),
        embed_text.alias("embed_text"),
        tag.cast("string").alias("tag"),
        created.alias("created_at"),
    )


def add_pairs(df: DataFrame, question: str = "question", sql: str = "sql", form: str = "json") -> DataFrame:
    """Corpus rows from question/SQL pairs. The id comes from the JSON text of the pair, so running twice
    gives the same rows; ``form`` picks the text to embed."""
    q, s = F.col(question), F.col(sql)
    tag = F.coalesce(F.col("tag"), F.lit(DEFAULT_TAG)) if "tag" in df.columns else F.lit(DEFAULT_TAG)
    return _rows(df, "sql", q, s, pair_text(q, s, form), pair_json(q, s), tag)


def add_ddl(df: DataFrame, ddl: str = "ddl") -> DataFrame:
    text = F.col(ddl)
    return _rows(df, "ddl", F.lit(None), text, text, text, F.lit(None))


def add_documentation(df: DataFrame, documentation: str = "documentation") -> DataFrame:
    text = F.col(documentation)
    return _rows(df, "documentation", F.lit(None), text, text, text, F.lit(None))


def split_empty(df: DataFrame, column: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows with a value in ``column``, and the rejects."""
    empty = F.coalesce(F.length(F.col(column)), F.lit(0)) == 0
    return df.filter(~empty), df.filter(empty)


def merge(corpus: DataFrame, new: DataFrame, policy: str = "skip") -> DataFrame:
    """``new`` into ``corpus`` by id. ``skip`` keeps what is there, ``upsert`` lets new rows win, the
    newest of them if an id comes more than once."""
    if policy == "skip":
        return corpus.unionByName(not_yet(corpus, one_per_id(new)))
    if policy == "upsert":
        newest = latest(new, ["id"], F.col("created_at")).select(*corpus.columns)
        return remove(corpus, newest).unionByName(newest)
    raise ValueError(f"unknown merge policy {policy!r}; skip or upsert")


def one_per_id(rows: DataFrame) -> DataFrame:
    """The oldest row of every id; repeats combine on the map side. A row without a time counts as the newest; of
    rows of one time a hash decides, so the same rows always give the same one."""
    order = F.struct(F.col("created_at").isNull(), F.col("created_at"), F.xxhash64(*rows.columns))
    best = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return best.select(*[F.col(c) if c == "id" else F.col("r")[c].alias(c) for c in rows.columns])  # still dealt out by id


def not_yet(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, one per id, whose id ``corpus`` lacks.

    First the ids found on both sides are picked out of the corpus (only its id column is read, and the
    usually small new side is what gets sent around); the anti join then meets just those.
    """
    known = corpus.select("id").join(new.select("id"), "id", "left_semi")
    return new.join(known, "id", "left_anti")


def training_data(corpus: DataFrame) -> DataFrame:
    """Listing of all training data."""
    return corpus.filter(F.col("training_data_type").isin(*KINDS)).select(*LISTING)


def listing(pairs: DataFrame, ddl: DataFrame, documentation: DataFrame) -> DataFrame:
    """Listing made of the three collections."""
    return (
        add_pairs(pairs).select(*LISTING)
        .unionByName(add_ddl(ddl).select(*LISTING))
        .unionByName(add_documentation(documentation).select(*LISTING))
    )


def with_kind(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Kind told from the id; rows with an unknown suffix are skipped."""
    return df.withColumn("training_data_type", kind_from_id(F.col(id_col))).filter("training_data_type is not null")


def parse_pairs(df: DataFrame, column: str = "content") -> tuple[DataFrame, DataFrame]:
    """Stored pair JSON to question and sql, and the rows that do not parse."""
    parsed = df.withColumn("_pair", F.from_json(column, PAIR, {"mode": "PERMISSIVE"}))
    good = F.col("_pair.question").isNotNull() & F.col("_pair.sql").isNotNull()
    return parsed.filter(good).select(*df.columns, "_pair.*"), parsed.filter(~good).select(*df.columns)


def remove(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """The corpus without the given ids; vectors of the other rows stay as they are."""
    return corpus.join(ids.select("id").distinct(), "id", "left_anti")


def removal_report(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """For every id to remove: whether a row had it."""
    wanted = ids.select("id").distinct()
    found = corpus.select("id").join(wanted, "id", "left_semi").distinct().withColumn("_hit", F.lit(True))
    return wanted.join(found, "id", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("existed"))


def remove_kind(corpus: DataFrame, kind: str) -> DataFrame:
    """The corpus with one collection emptied."""
    if kind not in KINDS:
        raise ValueError(f"unknown collection {kind!r}; one of {KINDS}")
    return corpus.filter(F.col("training_data_type") != kind)


def update(corpus: DataFrame, changes: DataFrame) -> DataFrame:
    """Field by field, the changed value where one is given. ``needs_embedding`` marks rows whose text to
    embed changed; only those have to go through the model again.

    ``embed_text`` follows a changed question or content by the row's kind, unless the change brings its own. Several
    changes of one id are put together: of each field the greatest value given counts.
    """
    fields = [c for c in changes.columns if c != "id" and c in corpus.columns]
    new = changes.groupBy("id").agg(*[F.max(c).alias(f"_new_{c}") for c in fields])
    joined = corpus.join(new, "id", "left")
    text_fields = [c for c in ("question", "content", "embed_text") if c in fields]
    changed = F.lit(False)
    for c in text_fields:
        changed = changed | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    now = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in fields else F.col(c) for c in corpus.columns}
    if {"embed_text", "question", "content", "training_data_type"} <= set(now) and {"question", "content"} & set(fields):
        pair = F.col("training_data_type") == "sql"
        text = F.when(pair, pair_text(now["question"], now["content"], "json")).otherwise(now["content"])
        own = F.col("_new_embed_text") if "embed_text" in fields else F.lit(None).cast("string")
        now["embed_text"] = F.coalesce(own, F.when(changed, text).otherwise(F.col("embed_text")))
    return joined.select(*(column.alias(c) for c, column in now.items()), changed.alias("needs_embedding"))


def route_training(rows: DataFrame) -> DataFrame:
    """What a training request (question, sql, ddl, documentation) adds: route, content and error.

    A question without sql is an error; else documentation goes before sql, sql before ddl.
    """
    has = {c: F.col(c).isNotNull() & (F.col(c) != "") for c in ("question", "sql", "ddl", "documentation")}
    route = (
        F.when(has["question"] & ~has["sql"], "reject")
        .when(has["documentation"], "documentation").when(has["sql"], "sql").when(has["ddl"], "ddl")
        .otherwise("plan")
    )
    return rows.withColumns({
        "route": route,
        "content": F.when(route == "documentation", F.col("documentation")).when(route == "sql", F.col("sql"))
        .when(route == "ddl", F.col("ddl")),
        "error": F.when(route == "reject", "a question needs its sql"),
        "needs_question": (route == "sql") & ~has["question"],
    })


PLAN_KIND = {"ddl": "ddl", "is": "documentation", "sql": "sql"}  # item type -> kind


def apply_plan(plan: DataFrame) -> DataFrame:
    """Plan items as corpus rows: ddl as ddl, information schema as documentation, sql as a pair."""
    kind, item_id = F.lit(None).cast("string"), F.lit(None).cast("string")
    name, value, is_pair = F.col("item_name"), F.col("item_value"), F.col("item_type") == "sql"
    text = F.when(is_pair, pair_json(name, value)).otherwise(value)
    for item_type, kind_name in PLAN_KIND.items():
        kind = F.when(F.col("item_type") == item_type, kind_name).otherwise(kind)
        item_id = F.when(F.col("item_type") == item_type, content_id(F.col("embed_text"), kind_name)).otherwise(item_id)
    return plan.withColumn("embed_text", text).select(
        item_id.alias("id"), kind.alias("training_data_type"), F.when(is_pair, name).alias("question"),
        value.alias("content"), "embed_text", F.when(is_pair, DEFAULT_TAG).alias("tag"), F.current_timestamp().alias("created_at"),
    ).filter("training_data_type is not null")


# Wording of plan summaries (fixed values)
SUMMARY = {"sql": "Train on SQL: ", "ddl": "Train on DDL: ", "is": "Train on Information Schema: "}


def plan_summary(plan: DataFrame) -> DataFrame:
    """Plan with one line per item saying what it trains on."""
    lead = F.lit(None).cast("string")
    for kind, text in SUMMARY.items():
        lead = F.when(F.col("item_type") == kind, text).otherwise(lead)
    return plan.withColumn("summary", F.concat(lead, F.col("item_group"), F.lit(" "), F.col("item_name")))


def remove_plan_item(plan: DataFrame, summary: str) -> DataFrame:
    """The plan without the first item (by value) that has this summary."""
    lines = plan_summary(plan)
    match = F.col("summary") == summary
    first = lines.filter(match).agg(
        F.min(F.struct("item_value", "item_type", "item_group", "item_name")).alias("f"), F.count(F.lit(1)).alias("n")
    )
    row = first.first()
    if not row["n"]:
        return plan
    same = match
    for field in ("item_value", "item_type", "item_group", "item_name"):
        same = same & F.col(field).eqNullSafe(F.lit(row["f"][field]))
    kept = lines.filter(~F.coalesce(same, F.lit(False))).select(*plan.columns)
    # exact repeats of that item stay, but one
    repeats = (
        lines.filter(same).groupBy(*plan.columns).agg(F.count(F.lit(1)).alias("n"))
        .select(*plan.columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).filter("i > 1")
        .select(*plan.columns)
    )
    return kept.unionByName(repeats)


def question_sample(corpus: DataFrame, seed: str = "0", n: int = 5) -> DataFrame:
    """``n`` questions drawn by a seeded hash, so a rerun draws the same."""
    draw = F.md5(F.concat(F.col("id"), F.lit(seed)))
    return corpus.filter("question is not null").orderBy(draw, "id").limit(n).select("id", "question")


def embeddings(corpus: DataFrame) -> DataFrame:
    """All vectors of all kinds."""
    return corpus.filter("embedding is not null").select("id", "training_data_type", "embedding")


def dim_check(df: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has ``dim`` entries, and the rejects."""
    good = F.coalesce(F.size(column) == dim, F.lit(False))
    return df.filter(good), df.filter(~good)

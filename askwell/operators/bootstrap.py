"""A first corpus out of metadata: information schema, query history, column descriptions, the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.functions.sqltext import contains_any
from askwell.functions.text import strip_brackets
from askwell.operators.ranking import joined_text, top_k

HISTORY_SAMPLE = 10  # fixed value


def schema_columns(columns: list[str]) -> dict:
    """Which columns of an information schema say what, by parts of their names."""
    def matching(*parts: str) -> list[str]:
        return [c for c in columns if any(p in c.lower() for p in parts)]

    try:
        found = {
            "database": matching("database", "table_catalog")[0],
            "schema": matching("table_schema")[0],
            "table": matching("table_name")[0],
        }
    except IndexError:
        raise ValueError(f"no database, schema or table name among {columns}") from None
    found["details"] = matching("column_name", "data_type", "comment")
    return found


def markdown_line(columns: list[Column]) -> Column:
    """One markdown table row; null cells are empty."""
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_header(names: list[str]) -> str:
    return "| " + " | ".join(names) + " |\n|" + "|".join([":--"] * len(names)) + "|\n"


def table_docs(info_schema: DataFrame, ordinal: str = "ORDINAL_POSITION") -> DataFrame:
    """One plan item per table that lists its columns as markdown. One grouping of the whole schema."""
    parts = schema_columns(info_schema.columns)
    names = [parts["database"], parts["schema"], parts["table"], *parts["details"]]
    keys = names[:3]
    lines = info_schema.select(
        *keys, F.col(ordinal).alias("_ordinal"), markdown_line([F.col(c) for c in names]).alias("_line")
    )
    texts = joined_text(lines, keys, "_ordinal", "_line", "\n", "_rows")
    lead = F.concat(
        F.lit("The following columns are in the "), F.col(parts["table"]), F.lit(" table in the "),
        F.col(parts["database"]), F.lit(" database:\n\n" + markdown_header(names)),
    )
    return texts.select(
        F.lit("is").alias("item_type"),
        F.concat_ws(".", parts["database"], parts["schema"]).alias("item_group"),
        F.col(parts["table"]).alias("item_name"),
        F.concat(lead, F.col("_rows")).alias("item_value"),
    )


def filtered_schema(
    info_schema: DataFrame, databases: list[str] | None = None, schemas: list[str] | None = None,
    include_information_schema: bool = False,
) -> DataFrame:
    """Information schema rows of the wanted databases and schemas."""
    parts = schema_columns(info_schema.columns)
    if databases is not None:
        info_schema = info_schema.filter(F.col(parts["database"]).isin(databases))
    if schemas is not None:
        info_schema = info_schema.filter(F.col(parts["schema"]).isin(schemas))
    if not include_information_schema:
        info_schema = info_schema.filter(F.col(parts["schema"]) != "INFORMATION_SCHEMA")
    return info_schema


def mine_history(
    history: DataFrame, databases: list[str] | None = None, schemas: list[str] | None = None,
    sample: int | None = None, seed: str = "0",
) -> DataFrame:
    """Queries worth training on: more than one row produced, naming a wanted database and schema.

    With ``sample`` they are cut to a seeded draw of so many; without, all count. The same text counts once.
    """
    kept = history.filter(F.col("ROWS_PRODUCED") > 1)
    for needles in (databases, schemas):
        if needles is not None:
            kept = kept.filter(contains_any(F.col("QUERY_TEXT"), needles))
    draw = F.md5(F.concat(F.col("QUERY_ID").cast("string"), F.lit(seed)))
    if sample is not None:
        kept = kept.orderBy(draw, "QUERY_ID").limit(sample)
    return kept.select("QUERY_TEXT").distinct()


def fingerprint(sql: Column) -> Column:
    """A statement's template: texts and numbers become ``?``, lists of them one, case and blanks do not count."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"'(?:[^']|'')*'", "?"), r"\b[0-9]+(?:\.[0-9]+)?\b", "?")
    listed = F.regexp_replace(bare, r"\(\s*\?(?:\s*,\s*\?)*\s*\)", "(?)")
    return F.trim(F.regexp_replace(F.lower(listed), r"\s+", " "))


def statement_templates(
    history: DataFrame, databases: list[str] | None = None, schemas: list[str] | None = None, per_template: int = 1, seed: str = "0",
) -> DataFrame:
    """Every template of the queries worth training on: ``template``, how many queries it has (``queries``), and ``per_template`` of
    them, a seeded draw (QUERY_ID, QUERY_TEXT).

    The draw is the smallest hashes of the ids, which map tasks pick before the shuffle, so a template that most queries have brings
    few rows to its task.
    """
    kept = history.filter(F.col("ROWS_PRODUCED") > 1)
    for needles in (databases, schemas):
        if needles is not None:
            kept = kept.filter(contains_any(F.col("QUERY_TEXT"), needles))
    kept = kept.select("QUERY_ID", "QUERY_TEXT", fingerprint(F.col("QUERY_TEXT")).alias("template"))
    draw = F.md5(F.concat(F.col("QUERY_ID").cast("string"), F.lit(seed)))
    counts = kept.groupBy("template").agg(F.count(F.lit(1)).alias("queries"))
    return top_k(kept, ["template"], [draw, F.col("QUERY_ID")], per_template).drop("rank").join(counts, "template")


def history_plan(queries: DataFrame, question: Column | None = None) -> DataFrame:
    """Mined queries as plan items; their questions come from a model (see :mod:`askwell.operators.model`)."""
    return queries.select(
        F.lit("sql").alias("item_type"), F.lit("").alias("item_group"),
        (F.lit(None).cast("string") if question is None else question).alias("item_name"),
        F.col("QUERY_TEXT").alias("item_value"),
    )


def training_plan(
    info_schema: DataFrame, history: DataFrame | None = None, databases: list[str] | None = None,
    schemas: list[str] | None = None, include_information_schema: bool = False, sample: int | None = None,
) -> DataFrame:
    """Plan from query history, all of it or a draw of ``sample`` queries, and information schema."""
    plan = table_docs(filtered_schema(info_schema, databases, schemas, include_information_schema))
    if history is None:
        return plan
    return history_plan(mine_history(history, databases, schemas, sample)).unionByName(plan)


def _column_text() -> Column:
    def labelled(label: str, column: str) -> Column:
        return F.when(F.col(column) != "nan", F.concat(F.lit(label), F.col(column))).otherwise("")  # null: as missing

    return F.concat(
        F.col("column_name"), F.lit(" "), strip_brackets(F.col("data_type")), F.lit(" COMMENT '"),
        labelled("Description:", "description"), F.lit(","), labelled("Usage:", "usage"), F.lit("'"),
    )


def described(descriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descriptions that name a table, a column and its type, and the rejects."""
    good = F.col("table_name").isNotNull() & F.col("column_name").isNotNull() & F.col("data_type").isNotNull()
    return descriptions.filter(good), descriptions.filter(~good)


def alter_ddl(descriptions: DataFrame) -> DataFrame:
    """One ALTER TABLE statement per described column; see :func:`described` for what is left out."""
    descriptions, _ = described(descriptions)
    text = F.concat(F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" ADD COLUMN "), _column_text(), F.lit(";"))
    return descriptions.select("table_name", "column_name", text.alias("ddl"))


def create_ddl(descriptions: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One CREATE TABLE statement per described table, columns in order (by name where there is no ``ordinal``).

    A table with a column that lacks its name or type gets no statement, since the column would be missing in it;
    :func:`described` gives those rows.
    """
    good, rejects = described(descriptions)
    if ordinal not in descriptions.columns:
        good = good.withColumn(ordinal, F.lit(0))
    lines = good.join(rejects.select("table_name").distinct(), "table_name", "left_anti").withColumn("_line", _column_text())
    tables = joined_text(lines, ["table_name"], ordinal, "_line", ",\n  ", "_columns")
    text = F.concat(F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" (\n  "), F.col("_columns"), F.lit("\n);"))
    return tables.select("table_name", text.alias("ddl"))


def catalog_ddl(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """CREATE TABLE text of each given table, from its schema."""
    rows = [
        (name, f"CREATE TABLE {name} (\n  " + ",\n  ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + "\n);")
        for name, df in tables.items()
    ]
    return spark.createDataFrame(rows, "table_name string, ddl string")


def info_schema(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Information schema rows of the catalog's tables and views."""
    catalog, rows = spark.catalog.currentCatalog(), []
    for found in spark.catalog.listTables(database):
        schema = found.namespace[-1] if found.namespace else ""
        name = f"`{schema}`.`{found.name}`" if schema and not found.isTemporary else f"`{found.name}`"
        for i, field in enumerate(spark.table(name).schema):
            comment = field.metadata.get("comment")
            rows.append((catalog, schema, found.name, field.name, field.dataType.simpleString(), comment, i + 1))
    return spark.createDataFrame(
        rows, "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, "
              "COMMENT string, ORDINAL_POSITION int"
    )


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame], catalog: str = "spark", schema: str = "default") -> DataFrame:
    """Information schema rows of the given tables, with the tables' row counts and the columns' nulls.

    One aggregate per table; only its few numbers are spread over the columns.
    """
    out = None
    for name, df in tables.items():
        nulls = [F.count_if(F.col(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(df.schema)]
        columns = F.array(*[
            F.struct(
                F.lit(f.name).alias("COLUMN_NAME"), F.lit(f.dataType.simpleString()).alias("DATA_TYPE"),
                F.lit(i + 1).alias("ORDINAL_POSITION"), F.col(f"n{i}").alias("NULL_COUNT"),
            )
            for i, f in enumerate(df.schema)
        ])
        part = (
            df.agg(F.count(F.lit(1)).alias("ROW_COUNT"), *nulls)
            .select("ROW_COUNT", F.explode(columns).alias("c"))
            .select(F.lit(catalog).alias("TABLE_CATALOG"), F.lit(schema).alias("TABLE_SCHEMA"),
                    F.lit(name).alias("TABLE_NAME"), "c.*", "ROW_COUNT")
        )
        out = part if out is None else out.unionByName(part)
    return out

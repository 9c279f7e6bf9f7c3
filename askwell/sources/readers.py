"""Reading tables from databases and the JSON inputs."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.schemas import COLUMN_DESCRIPTION, QA


class NotConfigured(Exception):
    """A setting needed to reach a source is missing."""


@dataclass(frozen=True)
class Source:
    """How a kind of database is read: JDBC url pattern and driver, or a data source format."""

    needs: tuple[str, ...]
    url: str = ""
    driver: str = ""
    format: str = "jdbc"
    env: tuple[tuple[str, str], ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()
    drop_semicolon: bool = False


# What each database needs (fixed values: option names, drivers, environment variables)
SOURCES = {
    "snowflake": Source(("account", "user", "password", "database"), format="snowflake", env=(
        ("account", "SNOWFLAKE_ACCOUNT"), ("user", "SNOWFLAKE_USERNAME"), ("password", "SNOWFLAKE_PASSWORD"),
        ("database", "SNOWFLAKE_DATABASE"))),
    "sqlite": Source(("path",), "jdbc:sqlite:{path}", "org.sqlite.JDBC"),
    "postgres": Source(("host", "database", "user", "password", "port"), "jdbc:postgresql://{host}:{port}/{database}",
                       "org.postgresql.Driver", env=(("host", "HOST"), ("database", "DATABASE"), ("user", "PG_USER"),
                                                     ("password", "PASSWORD"), ("port", "PORT"))),
    "mysql": Source(("host", "database", "user", "password", "port"), "jdbc:mysql://{host}:{port}/{database}",
                    "com.mysql.cj.jdbc.Driver", env=(("host", "HOST"), ("database", "DATABASE"), ("user", "USER"),
                                                     ("password", "PASSWORD"), ("port", "PORT"))),
    "clickhouse": Source(("host", "database", "user", "password", "port"), "jdbc:clickhouse://{host}:{port}/{database}",
                         "com.clickhouse.jdbc.ClickHouseDriver", env=(("host", "HOST"), ("database", "DATABASE"),
                                                                      ("user", "USER"), ("password", "PASSWORD"),
                                                                      ("port", "PORT"))),
    "oracle": Source(("dsn", "user", "password"), "jdbc:oracle:thin:@{dsn}", "oracle.jdbc.OracleDriver",
                     env=(("dsn", "DSN"), ("user", "USER"), ("password", "PASSWORD")), drop_semicolon=True),
    "bigquery": Source(("project",), format="bigquery", env=(("project", "PROJECT_ID"),
                                                            ("credentials", "GOOGLE_APPLICATION_CREDENTIALS"))),
    "duckdb": Source(("path",), "jdbc:duckdb:{path}", "org.duckdb.DuckDBDriver"),
    "mssql": Source(("host", "database", "port"), "jdbc:sqlserver://{host}:{port};databaseName={database}",
                    "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "presto": Source(("host", "catalog", "schema", "user", "port"), "jdbc:presto://{host}:{port}/{catalog}/{schema}",
                     "com.facebook.presto.jdbc.PrestoDriver", env=(("host", "PRESTO_HOST"), ("catalog", "PRESTO_CATALOG"),
                                                                   ("schema", "PRESTO_SCHEMA"), ("user", "PRESTO_USER"),
                                                                   ("password", "PRESTO_PASSWORD"), ("port", "PRESTO_PORT")),
                     defaults=(("catalog", "hive"), ("schema", "default")), drop_semicolon=True),
    "hive": Source((), format="catalog"),
}

#: options that split a JDBC read over tasks, passed on as they are
PARTITIONED = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def clean_query(query: str, drop_semicolon: bool) -> str:
    text = query.rstrip()
    return text[:-1] if drop_semicolon and text.endswith(";") else text


def source_options(kind: str, settings: dict, query: str) -> tuple[str, dict]:
    """Format and options that read ``query``; a setting not given is taken from its environment variable.
    A JDBC ``url`` may be given whole."""
    if kind not in SOURCES:
        raise NotConfigured(f"unknown source {kind!r}; one of {sorted(SOURCES)}")
    source = SOURCES[kind]
    values = dict(source.defaults)
    values.update({name: os.environ[var] for name, var in source.env if os.environ.get(var)})
    values.update({k: v for k, v in settings.items() if v is not None})
    missing = [] if values.get("url") else [name for name in source.needs if not values.get(name)]
    if missing:
        raise NotConfigured(f"{kind}: please set {', '.join(missing)}")
    text = clean_query(query, source.drop_semicolon)
    if source.format == "snowflake":
        options = {
            "sfURL": f"{values['account']}.snowflakecomputing.com", "sfUser": values["user"],
            "sfPassword": values["password"], "sfDatabase": values["database"], "query": text,
        }
        for name, option in (("role", "sfRole"), ("warehouse", "sfWarehouse"), ("schema", "sfSchema")):
            if values.get(name):
                options[option] = values[name]
        return source.format, options
    if source.format == "bigquery":
        options = {"parentProject": values["project"], "query": text, "viewsEnabled": "true"}
        if values.get("credentials"):
            options["credentialsFile"] = values["credentials"]
        return source.format, options
    if source.format == "catalog":
        return source.format, {"query": text}
    options = {"url": values.get("url") or source.url.format(**values), "driver": source.driver}
    for name in ("user", "password"):
        if values.get(name):
            options[name] = values[name]
    if values.get("init_sql"):
        options["sessionInitStatement"] = values["init_sql"]
    if any(values.get(p) for p in PARTITIONED):
        # Spark splits only tables and sub-selects, not its ``query`` option
        options["dbtable"] = f"({text}) q"
        options.update({p: str(values[p]) for p in PARTITIONED if values.get(p)})
    else:
        options["query"] = text
    return source.format, options


def read_source(spark: SparkSession, kind: str, settings: dict, query: str) -> DataFrame:
    """The result of ``query`` on another database. Its driver or connector must be on the class path."""
    fmt, options = source_options(kind, settings, query)
    if fmt == "catalog":
        return spark.sql(options["query"])
    return spark.read.format(fmt).options(**options).load()


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a statement on Spark's own catalog and views."""
    return spark.sql(clean_query(sql, True))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question/answer corpora: JSON arrays of objects."""
    return spark.read.schema(QA).option("multiLine", True).json(path)


def read_column_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Column-description uploads: JSON arrays of objects, with each one's place in its file as ``ordinal``."""
    files = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", T.ArrayType(COLUMN_DESCRIPTION))
    return files.select(F.posexplode(rows).alias("ordinal", "row")).select("row.*", "ordinal")


def databases(spark: SparkSession) -> DataFrame:
    """The databases of the current catalog."""
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("database"))


def read_history(history: DataFrame, n: int | None = None) -> DataFrame:
    """The queries of a history, oldest first; with ``n`` the newest so many."""
    newest = history if n is None else history.orderBy(F.desc("START_TIME"), F.desc("QUERY_ID")).limit(n)
    return newest.orderBy("START_TIME", "QUERY_ID")

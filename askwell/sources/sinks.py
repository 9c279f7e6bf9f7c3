"""Writing results and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """The whole result as CSV with a header, one file per task; white space in values is kept."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', **kept).mode("errorifexists").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON records."""
    df.write.option("ignoreNullFields", False).mode("errorifexists").json(path)

"""Table layouts shared by the whole package."""

from pyspark.sql import types as T

KINDS = ("sql", "ddl", "documentation")

#: id suffix -> training_data_type (fixed values: stored ids end in one of these)
SUFFIX_KIND = {"sql": "sql", "ddl": "ddl", "doc": "documentation"}
KIND_SUFFIX = {kind: suffix for suffix, kind in SUFFIX_KIND.items()}

CORPUS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("training_data_type", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("embed_text", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

#: The corpus with the vectors of its texts to embed, as the learning loop stores it
CORPUS_VECTORS = T.StructType([*CORPUS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

PLAN = T.StructType([
    T.StructField("item_type", T.StringType()),
    T.StructField("item_group", T.StringType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("item_value", T.StringType()),
])

QA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])

COLUMN_DESCRIPTION = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("usage", T.StringType()),
])

PAIR = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("sql", T.StringType()),
])

RUN_RESULT = T.StructType([
    T.StructField("sql", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("result_path", T.StringType()),
    T.StructField("preview", T.StringType()),
])

# Outcome categories of an asked question (fixed values)
NO_SQL_GENERATED = "No SQL Generated"
SQL_UNABLE_TO_RUN = "SQL Unable to Run"
BOOTSTRAP_TRAINING_QUERY = "Bootstrap Training Query"
SQL_RAN = "SQL Ran Successfully"
FLAGGED_FOR_REVIEW = "Flagged for Review"
REVIEWED_AND_APPROVED = "Reviewed and Approved"
REVIEWED_AND_REJECTED = "Reviewed and Rejected"
REVIEWED_AND_UPDATED = "Reviewed and Updated"
OUTCOMES = (
    NO_SQL_GENERATED, SQL_UNABLE_TO_RUN, BOOTSTRAP_TRAINING_QUERY, SQL_RAN,
    FLAGGED_FOR_REVIEW, REVIEWED_AND_APPROVED, REVIEWED_AND_REJECTED, REVIEWED_AND_UPDATED,
)

"""Pieces of SQL, for DuckDB, that several checks use."""

from askwell.schemas import KIND_SUFFIX


def sql_id(text: str, kind: str) -> str:
    """Content id of a text expression."""
    digest = f"sha1(unhex(repeat('00', 16)) || encode(sha256({text})))"
    variant = f"printf('%02x', ((('0x' || substr({digest}, 17, 2))::INT & 63) | 128))"
    return (
        f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || {variant}"
        f" || substr({digest}, 19, 2) || '-' || substr({digest}, 21, 12) || '-{KIND_SUFFIX[kind]}')"
    )


def sql_pair(question: str, sql: str) -> str:
    """Stored JSON text of a pair."""
    return (
        f"('{{\"question\": ' || CAST(to_json({question}) AS VARCHAR) || ', \"sql\": ' || CAST(to_json({sql}) AS VARCHAR) || '}}')"
    )


PAIRS = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS sql FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""

COLUMNS = """
coldesc AS (SELECT 't_' || (p_partkey // 40) AS table_name, replace(p_name, ' ', '_') || '_' || p_partkey AS column_name,
  '[' || lower(p_type) || ']' AS data_type, CASE WHEN p_size > 10 THEN p_name ELSE 'nan' END AS description,
  CASE WHEN p_size < 40 THEN p_brand ELSE 'nan' END AS usage, p_partkey AS ordinal FROM part),
collines AS (SELECT *, column_name || ' ' || trim(data_type, '[]') || ' COMMENT '''
  || CASE WHEN description <> 'nan' THEN 'Description:' || description ELSE '' END || ','
  || CASE WHEN usage <> 'nan' THEN 'Usage:' || usage ELSE '' END || '''' AS line FROM coldesc),
creates AS (SELECT table_name, 'CREATE TABLE ' || table_name || ' (' || chr(10) || '  '
  || string_agg(line, ',' || chr(10) || '  ' ORDER BY ordinal) || chr(10) || ');' AS ddl FROM collines GROUP BY table_name)"""

INFO_SCHEMA = """
info AS (SELECT lower(p_type) AS cat,
  CASE WHEN p_brand = 'Brand#1' THEN 'INFORMATION_SCHEMA' ELSE replace(p_brand, '#', '_') END AS sch,
  't_' || (p_partkey // 40) AS tab, replace(p_name, ' ', '_') || '_' || p_partkey AS col,
  CASE WHEN p_size % 2 = 0 THEN 'NUMBER' ELSE 'TEXT' END AS typ,
  CASE WHEN p_size > 10 THEN p_name ELSE '' END AS com, p_partkey AS ord FROM part)"""

DOC_HEADER = (
    "'| TABLE_CATALOG | TABLE_SCHEMA | TABLE_NAME | COLUMN_NAME | DATA_TYPE | COMMENT |' || chr(10)"
    " || '|:--|:--|:--|:--|:--|:--|' || chr(10)"
)


def table_docs(where: str = "true") -> str:
    """Common table ``docs``: plan items of the information schema rows that fulfil ``where``."""
    return f"""
docs AS (SELECT 'is' AS item_type, cat || '.' || sch AS item_group, tab AS item_name,
  'The following columns are in the ' || tab || ' table in the ' || cat || ' database:' || chr(10) || chr(10) || {DOC_HEADER}
  || string_agg('| ' || cat || ' | ' || sch || ' | ' || tab || ' | ' || col || ' | ' || typ || ' | ' || com || ' |',
                chr(10) ORDER BY ord) AS item_value
  FROM info WHERE {where} GROUP BY cat, sch, tab)"""


HISTORY = """
history AS (SELECT 'SELECT * FROM Sales_' || (user_id % 3) || '.Schema_' || event_type || '.t WHERE user_id = ' || user_id AS query_text,
  CAST(floor(value) AS BIGINT) AS rows_produced, ts AS start_time, event_id AS query_id FROM events)"""

KIND = "CASE label % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'ddl' ELSE 'documentation' END"

VECTORS = f"""
vectors AS (SELECT CAST(vec_id AS VARCHAR) AS id, {KIND} AS kind, embedding::DOUBLE[] AS v, label FROM embeddings),
topics AS (SELECT question_id, 'Is label ' || question_id || ' of a document known, and what is in the text?' AS question, list(m ORDER BY pos) AS v FROM (
  SELECT CAST(label AS VARCHAR) AS question_id, pos, avg(v[pos]) AS m FROM vectors, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY 1),
corpus AS (SELECT vectors.*, text AS content,
  CASE WHEN kind = 'sql' THEN 'Which ' || lang || ' text from ' || source || '?' END AS question
  FROM vectors JOIN documents ON CAST(doc_id AS VARCHAR) = id)"""


def knn(distance: str, k: str = "10", partition: str = "question_id", where: str = "true", rows: str = "vectors",
        asked: str = "topics", name: str = "hits") -> str:
    """Common table ``name``: nearest rows per question."""
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY distance, id) AS rank FROM (
  SELECT q.question_id, c.kind AS training_data_type, c.id, round({distance}, 6) + 0.0 AS distance
  FROM {asked} q, {rows} c WHERE {where})) WHERE rank <= {k})"""


L2 = "list_distance(q.v, c.v)"
L2SQ = "pow(list_distance(q.v, c.v), 2)"
COSINE = "1 - list_cosine_similarity(q.v, c.v)"
DOT = "-list_inner_product(q.v, c.v)"
HITS = "question_id, training_data_type, id, distance, CAST(rank AS INT) AS rank"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def overlap(question: str, content: str) -> str:
    a, b = f"list_distinct({words(question)})", f"list_distinct({words(content)})"
    return f"round(coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct({a} || {b})), 0), 0), 6)"

"""The workflow's tables as views of the given test tables.

One SQL text per table serves both engines: ``render`` fills in the dialect.
Nothing is sampled or cut; every row of the given tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom.functions.vectors import hashed_embedding

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

LINE_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)

VIEWS = {
    # knowledge base of long texts: documents, with labels as life-cycle marks
    "kb_docs": """
        SELECT d.doc_id AS id, d.source AS category, d.text AS question,
               concat(d.lang, ' answer ', CAST(d.n_chars AS {string})) AS answer,
               {ts}d.doc_id{/ts} AS created_at,
               CASE WHEN l.quality = 1 THEN {ts}d.doc_id + d.n_chars * 60{/ts} END AS updated_at,
               CASE WHEN l.toxic = 1 THEN {ts}d.doc_id + 86400{/ts} END AS deleted_at
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # knowledge base of single lines
    "kb_lines": """
        SELECT x.doc_id * 4294967296 + x.line_idx AS id, x.lang AS category, x.line AS question, concat('Known from ', x.source) AS answer,
               {ts}x.doc_id{/ts} AS created_at, CASE WHEN l.quality = 1 THEN {ts}x.doc_id + x.n_chars{/ts} END AS updated_at,
               CASE WHEN l.toxic = 1 THEN {ts}x.doc_id + 86400{/ts} END AS deleted_at
        FROM ({lines}) x LEFT JOIN {labels} l ON x.doc_id = l.doc_id""",
    # knowledge base of passages
    "kb_items": """
        SELECT item_id AS id, 'passage' AS category, text AS question, concat('Item ', CAST(item_id AS {string})) AS answer,
               {ts}item_id{/ts} AS created_at, {ts}item_id{/ts} AS updated_at, CASE WHEN item_id < 0 THEN {ts}item_id{/ts} END AS deleted_at
        FROM {benchmark}""",
    # reviews of neighbouring entries; ten labels give the mix of states
    "reviews": """
        SELECT vec_id AS id, vec_id AS entry_a_id, vec_id + 1 + label AS entry_b_id, CAST(0.9 AS DOUBLE) AS similarity_score,
               CASE WHEN label IN (0, 3, 5) THEN 'definitely_same' WHEN label IN (1, 6, 9) THEN 'probably_same' WHEN label = 2 THEN 'different' END AS classification,
               label IN (3, 6, 8) AS contradicts, CASE WHEN label < 5 THEN 'close' END AS reason,
               CASE WHEN label IN (0, 5, 6) THEN vec_id WHEN label IN (1, 3) THEN vec_id + 1 + label END AS recommended_keep_id,
               CASE label WHEN 7 THEN 'reviewed' WHEN 8 THEN 'dismissed' ELSE 'pending' END AS status,
               CAST(NULL AS {string}) AS reviewed_action, 'manual_scan' AS source, {ts}vec_id * 7{/ts} AS created_at,
               CASE WHEN label IN (7, 8) THEN {ts}vec_id * 9{/ts} END AS reviewed_at
        FROM {embeddings}""",
    "actions": """
        SELECT vec_id AS seq, vec_id AS review_id,
               CASE WHEN label IN (0, 4) THEN 'keep_left' WHEN label IN (1, 7) THEN 'keep_right' WHEN label IN (2, 9) THEN 'keep_both' ELSE 'merge' END AS action
        FROM {embeddings}""",
    # corrections: documents, changed by their reviewer
    "corrections": """
        SELECT d.doc_id AS id, d.doc_id AS job_id, d.doc_id AS question_result_id, d.lang AS question_text, d.source AS original_answer,
               concat(d.source, ' corrected') AS corrected_answer, CASE WHEN l.quality = 1 THEN d.source END AS original_source,
               coalesce(l.toxic = 1, false) AS auto_added_to_kb, {ts}d.n_chars{/ts} AS created_at
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # templates: one per part type and size, with the parts as answers
    "templates": """
        SELECT p_partkey AS id, concat(p_name, ' template') AS name, p_brand AS description, p_partkey AS source_job_id, p_size AS question_count,
               CAST(0 AS INT) AS times_used, {ts}p_partkey{/ts} AS created_at, {ts}p_size * 3600 + p_partkey{/ts} AS updated_at,
               CASE WHEN p_size = 50 THEN {ts}p_partkey{/ts} END AS deleted_at
        FROM {part}""",
    "template_answers": """
        SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS template_id, concat('Describe ', p_name, ' of ', p_brand) AS question_text,
               concat('  Size ', CAST(p_size AS {string}), ' ') AS answer_text, p_partkey AS question_index
        FROM {part}""",
    # trace events of jobs
    "trace": """
        SELECT user_id AS job_id, event_id AS seq, ts AS timestamp, event_type AS step, 'completed' AS status, props AS message FROM {events}""",
    "presets": """
        SELECT p_partkey AS id, p_name AS name, concat(' Use ', p_brand, ' ') AS instructions, p_size < 5 AS is_builtin, {ts}p_size{/ts} AS created_at FROM {part}""",
    # knowledge base of short texts: parts
    "kb_parts": """
        SELECT p_partkey AS id, p_type AS category, concat('Describe ', p_name, ' of ', p_brand) AS question,
               concat('Size ', CAST(p_size AS {string})) AS answer,
               {ts}p_partkey{/ts} AS created_at,
               CASE WHEN p_size > 25 THEN {ts}p_partkey * 60 + p_size{/ts} END AS updated_at,
               CASE WHEN p_size = 50 THEN {ts}p_partkey + 86400{/ts} END AS deleted_at
        FROM {part}""",
    # question turns of conversations with the reply as answer
    "talk": """
        SELECT u.conv_id AS doc_id, u.turn AS question_index, u.text AS question_text, a.text AS reply
        FROM {conversations} u LEFT JOIN {conversations} a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'""",
    "lines": """{lines}""",
    "flags": """
        SELECT x.doc_id * 4294967296 + x.line_idx AS id, x.doc_id AS job_id, x.line AS extracted_question, x.lang AS context,
               CAST(x.n_chars AS DOUBLE) / 100000 AS similarity_score, x.source AS best_match_question,
               coalesce(l.quality = 1, false) AS resolved,
               CASE WHEN l.quality = 1 AND l.toxic = 1 THEN '[Dismissed]' WHEN l.quality = 1 THEN concat('Answer from ', x.source) END AS resolved_answer,
               CASE WHEN l.quality = 1 THEN {ts}x.doc_id + x.n_chars{/ts} END AS resolved_at,
               {ts}x.doc_id{/ts} AS created_at, CAST(NULL AS {string}) AS assigned_to
        FROM ({lines}) x LEFT JOIN {labels} l ON x.doc_id = l.doc_id""",
    "doc_jobs": """
        SELECT doc_id AS id, concat(source, '_', lang, '.csv') AS original_filename, 'pending' AS review_status FROM {documents}""",
    "order_jobs": """
        SELECT o_orderkey AS id, o_custkey AS batch_id,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
               concat('form ', o_orderpriority, '.csv') AS original_filename,
               CASE WHEN o_orderstatus = 'F' THEN concat('out_', CAST(o_orderkey AS {string}), '.csv') END AS output_filename,
               CASE WHEN o_totalprice < 20000 THEN 0 ELSE CAST(floor(o_totalprice / 10000) AS BIGINT) END AS total_questions,
               CAST(floor(o_totalprice / 20000) AS BIGINT) AS matched_questions,
               CASE WHEN o_totalprice > 300000 THEN 2 ELSE 0 END AS flagged_questions_count,
               o_orderpriority = '1-URGENT' AS fallback_recommended, 'pending' AS review_status, o_orderdate AS uploaded_at
        FROM {orders}""",
    "results": """
        SELECT l_orderkey * 1000 + n AS id, l_orderkey AS job_id, n AS question_index,
               concat('Describe ', p.p_name, ' of ', p.p_brand) AS question_text,
               CASE WHEN l_returnflag <> 'N' THEN concat('Answer ', CAST(l_suppkey AS {string})) END AS answer_text,
               CASE WHEN l_returnflag = 'R' THEN concat('Edit ', CAST(l_partkey AS {string}))
                    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN concat('Answer ', CAST(l_suppkey AS {string})) END AS edited_answer_text,
               CASE WHEN l_returnflag <> 'N' OR l_linestatus = 'F' THEN l_discount * 10 END AS confidence_score,
               CASE l_returnflag WHEN 'A' THEN 'kb_match' WHEN 'R' THEN 'template' ELSE 'unmatched' END AS source,
               CASE WHEN l_returnflag = 'A' THEN l_partkey END AS kb_pair_id, l_linestatus = 'F' AS reviewed
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {line_order}) - 1 AS n FROM {lineitem}) l
        JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "audit": """
        SELECT event_id AS id, ts AS timestamp, event_type AS action_type, 'event' AS entity_type, event_id AS entity_id,
               user_id AS job_id, 'user' AS actor, props AS details FROM {events}""",
    # one row per record of a bulk import; a third of the wordings repeat stored ones
    "records": """
        SELECT o_orderkey + 1 AS row_no, CASE WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE o_orderpriority END AS category,
               CASE o_orderstatus WHEN 'F' THEN concat(' describe ', p_name, ' of ', p_brand)
                    WHEN 'O' THEN concat('Please describe ', p_name, ' of ', p_brand)
                    ELSE concat('Summarise ', p_name, ' for customer ', CAST(o_custkey AS {string})) END AS question,
               concat('Total ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS {string})) AS answer
        FROM {orders} JOIN {part} ON p_partkey = o_custkey""",
    # rows of questionnaires in five layouts: an order is a file, its lines are the questions
    "questions": """
        SELECT l_orderkey AS doc_id, o_orderpriority AS layout, n, p_type AS topic,
               CASE l_returnflag WHEN 'A' THEN concat('Describe the ', p_name, ' of ', p_brand)
                    WHEN 'R' THEN concat(CAST(n + 1 AS {string}), '. Is ', p_name, ' made by ', p_brand, '?') ELSE p_name END AS question,
               CASE l_linestatus WHEN 'F' THEN 'Yes, confirmed' ELSE '' END AS answer
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {line_order}) - 1 AS n FROM {lineitem}) l
        JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey""",
    "cells": """
        SELECT doc_id, layout, CAST(row_idx AS BIGINT) AS row_idx, cells FROM (
          SELECT doc_id, layout, n AS row_idx, {array}(question, answer) AS cells FROM ({questions}) q1 WHERE layout = '1-URGENT'
          UNION ALL SELECT doc_id, layout, n + 2, {array}(question, answer) FROM ({questions}) q2 WHERE layout = '2-HIGH'
          UNION ALL SELECT doc_id, layout, h, CASE h WHEN 0 THEN {array}('Question', 'Response') ELSE {array}('', '') END
            FROM ({questions}) q3, (SELECT 0 AS h UNION ALL SELECT 1) t WHERE layout = '2-HIGH' AND n = 0
          UNION ALL SELECT doc_id, layout, n + 1, {array}(topic, question, answer, '') FROM ({questions}) q4 WHERE layout = '3-MEDIUM'
          UNION ALL SELECT doc_id, layout, 0, {array}('Category', 'Question', 'Response', 'Evidence') FROM ({questions}) q5 WHERE layout = '3-MEDIUM' AND n = 0
          UNION ALL SELECT doc_id, layout, n, {array}(CAST(n + 1 AS {string}), question, answer) FROM ({questions}) q6 WHERE layout = '4-NOT SPECIFIED'
          UNION ALL SELECT doc_id, layout, 2 * n + h, CASE h WHEN 0 THEN {array}(question, question) ELSE {array}('', '') END
            FROM ({questions}) q7, (SELECT 0 AS h UNION ALL SELECT 1) t WHERE layout = '5-LOW') c""",
}

# the same rows as "cells", with one pass over the questions
_SPARK_CELLS = """
    SELECT doc_id, layout, CAST(r.row_idx AS BIGINT) AS row_idx, r.cells AS cells FROM ({questions}) q LATERAL VIEW explode(
      CASE layout
        WHEN '1-URGENT' THEN array(struct(n AS row_idx, array(question, answer) AS cells))
        WHEN '2-HIGH' THEN concat(array(struct(n + 2 AS row_idx, array(question, answer) AS cells)),
          IF(n = 0, array(struct(0 AS row_idx, array('Question', 'Response') AS cells), struct(1 AS row_idx, array('', '') AS cells)), array()))
        WHEN '3-MEDIUM' THEN concat(array(struct(n + 1 AS row_idx, array(topic, question, answer, '') AS cells)),
          IF(n = 0, array(struct(0 AS row_idx, array('Category', 'Question', 'Response', 'Evidence') AS cells)), array()))
        WHEN '4-NOT SPECIFIED' THEN array(struct(n AS row_idx, array(CAST(n + 1 AS STRING), question, answer) AS cells))
        ELSE array(struct(2 * n AS row_idx, array(question, question) AS cells), struct(2 * n + 1 AS row_idx, array('', '') AS cells))
      END) x AS r"""

# the same rows as "questions": lines meet their order where they were numbered, and few columns are shuffled to the parts
_SPARK_QUESTIONS = VIEWS["questions"].replace(
    "FROM (SELECT *, row_number()", "FROM (SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, n, o_orderpriority FROM (SELECT *, row_number()"
).replace(
    "FROM {lineitem}) l\n        JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey",
    "FROM {lineitem}) m JOIN {orders} ON l_orderkey = o_orderkey) l JOIN {part} ON l_partkey = p_partkey",
)

_SPARK = {
    "string": "STRING", "array": "array", "ts": "(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, ", "/ts": "))",
    "cells": _SPARK_CELLS, "questions": _SPARK_QUESTIONS,
    "lines": "SELECT doc_id, lang, source, n_chars, CAST(line_idx AS BIGINT) AS line_idx, line FROM {documents} "
             "LATERAL VIEW posexplode(split(text, '\\n')) x AS line_idx, line",
}
_DUCK = {
    "string": "VARCHAR", "array": "list_value", "ts": "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(", "/ts": "))",
    "lines": "SELECT doc_id, lang, source, n_chars, generate_subscripts(l, 1) - 1 AS line_idx, unnest(l) AS line "
             "FROM (SELECT *, string_split(text, chr(10)) AS l FROM {documents}) s",
}


def _fill(text: str, words: dict[str, str]) -> str:
    for _ in range(4):  # texts may name other texts
        for key, value in words.items():
            text = text.replace("{" + key + "}", value)
    return text


def render(name_or_text: str, folder: str | None = None, instead: dict[str, str] | None = None) -> str:
    """SQL of a stand-in (or of a text that names some): Spark's over the files of
    a folder, DuckDB's over its registered views without one."""
    text = "{" + name_or_text + "}" if name_or_text in VIEWS else name_or_text
    words = {"line_order": LINE_ORDER, **VIEWS, **(_SPARK if folder else _DUCK), **(instead or {})}
    words |= {t: f"parquet.`{folder.rstrip('/')}/{t}.parquet`" if folder else t for t in BASE}
    return _fill(text, words)


TEXT_VIEWS = ["lines", "flags", "kb_docs", "kb_lines", "doc_jobs"]


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, folder: str, name: str, questions: DataFrame | None = None) -> DataFrame:
    """A stand-in; rows of long texts are dealt out anew, as one of them may hold a thousand lines.

    ``questions`` is that stand-in as it was stored, for others made of it.
    """
    if questions is None:
        rows = spark.sql(render(name, folder))
    else:
        rows = spark.sql(render(name, folder, {"questions": "SELECT * FROM {given}"}), given=questions)
    return _spread(rows) if name in TEXT_VIEWS else rows


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return _spread(rows) if name == "documents" else rows


def with_vectors(kb: DataFrame, text: str = "question") -> DataFrame:
    return kb.withColumn("embedding", hashed_embedding(F.col(text)))

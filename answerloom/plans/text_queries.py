"""Scalar functions, sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import responses as R, text as X, vectors as V
from answerloom.operators import flags as FL, jobs as J, knowledge as KB
from answerloom.operators.matching import live
from answerloom.plans import checks as C
from answerloom.plans.extraction_queries import delimited_files
from answerloom.plans.registry import query
from answerloom.plans.standins import raw, table
from answerloom.session import durable, freeing, scratch_folder
from answerloom.sources import backup, grids, records

COUNT = lambda e: f"CAST({e} AS BIGINT)"


# --- text ------------------------------------------------------------------

@query("clean_question", f"SELECT doc_id, line_idx, {C.clean('line')} AS cleaned FROM ({{lines}}) x")
def clean_question(spark, d):
    return table(spark, d, "lines").select("doc_id", "line_idx", X.clean_question(F.col("line")).alias("cleaned"))


@query("question_key", f"SELECT doc_id, line_idx, {C.key('line')} AS question_key FROM ({{lines}}) x")
def question_key(spark, d):
    return table(spark, d, "lines").select("doc_id", "line_idx", X.question_key(F.col("line")).alias("question_key"))


@query("row_text_key", f"SELECT doc_id, line_idx, lower({C.collapse('line')}) AS row_key FROM ({{lines}}) x")
def row_text_key(spark, d):
    return table(spark, d, "lines").select("doc_id", "line_idx", X.row_text_key(F.col("line")).alias("row_key"))


@query("exact_key", f"SELECT row_no, {C.exact_key('question')} AS exact_key FROM ({{records}}) x")
def exact_key(spark, d):
    return table(spark, d, "records").select("row_no", X.exact_key(F.col("question")).alias("exact_key"))


@query(
    "is_question",
    f"""SELECT doc_id, CAST(n AS BIGINT) AS n, {C.is_question('question')} AS asks FROM ({{questions}}) x
        UNION ALL SELECT doc_id, -1 - line_idx, {C.is_question('line')} FROM ({{lines}}) y""",
)
def is_question(spark, d):
    lines = table(spark, d, "lines").select("doc_id", (-1 - F.col("line_idx")).alias("n"), F.col("line").alias("question"))
    asked = table(spark, d, "questions").select("doc_id", F.col("n").cast("long").alias("n"), "question").unionByName(lines)
    return asked.select("doc_id", "n", X.is_question(F.col("question")).alias("asks"))


@query(
    "header_predicates",
    f"""SELECT doc_id, row_idx, len(list_filter(cells, lambda c: {C.any_match('c', X.QUESTION_HEADER)})) > 0 AS question_header,
        len(list_filter(cells, lambda c: {C.any_match('c', X.ANSWER_HEADER)})) > 0 AS answer_header FROM ({{cells}}) x""",
)
def header_predicates(spark, d):
    return table(spark, d, "cells").select(
        "doc_id", "row_idx", F.exists("cells", X.is_question_header).alias("question_header"), F.exists("cells", X.is_answer_header).alias("answer_header")
    )


@query(
    "row_predicates",
    f"""SELECT doc_id, row_idx, len(list_filter(cells, lambda c: length({C.strip('c')}) >= 3)) = 0 AS blank,
        lower({C.collapse('cells[1]')}) <> '' AND len(list_filter(cells, lambda c: {C.strip('c')} <> '')) >= 2
          AND len(list_filter(cells, lambda c: {C.strip('c')} <> '' AND lower({C.collapse('c')}) <> lower({C.collapse('cells[1]')}))) = 0 AS merged
        FROM ({{cells}}) x""",
)
def row_predicates(spark, d):
    return table(spark, d, "cells").select(
        "doc_id", "row_idx", X.is_blank_row(F.col("cells")).alias("blank"), X.is_merged_row(F.col("cells"), F.get("cells", F.lit(0))).alias("merged")
    )


@query("search_match", "SELECT id FROM ({kb_docs}) x WHERE contains(lower(question), 'tion') OR contains(lower(answer), 'en_')")
def search_match(spark, d):
    rows = table(spark, d, "kb_docs")
    return rows.filter(X.search_match("TION", F.col("question")) | X.search_match("en_", F.col("answer"))).select("id")


@query(
    "answer_values",
    f"""SELECT id, coalesce(nullif(answer_text, ''), {C.QUOTE('[REVIEW REQUIRED] No matching answer found in the knowledge base.')}) AS shown,
        coalesce(nullif(edited_answer_text, ''), answer_text) AS final_answer,
        CASE WHEN confidence_score IS NULL THEN 'N/A' WHEN confidence_score >= 0.85 THEN 'high' WHEN confidence_score >= 0.70 THEN 'medium' ELSE 'low' END AS band
        FROM ({{results}}) x""",
)
def answer_values(spark, d):
    return table(spark, d, "results").select(
        "id", X.or_placeholder(F.col("answer_text")).alias("shown"),
        X.final_answer(F.col("edited_answer_text"), F.col("answer_text")).alias("final_answer"),
        X.confidence_band(F.col("confidence_score")).alias("band"),
    )


@query(
    "coerce_confidence",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN greatest(0.0, least(1.0, value / 50)) END AS confidence FROM events""",
)
def coerce_confidence(spark, d):
    given = F.when(F.col("event_type") == "error", F.concat(F.lit("n/a "), "props")).otherwise((F.col("value") / 50).cast("string"))
    return raw(spark, d, "events").select("event_id", X.coerce_confidence(given).alias("confidence"))


@query("estimate_tokens", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return raw(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(
    "extract_json_object",
    "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k FROM events",
)
def extract_json_object(spark, d):
    kind, props = F.col("event_type"), F.col("props")
    content = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == "view", F.concat(F.lit("Here it is: "), props, F.lit(" as asked.")))
        .when(kind == "error", F.concat(F.lit("{broken "), props))
        .when(kind == "signup", F.lit("[1, 2]"))
        .otherwise(props)
    )
    return raw(spark, d, "events").select(
        "event_id", F.get_json_object(R.extract_json_object(content), "$.k").cast("long").alias("k")
    )


@query(
    "content_to_text",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda t: {C.strip('t')}), lambda t: t <> ''), chr(10)) AS content FROM documents""",
)
def content_to_text(spark, d):
    blocks = F.to_json(F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))))
    return raw(spark, d, "documents").select("doc_id", R.content_to_text(blocks).alias("content"))


@query(
    "response_triage",
    """SELECT event_id, event_type IN ('purchase', 'view') OR (event_type = 'error' AND user_id >= 75) AS retriable,
       CASE event_type WHEN 'error' THEN concat('limit ', CAST(user_id AS VARCHAR), CASE WHEN user_id < 75 THEN ' (insufficient_quota)' ELSE ' (rate_limit)' END)
         WHEN 'view' THEN concat('trouble ', CAST(user_id AS VARCHAR)) WHEN 'purchase' THEN 'HTTP 408' WHEN 'signup' THEN concat('page ', CAST(user_id AS VARCHAR)) ELSE props END AS detail
       FROM events""",
)
def response_triage(spark, d):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    status = F.when(kind == "error", 429).when(kind == "view", 503).when(kind == "purchase", 408).when(kind == "signup", 404).otherwise(200)
    code = F.when(F.col("user_id") < 75, "insufficient_quota").otherwise("rate_limit")
    body = (
        F.when(kind == "error", F.concat(F.lit('{"error":{"message":"limit '), user, F.lit('","code":"'), code, F.lit('"}}')))
        .when(kind == "view", F.concat(F.lit('{"error":" trouble '), user, F.lit('"}')))
        .when(kind == "purchase", F.lit(" "))
        .when(kind == "signup", F.concat(F.lit("page "), user))
        .otherwise(F.col("props"))
    )
    return raw(spark, d, "events").select(
        "event_id", R.is_retriable(status, body).alias("retriable"), R.error_detail(status, body).alias("detail")
    )


@query(
    "filename_parts",
    """SELECT doc_id, concat(source, CASE lang WHEN 'de' THEN '.tar' ELSE '' END) AS stem,
       CASE lang WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.gz' WHEN 'es' THEN '' ELSE '.csv' END AS suffix, lang NOT IN ('de', 'es') AS allowed FROM documents""",
)
def filename_parts(spark, d):
    ending = F.when(F.col("lang") == "fr", ".PDF").when(F.col("lang") == "de", ".tar.GZ").when(F.col("lang") == "es", "").otherwise(".csv")
    name = F.concat("source", ending)
    return raw(spark, d, "documents").select(
        "doc_id", X.file_stem(name).alias("stem"), X.file_suffix(name).alias("suffix"), X.is_allowed_file(name).alias("allowed")
    )


SME = {"ECONOMY": "ada@example.com", "PROMO": "bo@example.com"}


@query("route_sme", "SELECT id, CASE category WHEN 'ECONOMY' THEN 'ada@example.com' WHEN 'PROMO' THEN 'bo@example.com' END AS assignee FROM ({kb_parts}) x")
def route_sme(spark, d):
    return table(spark, d, "kb_parts").select("id", X.route_sme(F.concat(F.lit(" "), "category"), SME).alias("assignee"))


@query("clean_optional", f"SELECT doc_id, line_idx, nullif({C.strip('line')}, '') AS value FROM ({{lines}}) x")
def clean_optional(spark, d):
    return table(spark, d, "lines").select("doc_id", "line_idx", X.clean_optional(F.col("line")).alias("value"))


# --- vectors ---------------------------------------------------------------

@query(
    "dot",
    """SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def dot(spark, d):
    rows = raw(spark, d, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    "l2_normalize",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS total FROM embeddings""",
)
def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x * 3)
    total = F.aggregate(V.l2_normalize(scaled), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return raw(spark, d, "embeddings").select("vec_id", F.round(total, 4).alias("total"))


@query(
    "vector_codec",
    "SELECT vec_id, CAST(len(embedding) * 4 AS BIGINT) AS n_bytes, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm FROM embeddings",
)
def vector_codec(spark, d):
    packed = raw(spark, d, "embeddings").select("vec_id", "embedding", V.encode_vector("embedding").alias("bytes"))
    return packed.select(
        "vec_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.round(V.dot(V.decode_vector("bytes"), F.col("embedding")), 6).alias("norm")
    )


@query("embed", f"WITH {C.vectors('v', 'SELECT doc_id AS id, text AS question FROM documents')} SELECT id, CAST(b AS BIGINT) AS bucket, round(w, 6) AS weight FROM v")
def embed(spark, d):
    docs = raw(spark, d, "documents").select(F.col("doc_id").alias("id"), V.hashed_embedding("text").alias("v"))
    return docs.select("id", F.posexplode("v").alias("bucket", "w")).filter("w <> 0").select(
        "id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 6).alias("weight")
    )


# --- sources and sinks -----------------------------------------------------

@query("live_kb", "SELECT id, category FROM ({kb_docs}) x WHERE deleted_at IS NULL")
def live_kb(spark, d):
    return live(table(spark, d, "kb_docs")).select("id", "category")


@query(
    "read_qa_csv",
    "SELECT category, question, answer, CAST(count(*) AS BIGINT) AS n FROM (SELECT category, question, answer FROM ({records}) r UNION ALL SELECT source, text, lang FROM documents) x GROUP BY ALL",
)
def read_qa_csv(spark, d):
    """Round trip through files with quotes and line breaks in the cells."""
    path = scratch_folder(spark)
    docs = raw(spark, d, "documents").select(F.col("source").alias("category"), F.col("text").alias("question"), F.col("lang").alias("answer"))
    rows = table(spark, d, "records").select("category", "question", "answer").unionByName(docs)
    with freeing(spark):
        rows.select(F.col("category").alias(" Category"), F.col("question").alias("QUESTION"), F.col("answer").alias("Answer ")).write.csv(
            path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    return records.read_qa_csv(spark, path).groupBy("category", "question", "answer").agg(F.count(F.lit(1)).alias("n"))


# Import files: rows dealt to 200 files in five shapes (by number modulo 5): plain; other header order, names with
# blanks and a mark; no category but surplus cells; short rows with line breaks; bytes that are no UTF-8.
FILED = "filed AS (SELECT *, row_no % 200 AS file, row_no % 5 AS shape, row_number() OVER (PARTITION BY row_no % 200 ORDER BY row_no) AS n FROM ({records}) r)"


def _import_files(spark, d):
    """(source_file, content): CSV files of the records."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    shape = F.col("row_no") % 5
    broken = F.concat(F.lit('"first\n""'), F.replace(F.col("question"), F.lit('"'), F.lit('""')), F.lit('"""'))
    line = (
        F.when(shape == 1, F.concat_ws(",", quoted("answer"), quoted("question"), quoted("category")))
        .when(shape == 2, F.concat_ws(",", quoted("question"), quoted("answer"), F.lit('extra,"more"')))
        .when(shape == 3, F.concat_ws(",", quoted("category"), broken))
        .otherwise(F.concat_ws(",", quoted("category"), quoted("question"), quoted("answer")))
    )
    rows = table(spark, d, "records").select((F.col("row_no") % 200).alias("file"), shape.alias("shape"), "row_no", line.alias("line"))
    files = rows.groupBy("file", "shape").agg(F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("l"))
    head = F.when(F.col("shape") == 1, "﻿ Answer ,QUESTION,category").when(F.col("shape") == 2, "question,answer").otherwise("category,question,answer")
    text = F.encode(F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")), "UTF-8")
    return files.select(F.format_string("f%03d", "file").alias("source_file"), F.when(F.col("shape") == 4, F.concat(text, F.unhex(F.lit("FF")))).otherwise(text).alias("content"))


@query(
    "import_files",
    f"""WITH {FILED} SELECT printf('f%03d', file) AS source_file, n AS row_no, CASE WHEN shape = 2 THEN NULL ELSE category END AS category,
       CASE WHEN shape = 3 THEN concat('first', chr(10), '"', question, '"') ELSE question END AS question, CASE WHEN shape = 3 THEN NULL ELSE answer END AS answer, false AS failed FROM filed WHERE shape <> 4
    UNION ALL SELECT DISTINCT printf('f%03d', file), 1, NULL, NULL, NULL, true FROM filed WHERE shape = 4""",
)
def import_files(spark, d):
    read = records.parse_qa_csv(_import_files(spark, d))
    return read.select("source_file", "row_no", "category", "question", "answer", F.col("error").isNotNull().alias("failed"))


@query(
    "import_file_order",
    f"""WITH {FILED} SELECT printf('f%03d', file) AS source_file, n AS file_row, row_number() OVER (ORDER BY file, n) AS row_no FROM filed WHERE shape <> 4""",
)
def import_file_order(spark, d):
    read = records.parse_qa_csv(_import_files(spark, d)).filter("error IS NULL")
    return records.numbered(read).select("source_file", "file_row", "row_no")


def _record_files(spark, d):
    """JSON files of one customer's records each, with one element that is no object."""
    part = table(spark, d, "records").withColumn("file", F.col("question"))
    element = F.to_json(F.struct(F.col("row_no"), F.col("category").alias(" Category"), F.col("question").alias("QUESTION"), "answer"))
    files = part.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(F.struct("row_no", element.alias("e"))))["e"], ", ").alias("body"))
    return files.select(F.col("file").alias("source_file"), F.concat(F.lit("[7, "), "body", F.lit("]")).alias("content"))


@query(
    "parse_records",
    """SELECT question AS source_file, row_number() OVER (PARTITION BY question ORDER BY row_no) AS row_no, category, question, answer FROM ({records}) x""",
)
def parse_records(spark, d):
    return records.parse_records(_record_files(spark, d))[0]


@query("parse_record_errors", "SELECT DISTINCT question AS source_file, 'Row 1: invalid record format (expected object)' AS error FROM ({records}) x")
def parse_record_errors(spark, d):
    return records.parse_records(_record_files(spark, d))[1]


@query(
    "validate_records",
    f"SELECT row_no, {C.strip('category')} AS category, {C.strip('question')} AS question, {C.strip('answer')} AS answer FROM ({{records}}) x WHERE {C.strip('category')} <> ''",
)
def validate_records(spark, d):
    return KB.validate_records(table(spark, d, "records"))[0]


@query(
    "invalid_records",
    f"SELECT row_no, concat('Row ', CAST(row_no AS VARCHAR), ': missing category, question, or answer') AS error FROM ({{records}}) x WHERE {C.strip('category')} = ''",
)
def invalid_records(spark, d):
    return KB.validate_records(table(spark, d, "records"))[1]


@query("export_kb", "SELECT coalesce(category, '') AS category, question, answer FROM ({kb_docs}) x WHERE deleted_at IS NULL")
def export_kb(spark, d):
    return KB.export_kb(table(spark, d, "kb_docs"))


@query(
    "export_flags",
    f"""WITH keyed AS (SELECT f.*, {C.key('extracted_question')} AS k FROM ({{flags}}) f WHERE resolved),
    newest AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, id DESC) AS rn FROM keyed)
    SELECT '' AS category, {C.clean('extracted_question')} AS question, CASE WHEN resolved_answer <> '[Dismissed]' THEN resolved_answer ELSE '' END AS answer FROM newest WHERE rn = 1""",
)
def export_flags(spark, d):
    return FL.export_flags(table(spark, d, "flags"), table(spark, d, "doc_jobs"), resolved=True)


def _backup_set(spark, d):
    return {
        "flagged_questions": table(spark, d, "flags"), "processing_jobs": table(spark, d, "order_jobs"),
        "qa_pairs": raw(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), "questionnaire_templates": table(spark, d, "templates"),
    }


@query(
    "backup_tables",
    """SELECT t AS "table", CAST(n AS BIGINT) AS rows, CASE WHEN n > 0 THEN 'ok' ELSE 'skipped' END AS status FROM (
       SELECT 'flagged_questions' AS t, (SELECT count(*) FROM ({flags}) a) AS n UNION ALL SELECT 'processing_jobs', (SELECT count(*) FROM orders)
       UNION ALL SELECT 'qa_pairs', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'questionnaire_templates', (SELECT count(*) FROM part)
       UNION ALL SELECT unnest(['agent_presets', 'format_fingerprints', 'audit_logs', 'question_results', 'answer_corrections', 'template_answers']), 0) x""",
)
def backup_tables(spark, d):
    return backup.backup_tables(_backup_set(spark, d), scratch_folder(spark))


@query(
    "restore_tables",
    f"""SELECT CAST(id AS VARCHAR) AS id, CAST(job_id AS VARCHAR) AS job_id, nullif(extracted_question, '') AS extracted_question, resolved, resolved_answer,
        {C.stamp('resolved_at')} AS resolved_at, {C.stamp('created_at')} AS created_at FROM ({{flags}}) x""",
)
def restore_tables(spark, d):
    folder = scratch_folder(spark)
    backup.backup_tables({"flagged_questions": table(spark, d, "flags")}, folder)
    flags = backup.restore_tables(spark, folder)[0]["flagged_questions"]
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return flags.select("id", "job_id", "extracted_question", "resolved", "resolved_answer", text("resolved_at"), text("created_at"))


@query("parse_grids")
def parse_grids(spark, d):
    """No SQL twin: what a delimiter sniffer decides is not expressible in SQL."""
    parsed = grids.parse_grids(delimited_files(spark, d))
    return parsed.select("doc_id", "row_idx", F.array_join("cells", "␟").alias("cells"), "delimiter")


def _damaged_files(spark, d):
    """The delimited files as bytes; some are no UTF-8, some are empty."""
    text = F.encode("content", "UTF-8")
    content = F.when(F.col("doc_id") % 7 == 3, F.concat(text, F.unhex(F.lit("C3")))).when(F.col("doc_id") % 11 == 5, F.unhex(F.lit(""))).otherwise(text)
    return delimited_files(spark, d).select("doc_id", content.alias("content"))


@query("grid_errors", "SELECT DISTINCT doc_id, true AS failed FROM ({cells}) c WHERE doc_id % 7 = 3")
def grid_errors(spark, d):
    """Rows and errors come from one stored parse."""
    parsed = durable(grids.parse(_damaged_files(spark, d)))
    readable = grids.cells_of(parsed).select("doc_id").distinct()
    return grids.errors_of(parsed).join(readable, "doc_id", "left_anti").select("doc_id", F.contains("error", F.lit("utf-8")).alias("failed"))


FILL = C.QUOTE("[REVIEW REQUIRED] No matching answer found in the knowledge base.")


@query(
    "fill_grids",
    f"""WITH r AS (SELECT doc_id, layout, n, question, coalesce(nullif(answer, ''), {FILL}) AS answer FROM ({{questions}}) q),
    c AS (SELECT doc_id, layout, row_idx, cells FROM ({{cells}}) x)
    SELECT c.doc_id, c.row_idx, CASE WHEN r.n IS NULL THEN array_to_string(c.cells, ';')
        ELSE array_to_string(list_concat(c.cells[1:3], list_concat(list_transform(range(3 - len(c.cells[1:3])), lambda i: ''), list_concat([r.answer], c.cells[5:]))), ';') END AS line
    FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND c.row_idx = r.n""",
)
def fill_grids(spark, d):
    answers = table(spark, d, "questions").select(
        "doc_id", F.col("n").cast("long").alias("answer_row_idx"), F.lit(3).alias("answer_col_idx"), F.col("answer").alias("answer_text")
    )
    filled = grids.fill_grids(table(spark, d, "cells"), answers)
    return filled.select("doc_id", "row_idx", F.array_join("cells", ";").alias("line"))


@query(
    "delimited_lines",
    """SELECT doc_id, row_idx, array_to_string(list_transform(cells, lambda c: CASE WHEN contains(c, ',') OR contains(c, '"') THEN concat('"', replace(c, '"', '""'), '"') ELSE c END), ',') AS line FROM ({cells}) x""",
)
def delimited_lines(spark, d):
    line = grids.delimited_line(F.col("cells"), F.lit(","), F.lit('"'))
    return table(spark, d, "cells").select("doc_id", "row_idx", line.alias("line"))


@query(
    "answer_listing",
    f"""SELECT job_id AS doc_id, question_index + 1 AS seq, concat(CAST(question_index + 1 AS VARCHAR), '. ', question_text) AS question_line,
        coalesce(answer_text, {FILL}) AS answer_line, answer_text IS NULL AS is_placeholder FROM ({{results}}) x""",
)
def answer_listing(spark, d):
    rows = table(spark, d, "results").withColumnRenamed("job_id", "doc_id").withColumn("question_index", F.col("question_index").cast("long"))
    return grids.answer_listing(rows)


@query("text_lines", f"SELECT doc_id, line_idx, {C.strip('line')} AS line FROM ({{lines}}) x")
def text_lines(spark, d):
    lines = grids.text_lines(raw(spark, d, "documents"))
    return lines.withColumn("line_idx", F.col("line_idx").cast("long"))


@query(
    "batch_manifest",
    """WITH done AS (SELECT batch_id, id, output_filename, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS idx, replace(original_filename, '.csv', '') AS stem FROM ({order_jobs}) j WHERE status = 'done')
    SELECT batch_id, id, idx AS "index", output_filename, CASE WHEN row_number() OVER (PARTITION BY batch_id, stem ORDER BY id) = 1 THEN concat('filled_', stem, '.csv') ELSE concat('filled_', stem, '_', CAST(idx AS VARCHAR), '.csv') END AS download_name FROM done""",
)
def batch_manifest(spark, d):
    return J.batch_manifest(table(spark, d, "order_jobs"))

"""Extraction over questionnaires made of the given tables.

An order is a questionnaire; its priority decides the layout (see the stand-in
``cells``).  Documents give the text lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerloom import constants as K
from answerloom.functions import text as X
from answerloom.operators import extraction as E, jobs as J, layouts as L, matching as M
from answerloom.operators.ranking import with_positions
from answerloom.plans import checks as C
from answerloom.plans.registry import query
from answerloom.plans.standins import raw, table
from answerloom.session import durable
from answerloom.sources import grids


def stored_cells(spark, d) -> DataFrame:
    """The forms as a stored cell table, which is what extraction reads several times."""
    return durable(table(spark, d, "cells"))


def delimited_files(spark, d) -> DataFrame:
    """(doc_id, content): whole questionnaires as delimited text; the layout decides the delimiter."""
    rows = table(spark, d, "cells")
    mark = F.when(F.col("layout") == "2-HIGH", ";").when(F.col("layout") == "3-MEDIUM", "|").when(F.col("layout") == "4-NOT SPECIFIED", "\t").otherwise(",")
    lines = rows.withColumn("mark", mark).withColumn("line", grids.delimited_line(F.col("cells"), F.col("mark"), F.lit('"')))
    files = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "line"))).alias("l"))
    return files.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def stored_questions(spark, d) -> DataFrame:
    """The questions of the forms, stored: cells and lines follow from them row by row."""
    return durable(table(spark, d, "questions"))


def cells(spark, d, asked: DataFrame | None = None, **options) -> DataFrame:
    rows = stored_cells(spark, d) if asked is None else table(spark, d, "cells", asked)
    return E.with_options(rows, **options)


# --- SQL side --------------------------------------------------------------

def mapping_sql(profile: str = "default", skip_blank: bool = True, source: str = "cells", keys: str = "doc_id", tag: str = "") -> str:
    """CTEs rows, mapping(keys, q_col, a_col, header_rows) with 0-based columns."""
    opt = K.profile_options(profile)
    auto = "true" if opt["auto_detect_columns"] else "false"
    head, q0, a0 = opt["header_rows"], opt["question_column_index"], opt["answer_column_index"]
    filled = f"len(list_filter(cells, lambda c: {C.strip('c')} <> '')) > 0"
    hits = lambda patterns: f"list_filter(range(len(f)), lambda i: {C.any_match('f[i + 1]', patterns)})"
    return f"""rows{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY row_idx) AS nth FROM {source} {'WHERE ' + filled if skip_blank else ''}),
    heads{tag} AS (SELECT {keys}, len(f) AS width, {hits(X.QUESTION_HEADER)} AS qh, {hits(X.ANSWER_HEADER)} AS ah FROM (SELECT {keys}, cells AS f FROM rows{tag} WHERE nth = 1) t),
    asked{tag} AS MATERIALIZED (SELECT {keys}, cells, q FROM (SELECT {keys}, cells, unnest(range(len(cells) - 1)) AS q FROM rows{tag} WHERE nth > {head}) t WHERE {C.is_question('cells[q + 1]')}),
    pairs{tag} AS (SELECT {keys}, cells, q, a FROM (SELECT {keys}, cells, q, unnest(range(q + 1, len(cells))) AS a FROM asked{tag}) t WHERE length(cells[a + 1]) < 3),
    sums{tag} AS (SELECT {keys}, q, a, sum(3 + CASE WHEN a = q + 1 THEN 2 ELSE 0 END + CASE WHEN len(list_filter(cells[1:q], lambda c: length(c) >= 10)) = 0 THEN 1 ELSE 0 END
      - CASE WHEN len(list_filter(cells[q + 2:a], lambda c: c <> '')) > 0 THEN 2 ELSE 0 END) AS score FROM pairs{tag} GROUP BY ALL),
    tops{tag} AS (SELECT {keys}, q, a FROM sums{tag} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, q, a) = 1),
    mapping{tag} AS (SELECT {', '.join('h.' + k.strip() for k in keys.split(','))},
      CAST(CASE WHEN {auto} AND len(qh) > 0 AND len(ah) > 0 THEN qh[1] WHEN {auto} AND width > 2 AND t.q IS NOT NULL THEN t.q ELSE {q0} END AS INTEGER) AS q_col,
      CAST(CASE WHEN {auto} AND len(qh) > 0 AND len(ah) > 0 THEN coalesce(list_filter(ah, lambda i: i > qh[1])[1], ah[1]) WHEN {auto} AND width > 2 AND t.q IS NOT NULL THEN t.a ELSE {a0} END AS INTEGER) AS a_col,
      CAST(CASE WHEN {auto} AND len(qh) > 0 AND len(ah) > 0 THEN greatest({head}, 1) ELSE {head} END AS INTEGER) AS header_rows
      FROM heads{tag} h LEFT JOIN tops{tag} t USING ({keys}))"""


def items_sql(profile: str = "default", skip_blank: bool = True, source: str = "cells", keys: str = "doc_id", tag: str = "") -> str:
    """CTE items(keys, row_idx, cells, q_col, a_col, header_rows, question_text) after mapping_sql."""
    strict = "" if K.profile_options(profile)["allow_additional_columns"] else "AND len(r.cells) <= greatest(q_col, a_col) + 1"
    start = "r.nth > header_rows" if skip_blank else "r.row_idx >= header_rows"
    return f"""items{tag} AS (SELECT r.*, m.q_col, m.a_col, m.header_rows, {C.strip('r.cells[q_col + 1]')} AS question_text FROM rows{tag} r JOIN mapping{tag} m USING ({keys})
      WHERE {start} AND len(r.cells) > greatest(q_col, a_col) {strict} AND {C.is_question('r.cells[q_col + 1]')})"""


BASE = "cells AS MATERIALIZED (SELECT * FROM ({cells}) z)"
TABLES = "cells AS MATERIALIZED (SELECT *, 0 AS table_idx, 0 AS page_idx, layout AS sheet_name FROM ({cells}) z)"


@query("infer_mapping", f"WITH {BASE}, {mapping_sql()} SELECT * FROM mapping")
def infer_mapping(spark, d):
    return E.infer_mapping(cells(spark, d), E.GRID, skip_blank=True, max_header_rows=0)


GRID_COLUMNS = ["doc_id", "question_text", "question_row_idx", "question_col_idx", "answer_col_idx", "column_count", "header_rows", "confidence", "source_block_id"]


@query(
    "extract_grid",
    f"""WITH {BASE}, {mapping_sql()}, {items_sql()} SELECT doc_id, question_text, row_idx AS question_row_idx, q_col AS question_col_idx, a_col AS answer_col_idx,
        CAST(len(cells) AS INTEGER) AS column_count, header_rows, CAST(0.88 AS DOUBLE) AS confidence, concat('csv-row-', CAST(row_idx AS VARCHAR), '-q', CAST(q_col AS VARCHAR), '-a', CAST(a_col AS VARCHAR)) AS source_block_id FROM items""",
)
def extract_grid(spark, d):
    return E.extract_grid(cells(spark, d), max_header_rows=0).select(*GRID_COLUMNS)


@query(
    "extract_grid_strict",
    f"""WITH {BASE}, {mapping_sql('strict_two_column')}, {items_sql('strict_two_column')} SELECT doc_id, question_text, row_idx AS question_row_idx FROM items""",
)
def extract_grid_strict(spark, d):
    return E.extract_grid(cells(spark, d, profile="strict_two_column"), max_header_rows=0).select("doc_id", "question_text", "question_row_idx")


@query(
    "extract_tables",
    f"""WITH {TABLES}, {mapping_sql(skip_blank=False)}, {items_sql(skip_blank=False)},
    below AS (SELECT doc_id, row_idx - 1 AS row_idx, len(cells) AS next_width FROM cells WHERE len(list_filter(cells, lambda c: length({C.strip('c')}) >= 3)) = 0),
    placed AS (SELECT i.*, next_width, next_width IS NOT NULL AND len(list_filter(cells, lambda c: c <> '')) >= 2
      AND len(list_filter(cells, lambda c: c <> '' AND lower({C.collapse('c')}) <> lower({C.collapse('question_text')}))) = 0 AS block FROM items i LEFT JOIN below USING (doc_id, row_idx))
    SELECT doc_id, question_text, row_idx AS question_row_idx, row_idx + CASE WHEN block THEN 1 ELSE 0 END AS answer_row_idx,
      CAST(CASE WHEN block AND next_width <= a_col THEN 0 ELSE a_col END AS INTEGER) AS answer_col_idx,
      CASE WHEN block THEN 'row_block' ELSE 'same_row' END AS layout_hint, CAST(CASE WHEN block THEN 0.85 ELSE 0.9 END AS DOUBLE) AS confidence FROM placed""",
)
def extract_tables(spark, d):
    rows = cells(spark, d).withColumn("table_idx", F.lit(0))
    return E.extract_tables(rows, max_header_rows=0).select(
        "doc_id", "question_text", "question_row_idx", "answer_row_idx", "answer_col_idx", "layout_hint", "confidence"
    )


@query(
    "extract_sheets",
    f"""WITH {TABLES}, {mapping_sql(skip_blank=False)}, {items_sql(skip_blank=False)}
    SELECT doc_id, sheet_name, question_text, row_idx + 1 AS excel_row, a_col AS answer_col_idx FROM items""",
)
def extract_sheets(spark, d):
    rows = cells(spark, d).withColumn("sheet_name", F.col("layout"))
    return E.extract_sheets(rows, max_header_rows=0).select("doc_id", "sheet_name", "question_text", "excel_row", "answer_col_idx")


@query(
    "extract_page_tables",
    f"""WITH {TABLES}, {mapping_sql(skip_blank=False)}, {items_sql(skip_blank=False)}
    SELECT doc_id, question_text, concat('pdf-page-0-table-0-row-', CAST(row_idx AS VARCHAR), '-q', CAST(q_col AS VARCHAR), '-a', CAST(a_col AS VARCHAR)) AS source_block_id FROM items""",
)
def extract_page_tables(spark, d):
    rows = cells(spark, d).withColumns({"table_idx": F.lit(0), "page_idx": F.lit(0)})
    return E.extract_page_tables(rows, max_header_rows=0).select("doc_id", "question_text", "source_block_id")


# Document lines seldom ask; the questions of the order forms join them as lines
# of the "document" of their topic's supplier order.
LINES = """lines AS (SELECT doc_id, CAST(line_idx AS BIGINT) AS line_idx, line FROM ({lines}) a UNION ALL SELECT doc_id, CAST(4294967296 + n AS BIGINT), question FROM ({questions}) b)"""


def _lines(spark, d, asked: DataFrame | None = None) -> DataFrame:
    text = table(spark, d, "lines").select("doc_id", "line_idx", "line")
    asked = (table(spark, d, "questions") if asked is None else asked).select("doc_id", (F.col("n") + 4294967296).cast("long").alias("line_idx"), F.col("question").alias("line"))
    return E.with_options(text.unionByName(asked))


PARAGRAPHS = f"paragraphs AS (SELECT doc_id, line_idx, {C.strip('line')} AS question_text FROM lines WHERE {C.is_question('line')})"


@query(
    "extract_paragraphs",
    f"WITH {LINES}, {PARAGRAPHS} SELECT doc_id, line_idx, question_text, concat('docx-paragraph-', CAST(line_idx AS VARCHAR)) AS source_block_id FROM paragraphs",
)
def extract_paragraphs(spark, d):
    return E.extract_paragraphs(_lines(spark, d)).select("doc_id", "line_idx", "question_text", "source_block_id")


@query(
    "extract_lines",
    f"""WITH {TABLES}, {mapping_sql(skip_blank=False)}, {items_sql(skip_blank=False)}, {LINES}, {PARAGRAPHS},
    fresh AS (SELECT * FROM paragraphs p WHERE line_idx < 4294967296 OR NOT EXISTS (SELECT 1 FROM items i WHERE i.doc_id = p.doc_id AND lower(i.question_text) = lower(p.question_text) AND i.row_idx < 2))
    SELECT doc_id, question_text, line_idx FROM fresh QUALIFY row_number() OVER (PARTITION BY doc_id, lower(question_text) ORDER BY line_idx) = 1""",
)
def extract_lines(spark, d):
    """Lines of page 1 after the tables of pages 0 and 2: table rows count only up to page 1."""
    asked = stored_questions(spark, d)
    rows = cells(spark, d, asked).withColumns({"table_idx": F.lit(0), "page_idx": F.lit(0)})
    tables = E.extract_page_tables(rows, max_header_rows=0).withColumn("page_idx", F.when(F.col("question_row_idx") < 2, 0).otherwise(2))
    lines = _lines(spark, d, asked).withColumn("page_idx", F.when(F.col("line_idx") < 4294967296, -1).otherwise(1))
    return E.extract_lines(lines, tables).select("doc_id", "question_text", "line_idx")


@query(
    "merge_items",
    f"""WITH {TABLES}, {mapping_sql(skip_blank=False)}, {items_sql(skip_blank=False)}, {LINES}, {PARAGRAPHS}
    SELECT doc_id, question_text, 0 AS part, row_idx AS place FROM items
    UNION ALL SELECT doc_id, question_text, 1, line_idx FROM paragraphs p WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.doc_id = p.doc_id AND lower(i.question_text) = lower(p.question_text))""",
)
def merge_items(spark, d):
    asked = stored_questions(spark, d)
    tables = E.extract_tables(cells(spark, d, asked).withColumn("table_idx", F.lit(0)), max_header_rows=0)
    merged = E.merge_items(tables, E.extract_paragraphs(_lines(spark, d, asked)))
    return merged.select("doc_id", "question_text", "part", F.coalesce("question_row_idx", "line_idx").alias("place"))


STATS = f"""WITH {TABLES}, {mapping_sql(skip_blank=False)}, {items_sql(skip_blank=False)}, {LINES}, {PARAGRAPHS},
    kept AS (SELECT doc_id FROM items UNION ALL SELECT doc_id FROM paragraphs p WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.doc_id = p.doc_id AND lower(i.question_text) = lower(p.question_text))),
    tagged AS (SELECT doc_id, 'r' AS k FROM cells UNION ALL SELECT doc_id, 't' FROM items UNION ALL SELECT doc_id, 'l' FROM lines UNION ALL SELECT doc_id, 'p' FROM paragraphs UNION ALL SELECT doc_id, 'm' FROM kept),
    stats AS (SELECT doc_id, count(*) FILTER (k = 'r') AS table_rows_scanned, count(*) FILTER (k = 't') AS table_items, count(*) FILTER (k = 'l') AS text_lines_scanned,
      count(*) FILTER (k = 'p') AS text_items, count(*) FILTER (k = 'm') AS items_total, count(*) FILTER (k IN ('t', 'p')) - count(*) FILTER (k = 'm') AS deduplicated_items FROM tagged GROUP BY doc_id)"""


@query(
    "parse_stats",
    STATS + """ SELECT s.*, CAST(c AS DOUBLE) AS confidence, CASE WHEN items_total = 0 THEN 'no_questions_found' WHEN c < 0.8 THEN 'low_confidence_parse' WHEN table_rows_scanned >= 3 AND table_items = 0 THEN 'table_layout_not_understood' END AS fallback_reason
    FROM (SELECT *, CASE WHEN items_total = 0 THEN 0.0 WHEN table_items > 0 AND text_items > 0 THEN 0.95 WHEN table_items > 0 THEN 0.9 WHEN text_items > 0 THEN 0.75 ELSE 0.5 END AS c FROM stats) s""".replace("s.*,", "doc_id, table_rows_scanned, table_items, text_lines_scanned, text_items, items_total, deduplicated_items,"),
)
def parse_stats(spark, d):
    asked = stored_questions(spark, d)
    rows, lines = cells(spark, d, asked).withColumn("table_idx", F.lit(0)), _lines(spark, d, asked)
    tables, paragraphs = E.extract_tables(rows, max_header_rows=0), E.extract_paragraphs(lines)
    stats = E.parse_stats(["doc_id"], rows, tables, lines, paragraphs, E.merge_items(tables, paragraphs))
    return E.score_parse(stats).drop("fallback_recommended")


@query(
    "score_sheets",
    f"""WITH {TABLES}, {mapping_sql(skip_blank=False)}, {items_sql(skip_blank=False)},
    s AS (SELECT doc_id, count(*) AS n, (SELECT count(*) FROM items i WHERE i.doc_id = c.doc_id) AS k FROM cells c GROUP BY doc_id),
    v AS (SELECT doc_id, k, CAST(CASE WHEN k = 0 THEN 0.0 WHEN k / n > 0.8 THEN 0.95 WHEN k / n > 0.4 THEN 0.85 WHEN k / n > 0.1 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM s)
    SELECT doc_id, k AS items_total, confidence, confidence < 0.4 AND k < 3 AS fallback_recommended FROM v""",
)
def score_sheets(spark, d):
    rows = cells(spark, d).withColumn("sheet_name", F.col("layout"))
    stats = E.parse_stats(["doc_id"], rows=rows, table_items=E.extract_sheets(rows, max_header_rows=0))
    return E.score_sheets(stats).select("doc_id", "items_total", "confidence", "fallback_recommended")


PROFILES = list(K.PROFILE_OVERRIDES)
SWEEP = f"""WITH {BASE}, """ + ", ".join(f"{mapping_sql(p, tag=f'_{i}')}, {items_sql(p, tag=f'_{i}')}" for i, p in enumerate(PROFILES)) + """,
    found AS (""" + " UNION ALL ".join(f"SELECT '{p}' AS profile_name, doc_id, row_idx, question_text FROM items_{i}" for i, p in enumerate(PROFILES)) + """),
    counted AS (SELECT c.doc_id, p.profile_name, count(f.doc_id) AS question_count, coalesce(string_agg(f.question_text, '␟' ORDER BY f.row_idx) FILTER (f.nth <= 6), '') AS sample
      FROM (SELECT DISTINCT doc_id FROM cells) c, (SELECT unnest(""" + str(PROFILES) + """) AS profile_name) p
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, profile_name ORDER BY row_idx) AS nth FROM found) f ON f.doc_id = c.doc_id AND f.profile_name = p.profile_name GROUP BY ALL),
    report AS (SELECT r.*, CAST(CASE WHEN question_count > 0 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence, question_count = 0 AS fallback_recommended FROM counted r)"""


@query("profile_report", SWEEP + " SELECT doc_id, profile_name, question_count, sample, confidence, fallback_recommended FROM report")
def profile_report(spark, d):
    return E.profile_report(table(spark, d, "cells")).select(
        "doc_id", "profile_name", "question_count", F.array_join("sample_questions", "␟").alias("sample"), "confidence", "fallback_recommended"
    )


@query(
    "recommend_profile",
    SWEEP + """, best AS (SELECT * FROM report QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY question_count > 0 DESC, fallback_recommended, question_count DESC, confidence DESC, profile_name = 'default' DESC,
        CASE profile_name WHEN 'default' THEN 0 WHEN 'strict_two_column' THEN 1 WHEN 'three_column_table' THEN 2 ELSE 3 END) = 1),
    named AS (SELECT b.*, (SELECT question_count FROM report r WHERE r.doc_id = b.doc_id AND r.profile_name = 'default') AS base,
        CASE profile_name WHEN 'default' THEN 'Default' WHEN 'strict_two_column' THEN 'Strict Two Column' WHEN 'three_column_table' THEN 'Three Column Table' ELSE 'Row Block' END AS label FROM best b)
    SELECT doc_id, CASE WHEN question_count > 0 THEN profile_name END AS recommended_profile,
      CASE WHEN question_count = 0 THEN 'No parser profile was able to extract questions from this file.'
        WHEN profile_name = 'default' THEN concat(label, ' is the best fit for this document and found ', CAST(question_count AS VARCHAR), ' questions.')
        WHEN base = 0 THEN concat('The default parser found no questions, but ', label, ' found ', CAST(question_count AS VARCHAR), '.')
        ELSE concat(label, ' found ', CAST(question_count AS VARCHAR), ' questions, which is more complete than the default parser''s ', CAST(base AS VARCHAR), '.') END AS reason,
      CASE WHEN question_count = 0 THEN 3 ELSE 1 END AS n_hints FROM named""",
)
def recommend_profile(spark, d):
    return E.recommend_profile(E.profile_report(table(spark, d, "cells"))).select(
        "doc_id", "recommended_profile", "reason", F.size("hints").alias("n_hints")
    )


def _readable(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, errors, all documents): the forms as if some files had been unreadable or empty."""
    every = stored_cells(spark, d)
    number = F.col("doc_id")
    errors = every.filter(number % 7 == 3).groupBy("doc_id").agg(F.lit("not UTF-8").alias("error"))
    return every.filter((number % 7 != 3) & (number % 11 != 5)), errors, every.select("doc_id").distinct()


READ = "(doc_id % 7 <> 3 AND doc_id % 11 <> 5)"


@query(
    "profile_errors",
    SWEEP + f""" SELECT doc_id, profile_name, question_count, confidence, fallback_recommended, NULL AS error_message FROM report WHERE {READ}
      UNION ALL SELECT doc_id, p, 0, 0.0, true, 'not UTF-8' FROM (SELECT DISTINCT doc_id FROM cells WHERE doc_id % 7 = 3) x, (SELECT unnest({PROFILES}) AS p) y""",
)
def profile_errors(spark, d):
    rows, errors, _ = _readable(spark, d)
    return E.profile_report(rows, errors=errors).select("doc_id", "profile_name", "question_count", "confidence", "fallback_recommended", "error_message")


@query(
    "recommend_unreadable",
    f"""WITH {BASE} SELECT DISTINCT doc_id, 'Every parser profile failed while reading this document.' AS reason, 2 AS n_hints FROM cells WHERE doc_id % 7 = 3""",
)
def recommend_unreadable(spark, d):
    rows, errors, _ = _readable(spark, d)
    advice = E.recommend_profile(E.profile_report(rows, errors=errors))
    return advice.join(errors.select("doc_id"), "doc_id").filter("recommended_profile IS NULL").select("doc_id", "reason", F.size("hints").alias("n_hints"))


def _finished(spark, d) -> DataFrame:
    rows, errors, documents = _readable(spark, d)
    found = durable(E.extract_grid(E.with_options(rows), max_header_rows=0))
    parses = E.score_parse(E.parse_stats(["doc_id"], rows=rows, table_items=found))
    return M.finished_jobs(documents, found.withColumn("answer_text", F.lit(None).cast("string")), parses, errors)


FINISHED = f"""WITH {BASE}, {mapping_sql()}, {items_sql()}, sizes AS (SELECT doc_id, count(*) AS rows FROM cells GROUP BY doc_id),
    counted AS (SELECT s.doc_id, s.rows, count(i.doc_id) AS n FROM sizes s LEFT JOIN items i USING (doc_id) GROUP BY ALL),
    jobs AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 11 = 5 THEN 0 ELSE n END AS total_questions, doc_id % 7 = 3 AS failed, CASE WHEN {READ} THEN rows ELSE 0 END AS rows FROM counted)"""


@query(
    "finished_jobs",
    FINISHED + """ SELECT job_id, total_questions, CASE WHEN NOT failed THEN 0 END AS matched_questions, total_questions AS flagged_questions_count, CASE WHEN failed THEN 'error' ELSE 'done' END AS status,
      CASE WHEN failed THEN 'not UTF-8' END AS error_message, CASE WHEN NOT failed THEN 'default' END AS parser_profile_name,
      CAST(CASE WHEN failed THEN NULL WHEN total_questions = 0 THEN 0.0 ELSE 0.9 END AS DOUBLE) AS parse_confidence, CASE WHEN NOT failed THEN total_questions = 0 END AS fallback_recommended,
      CASE WHEN NOT failed AND total_questions = 0 THEN 'no_questions_found' END AS fallback_reason, CASE WHEN NOT failed THEN rows END AS table_rows_scanned FROM jobs""",
)
def finished_jobs(spark, d):
    return _finished(spark, d).drop("review_status")


@query(
    "finished_batches",
    FINISHED + """ SELECT job_id % 50 AS batch_id, count(*) AS total, count(*) FILTER (NOT failed) AS done_count, count(*) FILTER (failed) AS error_count, CAST(coalesce(sum(total_questions), 0) AS BIGINT) AS found_total,
      bool_or(failed OR total_questions >= 0) AS needs_attention, 100 AS progress_percent FROM jobs GROUP BY ALL""",
)
def finished_batches(spark, d):
    jobs = _finished(spark, d).withColumn("batch_id", F.col("job_id") % 50)
    return J.batch_summary(jobs).select("batch_id", "total", "done_count", "error_count", "found_total", "needs_attention", "progress_percent")


@query("unfilled_jobs", FINISHED + " SELECT job_id FROM jobs WHERE total_questions = 0")
def unfilled_jobs(spark, d):
    """Done jobs that need a review for nothing but their lack of questions."""
    jobs = _finished(spark, d)
    return jobs.withColumns({"flagged_questions_count": F.lit(0), "fallback_recommended": F.lit(False)}).filter(J.needs_review()).select("job_id")


@query(
    "hint_columns",
    """SELECT event_id, CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k ELSE 0 END AS question_column_index, CASE event_type WHEN 'error' THEN 1 ELSE 1 END AS answer_column_index,
       CASE event_type WHEN 'purchase' THEN 2 ELSE 0 END AS header_rows, event_type <> 'signup' AS detect_row_blocks
       FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events) x""",
)
def hint_columns(spark, d):
    kind, k = F.col("event_type"), F.regexp_extract("props", "[0-9]+", 0)
    text = lambda head, tail: F.concat(F.lit(head), k, F.lit(tail))
    hints = (
        F.when(kind == "click", text('{"question_column_index": ', "}"))
        .when(kind == "view", text('{"question_column_index": "', '", "detect_row_blocks": "false"}'))
        .when(kind == "error", text('{"answer_column_index": -1', ', "header_rows": true}'))
        .when(kind == "purchase", F.lit('{"header_rows": 2.7, "answer_column_index": "x"}'))
        .otherwise(F.lit('{"detect_row_blocks": false}'))
    )
    rows = E.hint_columns(E.with_options(raw(spark, d, "events")), hints)
    return rows.select("event_id", *[F.col(f"o_{n}").alias(n) for n in [*E.INTEGER_HINTS, *E.BOOLEAN_HINTS]])


@query(
    "document_context",
    f"""WITH ask AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS pos, line FROM ({{lines}}) x),
    parts AS (SELECT doc_id, 0 AS part, line_idx AS place, {C.strip('line')} AS line FROM ({{lines}}) x WHERE line_idx < 120 AND {C.strip('line')} <> ''
      UNION ALL SELECT DISTINCT doc_id, 1, 0, 'Extracted question preview:' FROM ask
      UNION ALL SELECT doc_id, 2, pos, concat('- ', {C.strip('line')}) FROM ask WHERE pos <= 40 AND {C.strip('line')} <> ''),
    whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY part, place) AS w FROM parts GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(w) > 6000 THEN concat(substr(w, 1, 6000), chr(10), '...[truncated]') ELSE w END AS context FROM whole""",
)
def document_context(spark, d):
    lines = table(spark, d, "lines").select("doc_id", "line_idx", "line")
    items = lines.select("doc_id", F.col("line_idx").alias("position"), F.col("line").alias("question_text"))
    return E.document_context(lines, items)


# --- layouts ---------------------------------------------------------------

PRINTS = """prints AS (SELECT doc_id, CAST(len(first) AS INTEGER) AS column_count, words,
      sha256(concat('csv::', CAST(len(first) AS VARCHAR), '::', array_to_string(words, '|'))) AS fingerprint_hash
      FROM (SELECT doc_id, first, list_sort(list_distinct(list_filter(flatten(list_transform(first, lambda c: string_split_regex(lower(c), '[ ]+'))), lambda w: w <> ''))) AS words
        FROM (SELECT doc_id, arg_min(cells, row_idx) AS first FROM ({cells}) c GROUP BY doc_id) f) g)"""


@query("fingerprint", f"WITH {PRINTS} SELECT doc_id, column_count, array_to_string(words, ' ') AS words, fingerprint_hash FROM prints")
def fingerprint(spark, d):
    return L.fingerprint(table(spark, d, "cells")).select(
        "doc_id", "column_count", F.array_join("header_words", " ").alias("words"), "fingerprint_hash"
    )


# a file is known by its first record split at commas, also where another delimiter separates its cells
FILE_PRINTS = """marked AS (SELECT doc_id, arg_min(cells, row_idx) AS c, CASE any_value(layout) WHEN '2-HIGH' THEN ';' WHEN '3-MEDIUM' THEN '|' WHEN '4-NOT SPECIFIED' THEN chr(9) ELSE ',' END AS mark FROM ({cells}) x GROUP BY doc_id),
    heads AS (SELECT doc_id, CASE mark WHEN ',' THEN c ELSE string_split(replace(array_to_string(c, chr(31)), chr(31), mark), ',') END AS first FROM marked),
    words AS (SELECT doc_id, first, list_sort(list_distinct(list_filter(flatten(list_transform(first, lambda c: string_split_regex(lower(c), '[ \\t]+'))), lambda w: w <> ''))) AS words FROM heads)"""


@query(
    "fingerprint_files",
    f"""WITH {FILE_PRINTS} SELECT doc_id, CAST(len(first) AS INTEGER) AS column_count, array_to_string(words, ' ') AS words,
      sha256(concat('csv::', CAST(len(first) AS VARCHAR), '::', array_to_string(words, '|'))) AS fingerprint_hash FROM words""",
)
def fingerprint_files(spark, d):
    return L.fingerprint(grids.header_cells(delimited_files(spark, d))).select(
        "doc_id", "column_count", F.array_join("header_words", " ").alias("words"), "fingerprint_hash"
    )


@query(
    "fingerprint_tables",
    """WITH f AS (SELECT doc_id, layout, arg_min(cells, row_idx) AS first FROM (SELECT p.p_size AS doc_id, c.doc_id AS layout, row_idx, cells FROM ({cells}) c JOIN part p ON p.p_partkey = c.doc_id) x GROUP BY ALL),
    w AS (SELECT doc_id, max(len(first)) AS width, list_sort(list_distinct(flatten(list(list_filter(flatten(list_transform(first, lambda c: string_split_regex(lower(c), '[ ]+'))), lambda t: t <> ''))))) AS words FROM f GROUP BY doc_id)
    SELECT doc_id, CAST(width AS INTEGER) AS column_count, sha256(concat('docx::', CAST(width AS VARCHAR), '::', array_to_string(words, '|'))) AS fingerprint_hash FROM w""",
)
def fingerprint_tables(spark, d):
    """Forms grouped into documents by the size of the part with their number."""
    sizes = raw(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("size"))
    rows = table(spark, d, "cells").join(sizes, "doc_id").select(F.col("size").alias("doc_id"), F.col("doc_id").alias("table_idx"), "row_idx", "cells")
    return L.fingerprint(rows, "docx").select("doc_id", "column_count", "fingerprint_hash")


def _known_layouts(spark, d) -> DataFrame:
    """One learned layout per hash, from all forms."""
    prints = L.fingerprint(table(spark, d, "cells"))
    layouts = table(spark, d, "cells").select("doc_id", "layout").distinct()
    known = prints.join(layouts, "doc_id")
    return known.groupBy("fingerprint_hash").agg(
        F.min("doc_id").alias("id"), F.min_by("layout", "doc_id").alias("source_filename"), F.min("column_count").alias("column_count")
    ).select(
        "id", "fingerprint_hash", F.lit(None).cast("string").alias("name"), "source_filename", "column_count",
        F.lit("seen").alias("header_signature"),
        F.when(F.col("source_filename") == "3-MEDIUM", "three_column_table").otherwise("strict_two_column").alias("parser_profile"),
        F.when(F.col("source_filename") == "2-HIGH", '{"header_rows": 1}').alias("hint_overrides"), F.lit(3).cast("long").alias("success_count"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_used_at"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


KNOWN = f"""{PRINTS}, layouts AS (SELECT DISTINCT doc_id, layout FROM ({{cells}}) c),
    known AS (SELECT fingerprint_hash, min(doc_id) AS id, arg_min(layout, doc_id) AS layout FROM prints JOIN layouts USING (doc_id) GROUP BY ALL)"""


@query(
    "lookup_profile",
    f"""WITH {KNOWN}, asked AS (SELECT p.doc_id, fingerprint_hash, CASE layout WHEN '1-URGENT' THEN 'row_block_questionnaire' WHEN '5-LOW' THEN NULL ELSE 'default' END AS profile FROM prints p JOIN layouts USING (doc_id))
    SELECT a.doc_id, CASE WHEN k.id IS NOT NULL AND coalesce(profile, 'default') = 'default' THEN CASE k.layout WHEN '3-MEDIUM' THEN 'three_column_table' ELSE 'strict_two_column' END ELSE coalesce(profile, 'default') END AS effective_profile,
      CASE WHEN k.id IS NOT NULL AND coalesce(profile, 'default') = 'default' AND k.layout = '2-HIGH' THEN '{{"header_rows": 1}}' ELSE '{{}}' END AS effective_hints
    FROM asked a LEFT JOIN known k USING (fingerprint_hash)""".replace("{{", "{").replace("}}", "}"),
)
def lookup_profile(spark, d):
    prints = L.fingerprint(table(spark, d, "cells"))
    layouts = table(spark, d, "cells").select("doc_id", "layout").distinct()
    asked = F.when(F.col("layout") == "1-URGENT", "row_block_questionnaire").when(F.col("layout") == "5-LOW", None).otherwise("default")
    docs = prints.join(layouts, "doc_id").select("doc_id", "fingerprint_hash", asked.alias("parser_profile_name"))
    return L.lookup_profile(docs, _known_layouts(spark, d), "{}").select("doc_id", "effective_profile", "effective_hints")


def _learned(spark, d) -> DataFrame:
    prints = L.fingerprint(table(spark, d, "cells"))
    layouts = table(spark, d, "cells").select("doc_id", "layout").distinct()
    runs = prints.join(layouts, "doc_id").select(
        F.col("doc_id").alias("seq"), "fingerprint_hash", "column_count", "header_words",
        F.when(F.col("layout") == "5-LOW", "row_block_questionnaire").otherwise("default").alias("parser_profile"),
        F.when(F.col("layout") == "4-NOT SPECIFIED", '{"header_rows": 0}').alias("hint_overrides"),
        F.concat(F.lit("form "), F.col("doc_id").cast("string")).alias("original_filename"),
    )
    return L.learn_layouts(_known_layouts(spark, d), runs, "2024-06-01 00:00:00")


@query(
    "learn_layouts",
    f"""WITH {KNOWN}, runs AS (SELECT p.doc_id, fingerprint_hash, column_count, words, layout FROM prints p JOIN layouts USING (doc_id)),
    folded AS (SELECT fingerprint_hash, count(*) AS n, arg_max(layout, doc_id) AS last, max(CASE WHEN layout = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS hinted, min(doc_id) AS first, arg_min(words, doc_id) AS words FROM runs GROUP BY ALL)
    SELECT fingerprint_hash, CASE WHEN last = '5-LOW' THEN 'row_block_questionnaire' ELSE 'default' END AS parser_profile,
      CASE WHEN hinted = 1 THEN '{{"header_rows": 0}}' WHEN k.layout = '2-HIGH' THEN '{{"header_rows": 1}}' END AS hint_overrides, n + CASE WHEN k.id IS NULL THEN 0 ELSE 3 END AS success_count,
      CASE WHEN k.id IS NULL THEN concat('form ', CAST(first AS VARCHAR)) ELSE k.layout END AS source_filename, CASE WHEN k.id IS NULL THEN array_to_string(words[1:20], ' | ') ELSE 'seen' END AS header_signature
    FROM folded LEFT JOIN known k USING (fingerprint_hash)""".replace("{{", "{").replace("}}", "}"),
)
def learn_layouts(spark, d):
    return _learned(spark, d).select("fingerprint_hash", "parser_profile", "hint_overrides", "success_count", "source_filename", "header_signature")


@query(
    "edit_layouts",
    f"""WITH {KNOWN} SELECT id, CASE WHEN layout = '2-HIGH' THEN 'two columns' END AS name, CASE layout WHEN '3-MEDIUM' THEN 'three_column_table' WHEN '2-HIGH' THEN 'default' ELSE 'strict_two_column' END AS parser_profile FROM known WHERE layout <> '1-URGENT'""",
)
def edit_layouts(spark, d):
    known = _known_layouts(spark, d)
    high = known.filter("source_filename = '2-HIGH'").select("id", F.lit("two columns").alias("name"), F.lit("default").alias("parser_profile"), F.lit(None).cast("string").alias("hint_overrides"))
    gone = known.filter("source_filename = '1-URGENT'").select("id")
    return L.delete_fingerprints(L.update_fingerprints(known, high), gone).select("id", "name", "parser_profile")

"""Thresholds, sentinels and parser profiles that define the semantics."""

from __future__ import annotations

# Results depend on them.
MATCH_THRESHOLD = 0.75
DEDUP_THRESHOLD = 0.92
CLASSIFY_THRESHOLD = 0.85
CANDIDATE_CUTOFF = 0.35
CANDIDATE_COUNT = 3
DIRECT_ROUTE_THRESHOLD = 0.78
SKIP_VERIFY_THRESHOLD = 0.78
SKIP_VERIFY_MIN_ANSWERS = 3
VERIFY_MAX_ANSWERS = 40
VERIFY_MAX_FLAGGED = 10
QUESTIONS_PER_REQUEST = 40
PAIRS_PER_REQUEST = 10
PRIOR_ANSWERS = 30
CONTEXT_CHARS = 6000
CONTEXT_CHARS_FLOOR = 500
CONTEXT_ROWS = 120
CONTEXT_TABLES = 10
CONTEXT_TABLE_ROWS = 40
CONTEXT_PAGES = 8
CONTEXT_PREVIEW = 40
CLASSIFY_ANSWER_CHARS = 500
FEEDBACK_MIN_CONFIDENCE = 0.0
TEMPLATE_CONFIDENCE = 0.95
RESOLVED_CONFIDENCE = 1.0
CLUSTER_LIMIT = 100
SAMPLE_QUESTIONS = 6
HEADER_SIGNATURE_WORDS = 20
BATCH_TRACE_EVENTS = 160
JOB_TRACE_EVENTS = 120
MIN_QUESTION_LENGTH = 10

DISMISSED = "[Dismissed]"
REVIEW_PLACEHOLDER = "[REVIEW REQUIRED] No matching answer found in the knowledge base."
AUTO_LEARNED = "Auto-Learned"
CLASSIFY_FAILED_REASON = "LLM classification failed; defaulting to probably_same"
DEFAULT_ACTOR = "user"
DEFAULT_PROFILE = "default"
ALLOWED_EXTENSIONS = ("docx", "pdf", "csv", "xlsx", "xls")

# Similarities are compared after rounding to this many decimals.  Stored
# vectors are 32-bit, so digits past the sixth are noise; rounding makes the
# order of near-equal candidates the same on every engine and block layout.
SIMILARITY_DIGITS = 6
REPORT_DIGITS = 4

# Parser profiles (options left out keep the default).
DEFAULT_OPTIONS = {
    "question_column_index": 0,
    "answer_column_index": 1,
    "header_rows": 0,
    "min_question_length": MIN_QUESTION_LENGTH,
    "allow_additional_columns": True,
    "auto_detect_columns": True,
    "scan_paragraphs": True,
    "detect_row_blocks": True,
}
PROFILE_OVERRIDES = {
    "default": {},
    "strict_two_column": {
        "allow_additional_columns": False,
        "auto_detect_columns": False,
        "detect_row_blocks": False,
    },
    "three_column_table": {
        "question_column_index": 1,
        "answer_column_index": 2,
        "header_rows": 1,
        "auto_detect_columns": False,
    },
    "row_block_questionnaire": {"detect_row_blocks": True},
}
PROFILE_LABELS = {
    "default": "Default",
    "strict_two_column": "Strict Two Column",
    "three_column_table": "Three Column Table",
    "row_block_questionnaire": "Row Block",
}


def profile_options(name: str = DEFAULT_PROFILE) -> dict:
    """Full option set of one profile."""
    return {**DEFAULT_OPTIONS, **PROFILE_OVERRIDES[name], "profile_name": name}

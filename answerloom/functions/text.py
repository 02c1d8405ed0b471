"""Question and text normalisation as Column expressions.

Patterns spell out Unicode whitespace instead of ``\\s`` so that they mean the
same in Java, RE2 and Python.  Every pattern is one that all three accept.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerloom import constants as K

# Character classes and question heuristics.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
STRIP = rf"\A{WS}+|{WS}+\z"
BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# ``[.)-:]`` is a range from ")" to ":", so digits, commas and dots all count.
LEADING_MARK = rf"\A{WS}*(?:\(?\p{{Nd}}+\)?[.)-:]?|[A-Za-z][.)-:]?){WS}+"

NOT_QUESTION = [
    rf"(?i)(^|{NOT_WORD})please{WS}+provide{WS}+detailed{WS}+responses?{WS}+to{WS}+(each|all){WS}+questions?{WS}+below($|{NOT_WORD})",
    rf"(?i)(^|{NOT_WORD})detailed{WS}+responses?{WS}+required($|{NOT_WORD})",
    rf"(?i)(^|{NOT_WORD})detailed{WS}+assessment{WS}+with{WS}+verbose{WS}+questions($|{NOT_WORD})",
]
QUESTION = [
    r"\?\z",
    rf"\A\p{{Nd}}+[.)]{WS}+[^\n]{{10,}}",
    rf"\A[a-zA-Z][.)]{WS}+[^\n]{{10,}}",
    rf"(?i)\A(please{WS}+)?(describe|explain|provide|list|detail|specify|state|outline|indicate|confirm|identify)",
]
LABEL = [
    rf"(?i)\A(company{WS}+name|organization|contact|address|phone|email|website|date|name|title|role|department)",
    rf"(?i)\A(policy|procedure|description|overview|summary|response|answer|comments?|notes?){WS}*:?{WS}*\z",
]
QUESTION_HEADER = [
    rf"(?i)(^|{NOT_WORD})questions?($|{NOT_WORD})",
    rf"(?i)(^|{NOT_WORD})(prompt|requirement|control|field)($|{NOT_WORD})",
]
ANSWER_HEADER = [
    rf"(?i)(^|{NOT_WORD})answers?($|{NOT_WORD})",
    rf"(?i)(^|{NOT_WORD})responses?($|{NOT_WORD})",
    rf"(?i)(^|{NOT_WORD})(comment|comments|notes?)($|{NOT_WORD})",
]


def _any_match(text: Column, patterns: list[str]) -> Column:
    # one alternation, so each text is scanned once
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))  # looks at the ends only, unlike a pattern


def collapse(text: Column) -> Column:
    """Strip and turn every whitespace run into one blank."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def fold(text: Column) -> Column:
    """Case folding: lower case, sharp s to ss, final sigma to sigma."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean_question(text: Column) -> Column:
    """Drop one leading number or single letter, collapse blanks.

    A bare leading letter or number goes too ("A policy exists" becomes
    "policy exists").  Something always follows the blanks after the mark in a
    stripped text, so the result is empty only for blank input.
    """
    return collapse(F.regexp_replace(strip(_or_empty(text)), LEADING_MARK, ""))


def question_key(text: Column) -> Column:
    """Grouping key: cleaned wording without trailing colons, case-folded."""
    # blanks are collapsed already, so only the ends need another look
    return fold(strip(F.rtrim(clean_question(text), F.lit(":"))))


def row_text_key(text: Column) -> Column:
    return F.lower(collapse(text))


def digest(text: Column) -> Column:
    """Sixteen bytes that stand for a text in joins and groups, where the text itself would be shuffled."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def exact_key(text: Column) -> Column:
    """Numbering is kept, unlike :func:`question_key`."""
    return F.lower(strip(_or_empty(text)))


def asks(text: Column) -> Column:
    """Whether a text reads like a question, whatever its length."""
    stripped = strip(text)
    return _any_match(stripped, QUESTION + LABEL) & ~_any_match(stripped, NOT_QUESTION)


def is_question(text: Column, min_length: Column | int = K.MIN_QUESTION_LENGTH) -> Column:
    limit = F.lit(min_length) if isinstance(min_length, int) else min_length
    return (F.char_length(strip(text)) >= limit) & asks(text)


def is_question_header(text: Column) -> Column:
    return _any_match(text, QUESTION_HEADER)


def is_answer_header(text: Column) -> Column:
    return _any_match(text, ANSWER_HEADER)


def is_blank_row(cells: Column) -> Column:
    return F.forall(cells, lambda c: F.char_length(strip(c)) < 3)


def is_merged_row(cells: Column, question: Column) -> Column:
    """Two or more non-blank cells, all equal to the question."""
    filled = F.filter(F.transform(cells, row_text_key), lambda c: c != "")
    key = row_text_key(question)
    return (key != "") & (F.size(filled) >= 2) & F.forall(filled, lambda c: c == key)


def search_match(term: str, *columns: Column) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` have no special meaning."""
    needle = F.lower(F.lit(term))
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), needle), F.lit(False))
    return hit


def or_placeholder(answer: Column) -> Column:
    return F.coalesce(F.nullif(answer, F.lit("")), F.lit(K.REVIEW_PLACEHOLDER))


def final_answer(edited: Column, answer: Column) -> Column:
    return F.coalesce(F.nullif(edited, F.lit("")), answer)


def confidence_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "N/A").when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("low")
    )


def coerce_confidence(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(_or_empty(text)) / 4).cast("int"))


def clean_optional(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def file_stem(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/]*)\z", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+\z", "")


def file_suffix(filename: Column) -> Column:
    """Lower-case suffix with its dot, or an empty string."""
    base = F.regexp_extract(filename, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(base, r".(\.[^.]+)\z", 1))


def is_allowed_file(filename: Column) -> Column:
    return file_suffix(filename).isin([f".{e}" for e in K.ALLOWED_EXTENSIONS])


def layout_hash(file_type: Column, column_count: Column, words: Column) -> Column:
    return F.sha2(
        F.concat_ws("::", file_type, column_count.cast("string"), F.array_join(words, "|")), 256
    )


def route_sme(category: Column, sme_map: dict[str, str]) -> Column:
    """Assignee of a category; an unmapped category has none."""
    if not sme_map:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for item in sme_map.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), strip(category))

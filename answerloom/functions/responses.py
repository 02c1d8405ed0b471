"""Model responses that arrive as text: JSON extraction and HTTP triage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from answerloom.functions.text import WS, strip

# Markers of errors that a retry cannot cure.
QUOTA_MARKERS = [
    "insufficient_quota",
    "billing_hard_limit",
    "billing",
    "credit balance is too low",
    "quota exceeded",
]
ERROR_TEXT_CHARS = 300


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps the plan small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _json_type(json: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(json)), F.lit(""))


def _is_object(json: Column) -> Column:
    """Whether a text without blanks in front is a JSON object."""
    return json.startswith("{") & F.try_parse_json(json).isNotNull()


def extract_json_object(content: Column) -> Column:
    """Text of the JSON object in a response, or null when there is none.

    Code fences are removed; if the rest is no object, the text from the first
    opening to the last closing brace is tried.
    """
    unfenced = _let(strip(content), lambda text: F.when(
        text.startswith("```"),
        F.regexp_replace(F.regexp_replace(text, rf"\A```(?:json)?{WS}*", ""), rf"{WS}*```\z", ""),
    ).otherwise(text))
    braces = lambda t: _let(F.regexp_extract(t, r"(?s)(\{.*\})", 1), lambda b: F.when(_is_object(b), b))
    return _let(unfenced, lambda t: F.when(_is_object(t), t).otherwise(braces(t)))


def content_to_text(content: Column) -> Column:
    """Plain text of a message content given as JSON: a string, or text blocks."""
    kind = _json_type(content)
    blocks = F.from_json(content, "array<string>")
    texts = F.filter(
        F.transform(blocks, lambda b: F.when(_text_is_string(b), strip(F.get_json_object(b, "$.text")))),
        lambda t: t != "",
    )
    return (
        F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(content), "$", "string"))
        .when(kind.startswith("ARRAY"), F.array_join(texts, "\n"))
        .otherwise(content)
    )


def _text_is_string(block: Column) -> Column:
    inner = F.try_variant_get(F.try_parse_json(block), "$.text", "variant")
    return F.coalesce(F.schema_of_variant(inner) == "STRING", F.lit(False))


def _payload(body: Column) -> Column:
    """The response as a variant when it is a JSON object."""
    parsed = F.try_parse_json(body)
    return _let(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _text_at(payload: Column, path: str, only_strings: bool = False) -> Column:
    """Stripped text at a path; null when missing or blank."""
    value = F.nullif(strip(F.try_variant_get(payload, path, "string")), F.lit(""))
    if not only_strings:
        return value
    kind = F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    return F.when(kind == "STRING", value)


def is_quota_error(body: Column) -> Column:
    def check(payload: Column) -> Column:
        paths = ["$.error.code", "$.error.type", "$.error.message", "$.error", "$.message"]
        joined = F.lower(F.concat_ws(" ", *[_text_at(payload, p, only_strings=True) for p in paths]))
        return joined.rlike("|".join(QUOTA_MARKERS))

    return _let(_payload(body), check)


def is_retriable(status: Column, body: Column) -> Column:
    return F.when(status == 429, ~is_quota_error(body)).otherwise(
        status.isin(408, 409) | status.between(500, 599)
    )


def error_detail(status: Column, body: Column) -> Column:
    """Most readable message a response offers."""

    def described(payload: Column) -> Column:
        message = _text_at(payload, "$.error.message")
        code = F.coalesce(_text_at(payload, "$.error.code"), _text_at(payload, "$.error.type"))
        return F.coalesce(
            F.concat(message, F.lit(" ("), code, F.lit(")")), message, code,
            _text_at(payload, "$.error", only_strings=True), _text_at(payload, "$.message", only_strings=True),
        )

    return F.coalesce(
        _let(_payload(body), described),
        F.nullif(F.substring(strip(body), 1, ERROR_TEXT_CHARS), F.lit("")),
        F.concat(F.lit("HTTP "), status.cast("string")),
    )

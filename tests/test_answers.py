from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import answers as fa
from gradeflow.schemas import ANSWER


def one(spark, column, **values):
    """Value of a column over one row of given values."""
    names = ", ".join(f"{n} {t}" for n, (_, t) in values.items())
    frame = spark.createDataFrame([tuple(v for v, _ in values.values())], names)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("yes", True), ("Yes, it is", True), ("TRUE", True), ("1", True), ("10", True), ("no", False),
        ("unknown", False), ("False.", False), ("0", False), ("maybe", None), ("", None), ("not 1", True),
        ("  No \n", False), (None, None),
    ],
)
def test_parse_binary(spark, text, expected):
    parsed = one(spark, fa.parse_answer("t", "binary"), t=(text, "string"))
    assert parsed["value_bool"] is expected
    assert parsed["raw"] == (text if expected is None else None)


@pytest.mark.parametrize("text, expected", [("10", None), ("unknown", None), ("yes!", True), ("it is 0", False)])
def test_parse_binary_strict(spark, text, expected):
    assert one(spark, fa.parse_binary("t", strict=True), t=(text, "string")) is expected


@pytest.mark.parametrize(
    "text, expected, raw",
    [("3.5", 3, None), ("-2", 2, None), ("1,200", 1, None), ("none", None, "none"), ("", None, ""), ("about 12 or 13", 12, None),
     ("12345678901234567890123", 12345678901234567890123, None), ("9" * 39, None, "9" * 39)],
)
def test_parse_count(spark, text, expected, raw):
    parsed = one(spark, fa.parse_answer("t", "count"), t=(text, "string"))
    assert parsed["value_count"] == expected and parsed["raw"] == raw


@pytest.mark.parametrize("qtype", ["multiple_choice", "text"])
def test_parse_text_strips_every_white_space(spark, qtype):
    parsed = one(spark, fa.parse_answer("t", qtype), t=("\t  Cat \n", "string"))
    assert parsed["value_str"] == "Cat" and parsed["raw"] is None


@pytest.mark.parametrize(
    "text, truth, qtype, expected",
    [
        ("yes", (True, None, None), "binary", True), ("no", (True, None, None), "binary", False),
        ("maybe", (True, None, None), "binary", False), ("yes", (None, None, None), "binary", False),
        ("yes", None, "binary", False), ("3 cats", (None, Decimal(3), None), "count", True), ("none", (None, Decimal(3), None), "count", False),
        (" CAT ", (None, None, "cat"), "multiple_choice", True), ("dog", (None, None, "cat"), "text", False),
        ("x", None, "text", False), ("None", (None, None, None), "text", True), ("", (None, None, ""), "text", True),
    ],
)
def test_check_answer(spark, text, truth, qtype, expected):
    frame = spark.createDataFrame([(text, truth)], f"t string, truth {ANSWER}")
    checked = frame.select(fa.check_answer(fa.parse_answer("t", qtype), "truth", qtype).alias("x"))
    assert checked.first()["x"] is expected


@pytest.mark.parametrize(
    "value, expected, message",
    [
        ("yes", True, None), ("no", False, None), ("TRUE", True, None), ("0", False, None), (" Y ", True, None),
        ("1.0", True, None), ("f", False, None), ("", None, None), (None, None, None),
        ("maybe", None, "Invalid binary value: 'maybe'. Accepted: yes/no, y/n, true/false, t/f, 1/0"),
        (" ", None, "Invalid binary value: ' '. Accepted: yes/no, y/n, true/false, t/f, 1/0"),
    ],
)
def test_binary_labels(spark, value, expected, message):
    checked = one(spark, fa.validate_label("v", "binary"), v=(value, "string"))
    assert checked["answer"]["value_bool"] is expected and checked["error"] == message


@pytest.mark.parametrize(
    "value, expected, message",
    [("Cat", "Cat", None), ("dog", "Dog", None), (" CAT ", "Cat", None), ("", None, None),
     ("Bird", None, "Invalid option: 'Bird'. Valid options: Cat, Dog")],
)
def test_choice_labels(spark, value, expected, message):
    options = F.array(F.lit("Cat"), F.lit("Dog"))
    checked = one(spark, fa.validate_label("v", "multiple_choice", options), v=(value, "string"))
    assert checked["answer"]["value_str"] == expected and checked["error"] == message


def test_choice_without_options_and_unknown_type(spark):
    checked = one(spark, fa.validate_label("v", "multiple_choice"), v=("Cat", "string"))
    assert checked["error"] == "No question options defined for multiple choice question"
    checked = one(spark, fa.validate_label("v", "ranking"), v=("Cat", "string"))
    assert checked["error"] == "Unknown question type: ranking"


@pytest.mark.parametrize(
    "value, expected",
    [("3.7", 3), ("1e3", 1000), ("-0.5", 0), ("0", 0), (" 7 ", 7), ("-1", None), ("abc", None), ("inf", None),
     ("nan", None), ("1d", None), ("1e30", 10**30), ("1e400", None), (".5", 0), ("5.", 5)],
)
def test_count_labels(spark, value, expected):
    checked = one(spark, fa.validate_label("v", "count"), v=(value, "string"))
    assert checked["answer"]["value_count"] == expected
    wanted = None if expected is not None else f"Invalid count value: '{value}'. Must be a non-negative integer."
    assert checked["error"] == wanted


@pytest.mark.parametrize(
    "answer, qtype, expected",
    [
        ((True, None, None), "binary", "yes"), ((False, None, None), "binary", "no"), ((None, None, None), "binary", ""),
        (None, "binary", ""), ((None, Decimal(3), None), "count", "3"), ((None, None, "Cat"), "text", "Cat"), (None, "count", ""),
    ],
)
def test_answer_text(spark, answer, qtype, expected):
    assert one(spark, fa.answer_text("a", qtype), a=(answer, ANSWER)) == expected

"""Parsing, checking, validating and printing answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeflow.functions.text import as_col, fold, strip
from gradeflow.schemas import ANSWER, PARSED

# Words that decide a yes/no answer, looked for anywhere in it.
TRUE_WORDS = ("yes", "true", "1")
FALSE_WORDS = ("no", "false", "0")

# Accepted spellings of an imported yes/no label.
TRUE_LABELS = ("yes", "y", "true", "t", "1", "1.0")
FALSE_LABELS = ("no", "n", "false", "f", "0", "0.0")

# Messages for a label that cannot be accepted.
BINARY_HINT = "Accepted: yes/no, y/n, true/false, t/f, 1/0"
COUNT_HINT = "Must be a non-negative integer."
NO_OPTIONS = "No question options defined for multiple choice question"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _qtype(question_type: Column | str) -> Column:
    """A question type given as a literal name or as a column."""
    return F.lit(question_type) if isinstance(question_type, str) else question_type


def _any_word(text: Column, words: tuple[str, ...], strict: bool) -> Column:
    words_pattern = "|".join(words)
    return text.rlike(rf"(^|[^a-z0-9])({words_pattern})([^a-z0-9]|$)" if strict else words_pattern)


def parse_binary(response: Column | str, strict: bool = False) -> Column:
    """True, false or NULL.

    The default looks for the words anywhere, so "10" is true and "unknown" is
    false; ``strict`` asks for whole words.
    """
    text = F.lower(as_col(response))
    return (
        F.when(_any_word(text, TRUE_WORDS, strict), F.lit(True))
        .when(_any_word(text, FALSE_WORDS, strict), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def parse_count(response: Column | str) -> Column:
    """The first run of ASCII digits as a number ("3.5" is 3, "1,200" is 1), or NULL."""
    digits = F.regexp_extract(as_col(response), "0*([0-9]+)", 1)  # leading zeros don't make a number long
    return digits.try_cast("decimal(38,0)")


def parse_answer(response: Column | str, question_type: Column | str, strict: bool = False) -> Column:
    """Response text to a typed answer; ``raw`` keeps what could not be read."""
    text, qtype = as_col(response), _qtype(question_type)
    as_bool = F.when(qtype == "binary", parse_binary(text, strict))
    as_count = F.when(qtype == "count", parse_count(text))
    as_text = F.when(~qtype.isin("binary", "count"), strip(text))
    # One test each, apart from the parsing: generated code stays small enough to be compiled.
    unread = ((qtype == "binary") & ~_any_word(F.lower(text), TRUE_WORDS + FALSE_WORDS, strict)) | (
        (qtype == "count") & text.rlike("^[^0-9]*(0*[1-9][0-9]{38}|$)")
    )
    return F.struct(
        as_bool.alias("value_bool"),
        as_count.alias("value_count"),
        as_text.alias("value_str"),
        F.when(unread, text).alias("raw"),
    ).cast(PARSED)


def check_answer(parsed: Column | str, truth: Column | str, question_type: Column | str) -> Column:
    """Whether a parsed answer equals the ground truth; never NULL.

    No parsed value or no ground truth counts as wrong.  A ground truth that is
    present but holds no value compares as the text "none", as it always has.
    """
    parsed, truth, qtype = as_col(parsed), as_col(truth), _qtype(question_type)
    same_text = fold(parsed["value_str"]) == F.coalesce(fold(truth["value_str"]), F.lit("none"))
    equal = (
        F.when(truth.isNull(), F.lit(False))
        .when(qtype == "binary", parsed["value_bool"] == truth["value_bool"])
        .when(qtype == "count", parsed["value_count"] == truth["value_count"])
        .otherwise(same_text)
    )
    return F.coalesce(equal, F.lit(False))


def normalize_binary_label(value: Column | str) -> Column:
    """Accepted spelling of a yes/no label to a boolean, else NULL."""
    text = fold(value)
    return F.when(text.isin(*TRUE_LABELS), F.lit(True)).when(text.isin(*FALSE_LABELS), F.lit(False))


def canonical_option(value: Column | str, options: Column) -> Column:
    """The option equal to the label: exactly first, else ignoring case, else NULL."""
    text = strip(value)
    exact = F.when(F.array_contains(options, text), text)
    loose = F.get(F.filter(options, lambda o: F.lower(o) == F.lower(text)), F.lit(0))
    return F.coalesce(exact, loose)


def count_label(value: Column | str) -> Column:
    """A label as a whole number, cut toward zero ("3.7" is 3, "1e3" is 1000), or NULL."""
    text = strip(value)
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    whole = F.when(F.abs(number) < 1e15, number.cast("bigint").cast("decimal(38,0)")).otherwise(
        number.try_cast("decimal(38,0)")
    )
    return F.when(whole >= 0, whole)


def is_blank_label(value: Column | str) -> Column:
    value = as_col(value)
    return value.isNull() | (value == "")


def validate_label(value: Column | str, question_type: Column | str, options: Column | None = None) -> Column:
    """Check one imported label: struct of typed value and ``error``.

    A blank label gives neither value nor error.  ``options`` is an array column.
    """
    value, qtype = as_col(value), _qtype(question_type)
    options = options if options is not None else F.lit(None).cast("array<string>")
    blank = is_blank_label(value)
    no_options = options.isNull() | (F.size(options) == 0)
    as_bool = F.when(~blank & (qtype == "binary"), normalize_binary_label(value))
    as_count = F.when(~blank & (qtype == "count"), count_label(value))
    as_text = (
        F.when(blank, F.lit(None))
        .when(qtype == "multiple_choice", F.when(~no_options, canonical_option(value, options)))
        .when(qtype == "text", strip(value))
    )
    error = (
        F.when(blank, F.lit(None))
        .when(
            (qtype == "binary") & as_bool.isNull(),
            F.concat(F.lit("Invalid binary value: '"), value, F.lit("'. " + BINARY_HINT)),
        )
        .when((qtype == "multiple_choice") & no_options, F.lit(NO_OPTIONS))
        .when(
            (qtype == "multiple_choice") & as_text.isNull(),
            F.concat(
                F.lit("Invalid option: '"), strip(value), F.lit("'. Valid options: "), F.array_join(options, ", ")
            ),
        )
        .when(
            (qtype == "count") & as_count.isNull(),
            F.concat(F.lit("Invalid count value: '"), value, F.lit("'. " + COUNT_HINT)),
        )
        .when(
            ~qtype.isin("binary", "multiple_choice", "text", "count"),
            F.concat(F.lit("Unknown question type: "), qtype),
        )
    )
    return F.struct(
        F.struct(
            as_bool.alias("value_bool"), as_count.alias("value_count"), as_text.alias("value_str")
        ).cast(ANSWER).alias("answer"),
        error.cast("string").alias("error"),
    )


def answer_text(answer: Column | str, question_type: Column | str) -> Column:
    """Typed answer to its export text: yes/no for binary, "" when there is none."""
    answer, qtype = as_col(answer), _qtype(question_type)
    plain = F.coalesce(
        answer["value_str"], answer["value_count"].cast("string"), F.initcap(answer["value_bool"].cast("string"))
    )
    text = F.when(
        qtype == "binary", F.when(answer["value_bool"], "yes").when(~answer["value_bool"], "no")
    ).otherwise(plain)
    return F.coalesce(text, F.lit(""))


def has_value(answer: Column | str) -> Column:
    answer = as_col(answer)
    return (
        answer["value_bool"].isNotNull() | answer["value_count"].isNotNull() | answer["value_str"].isNotNull()
    )

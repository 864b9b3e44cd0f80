"""The known run scenarios, and invariants of the summary."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import scoring
from gradeflow.schemas import ANSWER, PRICING, STEPS

SCHEMA = (
    f"evaluation_id string, image_id bigint, filename string, question_type string, model_response string,"
    f" ground_truth {ANSWER}, steps {STEPS}, error string, provider string, pricing {PRICING}"
)
PRICES = (Decimal("1"), Decimal("2"), None, None, None)


def run(spark, rows):
    """rows: (run, response, truth, error)"""
    data = [
        (r, i, f"img-{i}", "binary", text, (truth, None, None),
         [(1, text, 100, 10, 5, 1, None)] if error is None else None, error, "openai", PRICES)
        for i, (r, text, truth, error) in enumerate(rows)
    ]
    return scoring.score(spark.createDataFrame(data, SCHEMA))


def both_ways(results):
    """The summary from the steps, which must equal the one from per-row columns."""
    steps = scoring.summarize(results, usage="steps").first()
    assert steps == scoring.summarize(scoring.add_usage(results), usage="columns").first()
    return steps


def summary(spark, rows):
    return both_ways(run(spark, rows))


def test_all_correct(spark):
    got = summary(spark, [("a", "yes", True, None)] * 5)
    assert (got["status"], got["accuracy"], got["correct"], got["total"]) == ("completed", 1.0, 5, 5)
    assert (got["prompt_tokens"], got["completion_tokens"], got["total_tokens"]) == (50, 25, 75)
    assert (got["actual_cost"], got["average_cost_per_image"]) == (Decimal("0.0001"), 0.00002)


def test_partial_failure(spark):
    got = summary(spark, [("a", "yes", True, None)] * 3 + [("a", None, True, "boom")] * 2)
    assert (got["status"], got["successful"], got["failed"]) == ("completed", 3, 2)


def test_high_failure_and_message(spark):
    rows = [("a", "yes", True, None)] + [("a", None, True, "boom")] * 4
    assert summary(spark, rows)["status"] == "failed"
    got = scoring.failure_messages(run(spark, rows)).first()
    assert got["error_message"] == (
        "Evaluation failed: 80.0% of predictions failed (4/5). Errors: Image img-1: boom; Image img-2: boom;"
        " Image img-3: boom (and 1 more errors)"
    )


def test_half_failed_is_completed(spark):
    assert summary(spark, [("a", "yes", True, None), ("a", None, True, "x")])["status"] == "completed"


def test_all_failed_has_no_accuracy(spark):
    got = summary(spark, [("a", None, True, "x")])
    assert (got["accuracy"], got["accuracy_percent"], got["failure_rate_percent"]) == (0.0, 0.0, 100.0)
    assert got["actual_cost"] == 0


def test_unreadable_and_missing_truth_stay_out_of_the_matrix(spark):
    rows = [("a", "yes", True, None), ("a", "no", False, None), ("a", "yes", False, None), ("a", "no", True, None),
            ("a", "maybe", True, None), ("a", "yes", None, None), ("a", None, True, "x")]
    got = summary(spark, rows)
    assert [got[c] for c in ("tp", "tn", "fp", "fn")] == [1, 1, 1, 1]
    assert (got["successful"], got["correct"], got["unparsed"]) == (6, 2, 1)
    scored = run(spark, rows)
    size = lambda which: scoring.filter_results(scored, which).count()
    # The filter counts the wrong "yes" without a truth, the matrix does not.
    assert [size(w) for w in ("all", "correct", "incorrect", "tp", "tn", "fp", "fn")] == [7, 2, 4, 1, 1, 2, 1]
    with pytest.raises(ValueError):
        scoring.filter_results(scored, "other")


def test_matrix_is_null_unless_binary(spark):
    counts = scoring.summarize(run(spark, [("a", "yes", True, None)]))
    struct = scoring.run_summary(counts.withColumn("question_type", F.lit("count"))).first()["results_summary"]
    assert struct["confusion_matrix"] is None and struct["total"] == 1


def test_steps_finished_before_a_failure_are_paid(spark):
    rows = [("a", 1, "f", "binary", None, (True, None, None), [(1, "x", 5, 1_000_000, 0, 1, None)], "step 2", "openai", PRICES)]
    got = both_ways(scoring.score(spark.createDataFrame(rows, SCHEMA)))
    assert (got["failed"], got["actual_cost"], got["prompt_tokens"]) == (1, Decimal("1.0000"), 1_000_000)


def test_precision_recall(spark):
    frame = spark.createDataFrame([(45, 30, 10, 15), (0, 0, 0, 0)], "tp bigint, tn bigint, fp bigint, fn bigint")
    good, none = scoring.precision_recall_f1(frame).collect()
    assert round(good["precision"], 4) == 0.8182 and good["recall"] == 0.75 and round(good["f1"], 4) == 0.7826
    assert none["precision"] is None and none["recall"] is None and none["f1"] is None


def test_confidence_bins(spark):
    frame = spark.createDataFrame([(0.0, True), (0.05, False), (0.1, True), (1.0, True), (None, True)], "c double, is_correct boolean")
    got = {r["bin"]: (r["total"], r["correct"]) for r in scoring.confidence_histogram(frame, "c").collect()}
    assert got == {1: (2, 1), 2: (1, 1), 10: (1, 1)}

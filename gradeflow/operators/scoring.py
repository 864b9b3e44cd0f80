"""Scoring of results and the summary of a run.

Results carry: evaluation_id, image_id, filename, question_type, model_response,
ground_truth, steps, error, and for costs provider and pricing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions.answers import check_answer, parse_answer
from gradeflow.functions.cost import actual_cost_units, money, sum_money
from gradeflow.functions.text import as_col, half_up_ratio
from gradeflow.operators.joins import first_by

FAILURE_THRESHOLD_PERCENT = 50  # a run fails above this, not at it
SHOWN_ERRORS = 3
# Size of a quantile sketch (its rank error is 1 %) and the percentiles reported.
SKETCH_K = 400
PERCENTS = (5, 25, 50, 75, 95)


def score(results: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``parsed`` and ``is_correct``; both are NULL for a row that ended in an error."""
    fine = F.col("error").isNull()
    parsed = F.when(fine, parse_answer("model_response", F.col("question_type"), strict))
    scored = results.withColumn("parsed", parsed)
    correct = F.when(fine, check_answer("parsed", "ground_truth", F.col("question_type")))
    return scored.withColumn("is_correct", correct)


def step_total(steps: Column | str, field: str) -> Column:
    """Sum of a step field over the steps of one row."""
    return F.aggregate(
        F.coalesce(as_col(steps), F.array()),
        F.lit(0).cast("bigint"),
        lambda total, step: total + F.coalesce(step[field], F.lit(0)).cast("bigint"),
    )


def steps_cost(steps: Column | str, provider: Column | str, pricing: Column | str, has_image: bool = True) -> Column:
    """Cost of the finished steps of one row; each step is priced by itself."""
    provider, pricing = as_col(provider), as_col(pricing)
    return money(
        F.aggregate(
            F.coalesce(as_col(steps), F.array()),
            F.lit(0).cast("bigint"),
            lambda total, step: total + _step_units(step, provider, pricing, has_image),
        )
    )


def _step_units(step: Column, provider: Column, pricing: Column, has_image: bool) -> Column:
    units = actual_cost_units(provider, step["prompt_tokens"], step["completion_tokens"], pricing, has_image)
    return F.when(step["error"].isNull(), units).otherwise(F.lit(0).cast("bigint"))


def add_usage(results: DataFrame, has_image: bool = True) -> DataFrame:
    """Add prompt_tokens, completion_tokens, latency_ms and cost per row, from its steps."""
    return results.select(
        "*",
        step_total("steps", "prompt_tokens").alias("prompt_tokens"),
        step_total("steps", "completion_tokens").alias("completion_tokens"),
        step_total("steps", "latency_ms").alias("latency_ms"),
        steps_cost("steps", "provider", "pricing", has_image).alias("cost"),
    )


def _outcomes() -> dict[str, Column]:
    """Conditions behind total, failed, successful, correct and unparsed."""
    fine = F.col("error").isNull()
    unread = fine & ~F.coalesce(
        F.col("parsed.value_bool").isNotNull()
        | F.col("parsed.value_count").isNotNull()
        | F.col("parsed.value_str").isNotNull(),
        F.lit(False),
    )
    return {
        "total": F.lit(True), "failed": ~fine, "successful": fine, "correct": F.col("is_correct"), "unparsed": unread
    }


def _matrix() -> dict[str, Column]:
    """Conditions behind tp, tn, fp and fn: scored rows with two real booleans only."""
    truth, guess = F.col("ground_truth.value_bool"), F.col("parsed.value_bool")
    scored = F.col("is_correct").isNotNull() & (F.col("question_type") == "binary")
    return {
        "tp": scored & truth & guess, "tn": scored & ~truth & ~guess,
        "fp": scored & ~truth & guess, "fn": scored & truth & ~guess,
    }


def _counts(conditions: dict[str, Column], only: Column | None = None) -> list[Column]:
    """Counting aggregates; ``only`` marks the rows that count."""
    return [
        F.count_if(c if only is None else c & only).cast("bigint").alias(name) for name, c in conditions.items()
    ]


def outcome_counts() -> list[Column]:
    """total, failed, successful, correct and unparsed as aggregates."""
    return _counts(_outcomes())


def confusion_counts() -> list[Column]:
    """tp, tn, fp and fn as aggregates."""
    return _counts(_matrix())


def accuracy(correct: Column | str, successful: Column | str) -> Column:
    correct, successful = as_col(correct), as_col(successful)
    return F.coalesce(F.try_divide(correct, successful), F.lit(0.0)).cast("double")


def run_status(failed: Column | str, total: Column | str) -> Column:
    """'failed' when more than half of the rows failed, else 'completed'."""
    too_many = as_col(failed) * 100 > as_col(total) * FAILURE_THRESHOLD_PERCENT
    return F.when(too_many, "failed").otherwise("completed")


def percent_2dp(part: Column | str, whole: Column | str) -> Column:
    return half_up_ratio(as_col(part), as_col(whole), scale=2, factor=100)


def summarize(
    results: DataFrame, by: Sequence[str] = ("evaluation_id",), usage: str | None = None, has_image: bool = True
) -> DataFrame:
    """One row per run: counts, accuracy, status, confusion matrix, and usage on request.

    ``usage`` is "columns" when rows carry prompt_tokens, completion_tokens and
    cost, or "steps" to take them from the steps.  Either way it is a single
    grouped aggregation; partial results are formed before the shuffle, so a run
    with a third of all rows costs one row per task.
    """
    by, conditions = list(by), {**_outcomes(), **_matrix()}
    if usage == "steps":
        # Steps are laid out as rows, and a result is counted at its first step.
        needed = [*by, "question_type", "error", "parsed", "is_correct", "ground_truth", "provider", "pricing"]
        rows = results.select(*dict.fromkeys(needed), F.posexplode_outer("steps").alias("_at", "_step"))
        first = F.coalesce(F.col("_at") == 0, F.lit(True))
        step = F.col("_step")
        units = F.when(step.isNotNull(), _step_units(step, F.col("provider"), F.col("pricing"), has_image))
        measures = _counts(conditions, first) + _usage(step["prompt_tokens"], step["completion_tokens"], sum_money(units))
    else:
        rows, measures = results, _counts(conditions)
        if usage == "columns":
            measures += _usage(F.col("prompt_tokens"), F.col("completion_tokens"), F.sum("cost"))
    out = rows.groupBy(*by).agg(*measures)
    out = out.select(
        "*",
        accuracy("correct", "successful").alias("accuracy"),
        percent_2dp("correct", "successful").alias("accuracy_percent"),
        percent_2dp("failed", "total").alias("failure_rate_percent"),
        run_status("failed", "total").alias("status"),
    )
    if usage:
        ten_thousandths = (F.col("actual_cost") * F.lit(10000).cast("decimal(5,0)")).cast("bigint")
        out = out.select(
            "*",
            (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
            # Cost is held in ten-thousandths; two more places make the six of the average.
            (half_up_ratio(ten_thousandths, F.col("total"), scale=2) / F.lit(10000.0)).alias("average_cost_per_image"),
        )
    return out


def _usage(prompt: Column, completion: Column, cost: Column) -> list[Column]:
    def total(tokens: Column) -> Column:
        return F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint")

    actual = F.coalesce(F.round(cost, 4), F.lit(0)).cast("decimal(20,4)")
    return [
        total(prompt).alias("prompt_tokens"), total(completion).alias("completion_tokens"), actual.alias("actual_cost")
    ]


def _first_errors(failed: DataFrame, by: Sequence[str], shown: int) -> DataFrame:
    """The first ``shown`` messages per run as ``_head``."""
    message = F.concat(F.lit("Image "), F.col("filename"), F.lit(": "), F.col("error")).alias("_message")
    head = first_by(failed.select(*by, "image_id", message), by, ["image_id"], keep=shown)
    return head.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("image_id", "_message"))).alias("_head"))


def _joined_errors(count: Column, shown: int) -> Column:
    text, more = F.array_join(F.col("_head._message"), "; "), count - shown
    return F.when(
        more > 0, F.concat(text, F.lit(" (and "), more.cast("string"), F.lit(" more errors)"))
    ).otherwise(text)


def first_errors(results: DataFrame, by: Sequence[str] = ("evaluation_id",), shown: int = SHOWN_ERRORS) -> DataFrame:
    """First error messages per run, joined by "; ", with the number left out."""
    by = list(by)
    failed = results.filter(F.col("error").isNotNull())
    counts = failed.groupBy(*by).agg(F.count("*").cast("bigint").alias("error_count"))
    return counts.join(_first_errors(failed, by, shown), by).select(
        *by, "error_count", _joined_errors(F.col("error_count"), shown).alias("errors")
    )


def failure_messages(results: DataFrame, by: Sequence[str] = ("evaluation_id",), shown: int = SHOWN_ERRORS) -> DataFrame:
    """Message of every run that failed: rate, counts and its first errors.

    Two readings of the results: one counts, one cuts every task's failures of a run to ``shown``.
    """
    by = list(by)
    counts = results.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
    failed = counts.filter(run_status("failed", "total") == "failed")
    rate = F.format_string("%.1f", half_up_ratio(F.col("failed"), F.col("total"), scale=1, factor=100))
    message = F.concat(
        F.lit("Evaluation failed: "), rate, F.lit("% of predictions failed ("),
        F.col("failed").cast("string"), F.lit("/"), F.col("total").cast("string"),
        F.lit("). Errors: "), _joined_errors(F.col("failed"), shown),
    )
    heads = _first_errors(results.filter(F.col("error").isNotNull()), by, shown)
    return failed.join(heads, by).select(*by, "failed", "total", message.alias("error_message"))


def run_summary(summary: DataFrame, by: Sequence[str] = ("evaluation_id",)) -> DataFrame:
    """The summary as one struct; the matrix is NULL for a run that is not binary."""
    matrix = F.struct("tp", "tn", "fp", "fn")
    return summary.select(
        *by,
        F.struct(
            "correct", "total", "successful", "failed", "failure_rate_percent", "accuracy_percent",
            F.when(F.col("question_type") == "binary", matrix).alias("confusion_matrix"),
        ).alias("results_summary"),
    )


def result_classes() -> dict[str, Column]:
    """Condition of each result class.

    fp and fn mean "wrong, and answered true / false".  A wrong answer without
    a boolean ground truth is in them, though not in the confusion matrix.
    """
    correct, guess = F.col("is_correct"), F.col("parsed.value_bool")
    return {
        "all": F.lit(True),
        "correct": correct,
        "incorrect": ~correct,
        "tp": correct & guess,
        "tn": correct & ~guess,
        "fp": ~correct & guess,
        "fn": ~correct & ~guess,
    }


def filter_results(results: DataFrame, which: str = "all") -> DataFrame:
    """Rows of one class: all, correct, incorrect, tp, tn, fp or fn."""
    classes = result_classes()
    if which not in classes:
        raise ValueError(f"unknown result filter: {which}")
    return results.filter(classes[which])


def class_sizes(results: DataFrame, by: Sequence[str] = ("evaluation_id",), value: str = "image_id") -> DataFrame:
    """Rows and sum of ``value`` per run and class, in one pass over the results."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in result_classes().items()]))
    return results.select(*by, value, F.explode(names).alias("which")).groupBy("which", *by).agg(
        F.count("*").cast("bigint").alias("results"), F.sum(value).cast("bigint").alias("ids")
    )


def precision_recall_f1(summary: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; NULL where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return summary.select(
        "*",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def accuracy_by_question(results: DataFrame, by: Sequence[str] = ("question_type",), overall: str | None = None) -> DataFrame:
    """Accuracy per question and, in one row with NULL keys, over all.

    ``overall`` names a column that marks this row, as a question may be NULL too.
    """
    keys = [F.col(c) for c in by]
    mark = [(F.grouping(by[0]) == 1).alias(overall)] if overall else []
    counts = results.groupingSets([keys, []], *keys).agg(*mark, *outcome_counts())
    return counts.withColumn("accuracy_percent", percent_2dp("correct", "successful"))


def accuracy_trend(results: DataFrame, time: str, unit: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy per time unit and its change against the unit before."""
    from pyspark.sql import Window

    by = list(by)
    daily = (
        results.withColumn("period", F.date_trunc(unit, F.col(time)))
        .groupBy(*by, "period")
        .agg(
            F.count_if(F.col("error").isNull()).alias("successful"),
            F.count_if(F.col("is_correct")).alias("correct"),
        )
    )
    daily = daily.withColumn("accuracy_percent", percent_2dp("correct", "successful"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("period")  # one row per period
    change = F.col("accuracy_percent") - F.lag("accuracy_percent").over(order)
    return daily.withColumn("change", F.round(change, 2))


def confidence_histogram(results: DataFrame, confidence: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Number and accuracy of results per confidence bin on [0, 1]; 1 falls in the last bin."""
    bucket = F.least(F.width_bucket(F.col(confidence), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    counts = results.filter(F.col(confidence).isNotNull()).groupBy(*by, bucket.cast("bigint").alias("bin")).agg(
        F.count("*").cast("bigint").alias("total"),
        F.count_if(F.col("is_correct")).alias("correct"),
    )
    return counts.withColumn("accuracy_percent", percent_2dp("correct", "total"))


def confidence_sketches(results: DataFrame, confidence: str, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """A KLL quantile sketch of the confidence per group, as ``sketch``; rows without one are left out.

    A sketch has a bounded size whatever the group's, is built in every task
    before the shuffle, and can be stored and merged later.
    """
    rows = results.filter(F.col(confidence).isNotNull() & ~F.isnan(F.col(confidence).cast("double")))
    return rows.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(confidence).cast("double"), F.lit(k)).alias("sketch"), F.count("*").cast("bigint").alias("total")
    )


def percentiles(sketches: DataFrame, percents: Sequence[int] = PERCENTS, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles out of stored sketches, merged per ``by``: one row per group and percent.

    A value's rank lies within :func:`sketch_rank_error` of the one asked for
    (99 % of the time); up to about ``k`` values a group's percentiles are exact.
    """
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("total").cast("bigint").alias("total")
    ).filter(F.col("total") > 0)
    each = merged.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    # The rank is a literal, as the function asks for one.
    value = F.coalesce(*[F.when(F.col("percent") == p, F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100))) for p in percents])
    return each.select(*by, "total", "percent", value.alias("value"))


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Rank error of one quantile at 99 % confidence, as a share of the rows (published fit for KLL sketches)."""
    return 2.296 / k**0.9021


def paired_outcomes(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two runs over the same images, such as zero-shot against few-shot, compared image by image.

    ``pairs`` has first_id and second_id; ``results`` has evaluation_id, image_id and
    is_correct.  Only images that both runs answered count (a repeated image counts as
    right if any of its answers is).  Returns counts, both accuracies in percent, their
    difference, and McNemar's statistic with continuity correction, NULL where the runs
    never differ; above 3.84 the difference is significant at 5 %.  Runs meet by
    (pair, image), so a run with a third of all rows is spread by its images.
    """
    pair = F.struct("first_id", "second_id")
    sides = pairs.select("first_id", "second_id").distinct().select(
        pair.alias("_pair"), F.inline(F.array(*[F.struct(F.col(c).alias("evaluation_id"), F.lit(i).alias("_side")) for i, c in enumerate(("first_id", "second_id"))]))
    )
    answered = results.filter(F.col("is_correct").isNotNull()).select("evaluation_id", "image_id", "is_correct")
    side = lambda i: F.max(F.when(F.col("_side") == i, F.col("is_correct")))
    met = answered.join(sides, "evaluation_id").groupBy("_pair", "image_id").agg(side(0).alias("_a"), side(1).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    count = lambda c: F.count_if(c).cast("bigint")
    counts = met.filter(a.isNotNull() & b.isNotNull()).groupBy("_pair").agg(
        F.count("*").cast("bigint").alias("paired"), count(a & b).alias("both_right"), count(a & ~b).alias("only_first"),
        count(~a & b).alias("only_second"), count(~a & ~b).alias("both_wrong"),
    )
    apart = F.col("only_first") + F.col("only_second")
    off = F.greatest(F.abs(F.col("only_first") - F.col("only_second")) - 1, F.lit(0))
    return counts.select(
        F.col("_pair.first_id").alias("first_id"), F.col("_pair.second_id").alias("second_id"),
        "paired", "both_right", "only_first", "only_second", "both_wrong",
        percent_2dp(F.col("both_right") + F.col("only_first"), F.col("paired")).alias("first_percent"),
        percent_2dp(F.col("both_right") + F.col("only_second"), F.col("paired")).alias("second_percent"),
        F.try_divide((off * off).cast("double"), apart.cast("double")).alias("statistic"),
    )

"""Cost of a run before it starts, and against what it did cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions.cost import estimate_cost, image_tokens, rough_estimate, text_tokens
from gradeflow.functions.text import as_col
from gradeflow.operators.joins import first_by

SAMPLE_SIZE = 5
EXPECTED_OUTPUT_TOKENS = 100
# Fixed value: the answer for a model without prices.
NO_PRICING = "No pricing configuration available for this model"


def chain_input_text(chain: Column | str, system_message: Column, question: Column) -> Column:
    """All prompt text of a run: the chain's system messages and prompts, or the single prompt."""
    chain = as_col(chain)

    def lines(field: str) -> Column:
        return F.array_join(F.transform(chain, lambda step: F.concat(F.coalesce(step[field], F.lit("")), F.lit("\n"))), "")

    question = F.coalesce(question, F.lit(""))
    single = F.concat(F.coalesce(system_message, F.lit("")), F.lit("\n"), question)
    return F.when(F.size(chain) > 0, F.concat(lines("system_message"), lines("prompt"), question)).otherwise(single)


def sampled_estimate(
    images: DataFrame, by: Sequence[str], input_text: Column, size: int = SAMPLE_SIZE, order: str = "image_id"
) -> DataFrame:
    """Estimated cost per group: text cost plus the mean image cost of its first images, times its size.

    ``images`` has provider and pricing, width and height (NULL where an image
    cannot be read, which leaves it at the provider's fallback) and ``readable``,
    false where it could not be fetched, which leaves it out of the sample.
    Groups are keyed by run or dataset; the sample is cut in every task before
    it is shuffled.
    """
    by = list(by)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    provider, pricing = F.col("provider"), F.col("pricing")
    text = estimate_cost(provider, text_tokens(input_text), F.lit(EXPECTED_OUTPUT_TOKENS).cast("bigint"), none, none, pricing)
    image = estimate_cost(provider, none, none, image_tokens(provider, F.col("width"), F.col("height")), one, pricing)
    counts = images.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("image_count"), F.any_value(text).alias("text_cost_per_request")
    )
    head = first_by(
        images.select(*by, order, "provider", "pricing", "width", "height", "readable"), by, [F.col(order)], keep=size
    )
    sample = head.filter("readable").groupBy(*by).agg(
        F.count("*").cast("bigint").alias("sampled_images"), F.sum(image).alias("_cost")
    )
    mean = F.coalesce(F.try_divide(F.col("_cost"), F.col("sampled_images")), F.lit(0)).cast("decimal(24,12)")
    total = (F.col("text_cost_per_request") + mean).cast("decimal(24,12)") * F.col("image_count").cast("decimal(12,0)")
    return counts.join(sample, by, "left").select(
        *by,
        "image_count",
        F.coalesce("sampled_images", F.lit(0)).cast("bigint").alias("sampled_images"),
        F.round(F.col("text_cost_per_request"), 6).alias("text_cost_per_request"),
        F.round(mean, 6).alias("avg_cost_per_image"),
        F.round(total, 4).alias("estimated_cost"),
    )


def estimate_against_actual(estimates: DataFrame, summaries: DataFrame, by: Sequence[str] = ("evaluation_id",)) -> DataFrame:
    """Estimated and actual cost per run, and their difference; a run without results has no actual cost."""
    actual = summaries.select(*by, "actual_cost")
    return estimates.join(actual, list(by), "left").withColumn(
        "difference", F.round(F.col("actual_cost") - F.col("estimated_cost"), 4)
    )


def selected_counts(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Runs with ``image_count``, the images their selection takes.

    ``runs`` has dataset_id, mode, limit and image_ids.  A manual choice counts
    the ids it lists, a random one its limit but no more than the dataset holds;
    anything else, or a choice without its list or limit, takes the whole dataset.
    """
    sizes = images.groupBy("dataset_id").agg(F.count("*").cast("bigint").alias("_held"))
    held = F.coalesce("_held", F.lit(0).cast("bigint"))
    chosen = (
        F.when((F.col("mode") == "manual") & F.col("image_ids").isNotNull(), F.size("image_ids").cast("bigint"))
        .when((F.col("mode") == "random") & F.col("limit").isNotNull(), F.least(F.col("limit").cast("bigint"), held))
        .otherwise(held)
    )
    return runs.join(sizes, "dataset_id", "left").withColumn("image_count", chosen).drop("_held")


def selection_estimates(runs: DataFrame, images: DataFrame) -> DataFrame:
    """The fixed-size estimate of every run over the images it selects.

    A run whose model has no ``pricing`` costs 0 for 0 images and says why in ``fault``.
    """
    counted = selected_counts(runs, images)
    priced = F.col("pricing").isNotNull()
    guess = rough_estimate("pricing", F.col("image_count"))
    zero = F.lit(0)
    return counted.withColumn("_guess", guess).select(
        *runs.columns,
        F.when(priced, F.col("image_count")).otherwise(zero).cast("bigint").alias("image_count"),
        F.when(priced, F.col("_guess.estimated_cost")).otherwise(zero).alias("estimated_cost"),
        F.when(priced, F.col("_guess.avg_cost_per_image")).otherwise(zero).alias("avg_cost_per_image"),
        F.when(~priced, F.lit(NO_PRICING)).alias("fault"),
    )

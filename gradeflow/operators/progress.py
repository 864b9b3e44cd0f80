"""Progress of runs and of dataset processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions.text import as_col, half_up_ratio
from gradeflow.operators.joins import first_by
from gradeflow.operators.ordering import running_index, trailing

LOG_LINES = 5
STORED_PROCESSING_ERRORS = 10
STALE_MINUTES = 2


def progress_log(results: DataFrame, by: str, completed_at: str, result_id: str, filename: str) -> DataFrame:
    """For every finished image: "k/n: file", whole percent, and the last five lines.

    Positions come from a range-partitioned order, so one huge run is spread
    over many tasks.
    """
    numbered = running_index(
        results.select(by, completed_at, result_id, filename), [by], [completed_at, result_id],
        index="completed", total="total",
    )
    line = F.concat(
        F.col("completed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(": "), F.col(filename)
    )
    # The fraction is taken first: 29 of 100 shows as 28 %, as in the progress bar.
    percent = F.floor(F.col("completed") / F.col("total") * 100).cast("bigint")
    logged = numbered.select("*", line.alias("line"), percent.alias("progress"))
    return trailing(logged, [by], F.col("line"), "latest_images", LOG_LINES, index="completed")


def eta_seconds(latency_ms: Column, completed: Column, remaining: Column, concurrency: Column) -> Column:
    """Average time per image times images left over the number of parallel calls, one decimal.

    NULL until a first full round of ``concurrency`` images is done.
    """
    eta = half_up_ratio(latency_ms * remaining, completed * concurrency * 1000, scale=1)
    return F.when((completed >= concurrency) & (latency_ms > 0), eta)


def run_progress(results: DataFrame, runs: DataFrame, by: str = "evaluation_id") -> DataFrame:
    """Per run: completed, total, percent, mean latency and time left.

    ``results`` has latency_ms; ``runs`` has total_images and concurrency.
    """
    done = results.groupBy(by).agg(
        F.count("*").cast("bigint").alias("completed"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).cast("bigint").alias("latency_ms"),
    )
    counts = runs.join(done, by, "left").fillna(0, ["completed", "latency_ms"])
    completed, total = F.col("completed"), F.col("total_images")
    return counts.select(
        by,
        "completed",
        "total_images",
        F.coalesce(F.floor(F.try_divide(completed, total) * 100), F.lit(0)).cast("bigint").alias("progress"),
        half_up_ratio(F.col("latency_ms"), completed, scale=1).alias("mean_latency_ms"),
        eta_seconds(F.col("latency_ms"), completed, total - completed, F.col("concurrency")).alias("eta_seconds"),
    )


def stale_runs(runs: DataFrame, results: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Running runs without a new result for ``minutes``; a run without any counts from its start."""
    last = results.groupBy("evaluation_id").agg(F.max("completed_at").alias("_last"))
    cutoff = now - F.expr(f"INTERVAL {minutes} MINUTES")
    return (
        runs.filter(F.col("status") == "running").join(last, "evaluation_id", "left")
        .withColumn("last_activity", F.coalesce("_last", "created_at")).drop("_last")
        .filter(F.col("last_activity") < cutoff)
    )


def processing_progress(processed: Column | str, total: Column | str) -> Column:
    """Percent of files processed, two decimals; 0 when there are none."""
    return half_up_ratio(as_col(processed), as_col(total), scale=2, factor=100)


def processing_outcome(images: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Dataset status after a processing pass, with its first error lines.

    ``images`` has status 'completed' or 'failed' and processing_error.
    """
    counts = images.groupBy(by).agg(
        F.count("*").cast("bigint").alias("total_files"),
        F.count_if(F.col("processing_status") == "completed").cast("bigint").alias("processed_files"),
        F.count_if(F.col("processing_status") == "failed").cast("bigint").alias("failed_files"),
    )
    failed = images.filter((F.col("processing_status") == "failed") & F.col("processing_error").isNotNull())
    line = F.concat(F.col("filename"), F.lit(": "), F.col("processing_error"))
    lines = failed.select(by, "image_id", line.alias("_line"))
    head = (
        first_by(lines, [by], ["image_id"], keep=STORED_PROCESSING_ERRORS)
        .groupBy(by).agg(F.array_sort(F.collect_list(F.struct("image_id", "_line"))).alias("_head"))
    )
    return counts.join(head, by, "left").select(
        by, "total_files", "processed_files", "failed_files",
        F.when(F.col("failed_files") == 0, "completed").otherwise("failed").alias("processing_status"),
        processing_progress("processed_files", "total_files").alias("progress_percent"),
        F.coalesce(F.col("_head._line"), F.array().cast("array<string>")).alias("processing_errors"),
    )

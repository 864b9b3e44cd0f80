"""Checks on files before they are taken up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gradeflow.functions.paths import MAX_UPLOAD_BYTES, upload_error
from gradeflow.functions.text import half_up_ratio
from gradeflow.operators.joins import first_by

SHOWN_FILES = 3
_MB = 1024 * 1024


def rejected_uploads(files: DataFrame) -> DataFrame:
    """Files that are no images, each with the reason as "name: reason"."""
    reason = upload_error("filename", "content_type")
    return files.withColumn("reason", reason).filter(F.col("reason").isNotNull()).withColumn(
        "message", F.concat(F.col("filename"), F.lit(": "), F.col("reason"))
    )


def oversize_reports(
    files: DataFrame, by: Sequence[str] = ("dataset_id",), order: str = "file_id", limit: int = MAX_UPLOAD_BYTES
) -> DataFrame:
    """Message per upload with files over the limit, naming the first three."""
    by = list(by)
    large = files.filter(F.col("file_size") > limit)
    size = F.format_string("%.1f", half_up_ratio(F.col("file_size").cast("bigint"), F.lit(_MB), scale=1))
    name = F.concat(F.col("filename"), F.lit(" ("), size, F.lit("MB)"))
    counts = large.groupBy(*by).agg(F.count("*").cast("bigint").alias("oversized"))
    head = (
        first_by(large.select(*by, F.col(order).alias("_order"), name.alias("_name")), by, ["_order"], SHOWN_FILES)
        .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_order", "_name"))).alias("_head"))
    )
    more = F.col("oversized") - SHOWN_FILES
    message = F.concat(
        F.col("oversized").cast("string"),
        F.lit(f" file(s) exceed {limit / _MB:.0f}MB limit: "),
        F.array_join(F.col("_head._name"), ", "),
        F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""),
    )
    return counts.join(head, by).select(*by, "oversized", message.alias("message"))


def within_size(files: DataFrame, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Files up to the limit; the others are left out of the upload."""
    return files.filter(F.col("file_size") <= limit)

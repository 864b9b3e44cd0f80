"""Duplicate images: groups, cleanup plan and upload check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.operators.joins import first_by, salted_lookup

GROUP = ("dataset_id", "filename")


def duplicate_groups(images: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Groups with more than one image."""
    return images.groupBy(*by).agg(F.count("*").cast("bigint").alias("copies")).filter(F.col("copies") > 1)


def kept_images(images: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """The newest image per group, lowest id on a tie; each task sends one per group."""
    slim = images.select(*by, "image_id", "uploaded_at")
    return first_by(slim, by, [F.col("uploaded_at").desc(), F.col("image_id")])


def cleanup_plan(images: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Images to delete: all but the newest of each group.

    Joined on the unique image id, so a group with very many copies is spread.
    """
    return images.join(kept_images(images, by).select("image_id"), "image_id", "left_anti")


def after_cleanup(images: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    return images.join(kept_images(images, by).select("image_id"), "image_id", "left_semi")


def check_uploads(uploads: DataFrame, images: DataFrame, order: Column) -> DataFrame:
    """Mark uploads whose name is taken, in the dataset or by an earlier upload of the batch.

    ``order`` gives the place of a file in its batch and must be unique.
    """
    taken = images.select(*GROUP).distinct().withColumn("_taken", F.lit(True))
    first = uploads.groupBy(*GROUP).agg(F.min(order).alias("_first"))
    known = first.join(taken, list(GROUP), "left")
    marked = salted_lookup(uploads.withColumn("_place", order), known, GROUP, "left")
    clash = F.col("_taken").isNotNull() | (F.col("_place") != F.col("_first"))
    error = F.when(clash, F.lit("Duplicate file (already exists in dataset)"))
    return marked.withColumn("error", error).drop("_taken", "_place", "_first")

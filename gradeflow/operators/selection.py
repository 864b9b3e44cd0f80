"""Which images an evaluation runs on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeflow.session import freeze

_HEAD_DIGITS = 3
_SLICES = 16**_HEAD_DIGITS  # of the hash range


def evaluable_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with an annotation, skipped ones included, that did not fail processing."""
    usable = images.filter(F.col("processing_status") != "failed")
    return usable.join(annotations, "image_id")


def _hash_order(image_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(image_id).cast("string")))


def sample_exact(
    images: DataFrame, quota: Column, seed: int, by: Sequence[str] = (), image_id: str = "image_id"
) -> DataFrame:
    """Exactly ``quota`` random images per group, the same ones for the same seed.

    ``quota`` may use ``_total``, the number of images in the group.  Images are
    ordered by a hash of seed and id, and a group is cut at its threshold: the
    hash and id at which its quota ends.  Counts per leading digits of the hash
    tell in which slice that is; only this slice is ranked; then one filter
    takes the images up to the threshold.  No group is sorted as a whole, and
    at most ``_SLICES`` counts of a group meet in a window.

    Slices and thresholds, one row a group, are written as tables.  Spark then knows
    their size before it plans the joins: few groups are broadcast and no image is
    shuffled by its group.  Where they are too many for that, no group is a large
    part of the images, or adaptive execution splits it.
    """
    # A struct key also holds groups whose name is NULL.  Without groups the key is
    # empty text, but no literal: a constant key would turn the join into a product.
    group = F.struct(*by) if by else F.substring("_hash", 33, 1)
    keyed = images.withColumn("_hash", _hash_order(image_id, seed)).withColumn("_group", group)
    head = F.conv(F.substring("_hash", 1, _HEAD_DIGITS), 16, 10).cast("int")
    counts = keyed.groupBy("_group", head.alias("_slice")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_group")
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_total", F.sum("_n").over(whole)).withColumn("_upto", F.sum("_n").over(upto))
    # The slice in which the quota ends; a quota of the whole group or more ends in its last one.
    wanted = F.least(quota, F.col("_total"))
    ends = freeze(placed.filter((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_n") < wanted)).select(
        "_group", "_slice", (wanted - F.col("_upto") + F.col("_n")).alias("_take")
    ), "slices")
    edge = keyed.select("_group", head.alias("_slice"), "_hash", F.col(image_id).alias("_id")).join(ends, ["_group", "_slice"])
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_hash", "_id"))
    last = freeze(edge.withColumn("_rank", rank).filter(F.col("_rank") == F.col("_take")).select(
        "_group", F.struct("_hash", "_id").alias("_last")
    ), "thresholds")
    chosen = keyed.join(last, "_group").filter(F.struct(F.col("_hash"), F.col(image_id).alias("_id")) <= F.col("_last"))
    return chosen.select(*images.columns)


def select_random_count(images: DataFrame, count: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """``count`` random images (per group); a count of 0 or less means all."""
    if count <= 0:
        return images
    return sample_exact(images, F.lit(count), seed, by)


def select_random_percent(images: DataFrame, percent: float, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """``percent`` of the images (per group), rounded up; 0 or less means all."""
    if percent <= 0:
        return images
    return sample_exact(images, F.ceil(F.col("_total") * F.lit(percent) / F.lit(100.0)), seed, by)


def select_manual(images: DataFrame, chosen: DataFrame | Sequence) -> DataFrame:
    """Images with the given ids; an empty list means all."""
    if not isinstance(chosen, DataFrame):
        if not chosen:
            return images
        id_type = images.schema["image_id"].dataType
        chosen = images.sparkSession.createDataFrame([(i,) for i in chosen], f"image_id {id_type.simpleString()}")
    return images.join(chosen.select("image_id").distinct(), "image_id", "left_semi")


def select_images(images: DataFrame, config: dict | None, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Selection by configuration: mode all, random_count, random_percent or manual."""
    config = config or {}
    mode = config.get("mode", "all")
    if mode == "random_count":
        return select_random_count(images, config.get("count", 0), seed, by)
    if mode == "random_percent":
        return select_random_percent(images, config.get("percent", 0), seed, by)
    if mode == "manual":
        return select_manual(images, config.get("image_ids", []))
    return images


def remaining_images(selected: DataFrame, results: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Selected images without any result yet; a row that ended in an error counts as done."""
    return selected.join(results.select(*keys), list(keys), "left_anti")


def pending_images(images: DataFrame) -> DataFrame:
    return images.filter(F.col("processing_status") == "pending")


def evaluation_setup_error(selected_count: Column) -> Column:
    """Message of a run that has nothing to do, else NULL."""
    return F.when(
        selected_count == 0, F.lit("No annotated images in dataset (or selection criteria matched none)")
    )

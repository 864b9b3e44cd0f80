"""Import, export and progress of ground-truth annotations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions.answers import answer_text, is_blank_label, validate_label
from gradeflow.functions.text import strip
from gradeflow.operators.joins import merge_by_key
from gradeflow.schemas import ANSWER, READY_STATES
from gradeflow.session import freeze

REQUIRED_COLUMNS = ("image_filename", "annotation_value")
MAX_STORED_ERRORS = 1000


def missing_columns_error(columns: Iterable[str]) -> str | None:
    """Message for an import without its required columns, else None."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(columns))
    return f"Missing columns: {', '.join(missing)}" if missing else None


@dataclass
class ImportResult:
    """Outcome of an import; every part is derived from ``outcomes``."""

    outcomes: DataFrame  # (file,) row_no, image_id, outcome, error, answer
    latest: DataFrame  # image_id, answer: the last valid row per image

    def counters(self) -> DataFrame:
        """processed, created, updated, skipped, error_count, as one row."""
        names = {"created": "created", "updated": "updated", "skipped": "skipped", "error": "error_count"}
        return self.outcomes.agg(
            F.count("*").cast("bigint").alias("processed"),
            *[F.count_if(F.col("outcome") == k).cast("bigint").alias(v) for k, v in names.items()],
        )

    def errors(self) -> DataFrame:
        place = [c for c in ("file", "row_no") if c in self.outcomes.columns]
        return self.outcomes.filter(F.col("outcome") == "error").select(*place, "error")

    def stored_errors(self, limit: int = MAX_STORED_ERRORS) -> DataFrame:
        """The first errors by file and row number, at most ``limit``."""
        errors = self.errors()
        return errors.orderBy(*errors.columns[:-1]).limit(limit)

    def applied(self, annotations: DataFrame, annotator_id: str) -> DataFrame:
        """Annotations after the import; an update leaves the skipped and flagged marks."""
        changed = self.latest.withColumnRenamed("answer", "_answer")
        merged = annotations.join(changed, "image_id", "full_outer")
        hit = F.col("_answer").isNotNull()
        return merged.select(
            "image_id",
            F.when(hit, F.col("_answer")).otherwise(F.col("answer")).alias("answer"),
            F.coalesce("is_skipped", F.lit(False)).alias("is_skipped"),
            F.coalesce("is_flagged", F.lit(False)).alias("is_flagged"),
            F.when(hit, F.lit(annotator_id)).otherwise(F.col("annotator_id")).alias("annotator_id"),
        )

    def all_or_nothing(self, annotations: DataFrame, annotator_id: str) -> DataFrame:
        """Annotations after a confirmed import: unchanged if any row had an error."""
        failed = self.errors().limit(1).count() > 0
        kept = annotations.select("image_id", "answer", "is_skipped", "is_flagged", "annotator_id")
        return kept if failed else self.applied(annotations, annotator_id)


def import_annotations(
    rows: DataFrame,
    images: DataFrame,
    annotations: DataFrame,
    question_type: Column | str,
    options: Column | None = None,
) -> ImportResult:
    """Check import rows against the images of a dataset.

    ``rows`` has image_filename, annotation_value and a row_no that is unique,
    or unique within ``file`` where rows carry one; files apply in the order of
    their names.  Of several
    images with one file name the one with the lowest id is meant.  The image is
    looked up before the value, so a blank value for an unknown image is an
    error.  Rows that name the same image apply in row order, the last one wins.
    """
    place = [c for c in ("file", "row_no") if c in rows.columns]
    known = images.groupBy("filename").agg(F.min("image_id").alias("image_id"))
    has_annotation = annotations.select("image_id", F.lit(True).alias("_annotated"))
    known = known.join(has_annotation, "image_id", "left")

    named = rows.withColumn("filename", strip("image_filename"))
    found = named.join(known, "filename", "left")  # grouped by image next, so a hot name can be split
    checked = found.withColumn("_check", validate_label("annotation_value", question_type, options))
    missing = F.col("image_id").isNull()
    blank = is_blank_label("annotation_value")
    kind = (
        F.when(missing, "error").when(blank, "skipped").when(F.col("_check.error").isNotNull(), "error")
        .otherwise("valid")
    )
    error = F.when(
        missing, F.concat(F.lit("Image not found: "), F.coalesce(F.col("filename"), F.lit("nan")))
    ).when(~blank, F.col("_check.error"))
    checked = checked.select(
        *place, "image_id", kind.alias("_kind"), error.alias("error"),
        F.when(kind == "valid", F.col("_check.answer")).alias("answer"),
        F.coalesce("_annotated", F.lit(False)).alias("_annotated"),
    )
    # Counters, errors and the upsert all start from here: look up and check once.
    checked = freeze(checked, "import")
    # Partial aggregates per image, so a file named in a third of the rows is no burden.
    valid = checked.filter(F.col("_kind") == "valid")
    per_image = valid.groupBy("image_id").agg(
        F.min(F.struct(*place)).alias("_first"),
        F.max_by("answer", F.struct(*place)).alias("answer"),
        F.any_value("_annotated").alias("_annotated"),
    )
    # Only the first valid row of a new image creates; join on its unique place.
    creators = per_image.filter(~F.col("_annotated")).select(
        "_first.*", F.lit(True).alias("_creates")
    )
    outcome = F.when(F.col("_kind") != "valid", F.col("_kind")).otherwise(
        F.when(F.col("_creates"), "created").otherwise("updated")
    )
    outcomes = checked.join(creators, place, "left").select(
        *place, "image_id", outcome.alias("outcome"), "error", "answer"
    )
    return ImportResult(outcomes, per_image.select("image_id", "answer"))


def mismatched_dataset_names(rows: DataFrame, dataset_name: str) -> DataFrame:
    """Dataset names in an import that differ from the target (a warning, not an error)."""
    return (
        rows.select("dataset_name").filter(F.col("dataset_name").isNotNull()).distinct()
        .filter(strip("dataset_name") != dataset_name)
    )


def duplicate_filename_warnings(rows: DataFrame) -> DataFrame:
    """File names that occur more than once in an import, with their number of rows."""
    return (
        rows.groupBy(strip("image_filename").alias("filename")).agg(F.count("*").cast("bigint").alias("rows"))
        .filter((F.col("rows") > 1) & F.col("filename").isNotNull())
    )


def import_preview(result: ImportResult) -> DataFrame:
    """What an import would do: total, valid, skipped and error rows."""
    return result.counters().select(
        F.col("processed").alias("total"),
        (F.col("created") + F.col("updated")).alias("valid"),
        "skipped",
        F.col("error_count").alias("errors"),
        (F.col("error_count") == 0).alias("can_confirm"),
    )


def save_annotations(annotations: DataFrame, updates: DataFrame, datasets: DataFrame, images: DataFrame) -> DataFrame:
    """Full overwrite by image; updates of datasets that are not ready are refused."""
    ready = datasets.filter(F.col("processing_status").isin(*READY_STATES)).select("dataset_id")
    allowed = images.join(ready, "dataset_id", "left_semi").select("image_id")
    return merge_by_key(annotations, updates.join(allowed, "image_id", "left_semi"), ["image_id"])


def annotation_listing(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotation state; annotated means a row exists, even a skipped one."""
    marks = annotations.withColumn("_exists", F.lit(True))
    return images.join(marks, "image_id", "left").select(
        *[images[c] for c in images.columns if c != "image_id"],
        "image_id",
        F.coalesce("_exists", F.lit(False)).alias("is_annotated"),
        "answer",
        F.coalesce("is_skipped", F.lit(False)).alias("is_skipped"),
        F.coalesce("is_flagged", F.lit(False)).alias("is_flagged"),
    )


def export_annotations(images: DataFrame, annotations: DataFrame, question_type: Column | str) -> DataFrame:
    """One row per image of a dataset, annotated or not."""
    return images.join(annotations.select("image_id", "answer"), "image_id", "left").select(
        "image_id",
        F.col("filename").alias("image_filename"),
        answer_text(F.coalesce("answer", F.lit(None).cast(ANSWER)), question_type).alias("annotation_value"),
        F.col("dataset_id").alias("dataset_name"),
    )


def annotation_stats(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per dataset: total, annotated, skipped, flagged, remaining and progress in percent."""
    counts = (
        images.select("image_id", "dataset_id")
        .join(annotations.select("image_id", "is_skipped", "is_flagged"), "image_id", "left")
        .groupBy("dataset_id")
        .agg(
            F.count("*").cast("bigint").alias("total"),
            F.count_if(~F.col("is_skipped")).cast("bigint").alias("annotated"),
            F.count_if(F.col("is_skipped")).cast("bigint").alias("skipped"),
            F.count_if(F.col("is_flagged")).cast("bigint").alias("flagged"),
        )
    )
    done = F.col("annotated") + F.col("skipped")
    return counts.select(
        "*",
        (F.col("total") - done).alias("remaining"),
        F.coalesce(F.try_divide(done * 100.0, F.col("total")), F.lit(0.0)).alias("progress_percent"),
    )


def next_unannotated(images: DataFrame, annotations: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Oldest image without an annotation, per (ready) dataset."""
    open_images = images.select("image_id", "dataset_id", "filename", "uploaded_at").join(
        annotations.select("image_id"), "image_id", "left_anti"
    )
    if datasets is not None:
        ready = datasets.filter(F.col("processing_status").isin(*READY_STATES)).select("dataset_id")
        open_images = open_images.join(ready, "dataset_id", "left_semi")
    oldest = F.min(F.struct("uploaded_at", "image_id", "filename")).alias("_next")
    return open_images.groupBy("dataset_id").agg(oldest).select("dataset_id", "_next.*")

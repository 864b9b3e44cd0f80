"""Scheduled labelling as batch steps: discover, take up, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions.paths import SCAN_EXTENSIONS, clash_name, destination_path, is_scannable
from gradeflow.functions.text import as_col
from gradeflow.operators.joins import first_by, salted_lookup
from gradeflow.operators.ordering import page, running_index

OVERLAP = "INTERVAL 1 MINUTE"


def scan_files(
    files: DataFrame,
    prefix: str | None = None,
    high_water: Column | None = None,
    extensions: tuple[str, ...] = SCAN_EXTENSIONS,
) -> DataFrame:
    """New files of a folder: no folder markers, known extensions, created after the mark.

    The mark is taken one minute back, strictly.  ``files`` has object_name and
    time_created.  Every condition is a plain filter and reaches the scan.
    """
    name = F.col("object_name")
    found = files.filter(~name.endswith("/") & is_scannable(name, extensions))
    if prefix is not None:
        found = found.filter(name.startswith(prefix) & (name != prefix))
    if high_water is not None:
        found = found.filter(F.col("time_created") > high_water - F.expr(OVERLAP))
    return found


def by_arrival(found: DataFrame, tie: str = "full_path") -> DataFrame:
    """Found files with their ``position`` in the order they came, oldest first from 1; ``tie`` tells equal times apart."""
    return running_index(found.withColumn("_scan", F.lit(0)), ["_scan"], ["time_created", tie]).drop("_scan")


def new_paths_only(found: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Drop files that the overlap finds again, and repeats within a scan.

    Where files carry a job, every job keeps its own: the key is job and path.
    """
    keys = [c for c in ("job_id", "full_path") if c in found.columns and c in known_paths.columns] or ["full_path"]
    fresh = found.join(known_paths.select(*keys), keys, "left_anti")
    own = ["job_id", "full_path"] if "job_id" in found.columns else ["full_path"]
    return first_by(fresh, own, ["time_created"])


def take_up(files: DataFrame, images: DataFrame) -> DataFrame:
    """Image rows for found files; a name that is taken gets a mark from its path.

    A name is taken by an image of the dataset or by an earlier file of the scan.
    """
    keys = ["dataset_id", "filename"]
    taken = images.select(*keys).distinct().withColumn("_taken", F.lit(True))
    first = files.groupBy(*keys).agg(F.min(F.struct("time_created", "full_path")).alias("_first"))
    known = first.join(taken, keys, "left").select(*keys, "_taken", F.col("_first.full_path").alias("_first_path"))
    marked = files.join(known, keys, "left")
    clash = F.col("_taken").isNotNull() | (F.col("full_path") != F.col("_first_path"))
    return named_image(marked, clash).drop("_taken", "_first_path")


def named_image(files: DataFrame, clash: Column) -> DataFrame:
    """Image rows of files: original_name, the name with a mark from the path where it is taken, storage_path."""
    name = F.when(clash, clash_name("filename", "full_path")).otherwise(F.col("filename"))
    return files.withColumn("original_name", F.col("filename")).withColumn("filename", name).withColumn(
        "storage_path", destination_path("project_id", "dataset_id", "filename")
    )


def run_counters(
    discovered: DataFrame, ingested: DataFrame, results: DataFrame, by: str = "run_id", known: DataFrame | None = None
) -> DataFrame:
    """Per run: discovered, already known, ingested, labelled, and failures counted apart by stage.

    ``known`` holds the discovered files that need no work: repeats within the
    scan and files with a result of an earlier run.
    """
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(by).agg(F.count("*").cast("bigint").alias(name))

    labelled = results.groupBy(by).agg(
        F.count_if(F.col("error").isNull()).cast("bigint").alias("images_labeled"),
        F.count_if(F.col("error").isNotNull()).cast("bigint").alias("images_failed"),
    )
    counts = count(discovered, "images_discovered").join(count(ingested, "images_ingested"), by, "left").join(labelled, by, "left")
    if known is not None:
        counts = counts.join(count(known, "already_known"), by, "left")
    counts = counts.fillna(0, [c for c in counts.columns if c != by])
    spared = F.col("already_known") if known is not None else F.lit(0)
    return counts.withColumn("ingest_failed", F.col("images_discovered") - spared - F.col("images_ingested"))


def job_totals(runs: DataFrame, by: str = "job_id") -> DataFrame:
    """Totals of a job over its runs, its success rate in whole percent included."""
    totals = runs.groupBy(by).agg(
        F.count("*").cast("bigint").alias("total_runs"),
        F.sum("images_ingested").cast("bigint").alias("total_images_processed"),
        F.sum("images_labeled").cast("bigint").alias("total_images_labeled"),
        F.sum("images_failed").cast("bigint").alias("total_errors"),
    )
    return totals.withColumn("success_rate", success_rate("total_images_labeled", "total_images_processed"))


def success_rate(labelled: Column | str, processed: Column | str) -> Column:
    """Whole percent, half up; 0 when nothing was processed."""
    labelled, processed = as_col(labelled), as_col(processed)
    doubled = labelled * 200 + processed
    return F.when(
        processed > 0, F.floor((doubled - F.pmod(doubled, processed * 2)) / (processed * 2))
    ).otherwise(F.lit(0)).cast("bigint")


def high_water_mark(discovered: DataFrame, by: str = "job_id") -> DataFrame:
    """Latest creation time per job, the mark for its next scan."""
    return discovered.groupBy(by).agg(F.max("time_created").alias("last_processed_timestamp"))


def duration_seconds(started: Column | str, completed: Column | str) -> Column:
    """Whole seconds, cut off."""
    return F.timestamp_diff("SECOND", as_col(started), as_col(completed)).cast("bigint")


def labelling_jobs(
    jobs: DataFrame, datasets: DataFrame, results: DataFrame, images: DataFrame, project_id=None, time: str = "created_at"
) -> DataFrame:
    """Jobs with dataset name and the thumbnail of their latest result that has an image, newest first.

    A result without an image is passed over; a job without any, or without a
    dataset, keeps its row.  The latest result is an aggregate: a job with a third
    of all results sends one row per task, and only these rows look their image up.
    """
    if project_id is not None:
        jobs = jobs.filter(F.col("project_id") == project_id)
    latest = results.filter(F.col("image_id").isNotNull()).groupBy("job_id").agg(
        F.max(F.struct(time, "result_id", "image_id")).alias("_latest")
    ).select("job_id", F.col("_latest.image_id").alias("latest_image_id"))
    shown = jobs.select("job_id").join(latest, "job_id").join(
        images.select(F.col("image_id").alias("latest_image_id"), "thumbnail"), "latest_image_id", "left"
    )
    named = jobs.join(datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")
    return named.join(shown, "job_id", "left").orderBy(F.col(time).desc(), "job_id")


def runs_page(runs: DataFrame, job_id, skip: int = 0, limit: int = 50) -> DataFrame:
    """Runs of one job with their length, newest first; filtered at the scan."""
    mine = runs.filter(F.col("job_id") == job_id)
    timed = mine.withColumn("duration_seconds", duration_seconds("started_at", "completed_at"))
    return page(timed, [F.col("started_at").desc(), F.col("run_id")], skip, limit)


def results_of(results: DataFrame, job_id, run_id=None) -> DataFrame:
    """Results of one job, or of one of its runs; conditions reach the scan."""
    mine = results.filter(F.col("job_id") == job_id)
    return mine if run_id is None else mine.filter(F.col("run_id") == run_id)


def upload_totals(chunks: DataFrame, by: str = "dataset_id", order: str = "uploaded_at", tie: str = "chunk_id") -> DataFrame:
    """Files announced and uploaded in the current upload of each dataset.

    A chunk that meets status 'processing' continues the upload; any other
    status starts a new one.  The last start per dataset is an aggregate, and
    only chunks from there on are summed.  A start counts the files that were
    really uploaded, a continuation counts the files it announced.
    """
    place = F.struct(order, tie)
    starts = chunks.filter(F.col("status_before") != "processing").groupBy(by).agg(F.max(place).alias("_start"))
    current = salted_lookup(chunks, starts, [by], "left")
    live = F.col("_start").isNull() | (place >= F.col("_start"))
    counted = F.when(F.col("status_before") == "processing", F.col("announced")).otherwise(F.col("uploaded"))
    return current.filter(live).groupBy(by).agg(
        F.sum(counted).cast("bigint").alias("total_files"),
        F.sum("uploaded").cast("bigint").alias("uploaded_files"),
        F.count("*").cast("bigint").alias("chunks"),
    )

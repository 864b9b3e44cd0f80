"""Arriving files: each path once, late files included unless a delay is set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeflow.functions.paths import SCAN_EXTENSIONS
from gradeflow.operators.labelling import scan_files

DELAY = "1 minute"


def discover(
    files: DataFrame,
    prefix: str | None = None,
    delay: str | None = None,
    extensions: tuple[str, ...] = SCAN_EXTENSIONS,
) -> DataFrame:
    """New files of a stream of listings, each ``full_path`` once per job.

    Every file is found, however late, for which the state keeps every path
    (use the RocksDB state store on a cluster).  With a ``delay``, state per path
    lives only as long: a file later than that behind the newest one is missed,
    as a scan from the last mark would miss it, and a path seen again after the
    delay is found again.
    """
    found = scan_files(files, prefix, extensions=extensions)
    keys = [c for c in ("job_id", "full_path") if c in found.columns]
    if delay is None:
        return found.dropDuplicates(keys)
    return found.withWatermark("time_created", delay).dropDuplicatesWithinWatermark(keys)


def arrivals(files: DataFrame, every: str = "15 minutes", delay: str = DELAY) -> DataFrame:
    """Files and bytes per folder and interval, for watching a job."""
    return (
        files.withWatermark("time_created", delay)
        .groupBy(F.window("time_created", every), "job_id")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    )

"""Table scans and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Tables worth partitioning, and by what: listings and summaries name one run or dataset.
PARTITION_COLUMNS = {"evaluation_results": ["evaluation_id"], "labelling_results": ["job_id"]}


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; filters and columns used later reach the scan."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 64, **options: str
) -> DataFrame:
    """A database table, read in parallel ranges of a numeric key."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode="overwrite"):
    """Write Parquet, sorted within files so that row groups can be skipped.

    Rows are not gathered by partition value first: one run may hold a third of
    all rows, and each task writes its own share of it.
    """
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

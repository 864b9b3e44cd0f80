"""Pages of an ordered table that read one slice, however far in they lie.

Skipping rows of a sort sorts everything for each page.  Here the table is
written once in its order with a position, cut in folders of ``slice_rows``
positions; a page then reads the one or two folders its positions fall in.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from gradeflow.operators.ordering import running_index

SLICE_ROWS = 100_000


def write_pages(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str | Column], slice_rows: int = SLICE_ROWS) -> None:
    """Write ``df`` by key and order for :func:`read_page`.

    ``order`` must end in a column that makes the rows of a key unique.  Keys
    may be empty: then the whole table has one row of pages.  Rows stay in the
    tasks that sorted them, so a slice is written by the few tasks that hold its
    positions and a key with a third of all rows is spread like any other.
    """
    keys = list(keys)
    placed = running_index(df.withColumn("_all", F.lit(0)), ["_all"], [*keys, *order], index="_place").drop("_all")
    slices = F.floor((F.col("_place") - 1) / slice_rows).cast("bigint")
    placed.withColumn("_slice", slices).write.partitionBy("_slice").parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.schema(_written(df.schema)).parquet(f"{path}/rows")
    rows.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows")).write.parquet(f"{path}/keys")
    about = [(slice_rows, df.schema.json())]
    spark.createDataFrame(about, "slice_rows bigint, columns string").coalesce(1).write.parquet(f"{path}/about")


def read_page(spark: SparkSession, path: str, skip: int = 0, limit: int = 50, key: Mapping[str, object] | None = None) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + limit`` of a key, in order; none past the end or for an unknown key.

    ``key`` gives the value of every key column; None is the null key.
    """
    about = spark.read.parquet(f"{path}/about").first()
    schema = StructType.fromJson(json.loads(about["columns"]))
    index = spark.read.parquet(f"{path}/keys")
    for name, value in (key or {}).items():
        index = index.filter(F.col(name).eqNullSafe(F.lit(value)))
    found = index.select("_first", "_rows").take(2)  # one key
    if len(found) > 1:
        raise ValueError(f"a page belongs to one key of {[c for c in index.columns if c not in ('_first', '_rows')]}")
    first, held = (found[0]["_first"] or 1, found[0]["_rows"]) if found else (1, 0)
    low, high = first + skip, first + min(held, skip + limit) - 1
    size = about["slice_rows"]
    rows = spark.read.schema(_written(schema)).parquet(f"{path}/rows")
    mine = rows.filter(F.col("_slice").between((low - 1) // size, (high - 1) // size) & F.col("_place").between(low, high))
    return mine.orderBy("_place").select(*schema.names)


def _written(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("_place", LongType()).add("_slice", LongType())

"""Positions and running values over an order, without one task per group.

A window over a whole group puts the group into one task.  Here rows are range
partitioned by (group, order), so a group that holds a third of the data is
spread over a third of the partitions; only per-partition totals meet in a
window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeflow.session import freeze


def running_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    index: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each key 1..n in order.

    ``order`` must end in a column that makes rows unique.  ``total`` names an
    optional column with n.  The sorted rows are frozen once, because range
    boundaries come from a sample and are read twice.
    """
    keys, order = list(keys), list(order)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = (
        df.repartitionByRange(partitions, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        # The id is (partition << 33) + position in the partition.
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = freeze(placed).withColumn("_part", F.shiftright("_id", 33))
    # One row per key and partition it touches: at most keys + partitions rows.
    pieces = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = pieces.select(
        *keys,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(whole).alias(total)] if total else []),
    )
    numbered = placed.join(offsets, [*keys, "_part"])
    return numbered.withColumn(
        index, (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("bigint")
    ).drop("_id", "_part", "_first", "_before")


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    name: str,
    size: int,
    index: str = "position",
    block: int = 100_000,
) -> DataFrame:
    """The last ``size`` values up to each row, in order, as an array.

    ``index`` numbers the rows of a key from 1.  Rows are grouped in blocks of
    ``block`` positions, and the last rows of a block are repeated as context
    at the head of the next, so no group grows with the data.
    """
    keys = list(keys)
    own = F.floor((F.col(index) - 1) / block)
    nearest_end = F.pmod(F.col(index) - 1, F.lit(block)) >= block - (size - 1)
    blocks = F.when(nearest_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_value", value).withColumn("_block", F.explode(blocks))
    last = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(-(size - 1), 0)
    return (
        spread.withColumn(name, F.collect_list("_value").over(last))
        .filter(F.col("_block") == own)
        .drop("_value", "_block")
    )


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    """One page of rows; ``order`` must be total for the page to be stable."""
    return df.orderBy(*order).offset(skip).limit(limit)

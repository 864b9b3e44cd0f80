"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the links: equal marks mean an unchanged table."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node; root is the smallest node of its component.

    Large stars move a node's larger neighbours to its smallest one, small stars
    its smaller ones; both are grouped minima and joins, so a node with very many
    links is summed per task first.  Every round is a written table, so lineage
    stays short and lost executors cost one round at most.  Links to itself and
    repeated links don't matter; null ends are ignored.
    """
    given = links.where(F.col(a) != F.col(b))
    edges = stored(given.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "small_star")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

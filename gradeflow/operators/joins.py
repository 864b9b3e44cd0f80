"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gradeflow.session import freeze

# So many of the most frequent keys are split: a list of fixed length at every size.
SPLIT_KEYS = 256
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], split_keys: int = SPLIT_KEYS) -> DataFrame:
    """The ``split_keys`` most frequent keys; counts are partial before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.orderBy(F.col("_n").desc(), *keys).limit(split_keys).select(*keys)


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    split_keys: int = SPLIT_KEYS,
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` that holds each key once.

    For joins whose result is used by the same keys again, where adaptive
    execution does not split a hot key.  Rows of the most frequent keys are
    spread over ``salts`` tasks by their other columns, and only the lookup
    rows of those keys are repeated.  ``how`` is inner or left.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(rows, keys, split_keys).withColumn("_hot", F.lit(True)))  # split_keys rows
    zero = F.lit(0).cast("bigint")
    others = [f.name for f in rows.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*others or [zero]), F.lit(salts))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(zero)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(zero, F.lit(salts - 1).cast("bigint"))).otherwise(F.array(zero))
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence, keep: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``keep`` rows per key.

    Spark cuts each task's rows of a key to ``keep`` before the shuffle, so a
    hot key sends ``keep`` rows per task and no more.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= keep)
    return kept if rank else kept.drop(name)


def merge_by_key(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: rows of ``updates`` replace rows of ``base`` with the same key."""
    return base.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def delete_cascade(
    parents: DataFrame,
    doomed: DataFrame,
    key: str,
    children: Sequence[tuple[str, DataFrame, str, str]],
) -> dict[str, DataFrame]:
    """Remove parents by key and, level by level, the rows that belong to them.

    ``children`` lists (name, table, foreign key, own key) from the top down; each belongs to the
    one before it.  Several children of one parent, or references that go round, are
    for :func:`cascade`.  Returns the tables that remain, "parents" included.
    """
    tables = {"parents": (parents, key)} | {name: (table, own) for name, table, _, own in children}
    links = [(name, foreign, parent) for (name, _, foreign, _), parent in zip(children, tables)]
    return cascade(tables, links, {"parents": doomed.select(key)})


def cascade(
    tables: Mapping[str, tuple[DataFrame, str]], references: Sequence[tuple[str, str, str]], doomed: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Remove rows and all that refers to them, over any graph of foreign keys.

    ``tables`` gives each table with its key column, ``references`` lists (child, foreign key, parent); a table
    may have several children and several parents, refer to itself, or be part of a cycle.  ``doomed``
    holds the keys to remove first, one column per table.  A NULL reference refers to nothing.  Tables go in the
    order of the graph, with plain joins; only those on a cycle are repeated, until a
    round finds no further row, and each round is a written table.
    """
    below = {name: {child for child, _, parent in references if parent == name} for name in tables}
    for _ in tables:  # all that can be reached
        below = {name: found.union(*(below[child] for child in found)) for name, found in below.items()}

    def following(name: str, gone: Mapping[str, DataFrame]) -> list[DataFrame]:
        """Keys of the rows of a table that refer to rows that are gone."""
        table, key = tables[name]
        return [
            table.join(gone[parent].select(F.col("_key").alias(foreign)), foreign, "left_semi").select(F.col(key).alias("_key"))
            for child, foreign, parent in references if child == name and parent in gone
        ]

    def together(parts: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, parts).filter(F.col("_key").isNotNull()).distinct()

    gone: dict[str, DataFrame] = {}
    left = dict.fromkeys(tables)
    while left:
        # A table that no other one left stands above, and those on a cycle with it.
        name = next(n for n in left if all(n not in below[m] or m in below[n] for m in left if m != n))
        cycle = [n for n in left if n == name or (n in below[name] and name in below[n])]
        begin = {n: ([doomed[n].toDF("_key")] if n in doomed else []) + following(n, gone) for n in cycle}
        found = {n: together(parts) for n, parts in begin.items() if parts}
        if found and name in below[name]:
            found = {n: freeze(keys, "doomed") for n, keys in found.items()}
            newest = found
            while newest:
                more = {n: following(n, newest) for n in cycle}
                more = {n: together(parts) for n, parts in more.items() if parts}
                more = {n: freeze(keys.join(found[n], "_key", "left_anti") if n in found else keys, "doomed") for n, keys in more.items()}
                newest = {n: keys for n, keys in more.items() if not keys.isEmpty()}
                found |= {n: found[n].unionByName(keys) if n in found else keys for n, keys in newest.items()}
        gone |= found
        for n in cycle:
            del left[n]
    return {n: table.join(gone[n].withColumnRenamed("_key", key), key, "left_anti") if n in gone else table for n, (table, key) in tables.items()}

"""Greedy batches of files by size, in file order.

A batch is closed when the next file would take it over the limit.  That makes
every batch depend on the one before it, so it is no running sum.  A block of
consecutive files, though, acts on the scan in a simple way: the size carried
into it decides where the first cut falls, and from that cut on everything is
fixed.  Blocks are summarised in parallel, the short summaries are chained, and
the blocks then replay the scan with their carry, again in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gradeflow.operators.ordering import running_index

MAX_BATCH_BYTES = 25 * 1024 * 1024
BLOCK = 50_000


def _cuts(ends: np.ndarray, carry: int | None, limit: int) -> list[int]:
    """Where batches start in a block; ``carry`` is the size of the open batch, None without one.

    ``ends`` are the running sizes of the block.
    """
    at = 0 if carry is None else int(np.searchsorted(ends, limit - carry, side="right"))
    cuts = []
    while at < len(ends):
        cuts.append(at)
        before = int(ends[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
    return cuts


def _carry_out(ends: np.ndarray, cuts: list[int]) -> int:
    """Size of the batch that is open after a block with at least one cut."""
    last = cuts[-1]
    return int(ends[-1]) - (int(ends[last - 1]) if last else 0)


def _stretches(ends: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """How a block acts on the carry: (largest carry, cuts, carry out), by rising carry.

    A carry out of -1 stands for "carry in plus the block": there is no cut.
    """
    total = int(ends[-1])
    # The first cut can only be at a file that starts within the limit.
    reach = min(len(ends), int(np.searchsorted(ends, limit, side="right")) + 1)
    found = [(limit - total, 0, -1)]
    effects: dict[int, tuple[int, int]] = {}
    for first in range(reach - 1, -1, -1):
        path, at = [], first
        while at < len(ends) and at not in effects:
            path.append(at)
            before = int(ends[at - 1]) if at else 0
            at = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        for start in reversed(path):
            before = int(ends[start - 1]) if start else 0
            cuts, out = effects[at] if at < len(ends) else (0, total - before)
            effects[start] = (cuts + 1, out)
            at = start
        top = limit - int(ends[first - 1]) if first else np.iinfo(np.int64).max
        if found[-1][1:] == effects[first]:
            found[-1] = (top, *effects[first])
        elif top > found[-1][0]:
            found.append((top, *effects[first]))
    return [stretch for stretch in found if stretch[0] >= 0]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of equal ``keys`` out of batches sorted by them; holds one stretch at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        changed = np.zeros(len(batch) - 1, dtype=bool)
        for values in columns:
            changed |= values[1:] != values[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
        for begin, end in zip(edges, edges[1:]):
            part = batch.iloc[begin:end]
            if held and any(held[-1][k].iloc[-1] != part[k].iloc[0] for k in keys):
                yield _joined(held, keys)
                held = []
            held.append(part)
    if held:
        yield _joined(held, keys)


def _joined(parts: list[pd.DataFrame], keys: list[str]) -> tuple[tuple, pd.DataFrame]:
    whole = parts[0] if len(parts) == 1 else pd.concat(parts)
    return tuple(whole[k].iloc[0] for k in keys), whole


def size_batches(
    files: DataFrame,
    by: str = "dataset_id",
    order: tuple[str, ...] = ("file_id",),
    size: str = "file_size",
    limit: int = MAX_BATCH_BYTES,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``batch_no``, 1, 2, … per ``by``; ``order`` must be unique within it.

    ``by`` and ``size`` must not be NULL.  Blocks are laid out side by side in
    sorted partitions and read as they pass, so many small datasets cost no more
    than one large one.
    """
    placed = running_index(files, [by], order, index="_position")
    placed = placed.withColumn("_block", F.floor((F.col("_position") - 1) / block))
    by_field = T.StructField(by, files.schema[by].dataType)
    keys = [by, "_block"]

    def fields(*names: str, kind: T.DataType | None = None) -> list[T.StructField]:
        return [T.StructField(name, kind or T.LongType()) for name in names]

    def in_order(df: DataFrame, *columns: str) -> DataFrame:
        return df.repartition(*columns[:-1]).sortWithinPartitions(*columns)

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (name, number), rows in _runs(batches, keys):
            ends = np.cumsum(rows["_size"].to_numpy(np.int64))
            fresh = _cuts(ends, None, limit)
            # The first block starts without an open batch and is no function of a carry.
            acts = _stretches(ends, limit) if number else []
            yield pd.DataFrame(
                {
                    by: [name], "_block": [number], "_bytes": [int(ends[-1])],
                    "_fresh_cuts": [len(fresh)], "_fresh_out": [_carry_out(ends, fresh)],
                    "_top": [[a[0] for a in acts]], "_cuts": [[a[1] for a in acts]], "_out": [[a[2] for a in acts]],
                }
            )

    summary_type = T.StructType(
        [by_field]
        + fields("_block", "_bytes", "_fresh_cuts", "_fresh_out")
        + fields("_top", "_cuts", "_out", kind=T.ArrayType(T.LongType()))
    )
    slim = placed.select(by, "_block", "_position", F.col(size).cast("bigint").alias("_size"))
    summaries = in_order(slim, by, "_block", "_position").mapInPandas(summarize, summary_type)

    # One short row per block of files passes here, never the files themselves.
    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, carry, count = None, 0, 0
        for rows in batches:
            entries = []
            for row in rows.to_dict("records"):
                if not row["_block"]:
                    entries.append((row[by], 0, 0, 0))
                    name, carry, count = row[by], row["_fresh_out"], row["_fresh_cuts"]
                    continue
                entries.append((name, row["_block"], carry, count))
                at = int(np.searchsorted(np.asarray(row["_top"], dtype=np.int64), carry, side="left"))
                count += int(row["_cuts"][at])
                carry = carry + row["_bytes"] if row["_out"][at] == -1 else int(row["_out"][at])
            yield pd.DataFrame(entries, columns=[by, "_block", "_carry", "_batches"])

    entry_type = T.StructType([by_field] + fields("_block", "_carry", "_batches"))
    entries = in_order(summaries, by, "_block").mapInPandas(chain, entry_type)

    # Every block numbers its batches from the state it is entered with.
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _runs(batches, keys):
            ends = np.cumsum(rows["_size"].to_numpy(np.int64))
            count = int(rows["_batches"].iloc[0])
            marks = np.zeros(len(rows), dtype=np.int64)
            marks[_cuts(ends, int(rows["_carry"].iloc[0]) if count else None, limit)] = 1
            yield pd.DataFrame(
                {by: rows[by].to_numpy(), "_position": rows["_position"].to_numpy(), "batch_no": count + np.cumsum(marks)}
            )

    batch_type = T.StructType([by_field] + fields("_position", "batch_no"))
    numbered = in_order(slim.join(entries, keys), by, "_block", "_position").mapInPandas(replay, batch_type)
    return placed.join(numbered, [by, "_position"]).drop("_position", "_block")

"""Records of CSV files in parallel, with line breaks inside quotes.

A task that begins in the middle of a file can't know whether it begins inside quotes.  Each
split is therefore walked under both assumptions; what a split makes of either is a map on two
states with two counts.  Composed in the order of the file, the maps say how every split begins and
what number its first record has.  Lines then pick the assumption that holds; only records of
several lines are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeflow.session import freeze

_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*+|(?:[^",][^,]*+)?+)'
#: Whether a line that begins outside, or inside, quotes ends outside of them.
_CLOSED = (re.compile(rf"{_FIELD}(?:,{_FIELD})*+").fullmatch, re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{_FIELD})*+').fullmatch)


@dataclass
class _Walk:
    """One split under one assumption about its begin: inside quotes (1) or not (0)."""

    inside: int
    records: int = 0

    def lines(self, quoted: list[tuple[int, tuple[int, int]]], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the next lines: inside quotes before, after, and the record number within the split."""
        before, at = np.empty(len(blank), np.int8), 0
        for i, ends in quoted:
            before[at : i + 1] = self.inside
            self.inside, at = ends[self.inside], i + 1
        before[at:] = self.inside
        after = np.r_[before[1:], np.int8(self.inside)]
        number = self.records + np.cumsum((before == 0) & ~blank)
        self.records = int(number[-1]) if len(number) else self.records
        return before, after, number


def _segments(batches: Iterator[pa.RecordBatch], multi_line: bool) -> Iterator[tuple]:
    """Parts of splits in order: (file, start, first line, values, quoted lines with their maps, blank lines)."""
    place, line = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
        ids = files.indices.to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            here = (files.dictionary[int(ids[lo])].as_py(), int(starts[lo]))
            if here != place:
                place, line = here, 0
            values = batch.column("value").slice(lo, hi - lo)
            if line == 0 and here[1] == 0 and (values[0].as_py() or "").startswith("\ufeff"):
                values = pa.concat_arrays([pa.array([values[0].as_py()[1:]], values.type), values.slice(1)])
            blank = pc.equal(pc.utf8_rtrim(values, "\r"), "").to_numpy(zero_copy_only=False)
            found = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist() if multi_line else []
            quoted = [(i, tuple(0 if closed(v) else 1 for closed in _CLOSED)) for i, v in zip(found, (values[i].as_py().rstrip("\r") for i in found))]
            yield (*place, line, values, quoted, blank)
            line += hi - lo


def _summary(lines: DataFrame, multi_line: bool) -> DataFrame:
    """One row per split: its end and number of records under both assumptions, and a file's first record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, int], tuple[_Walk, _Walk, list[str]]] = {}
        for file, start, _, values, quoted, blank in _segments(batches, multi_line):
            walks = out.setdefault((file, start), (_Walk(0), _Walk(1), []))
            seen = walks[0].records
            _, _, number = walks[0].lines(quoted, blank)
            walks[1].lines(quoted, blank)
            if start == 0 and seen <= 1:
                walks[2].extend(values.filter(pa.array(number == 1)).to_pylist())
        if out:
            rows = [(file, start, a.inside, b.inside, a.records, b.records, "\n".join(first).rstrip("\r") if first else None) for (file, start), (a, b, first) in out.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(list(zip(names, kinds))))

    names, kinds = ["file", "start", "end0", "end1", "n0", "n1", "first"], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return lines.mapInArrow(run, "file string, start bigint, end0 int, end1 int, n0 bigint, n1 bigint, first string")


def _composed(splits: DataFrame) -> DataFrame:
    """How each split begins (inside), the records before it, and the first record of its file.

    A split either fixes the state behind it (both assumptions end alike), keeps it, or swaps it: the state
    is that behind the last fixing split, swapped as often as splits since then say.
    """
    whole = Window.partitionBy("file").orderBy("start")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("end0") == F.col("end1"), F.col("end0"))
    marked = splits.withColumn("run", F.count(fixed).over(before)).withColumn("from", F.coalesce(F.last(fixed, True).over(before), F.lit(0)))
    swaps = F.sum(F.when(F.col("end0") > F.col("end1"), 1).otherwise(0)).over(Window.partitionBy("file", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begun = marked.withColumn("inside", (F.col("from") + F.coalesce(swaps, F.lit(0))) % 2)
    own = F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1"))
    return begun.select(
        "file", "start", "inside", own.alias("records"), F.coalesce(F.sum(own).over(before), F.lit(0)).alias("before"),
        F.first("first", True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"),
    )


def _lines(lines: DataFrame, multi_line: bool) -> DataFrame:
    """Every line with what it is under both assumptions: before, after and number of its record."""
    names = [f"{n}{h}" for h in (0, 1) for n in ("before", "after", "number")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, walks = None, ()
        for file, start, line, values, quoted, blank in _segments(batches, multi_line):
            if place != (file, start):
                place, walks = (file, start), (_Walk(0), _Walk(1))
            known = [column.astype(np.int64) for walk in walks for column in walk.lines(quoted, blank)]
            n = len(values)
            fixed = [pa.array([file] * n), pa.array(np.full(n, start)), pa.array(np.arange(line, line + n))]
            yield pa.RecordBatch.from_arrays([*fixed, values.cast(pa.string()), *map(pa.array, known)], names=["file", "start", "line", "value", *names])

    return lines.mapInArrow(run, f"file string, start bigint, line bigint, value string, {', '.join(f'{n} bigint' for n in names)}")


def read_records(spark: SparkSession, path: str, multi_line: bool = True, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """The records of CSV files, and their splits.

    Returns (file, record, value, first): ``record`` numbers the records of a file from 1, the header
    included, ``value`` is a record as it stands in the file, ``first`` the file's first record; and
    (file, start, inside, records, before, first) per split, a written table of one row per split.

    Files are read in splits of ``spark.sql.files.maxPartitionBytes``.  Lines end with a line feed, with or without a
    carriage return; empty lines outside quotes are no records.  Quotes count where a field begins with one;
    inside, two stand for one.  A quote that is never closed makes the rest of its file one record, less its last line break.  ``multi_line=False`` takes
    every line as a record.  Any encoding will do in which a line feed is the single byte 10.
    """
    if encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32")):
        raise ValueError(f"lines can't be found in {encoding}")
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("value")
    )
    splits = _composed(freeze(_summary(lines, multi_line), "csv_splits"))
    pick = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    placed = _lines(lines, multi_line).join(splits, ["file", "start"]).select(
        "file", "start", "line", "value", "first", pick("before").alias("inside"), pick("after").alias("open"), (F.col("before") + pick("number")).alias("record")
    )
    one_line = (F.col("inside") == 0) & (F.col("open") == 0)
    whole = placed.filter(one_line & (F.rtrim(F.col("value"), F.lit("\r")) != "")).select("file", "record", "value", "first")
    parts = placed.filter(~one_line).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "line", "value"))).alias("lines"), F.first("first").alias("first"))
    joined = parts.select("file", "record", F.array_join(F.transform("lines", lambda e: e["value"]), "\n").alias("value"), "first")
    records = whole.unionByName(joined) if multi_line else whole
    return records.withColumn("value", F.regexp_replace("value", "\r$", "")), splits

"""Totals of chunked uploads, kept as state per dataset while chunks arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gradeflow.streaming.state import GROUPS, rocksdb_state

#: Parts that the state of one dataset is spread over, so that no task holds all chunks of a large one.
PARTS = 8
_PLACE = "at bigint, id string"
_TOTALS = f"{_PLACE}, total_files bigint, uploaded_files bigint, chunks bigint"
_PART = "dataset_id string, part int"
_OLDEST = (-(2**63), "")
#: Chunks that are kept in one piece of state.
PIECE = 1024


class _Uploads(StatefulProcessor):
    """Of a group of parts, per part: the newest start with the totals from there on, and the chunks after it.

    A chunk older than the newest start never counts again, as starts only get newer; it is
    dropped.  A start that arrives late and is older than the kept one changes nothing, and a
    newer one takes over the chunks behind it, which are kept for that: in numbered pieces of
    ``PIECE`` chunks, so that a batch writes only what it brings.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", _PART, f"{_TOTALS}, first int, next int")
        self.chunks = handle.getMapState("chunks", f"{_PART}, number int", "at array<bigint>, id array<string>, counted array<bigint>, uploaded array<bigint>")

    def _add(self, part: tuple[str, int], given: list[tuple]) -> tuple:
        """Take up chunks (at, id, start, own, counted, uploaded) of one part; gives its newest start and totals."""
        kept = self.totals.getValue(part)
        *begins, total, done, chunks, first, last = kept if kept else (*_OLDEST, 0, 0, 0, 0, 0)
        begins = tuple(begins)
        newest = max([c[:2] for c in given if c[2]], default=_OLDEST)
        since = max(newest, begins)
        fresh = [(*c[:2], *c[4:]) for c in given if c[3] and c[:2] >= since]
        if newest > begins:
            for number in range(first, last):
                fresh += [c for c in zip(*self.chunks.getValue((*part, number))) if c[:2] >= newest]
                self.chunks.removeKey((*part, number))
            begins, total, done, chunks, first = newest, 0, 0, 0, last
        for at in range(0, len(fresh), PIECE):
            self.chunks.updateValue((*part, last), tuple(map(list, zip(*fresh[at : at + PIECE]))))
            last += 1
        sums = [total + sum(c[2] for c in fresh), done + sum(c[3] for c in fresh), chunks + len(fresh)]
        self.totals.updateValue(part, (*begins, *sums, first, last))
        return *part, *begins, *sums

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        given: dict[tuple, list[tuple]] = {}
        for part in rows:
            for dataset, number, *chunk in zip(*(part[c].tolist() for c in ("dataset_id", "part", "at", "id", "start", "own", "counted", "uploaded"))):
                given.setdefault((dataset, number), []).append(tuple(chunk))
        yield pd.DataFrame([self._add(part, chunks) for part, chunks in given.items()], columns=["dataset_id", "part", "at", "id", "total_files", "uploaded_files", "chunks"])

    def close(self) -> None:
        pass


def _placed(chunks: DataFrame, parts: int) -> DataFrame:
    """Chunks with their place in time and a part; a start goes to every part, and counts in one."""
    start = F.coalesce(F.col("status_before") != "processing", F.lit(False))
    counted = F.when(F.col("status_before") == "processing", F.col("announced")).otherwise(F.col("uploaded"))
    own = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")
    # Ids compare as numbers where they are numbers: digits are padded to one width.
    place = F.lpad(F.col("chunk_id").cast("string"), 20, "0") if "int" in chunks.schema["chunk_id"].dataType.simpleString() else F.col("chunk_id").cast("string")
    rows = chunks.select(
        F.col("dataset_id").cast("string").alias("dataset_id"), F.coalesce(F.unix_micros(F.col("uploaded_at").cast("timestamp")), F.lit(_OLDEST[0])).alias("at"),
        F.coalesce(place, F.lit("")).alias("id"), start.alias("start"), own.alias("_own"),
        F.coalesce(counted, F.lit(0)).cast("bigint").alias("counted"), F.coalesce("uploaded", F.lit(0)).cast("bigint").alias("uploaded"),
    )
    everywhere = F.when(F.col("start"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("_own"))
    return rows.withColumn("part", F.explode(everywhere)).withColumn("own", F.col("part") == F.col("_own")).drop("_own")


def upload_totals_stream(chunks: DataFrame, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Keep the totals of every dataset in the state of the stream; nothing else is written.

    Chunks may come in any order and any cut into batches; the totals are those of
    :func:`~gradeflow.operators.labelling.upload_totals` over all that has arrived.  The
    state holds the chunks from the newest start on, spread over ``parts`` parts a
    dataset.  Missing numbers count as 0.  Chunk ids of no whole-number type compare as text.
    """
    with rocksdb_state(chunks.sparkSession):
        group = F.pmod(F.xxhash64("dataset_id", "part"), F.lit(GROUPS)).cast("int")
        totals = _placed(chunks, parts).withColumn("_group", group).groupBy("_group").transformWithStateInPandas(
            _Uploads(), f"{_PART}, {_TOTALS}", "Update", "None"
        )
        return totals.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The totals of every dataset, read from the state of the last batch."""
    state = spark.read.format("statestore").option("stateVarName", "totals").load(checkpoint).select("user_map_key.dataset_id", "user_map_value.*")
    # Every part has seen every start, but a part may not have had a batch since: it then lags behind the newest.
    newest = state.groupBy("dataset_id").agg(F.max(F.struct("at", "id")).alias("newest"))
    live = state.join(newest, "dataset_id").where(F.struct("at", "id") == F.col("newest"))
    return live.groupBy("dataset_id").agg(*(F.sum(c).alias(c) for c in ("total_files", "uploaded_files", "chunks")))

"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected several times to a few dimensions, shifted, and put in
the order of a Hilbert curve: range-partitioned, sorted and numbered by Spark.  A
query meets the items in a window around its place in every order; the windows'
best merge and are ranked by the exact cosine.

The half-width of the windows is fitted, at any size alike: the exact neighbours
of a bounded sample of queries are searched among all rows, and the width is such
that ``target`` of them lie in a window of some order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import stored

ORDERS = 16
DIMENSIONS, BITS = 6, 10
#: Rows of an order that meet in one task.
BLOCK = 2048
#: Queries the window is fitted on at most.
SAMPLE = 64
TARGET = 0.97


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (a row of coordinates of ``bits`` bits) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for row in x:
            inverted = row & q != 0
            swap = np.where(inverted, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(inverted, low, swap)
            row ^= swap
        q >>= 1
    for before, row in zip(x, x[1:]):
        row ^= before
    turn, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        turn ^= np.where(x[-1] & q != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> bit & 1
    return place


class Curves:
    """Projections and shifts of all orders."""

    def __init__(self, size: int, orders: int = ORDERS, seed: int = 77):
        rng = np.random.default_rng(seed)
        self.width = min(DIMENSIONS, size)
        self.bases = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, : self.width] for _ in range(orders)]
        self.shifts = [rng.random(self.width) for _ in range(orders)]

    def places(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        for basis, shift in zip(self.bases, self.shifts):
            inside = (unit @ basis + 1) / 4 + shift / 2  # a unit vector's coordinates lie in [-1, 1]
            yield hilbert(np.clip((inside * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    return values.astype(np.float64).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _best(ids: np.ndarray, near: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of similarities the columns of its ``k`` best, and of any that tie with the last."""
    if near.shape[1] <= k:
        return [np.arange(near.shape[1])] * len(near)
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    out = []
    for row, bound in zip(near, last):
        at = np.flatnonzero(row >= bound - 1e-12)
        out.append(at if len(at) <= 4 * k else at[np.lexsort((ids[at], -row[at]))[: 4 * k]])
    return out


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, orders: int = ORDERS, target: float = TARGET) -> DataFrame:
    """The ``k`` nearest found for every query row, by the cosine of the original vectors.

    ``is_query`` is a condition on ``key``.  Returns query_id, rank (from 1),
    ``key`` and score, nearest first, ties to the smaller id; a query's own id is
    no candidate.  A vector that is null, zero, or has null or non-finite
    components takes no part, nor one of another than the usual size, nor a null
    id.  Equal vectors are one class that is searched once, so a vector that a
    third of the rows hold is one item; of rows that share an id the smallest vector
    takes part, once.
    Fewer candidates give fewer rows; an empty table none.
    """
    x = F.col("vector")
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & (F.size(x) > 0))
    rows = rows.where(F.forall(x, number) & F.exists(x, lambda c: c != 0))
    usual = rows.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = usual["size"] if usual else 1
    rows = rows.where(F.size(x) == size).groupBy("id").agg(F.min("vector").alias("vector"))

    # Classes of equal vectors, with the smallest ids of each: no answer needs more.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    classes = stored(least.select(F.col("members")[0].alias("cid"), "vector", "members"), "vector_classes")
    asked = stored(rows.where(is_query(F.col("id"))).join(classes.select("cid", "vector"), "vector").select("id", "cid"), "queries")
    curves = Curves(size, orders)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("vector")))
                for t, at in enumerate(curves.places(unit)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), batch.column("cid")], names=["t", "place", "cid"])

    placed = classes.select("cid", "vector").mapInArrow(place, "t int, place bigint, cid bigint")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "t", "place", "cid").sortWithinPartitions("t", "place", "cid")
    ordered = stored(ordered.select("t", "cid", F.monotonically_increasing_id().alias("n")), "curve_orders")
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy(F.shiftright("n", 33).alias("part")).count().toLocalIterator())
    total = sum(c for _, c in sizes) // orders
    offsets, at = [], 0
    for part, count in sizes:  # a number per partition
        offsets.append((part, at))
        at += count
    starts = vectors.sparkSession.createDataFrame(offsets, "part bigint, start bigint")
    ranks = ordered.withColumn("part", F.shiftright("n", 33)).join(F.broadcast(starts), "part")
    ranks = ranks.select("t", "cid", (F.col("start") + F.col("n").bitwiseAND((1 << 33) - 1) - F.col("t").cast("long") * total).alias("at"))

    width = _window(classes, asked, ranks, k, target)
    query_ids = asked.select("cid").distinct().withColumn("q", F.lit(True))
    whole = ranks.join(classes.select("cid", "vector"), "cid").join(query_ids, "cid", "left")
    span = 50 * BLOCK  # queries are sliced too, so that a wide window doesn't gather them in one task
    block, slice_ = F.floor(F.col("at") / BLOCK), F.floor(F.col("at") / span)
    def upto(a, b, step):
        return F.explode(F.sequence(F.floor(F.greatest(a, F.lit(0)) / step), F.floor(F.least(b, F.lit(max(total - 1, 0))) / step)))
    items = whole.select("t", block.alias("block"), upto(block * BLOCK - width, block * BLOCK + BLOCK + width, span).alias("slice"), F.lit(False).alias("q"), "cid", "vector")
    queries = whole.where("q").select("t", upto(F.col("at") - width, F.col("at") + width, BLOCK).alias("block"), slice_.alias("slice"), "q", "cid", "vector")

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        asking = group["q"].to_numpy(bool)
        out = []
        if asking.any() and not asking.all():
            ids = group["cid"].to_numpy()
            vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
            units = _unit(vectors)
            mine, theirs = np.flatnonzero(asking), np.flatnonzero(~asking)
            for at in range(0, len(mine), 512):
                own = mine[at : at + 512]
                for q, best in zip(own, _best(ids[theirs], units[own] @ units[theirs].T, k + 1)):
                    exact = cosine(np.broadcast_to(vectors[q], (len(best), vectors.shape[1])), vectors[theirs[best]])
                    out += zip([ids[q]] * len(best), ids[theirs[best]], exact)
        return pd.DataFrame(out, columns=["query", "cid", "score"]).astype({"query": "int64", "cid": "int64", "score": "float64"})

    met = items.unionByName(queries).groupBy("t", "block", "slice").applyInPandas(rerank, "query bigint, cid bigint, score double")
    met = met.groupBy("query", "cid").agg(F.max("score").alias("score"))
    nearest = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cid"))
    # Twice as many classes as needed: those that tie at the end are told apart by their ids below.
    met = met.withColumn("r", nearest).where(F.col("r") <= 2 * (k + 1)).drop("r")
    found = met.join(classes.select("cid", "members"), "cid").select("query", "score", F.explode("members").alias("id"))
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    # One more than asked, as the list of a class also holds the asking row itself.
    listed = found.withColumn("r", ranked).where(F.col("r") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("list"))
    answers = asked.join(listed.withColumnRenamed("query", "cid"), "cid").select(F.col("id").alias("query_id"), F.slice(F.filter("list", lambda e: e["id"] != F.col("id")), 1, k).alias("list"))
    return answers.select("query_id", F.posexplode("list").alias("rank", "e")).select(
        F.col("query_id").cast(vectors.schema[key].dataType), (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.id").cast(vectors.schema[key].dataType).alias(key), "e.score"
    )


def _window(classes: DataFrame, asked: DataFrame, ranks: DataFrame, k: int, target: float) -> int:
    """Half-width of the windows, from the exact neighbours of a sample of queries among all rows."""
    chosen = asked.select("cid").distinct().orderBy(F.xxhash64("cid")).limit(SAMPLE)
    sample = chosen.join(classes.select("cid", "vector"), "cid").toPandas()
    if not len(sample):
        return BLOCK
    ids = sample["cid"].to_numpy()
    units = _unit(np.stack(sample["vector"].to_numpy()).astype(np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("cid").to_numpy()
            near = units @ _unit(_matrix(batch.column("vector"))).T
            near[ids[:, None] == own[None, :]] = -2.0
            take = min(k, len(own))
            best = np.argpartition(-near, take - 1, axis=1)[:, :take]
            rows = np.repeat(np.arange(len(ids)), take)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(own[best.ravel()]), pa.array(near[rows, best.ravel()])], names=["query", "cid", "score"])

    exact = classes.select("cid", "vector").mapInArrow(scan, "query bigint, cid bigint, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cid"))
    pairs = exact.withColumn("r", best).where((F.col("r") <= k) & (F.col("score") > -2)).select("query", "cid").toPandas()
    if not len(pairs):
        return BLOCK
    used = sorted({*pairs["query"].tolist(), *pairs["cid"].tolist()})
    places = ranks.where(F.col("cid").isin(used)).toPandas().pivot(index="cid", columns="t", values="at")
    apart = np.abs(places.loc[pairs["query"]].to_numpy() - places.loc[pairs["cid"]].to_numpy()).min(1)
    return int(max(BLOCK // 4, np.quantile(apart, target)))

"""Hard negatives by slots: the upper limits of an anchor's positives part its scores into disjoint slots.

A positive's window is an interval of scores below a share of its own score.  Sorted
upwards, the upper limits of an anchor's windows are the bounds of slots, so a candidate
falls into one slot, however many windows overlap there.  Tasks keep the best ``k`` of
each slot; merged from the lowest slot upwards, the best ``k`` of all slots below a limit
answer its window, less what lies under the window's lower limit.

Anchors (a stated set of queries) meet all rows in cells of bounded blocks of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
#: Shares of the positive's score, in hundredths, that a negative's lies between.
LOWEST, HIGHEST = 30, 90
SCALE = 256
#: Anchors and rows of a cell at most; rows compared at once.
ANCHOR_BLOCK, ROW_BLOCK, STEP = 4096, 65_536, 1024


class Best:
    """The ``k`` highest scores per anchor, ties to the smaller id, of rows that come in the order of their ids."""

    def __init__(self, anchors: int, k: int, low):
        self.k = k
        self.owner, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, low.dtype), np.zeros(0, np.int64)
        self.low = np.full(anchors, low)  # a later row must pass the last one kept

    def add(self, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        owner, row = np.nonzero(allowed & (score > self.low[:, None]))
        if not len(owner):
            return
        owner, found, ids = np.r_[self.owner, owner], np.r_[self.score, score[owner, row]], np.r_[self.id, ids[row]]
        order = np.lexsort((ids, -found, owner))
        owner = owner[order]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        kept = rank < self.k
        self.owner, self.score, self.id = owner[kept], found[order][kept], ids[order][kept]
        full = rank[kept] == self.k - 1
        self.low[self.owner[full]] = self.score[full]


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as whole numbers: floor(256 x), x in double precision."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles: by BLAS where 53 bits hold every sum, else by wider numbers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    if (np.abs(exact) >= 2**62).any():
        raise OverflowError("scores beyond 62 bits")
    return exact.astype(np.int64)


_NONE = np.int64(-(2**63))


def _cells(anchors: DataFrame, rows: DataFrame, compare, schema: str, sizes: tuple[int, int]) -> DataFrame:
    """``compare`` for every cell of a block of anchors and a block of rows: no cell grows with the tables."""
    blocks, groups = sizes
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # both sides come from one table
    left = anchors.withColumn("block", F.pmod(F.hash("id"), F.lit(blocks))).withColumn("part", spread(groups))
    right = rows.withColumn("part", F.pmod(F.hash("id", F.lit(1)), F.lit(groups))).withColumn("block", spread(blocks))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(compare, schema)


def _steps(rows: pa.Table):
    """The rows of a cell by id, a few first, so that later ones meet a bound."""
    rows = rows.sort_by("id")
    at, size = 0, 64
    while at < rows.num_rows:
        own = rows.slice(at, size)
        yield own.column("id").to_numpy(), own.column("label").to_numpy(), _whole(own.column("vector"))
        at += size
        size = min(2 * size, STEP)


def _told(found: list[tuple[Best, int]], anchor: np.ndarray, names: list[str]) -> pa.Table:
    columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*((anchor[b.owner], np.full(len(b.id), slot), b.score, b.id) for b, slot in found))]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


_FOUND = "anchor bigint, slot bigint, score bigint, id bigint"
_NAMES = ["anchor", "slot", "score", "id"]


def _closest(k: int):
    """The ``k`` best rows of the anchor's own label in a cell."""

    def compare(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        best = Best(len(ids), k, _NONE)
        if len(ids) and rows.num_rows:
            vectors = _whole(anchors.column("vector"))
            for own, label, vector in _steps(rows):
                best.add(products(vectors, vector), (labels[:, None] == label) & (ids[:, None] != own), own)
        return _told([(best, 0)], ids, _NAMES)

    return compare


def _slots(k: int, count: int):
    """The ``k`` best rows of other labels per slot; slot j holds scores up to the limit j, and above j + 1."""

    def compare(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        best = [Best(len(ids), k, _NONE) for _ in range(count)]
        if len(ids) and rows.num_rows:
            vectors = _whole(anchors.column("vector"))
            limits = np.full((count + 1, len(ids)), _NONE)
            for k_, own in enumerate(anchors.column("limits").to_pylist()):
                limits[: len(own), k_] = own
            lowest = anchors.column("lowest").to_numpy()
            for own, label, vector in _steps(rows):
                score = products(vectors, vector)
                allowed = (labels[:, None] != label) & (score >= lowest[:, None]) & (score <= limits[0][:, None])
                for j in range(count):
                    if allowed.any():
                        inside = allowed & (score > limits[j + 1][:, None])
                        best[j].add(score, inside, own)
                        allowed &= ~inside
        return _told([(b, j) for j, b in enumerate(best)], ids, _NAMES)

    return compare


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per anchor and slot over all cells: (anchor, slot, list), best first as (-score, id)."""
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    kept = found.withColumn("r", place).where(F.col("r") <= k)
    return kept.groupBy("anchor", "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("list"))


def mine(
    vectors: DataFrame,
    is_anchor,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """Hard negatives per anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the id.  A score is the inner product of the vectors' components floor(256 x).
    An anchor's positives are its first ``positives`` other rows of its label; of the rows of other labels
    with lowest * positive <= 100 * score <= highest * positive the first ``negatives`` are returned.  Higher
    scores come first, ties go to the smaller id.

    Rows with a null id, label or vector, an empty vector, one with null or non-finite components, or one of another
    than the usual size, take no part.  Rows that share an id are one row: the least by label, then vector.
    A positive with a score below zero has an empty window.  Fewer rows give fewer results, an empty table none.
    Scores beyond 62 bits raise an OverflowError.  Other columns are not read.
    """
    if min(positives, negatives) < 1 or not 0 <= lowest <= highest:
        raise ValueError("one positive and one negative at least, and shares in order")
    x = F.col("vector")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0))
    rows = rows.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = stored(rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("m")).select("id", "m.label", "m.vector"), "vectors")
    usual = rows.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size(x) == (usual["size"] if usual else 0))
    anchors = rows.where(is_anchor(F.col("id")))

    here = rows.agg(F.count("*").alias("rows"), F.count_if(is_anchor(F.col("id"))).alias("anchors")).first()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = (max(1, -(-here["anchors"] // ANCHOR_BLOCK)), max(1, -(-here["rows"] // ROW_BLOCK), min(parts, here["rows"] // STEP)))

    near = _best(_cells(anchors, rows, _closest(positives), _FOUND, sizes), positives)
    near = stored(near.select("anchor", F.transform("list", lambda e: F.struct(e["id"].alias("id"), (-e["less"]).alias("score"))).alias("positives")), "positives")
    # Whole bounds of the windows: lowest * p <= 100 * s <= highest * p; positives come best first, so limits fall.
    asked = near.withColumn("positives", F.filter("positives", lambda p: p["score"] >= 0)).where(F.size("positives") > 0)
    windows = asked.withColumn("limits", F.transform("positives", lambda p: F.floor(p["score"].cast("decimal(20,0)") * highest / 100).cast("long")))
    windows = windows.withColumn("floors", F.transform("positives", lambda p: F.ceil(p["score"].cast("decimal(20,0)") * lowest / 100).cast("long")))
    asking = anchors.join(windows.select(F.col("anchor").alias("id"), "limits", F.array_min("floors").alias("lowest")), "id")
    slots = _best(_cells(asking, rows, _slots(negatives, positives), _FOUND, sizes), negatives)

    by_slot = slots.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "list"))).alias("slots"))
    joined = windows.join(by_slot, "anchor")
    own = lambda j: F.coalesce(F.col("slots")[F.lit(j).cast("long")], F.array().cast("array<struct<less:bigint,id:bigint>>"))
    merge = lambda above, j: F.slice(F.sort_array(F.concat(above, own(j))), 1, negatives)
    for j in range(positives - 1, -1, -1):  # from the lowest slot upwards
        joined = joined.withColumn(f"upto{j}", merge(F.col(f"upto{j + 1}"), j) if j + 1 < positives else own(j))
    answers = F.arrays_zip("positives", "floors", F.slice(F.array(*(F.col(f"upto{j}") for j in range(positives))), 1, F.size("positives")).alias("upto"))
    each = joined.select("anchor", F.explode(answers).alias("w")).select("anchor", "w.positives", "w.floors", F.col("w.upto").alias("upto"))
    each = each.select("anchor", "positives", F.posexplode(F.filter("upto", lambda e: -e["less"] >= F.col("floors"))).alias("place", "e"))
    kind = vectors.schema[key].dataType
    return each.select(
        F.col("anchor").cast(kind).alias("anchor_id"), F.col("positives.id").cast(kind).alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.col("e.id").cast(kind).alias("negative_id"), F.col("positives.score").alias("positive_score"), (-F.col("e.less")).alias("negative_score"),
    )

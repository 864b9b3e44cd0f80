"""Few-shot examples: the most similar labelled items by cosine, exactly.

Angles between unit vectors obey the triangle inequality.  Items are put into
cells by their nearest pivot and their angle to it; a query then needs only the
cells that can hold one of its K nearest.  Queries and items meet in bounded
blocks of a cell, and every block passes on K rows per query.

A block is an eighth of the items, within bounds: what is shuffled is in
proportion to the items until a block has ``MAX_BLOCK`` of them.  Where angles
tell nothing the comparisons themselves are all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gradeflow.operators.joins import first_by
from gradeflow.session import freeze

MAX_PIVOTS = 64
RING = 0.05  # width of the rings angles are counted in, in radians
BLOCK, MAX_BLOCK = 256, 65_536  # items, and queries, that meet in one group: at least and at most
BLOCKS = 8  # that the items are cut into between these bounds
TILE = 512  # queries, and so many items, that are compared at once inside a group
_SLACK = 1e-6


def _unit(vectors: Sequence) -> np.ndarray:
    matrix = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _angles(vectors: Sequence, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(vectors) @ pivots.T, -1.0, 1.0))


def _cells(histogram: Sequence[tuple[int, int, int]], block: int) -> tuple[dict, np.ndarray]:
    """Join neighbouring rings of a pivot until they hold a block of items.

    ``histogram`` has (pivot, ring, items).  Gives (pivot, ring) -> cell, and
    per cell its pivot, smallest angle, largest angle and number of items.
    """
    cell_of, cells = {}, []
    for pivot, ring, count in sorted(histogram):
        if not cells or cells[-1][0] != pivot or cells[-1][3] >= block:
            cells.append([pivot, ring * RING, 0.0, 0])
        cells[-1][2] = (ring + 1) * RING
        cells[-1][3] += count
        cell_of[pivot, ring] = len(cells) - 1
    return cell_of, np.asarray(cells, dtype=np.float64)


def _wanted_cells(angles: np.ndarray, cells: np.ndarray, k: int) -> np.ndarray:
    """Which cells can hold one of the ``k`` nearest other items, per query."""
    to_pivot = angles[:, cells[:, 0].astype(int)]
    near = np.maximum(0.0, np.maximum(to_pivot - cells[:, 2], cells[:, 1] - to_pivot))
    far = to_pivot + cells[:, 2]  # no item of the cell is farther
    order = np.argsort(far, axis=1, kind="stable")
    # Cells up to this one certainly hold k + 1 items (one may be the query itself).
    enough = np.cumsum(cells[:, 3][order], axis=1) >= k + 1
    last = order[np.arange(len(order)), enough.argmax(axis=1)]
    bound = np.where(enough[:, -1], far[np.arange(len(order)), last], np.inf)
    return near <= bound[:, None] + _SLACK


def _best(asked: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of the ``k`` nearest items per query, smaller places first among equals.

    Items are met in tiles.  Of a tile only those go on that reach the query's K-th best so far;
    they replace it at once, so that most of the later ones are passed over by one comparison.
    """
    place = np.zeros((len(asked), k), np.int64)
    value = np.full((len(asked), k), -np.inf)
    for at in range(0, len(items), TILE):
        similarity = asked @ items[at : at + TILE].T
        similarity[query_ids[:, None] == item_ids[None, at : at + TILE]] = -np.inf
        least = value[:, -1]
        if not at and similarity.shape[1] > k:  # none is kept yet: the K-th best of the tile itself
            least = np.partition(np.where(np.isnan(similarity), -np.inf, similarity), -k, axis=1)[:, -k]
        # Rounding moves a value by half a unit of the ninth decimal at most; equal ones of later places lose.
        rows, columns = np.nonzero(similarity > least[:, None] - 1e-9)
        if not len(rows):
            continue
        rounded = np.round(similarity[rows, columns], 9)
        live = np.unique(rows)
        # The kept ones come first, so that a stable order by row and value keeps smaller places before larger.
        row = np.concatenate([np.repeat(live, k), rows])
        held = np.concatenate([value[live].ravel(), rounded])
        where = np.concatenate([place[live].ravel(), columns + at])
        order = np.lexsort((-held, row))
        row, held, where = row[order], held[order], where[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < k
        value[row[top], rank[top]], place[row[top], rank[top]] = held[top], where[top]
    return place, value


def nearest_items(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    pivot_count: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """The ``k`` nearest other items per query: query_id, item_id, similarity, place.

    ``queries`` has query_id and embedding, ``items`` item_id and embedding; an
    item is never its own example.  Similarity has 9 decimals; equal ones are
    ordered by item_id.
    """
    spark = items.sparkSession
    id_type = items.schema["item_id"].dataType
    count = items.count()
    block = block or min(MAX_BLOCK, max(BLOCK, -(-count // BLOCKS)))
    wanted_pivots = pivot_count or max(1, min(MAX_PIVOTS, count // block))
    chosen = items.orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(wanted_pivots)
    picked = [row["embedding"] for row in chosen.select("embedding").collect()]  # at most MAX_PIVOTS vectors
    if not picked:
        return queries.limit(0).select(
            "query_id", F.lit(None).cast(id_type).alias("item_id"),
            F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("bigint").alias("place"),
        )
    pivots = _unit(picked)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            angles = _angles(batch["embedding"], pivots)
            nearest = angles.argmin(axis=1)
            ring = np.floor(angles[np.arange(len(batch)), nearest] / RING).astype(np.int64)
            yield batch.assign(_pivot=nearest.astype(np.int64), _ring=ring)

    def longs(*names: str) -> list[T.StructField]:
        return [T.StructField(name, T.LongType()) for name in names]

    placed_type = T.StructType([items.schema["item_id"], items.schema["embedding"]] + longs("_pivot", "_ring"))
    placed = freeze(items.select("item_id", "embedding").mapInPandas(place, placed_type))
    # At most pivots x rings rows: a table of fixed size, whatever the data.
    counted = placed.groupBy("_pivot", "_ring").agg(F.count("*").alias("_n")).collect()
    cell_of, cells = _cells([(r["_pivot"], r["_ring"], r["_n"]) for r in counted], block)
    parts = np.maximum(1, -(-cells[:, 3].astype(int) // block))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = _wanted_cells(_angles(batch["embedding"], pivots), cells, k)
            for cell in range(len(cells)):
                rows = batch[wanted[:, cell]]
                if len(rows):
                    yield rows.assign(_cell=np.int64(cell), _parts=np.int64(parts[cell]))

    asked_type = T.StructType([queries.schema["query_id"], queries.schema["embedding"]] + longs("_cell", "_parts"))
    asked = queries.select("query_id", "embedding").mapInPandas(candidates, asked_type)
    # A cell's items are cut into parts and its queries into groups; both stay near a block.
    groups = F.broadcast(asked.groupBy("_cell").agg(F.ceil(F.count("*") / block).cast("bigint").alias("_groups")))
    numbers = F.broadcast(
        spark.createDataFrame(
            [(p, r, cell, int(parts[cell])) for (p, r), cell in cell_of.items()],
            T.StructType(longs("_pivot", "_ring", "_cell", "_parts")),
        )
    )
    zero = F.lit(0).cast("bigint")
    left = (
        asked.join(groups, "_cell")
        .withColumn("_group", F.pmod(F.xxhash64("query_id"), F.col("_groups")))
        .withColumn("_part", F.explode(F.sequence(zero, F.col("_parts") - 1)))
    )
    right = (
        placed.join(numbers, ["_pivot", "_ring"]).join(groups, "_cell")
        .withColumn("_part", F.pmod(F.xxhash64("item_id"), F.col("_parts")))
        .withColumn("_group", F.explode(F.sequence(zero, F.col("_groups") - 1)))
    )

    def best(asking: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(offered):
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        offered = offered.sort_values("item_id")  # places are then in the order of the ids, which breaks ties
        item_ids, query_ids = offered["item_id"].to_numpy(), asking["query_id"].to_numpy()
        asked, items = _unit(asking["embedding"]), _unit(offered["embedding"])
        places, values = zip(*(_best(asked[i : i + TILE], query_ids[i : i + TILE], items, item_ids, k) for i in range(0, len(asked), TILE)))
        places, values = np.concatenate(places), np.concatenate(values)
        found = pd.DataFrame(
            {
                "query_id": np.repeat(query_ids, places.shape[1]),
                "item_id": item_ids[places.ravel()],
                "similarity": values.ravel(),
            }
        )
        return found[np.isfinite(found["similarity"])]

    found_type = T.StructType(
        [queries.schema["query_id"], items.schema["item_id"], T.StructField("similarity", T.DoubleType())]
    )
    keys = ["_cell", "_part", "_group"]
    left, right = left.select(*keys, "query_id", "embedding"), right.select(*keys, "item_id", "embedding")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, found_type)
    nearest = first_by(found, ["query_id"], [F.col("similarity").desc(), F.col("item_id")], keep=k, rank="place")
    return nearest.withColumn("place", F.col("place").cast("bigint"))


def few_shot_prompts(prompts: DataFrame, nearest: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefix each prompt with the ground truth of its nearest items, nearest first.

    ``prompts`` has query_id and prompt, ``labels`` item_id and label.
    """
    line = F.concat(F.lit("Example "), F.col("place").cast("string"), F.lit(": "), F.col("label").cast("string"))
    examples = (
        nearest.join(labels.select("item_id", "label"), "item_id")
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("_examples"))
    )
    text = F.array_join(F.col("_examples.line"), "\n")
    return prompts.join(examples, "query_id", "left").select(
        "query_id", F.concat_ws("\n", text, "prompt").alias("prompt")
    )

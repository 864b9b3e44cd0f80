"""Which images a run takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeflow.operators import selection as sel
from gradeflow.plans.registry import query
from gradeflow.plans.tables import Tables, with_views

_EVALUABLE = with_views("images", "marks") + """, usable AS (
  SELECT images.*, is_skipped FROM images JOIN marks USING (image_id) WHERE processing_status <> 'failed')
"""


def _usable(t: Tables) -> DataFrame:
    return sel.evaluable_images(t.view("images"), t.view("marks").select("image_id", "is_skipped"))


@query(_EVALUABLE + "SELECT image_id, dataset_id, filename, is_skipped FROM usable")
def evaluable_images(t: Tables) -> DataFrame:
    """Annotated images that did not fail."""
    return _usable(t).select("image_id", "dataset_id", "filename", "is_skipped")


@query(_EVALUABLE + "SELECT image_id, dataset_id FROM usable ORDER BY md5('42|' || image_id), image_id LIMIT 100")
def select_random_count(t: Tables) -> DataFrame:
    """One hundred random images."""
    return sel.select_random_count(_usable(t), 100, seed=42).select("image_id", "dataset_id")


@query(
    _EVALUABLE + """SELECT image_id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY md5('7|' || image_id), image_id) AS place,
    count(*) OVER (PARTITION BY project_id) AS n FROM usable) AS r WHERE place <= ceil(n * CAST(30 AS DOUBLE) / 100)"""
)
def select_random_percent(t: Tables) -> DataFrame:
    """Thirty percent of the images of every project, rounded up."""
    return sel.select_random_percent(_usable(t), 30, seed=7, by=["project_id"]).select("image_id", "project_id")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag"
    " ORDER BY md5('1|' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) AS place,"
    " count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) AS r WHERE place <= ceil(n * CAST(10 AS DOUBLE) / 100)"
)
def select_percent_lines(t: Tables) -> DataFrame:
    """Ten percent of the largest table, in three very large groups."""
    lines = t.given("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ids = lines.withColumn(
        "image_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    return sel.select_random_percent(ids, 10, seed=1, by=["l_returnflag"]).drop("image_id")


@query(_EVALUABLE + "SELECT image_id, dataset_id FROM usable WHERE image_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def select_manual(t: Tables) -> DataFrame:
    """Hand-picked images: those marked toxic."""
    chosen = t.given("labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("image_id"))
    return sel.select_manual(_usable(t), chosen).select("image_id", "dataset_id")


@query(
    with_views("images", "marks", "answers")
    + """SELECT u.image_id, m.model_id || '@' || u.project_id AS evaluation_id
FROM (SELECT images.* FROM images JOIN marks USING (image_id) WHERE processing_status <> 'failed') AS u CROSS JOIN models AS m
WHERE NOT EXISTS (SELECT 1 FROM answers AS a WHERE a.image_id = u.image_id AND a.evaluation_id = m.model_id || '@' || u.project_id
                  AND a.completed_at < TIMESTAMP '2024-02-01 01:30:00')"""
)
def resume_remaining(t: Tables) -> DataFrame:
    """Work left when every run stopped after ninety minutes."""
    work = t.per_model(_usable(t).select("image_id", "project_id"))
    work = work.select("image_id", F.concat_ws("@", "model_id", "project_id").alias("evaluation_id"))
    done = t.view("answers").filter(F.col("completed_at") < F.expr("TIMESTAMP_NTZ '2024-02-01 01:30:00'"))
    return sel.remaining_images(work, done, ["image_id", "evaluation_id"])


@query(with_views("images") + "SELECT image_id, dataset_id FROM images WHERE processing_status = 'pending'")
def pending_images(t: Tables) -> DataFrame:
    """Images that wait for processing."""
    return sel.pending_images(t.view("images")).select("image_id", "dataset_id")

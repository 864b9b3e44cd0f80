"""Pages out of slices, against offsets into a sort."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import estimate, labelling, paging, scoring
from gradeflow.operators.ordering import page


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    # One key holds most rows, one is null.
    rows = spark.range(3000).selectExpr("CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN 'k' || (id % 4) END AS key", "id * 7919 % 3001 AS at", "id")
    path = str(tmp_path_factory.mktemp("pages"))
    paging.write_pages(rows, path, ["key"], [F.col("at").desc(), "id"], slice_rows=100)
    return rows, path


@pytest.mark.parametrize("key", ["hot", "k1", None, "absent"])
@pytest.mark.parametrize("skip, limit", [(0, 10), (95, 20), (290, 30), (5000, 10)])
def test_pages_equal_offsets(spark, written, key, skip, limit):
    rows, path = written
    want = page(rows.filter(F.col("key").eqNullSafe(F.lit(key))), [F.col("at").desc(), F.col("id")], skip, limit).collect()
    assert paging.read_page(spark, path, skip, limit, {"key": key}).collect() == want


def test_a_page_reads_its_slices_only(spark, written):
    got = paging.read_page(spark, written[1], 1500, 50, {"key": "hot"})
    folders = {name.split("_slice=")[1].split("/")[0] for name in got.inputFiles()}
    assert len(got.collect()) == 50 and len(folders) > 2  # inputFiles lists all; the scan prunes
    assert "PartitionFilters: [isnotnull(_slice" in got._jdf.queryExecution().executedPlan().toString()


def test_a_page_needs_its_key(spark, written):
    with pytest.raises(ValueError):
        paging.read_page(spark, written[1])


def test_pages_of_an_empty_and_of_a_keyless_table(spark, tmp_path):
    none = spark.createDataFrame([], "key string, id int")
    paging.write_pages(none, f"{tmp_path}/none", ["key"], ["id"])
    assert paging.read_page(spark, f"{tmp_path}/none", key={"key": "a"}).collect() == []
    paging.write_pages(none, f"{tmp_path}/void", [], ["id"])
    assert paging.read_page(spark, f"{tmp_path}/void").collect() == []
    paging.write_pages(spark.range(25), f"{tmp_path}/all", [], ["id"], slice_rows=4)
    assert [r["id"] for r in paging.read_page(spark, f"{tmp_path}/all", 7, 5).collect()] == [7, 8, 9, 10, 11]


def test_jobs_show_their_latest_image(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    jobs = spark.createDataFrame([(1, 1, 5, at(1)), (2, None, 5, at(2)), (3, 9, 6, at(3))], "job_id int, dataset_id int, project_id int, created_at timestamp")
    datasets = spark.createDataFrame([(1, "d1")], "dataset_id int, name string")
    results = spark.createDataFrame(
        [(1, 1, 10, at(1)), (2, 1, 11, at(5)), (3, 1, None, at(9)), (4, 2, None, at(9)), (5, 3, 12, at(1)), (6, 3, 13, at(1))],
        "result_id int, job_id int, image_id int, created_at timestamp",
    )
    images = spark.createDataFrame([(10, "a"), (11, "b"), (13, None)], "image_id int, thumbnail string")
    got = labelling.labelling_jobs(jobs, datasets, results, images).collect()
    assert [(r["job_id"], r["dataset_name"], r["latest_image_id"], r["thumbnail"]) for r in got] == [(3, None, 13, None), (2, None, None, None), (1, "d1", 11, "b")]
    assert [r["job_id"] for r in labelling.labelling_jobs(jobs, datasets, results, images, project_id=5).collect()] == [2, 1]


def test_counts_by_selection(spark):
    images = spark.createDataFrame([("d",)] * 6, "dataset_id string")
    runs = spark.createDataFrame(
        [(1, "d", "manual", None, [1, 2, 9]), (2, "d", "manual", None, None), (3, "d", "random", 4, None), (4, "d", "random", 40, None),
         (5, "d", "random", None, None), (6, "d", None, 2, [1]), (7, "gone", "random", 4, None), (8, "gone", "manual", None, [1])],
        "id int, dataset_id string, mode string, limit int, image_ids array<int>",
    )
    got = {r["id"]: r["image_count"] for r in estimate.selected_counts(runs, images).collect()}
    assert got == {1: 3, 2: 6, 3: 4, 4: 6, 5: 6, 6: 6, 7: 0, 8: 1}


def test_percentiles_within_their_error(spark):
    n = 200_000
    rows = spark.range(n, numPartitions=8).selectExpr("id % 5 AS part", "id * 7919 % 200003 / 200003D AS score")
    found = scoring.percentiles(scoring.confidence_sketches(rows, "score", ["part"]), percents=(1, 50, 99)).collect()
    assert [(r["total"], r["percent"]) for r in found] == [(n, 1), (n, 50), (n, 99)]
    for r in found:
        assert abs(rows.filter(F.col("score") <= r["value"]).count() / n - r["percent"] / 100) < 2 * scoring.sketch_rank_error()
    odd = spark.createDataFrame([(None,), (float("nan"),), (0.5,)], "score double")
    assert [r["value"] for r in scoring.percentiles(scoring.confidence_sketches(odd, "score")).collect()] == [0.5] * 5
    assert scoring.percentiles(scoring.confidence_sketches(odd.limit(0), "score")).count() == 0


def test_paired_outcomes(spark):
    rights = {"a": "1100110x", "b": "1011000x", "c": "1100110x"}
    rows = [(run, i, None if v == "x" else v == "1") for run, marks in rights.items() for i, v in enumerate(marks)]
    results = spark.createDataFrame(rows + [("a", 99, True)], "evaluation_id string, image_id int, is_correct boolean")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "first_id string, second_id string")
    got = {r["second_id"]: r for r in scoring.paired_outcomes(results, pairs).collect()}
    assert got["b"].asDict() == {
        "first_id": "a", "second_id": "b", "paired": 7, "both_right": 1, "only_first": 3, "only_second": 2, "both_wrong": 1,
        "first_percent": 57.14, "second_percent": 42.86, "statistic": 0.0,
    }
    assert (got["c"]["paired"], got["c"]["both_right"], got["c"]["statistic"]) == (7, 4, None)

"""Joins, order and selection against plain Python, with hot keys forced."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import joins, ordering, selection as sel
from gradeflow.operators.progress import progress_log


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3000)] + [(9999, None)]
    return spark.createDataFrame(rows, "row_no bigint, key string")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_join(spark, skewed, how):
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), ("unused", 4)], "key string, value int")
    salted = joins.salted_lookup(skewed, lookup, ["key"], how, split_keys=1, salts=8)
    plain = skewed.join(lookup, "key", how)
    assert sorted(map(str, salted.select("row_no", "key", "value").collect())) == sorted(
        map(str, plain.select("row_no", "key", "value").collect())
    )


def test_hot_key_is_spread(spark, skewed):
    lookup = spark.createDataFrame([("hot", 1)], "key string, value int")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        salted = joins.salted_lookup(skewed, lookup, ["key"], "inner", split_keys=1, salts=8)
        sizes = salted.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 1000
    finally:
        spark.conf.set(conf, before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_first_by_cuts_before_the_shuffle(spark, skewed):
    first = joins.first_by(skewed, ["key"], [F.col("row_no").desc()], keep=2)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert sorted(r["row_no"] for r in first.filter("key = 'hot'").collect()) == [2994, 2997]


def test_merge_and_cascade(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    once = joins.merge_by_key(base, new, ["id"])
    twice = joins.merge_by_key(once, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")] == sorted(map(tuple, twice.collect()))
    runs = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "id int, run int")
    rows = spark.createDataFrame([(10, 100), (20, 200)], "run int, row int")
    left = joins.delete_cascade(base, base.filter("id = 1"), "id", [("runs", runs, "id", "run"), ("rows", rows, "run", "row")])
    assert [tuple(r) for r in left["parents"].collect()] == [(2, "b")]
    assert [r["run"] for r in left["runs"].collect()] == [20] and [r["row"] for r in left["rows"].collect()] == [200]


def test_cascade_over_siblings_cycles_and_self_references(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "job int")
    runs = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "run int, job int")
    results = spark.createDataFrame([(100, 1, 20), (101, 2, 10), (102, 2, 20), (103, None, None)], "result int, job int, run int")
    tables = {"results": (results, "result"), "jobs": (jobs, "job"), "runs": (runs, "run")}
    links = [("runs", "job", "jobs"), ("results", "job", "jobs"), ("results", "run", "runs")]
    left = joins.cascade(tables, links, {"jobs": jobs.filter("job = 1")})
    assert [sorted(r[0] for r in left[n].collect()) for n in ("jobs", "runs", "results")] == [[2], [20], [102, 103]]
    assert list(left) == list(tables) and left["results"].columns[:1] == ["result"]

    # A folder refers to its parent, and to a note that refers to a folder.
    rng = random.Random(4)
    folders = [(i, rng.randrange(i) if i and i % 7 else None, rng.choice([None, rng.randrange(40)])) for i in range(60)]
    notes = [(i, rng.randrange(60)) for i in range(40)]
    given = {"folders": (spark.createDataFrame(folders, "id int, parent int, note int"), "id"), "notes": (spark.createDataFrame(notes, "id int, folder int"), "id")}
    graph = [("folders", "parent", "folders"), ("folders", "note", "notes"), ("notes", "folder", "folders")]
    for seed in (3, 50):
        gone = {("folders", seed)}
        while True:
            more = {("folders", i) for i, p, n in folders if ("folders", p) in gone or ("notes", n) in gone} | {("notes", i) for i, f in notes if ("folders", f) in gone}
            if more <= gone:
                break
            gone |= more
        left = joins.cascade(given, graph, {"folders": spark.createDataFrame([(seed,)], "k int")})
        assert {r["id"] for r in left["folders"].collect()} == {i for i, _, _ in folders if ("folders", i) not in gone}
        assert {r["id"] for r in left["notes"].collect()} == {i for i, _ in notes if ("notes", i) not in gone}


def test_running_index_over_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(100), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "key string, t int, id bigint").repartition(7)
    got = ordering.running_index(frame, ["key"], ["t", "id"], total="n").collect()
    for key in ("hot", "a", "b"):
        mine = sorted((r["t"], r["id"], r["position"], r["n"]) for r in got if r["key"] == key)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
        assert {m[3] for m in mine} == {len(mine)}


def test_progress_log_crosses_blocks(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("r", start + dt.timedelta(seconds=i), i, f"f{i}") for i in range(100)]
    frame = spark.createDataFrame(rows, "run string, at timestamp, id bigint, filename string")
    log = {r["id"]: r for r in progress_log(frame, "run", "at", "id", "filename").collect()}
    assert log[0]["latest_images"] == ["1/100: f0"]
    assert log[50]["latest_images"] == [f"{i + 1}/100: f{i}" for i in range(46, 51)]
    assert log[28]["progress"] == 28 and log[99]["progress"] == 100  # 29/100 falls just short of 29 %
    numbered = spark.range(1, 101).select(F.lit("r").alias("run"), F.col("id").alias("position"))
    small = ordering.trailing(numbered, ["run"], F.col("position"), "last", 5, block=7).collect()
    assert len(small) == 100
    assert all(r["last"] == list(range(max(1, r["position"] - 4), r["position"] + 1)) for r in small)


@pytest.fixture(scope="module")
def images(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(700)] + [(1000 + i, "seven") for i in range(7)]
    return spark.createDataFrame(rows, "image_id bigint, dataset_id string")


def by_hash(ids, seed):
    import hashlib

    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("count", [1, 13, 500, 5000])
def test_random_count_is_exact(spark, images, count):
    got = {r["image_id"] for r in sel.select_random_count(images, count, seed=3).collect()}
    everyone = [r["image_id"] for r in images.collect()]
    assert got == set(by_hash(everyone, 3)[:count])


def test_random_percent(spark, images):
    got = sel.select_random_percent(images, 30, seed=5, by=["dataset_id"]).groupBy("dataset_id").count().collect()
    sizes = {r["dataset_id"]: r["count"] for r in images.groupBy("dataset_id").count().collect()}
    assert {r["dataset_id"]: r["count"] for r in got} == {k: math.ceil(n * 30 / 100) for k, n in sizes.items()}
    assert sel.select_random_percent(images.filter("dataset_id = 'seven'"), 30).count() == 3


def test_slices_of_the_hash_range_are_ranked_exactly(spark, images, monkeypatch):
    monkeypatch.setattr(sel, "_HEAD_DIGITS", 1)  # few, large slices
    everyone = images.collect()
    got = {r["image_id"] for r in sel.sample_exact(images, F.lit(333), 9).collect()}
    assert got == set(by_hash([r["image_id"] for r in everyone], 9)[:333])
    got = sel.sample_exact(images, F.ceil(F.col("_total") / 3), 9, ["dataset_id"]).collect()
    for name in ("hot", "cold", "seven"):
        ids = by_hash([r["image_id"] for r in everyone if r["dataset_id"] == name], 9)
        assert {r["image_id"] for r in got if r["dataset_id"] == name} == set(ids[: math.ceil(len(ids) / 3)])


def test_groups_without_a_name_are_sampled(spark, images):
    named = images.withColumn("dataset_id", F.when(F.col("dataset_id") != "cold", F.col("dataset_id")))
    got = sel.select_random_percent(named, 50, by=["dataset_id"])
    assert got.filter("dataset_id IS NULL").count() == math.ceil(named.filter("dataset_id IS NULL").count() / 2)


def test_empty_choices_mean_all(spark, images):
    for chosen in (
        sel.select_random_count(images, 0), sel.select_random_percent(images, 0), sel.select_manual(images, []),
        sel.select_images(images, None), sel.select_images(images, {"mode": "random_count"}),
    ):
        assert chosen.count() == 707
    assert sel.select_images(images, {"mode": "manual", "image_ids": [1, 5, 99999]}).count() == 2
    assert sel.select_images(images, {"mode": "random_percent", "percent": 10}).count() == 71


def test_resume_equals_fresh_run(spark, images):
    done = images.filter("image_id % 2 = 0")
    left = sel.remaining_images(images, done)
    assert left.count() + done.count() == images.count() and left.join(done, "image_id").count() == 0


def test_quotas_at_and_beyond_the_ends(spark, images):
    everyone = images.count()
    assert sel.sample_exact(images, F.lit(0), 1).count() == 0
    assert sel.sample_exact(images, F.lit(everyone), 1).count() == everyone
    assert sel.sample_exact(images, F.lit(everyone + 5), 1).count() == everyone
    assert sel.sample_exact(images.limit(0), F.lit(3), 1).count() == 0


def test_few_groups_are_sampled_without_a_shuffle_of_the_images(spark):
    """A group with a third of all images must not meet in one task; its threshold goes to the images."""
    images = spark.range(9000).select(F.col("id").alias("image_id"), F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("kind"))
    got = sel.select_random_percent(images, 10, by=["kind"])
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {0: 300, 1: 300, None: 300}

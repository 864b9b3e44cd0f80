"""Catalogue, configurations, duplicates, folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import catalog, dedup, labelling, quality
from gradeflow.operators.progress import stale_runs
from gradeflow.plans.tables import MODELS
from gradeflow.sources import catalogue as sc, files as sf, tables as st


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def model(**changes):
    base = {
        "id": "m", "provider": "openai", "model_name": "x", "display_name": "X", "description": "d", "endpoint": "e",
        "auth_type": "api_key",
        "pricing_config": {"mode": "token_based", "input_price_per_1m": 1, "output_price_per_1m": 2, "image_price_mode": "per_tile"},
    }
    return {k: v for k, v in {**base, **changes}.items() if v is not None}


def test_catalogue_faults(spark, tmp_path):
    bad = model(id="n", display_name=None, pricing_config={"mode": "token_based", "input_price_per_1m": -9, "output_price_per_1m": 1})
    path = write(tmp_path / "c.json", [model(), model(), bad, model(id="o", provider="elsewhere")])
    faults = sorted(map(tuple, catalog.catalogue_faults(sc.read_catalogue(spark, path)).collect()))
    assert faults == [
        ("m", "duplicate id"), ("n", "missing field: display_name"), ("n", "missing pricing field: image_price_mode"),
        ("n", "negative cost"), ("o", "unknown provider"),
    ]


def test_fixed_catalogue_is_sound(spark, tmp_path):
    rows = [
        model(id=m[0], provider=m[1], model_name=m[2], pricing_config={
            "mode": "token_based", "input_price_per_1m": float(m[3]), "output_price_per_1m": float(m[4]), "image_price_mode": m[5]})
        for m in MODELS
    ]
    read = sc.read_catalogue(spark, write(tmp_path / "c.json", rows))
    assert read.count() == 6 and catalog.catalogue_faults(read).count() == 0


def test_config_import_and_export(spark, tmp_path):
    items = [
        {"id": "a", "name": "new", "provider": "openai", "model_name": "x", "api_key": ""},
        {"id": "zz", "name": "other", "provider": "vertex", "model_name": "y", "concurrency": 7},
        {"name": "incomplete", "provider": "vertex"},
    ]
    read = sc.read_model_configs(spark, write(tmp_path / "i.json", items))
    configs = spark.createDataFrame(
        [("a", "old", "openai", "x", "secret", "api_key", 0.5, 10, 3, None, False)],
        read.select("model_config_id", "name", "provider", "model_name", "api_key", "auth_type", "temperature", "max_tokens",
                    "concurrency", "pricing", "is_active").schema,
    )
    done = catalog.import_model_configs(configs, read)
    assert catalog.import_counts(done).first().asDict() == {"imported_count": 1, "updated_count": 1}
    rows = {r["name"]: r for r in done.collect()}
    assert set(rows) == {"new", "other"}
    assert (rows["new"]["api_key"], rows["new"]["temperature"], rows["new"]["is_active"]) == ("secret", 0.5, False)
    assert (rows["other"]["api_key"], rows["other"]["max_tokens"], rows["other"]["concurrency"]) == ("sk-placeholder", 1024, 7)
    assert rows["other"]["model_config_id"] not in ("zz", None)
    sc.write_model_configs(done, str(tmp_path / "out"))
    assert "api_key" not in spark.read.json(str(tmp_path / "out")).columns
    with pytest.raises(sc.CatalogueFormatError):
        sc.read_model_configs(spark, write(tmp_path / "bad.json", {"a": 1}))


@pytest.mark.parametrize("text", ['[{"id":"a","name":"n"}, {"id":', '[{"id":"a"}, {"id" "b"}]', '{"id":"a"}', "3", "nothing", "[{\"id\": \"a\"}"])
@pytest.mark.parametrize("read", [sc.read_catalogue, sc.read_model_configs])
def test_broken_files_are_rejected(spark, tmp_path, text, read):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(sc.CatalogueFormatError):
        read(spark, str(tmp_path / "x.json"))


def test_evaluation_list_and_stale_runs(spark):
    day = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [(1, 1, 1, 1, "running", day, "busy"), (2, 1, 2, 1, "completed", day, "old"), (3, 2, 1, 9, "running", day, None)],
        "evaluation_id int, project_id int, dataset_id int, model_config_id int, status string, created_at timestamp, activity string",
    )
    names = lambda key, n: spark.createDataFrame([(i, f"{key}{i}") for i in (1, 2)], f"{key}_id int, name string")
    models = spark.createDataFrame([(1, "openai", "x")], "model_config_id int, provider string, model_name string")
    listed = catalog.evaluation_list(runs, names("project", 2), names("dataset", 2), models)
    assert {r["evaluation_id"]: (r["model"], r["activity"]) for r in listed.collect()} == {
        1: ("openai/x", "busy"), 2: ("openai/x", None)
    }
    results = spark.createDataFrame([(1, day + dt.timedelta(minutes=8))], "evaluation_id int, completed_at timestamp")
    now = F.lit(day + dt.timedelta(minutes=10))
    assert [r["evaluation_id"] for r in stale_runs(runs, results, now).collect()] == [3]
    assert {r["evaluation_id"] for r in stale_runs(runs, results, now + F.expr("INTERVAL 1 SECOND")).collect()} == {1, 3}


def test_latest_group(spark):
    rows = [(i, "p" if i < 8 else "q", "d", dt.datetime(2024, 1, 1 + (i if i < 8 else 0))) for i in range(10)]
    listed = spark.createDataFrame(rows, "evaluation_id int, project_name string, dataset_name string, created_at timestamp")
    assert [r["evaluation_id"] for r in catalog.latest_group_runs(listed).collect()] == [7, 6, 5, 4, 3, 2]
    first = catalog.evaluation_groups(listed).filter("project_name = 'q'").first()
    assert first["project_modified"] == first["dataset_modified"] == dt.datetime(2024, 1, 1)


def test_compare_keeps_runs_without_model(spark):
    runs = spark.createDataFrame([(1, 1, 5), (2, 9, 5)], "evaluation_id int, model_config_id int, project_id int")
    models = spark.createDataFrame([(1, "openai")], "model_config_id int, provider string")
    sums = spark.createDataFrame([(1, 0.5), (2, 0.7)], "evaluation_id int, accuracy double")
    got = {r["evaluation_id"]: r["provider"] for r in catalog.compare_runs(sums, runs, models, runs, lambda rows: rows).collect()}
    assert got == {1: "openai", 2: None}


@pytest.mark.parametrize("rows", [[(i, 1, 5) for i in range(9)], [(1, 1, 5)], [(1, 1, 5), (2, 1, 6)]])
def test_compare_refuses_other_choices(spark, rows):
    runs = spark.createDataFrame(rows, "evaluation_id int, model_config_id int, project_id int")
    with pytest.raises(ValueError):
        catalog.chosen_runs(runs, runs)


def test_empty_dashboard(spark):
    none = spark.createDataFrame([], "project_id int, dataset_id int, status string, accuracy double")
    row = catalog.dashboard(none, none, none).first()
    assert row.asDict() == {"projects": 0, "datasets": 0, "evaluations": 0, "avg_accuracy": 0.0}


def test_duplicates(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, "d", "a.jpg" if i < 5 else f"{i}.jpg", day + dt.timedelta(hours=i % 4)) for i in range(8)]
    images = spark.createDataFrame(rows, "image_id bigint, dataset_id string, filename string, uploaded_at timestamp")
    assert [tuple(r) for r in dedup.duplicate_groups(images).collect()] == [("d", "a.jpg", 5)]
    assert sorted(r["image_id"] for r in dedup.cleanup_plan(images).collect()) == [0, 1, 2, 4]
    assert sorted(r["image_id"] for r in dedup.after_cleanup(images).collect()) == [3, 5, 6, 7]
    uploads = spark.createDataFrame(
        [(1, "d", "a.jpg"), (2, "d", "new.jpg"), (3, "d", "new.jpg"), (4, "e", "a.jpg")], "place int, dataset_id string, filename string"
    )
    checked = dedup.check_uploads(uploads, images, F.col("place"))
    assert {r["place"]: r["error"] is None for r in checked.collect()} == {1: False, 2: True, 3: False, 4: True}


def test_oversize(spark):
    mb = 1024 * 1024
    files = spark.createDataFrame(
        [(i, "d", f"f{i}.jpg", (11 + i) * mb) for i in range(5)] + [(9, "d", "ok.jpg", 10 * mb)],
        "file_id int, dataset_id string, filename string, file_size bigint",
    )
    assert quality.oversize_reports(files).first()["message"] == (
        "5 file(s) exceed 10MB limit: f0.jpg (11.0MB), f1.jpg (12.0MB), f2.jpg (13.0MB) and 2 more"
    )
    assert [r["file_id"] for r in quality.within_size(files).collect()] == [9]


def test_scan_and_take_up(spark, tmp_path):
    folder = tmp_path / "pics"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.jpg", "b.TXT", "sub/a.jpg", "noext"):
        (folder / name).write_bytes(b"12345")
    listing = sf.list_folder(spark, str(folder))
    found = labelling.scan_files(listing)
    assert sorted(r["filename"] for r in found.collect()) == ["a.jpg", "a.jpg"]
    assert sorted(r["size"] for r in found.collect()) == [5, 5]
    assert sf.read_bytes(spark, str(folder)).filter(F.octet_length("content") == 5).count() == 4
    named = found.withColumn("dataset_id", F.lit("d")).withColumn("project_id", F.lit("p"))
    images = spark.createDataFrame([("d", "zzz.jpg")], "dataset_id string, filename string")
    taken = sorted(r["filename"] for r in labelling.take_up(named, images).collect())
    assert taken[0] == "a.jpg" and taken[1].startswith("a_") and len(taken[1]) == len("a_12345678.jpg")
    path = labelling.take_up(named, images).filter("filename = 'a.jpg'").first()["storage_path"]
    assert path == "projects/p/datasets/d/a.jpg"


def test_scan_marks(spark):
    mark = dt.datetime(2024, 1, 1, 12)
    rows = [("in/", mark), ("in/x.jpg", mark - dt.timedelta(seconds=60)), ("in/y.jpg", mark - dt.timedelta(seconds=59)), ("out/z.jpg", mark)]
    files = spark.createDataFrame(rows, "object_name string, time_created timestamp")
    found = labelling.scan_files(files, "in/", F.lit(mark))
    assert [r["object_name"] for r in found.collect()] == ["in/y.jpg"]


def test_tables_are_written_for_skipping(spark, tmp_path):
    frame = spark.createDataFrame([("r1", 2), ("r1", 1), ("r2", 3)], "evaluation_id string, image_id int")
    st.write_table(frame, str(tmp_path / "t"), st.PARTITION_COLUMNS["evaluation_results"], ["image_id"])
    back = st.read_table(spark, str(tmp_path / "t"), ["image_id", "evaluation_id"]).filter("evaluation_id = 'r1'")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(evaluation_id" in plan and back.count() == 2


def test_catalogue_merge_by_owner(spark):
    configs = spark.createDataFrame(
        [("1", "me", "p", "m", "a", "k", 0.5, 5, "s", None, 2, True), ("2", "me", "p", "m", "b", "k", 0.5, 5, "s", None, 2, True),
         ("3", "you", "p", "m", "c", "k", 0.5, 5, "s", None, 2, True)],
        "model_config_id string, owner_id string, provider string, model_name string, name string, auth_type string, temperature double,"
        " max_tokens int, api_key string, pricing struct<p: int>, concurrency int, is_active boolean",
    )
    listed = spark.createDataFrame(
        [("p", "m", "first", None, None, None, 0), ("p", "m", "last", None, (4,), 0.25, 1), ("p", "n", None, "key", None, 0.75, 2)],
        "provider string, model_name string, display_name string, auth_type string, pricing struct<p: int>, temperature double, position int",
    )
    rows = {(r["owner_id"], r["model_name"], r["name"]): r for r in catalog.merge_catalogue(configs, listed, "me").collect()}
    assert set(rows) == {("me", "m", "last"), ("me", "m", "b"), ("you", "m", "c"), ("me", "n", "n")}
    hit = rows["me", "m", "last"]
    assert (hit["model_config_id"], hit["temperature"], hit["max_tokens"], hit["api_key"], hit["pricing"]["p"]) == ("1", 0.25, 1024, "s", 4)
    assert (rows["me", "n", "n"]["temperature"], rows["me", "n", "n"]["api_key"]) == (0.0, "sk-placeholder")


def test_the_last_item_of_an_id_wins(spark, tmp_path):
    item = {"id": "a", "name": "one", "provider": "p", "model_name": "x", "max_tokens": 9}
    read = sc.read_model_configs(spark, write(tmp_path / "i.json", [item, {**item, "name": "two", "max_tokens": None}]))
    configs = read.filter("name = 'one'").drop("position")
    assert [(r["name"], r["max_tokens"]) for r in catalog.import_model_configs(configs, read).collect()] == [("two", 9)]

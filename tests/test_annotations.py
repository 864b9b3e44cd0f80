"""Import, export and progress of annotations."""

import random

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import annotations as oa
from gradeflow.schemas import ANSWER
from gradeflow.sources import csv_records, label_csv

ROWS = "row_no bigint, image_filename string, annotation_value string"
MARKS = f"image_id string, answer {ANSWER}, is_skipped boolean, is_flagged boolean, annotator_id string"


def images(spark, *names):
    return spark.createDataFrame([(f"i{k}", n) for k, n in enumerate(names)], "image_id string, filename string")


def marks(spark, *rows):
    return spark.createDataFrame(list(rows), MARKS)


def test_missing_columns():
    assert oa.missing_columns_error(["wrong_col"]) == "Missing columns: annotation_value, image_filename"
    assert oa.missing_columns_error(["image_filename", "annotation_value", "more"]) is None


def test_unknown_image(spark):
    rows = spark.createDataFrame([(2, "missing.jpg", "yes"), (3, "missing.jpg", ""), (4, None, "yes")], ROWS)
    result = oa.import_annotations(rows, images(spark, "test.jpg"), marks(spark), "binary")
    assert [tuple(r) for r in result.errors().orderBy("row_no").collect()] == [
        (2, "Image not found: missing.jpg"), (3, "Image not found: missing.jpg"), (4, "Image not found: nan")
    ]
    assert result.counters().first().asDict() == {
        "processed": 3, "created": 0, "updated": 0, "skipped": 0, "error_count": 3
    }


def test_create_then_update(spark):
    rows = spark.createDataFrame([(2, "test.jpg", "yes")], ROWS)
    created = oa.import_annotations(rows, images(spark, "test.jpg"), marks(spark), "binary")
    assert created.counters().first()["created"] == 1
    after = created.applied(marks(spark), "me")
    assert after.first()["answer"]["value_bool"] is True
    rows = spark.createDataFrame([(2, " test.jpg ", "no")], ROWS)
    updated = oa.import_annotations(rows, images(spark, "test.jpg"), after, "binary")
    assert updated.counters().first()["updated"] == 1
    assert updated.applied(after, "me").first()["answer"]["value_bool"] is False


def test_last_valid_row_wins_and_marks_stay(spark):
    rows = spark.createDataFrame(
        [(2, "a", "yes"), (3, "a", "no"), (4, "a", "maybe"), (5, "a", ""), (6, "b", "yes"), (7, "b", "no")], ROWS
    )
    old = marks(spark, ("i1", (True, None, None), True, True, "x"), ("i9", (True, None, None), False, False, "x"))
    result = oa.import_annotations(rows, images(spark, "a", "b", "a"), old, "binary")
    kinds = {r["row_no"]: r["outcome"] for r in result.outcomes.collect()}
    assert kinds == {2: "created", 3: "updated", 4: "error", 5: "skipped", 6: "updated", 7: "updated"}
    counts = result.counters().first()
    assert counts["created"] + counts["updated"] + counts["skipped"] + counts["error_count"] == counts["processed"] == 6
    after = {r["image_id"]: r for r in result.applied(old, "me").collect()}
    assert set(after) == {"i0", "i1", "i9"}
    assert after["i0"]["answer"]["value_bool"] is False and after["i0"]["annotator_id"] == "me"
    assert after["i1"]["answer"]["value_bool"] is False and after["i1"]["is_skipped"] and after["i1"]["is_flagged"]
    assert after["i9"]["annotator_id"] == "x"


def test_infinite_count_is_a_row_error(spark):
    rows = spark.createDataFrame([(2, "a", "inf"), (3, "a", "2.9")], ROWS)
    result = oa.import_annotations(rows, images(spark, "a"), marks(spark), "count")
    kinds = {r["row_no"]: r["outcome"] for r in result.outcomes.collect()}
    assert kinds == {2: "error", 3: "created"}


def test_all_or_nothing(spark):
    bad = spark.createDataFrame([(2, "a", "yes"), (3, "a", "maybe")], ROWS)
    good = spark.createDataFrame([(2, "a", "yes")], ROWS)
    pictures, none = images(spark, "a"), marks(spark)
    assert oa.import_annotations(bad, pictures, none, "binary").all_or_nothing(none, "me").count() == 0
    assert oa.import_annotations(good, pictures, none, "binary").all_or_nothing(none, "me").count() == 1
    preview = oa.import_preview(oa.import_annotations(bad, pictures, none, "binary")).first()
    assert (preview["total"], preview["valid"], preview["errors"], preview["can_confirm"]) == (2, 1, 1, False)


def test_hot_file_name(spark):
    """A third of the rows name one image."""
    rows = spark.createDataFrame(
        [(i + 2, "hot.jpg" if i % 3 == 0 else f"f{i}.jpg", "yes" if i % 2 else "no") for i in range(900)], ROWS
    )
    pictures = images(spark, "hot.jpg", *[f"f{i}.jpg" for i in range(0, 900, 2)])
    outcomes = oa.import_annotations(rows, pictures, marks(spark), "binary").outcomes.groupBy("outcome").count().collect()
    # 300 rows for the hot image, one of which creates; 300 even and 300 odd others by number.
    assert {r["outcome"]: r["count"] for r in outcomes} == {"created": 301, "updated": 299, "error": 300}


def test_row_numbers_repeat_over_files(spark):
    rows = spark.createDataFrame(
        [("f1", 2, "a", "yes"), ("f1", 3, "b", "maybe"), ("f2", 2, "b", "no"), ("f2", 3, "a", "no")], "file string, " + ROWS
    )
    result = oa.import_annotations(rows, images(spark, "a", "b"), marks(spark), "binary")
    kinds = {(r["file"], r["row_no"]): r["outcome"] for r in result.outcomes.collect()}
    assert kinds == {("f1", 2): "created", ("f1", 3): "error", ("f2", 2): "created", ("f2", 3): "updated"}
    assert {r["answer"]["value_bool"] for r in result.latest.collect()} == {False}
    assert [(r["file"], r["row_no"]) for r in result.stored_errors().collect()] == [("f1", 3)]


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('image_filename,annotation_value\na.jpg,yes\n"b.jpg","two\nlines"\nc.jpg,no\n')
    (tmp_path / "b.csv").write_text('extra,annotation_value,"image_filename"\n1,yes,c.jpg\n2,,d.jpg\n')
    rows = label_csv.read_import_rows(spark, str(tmp_path))
    got = sorted((r["file"].rsplit("/")[-1], r["row_no"], r["image_filename"], r["annotation_value"]) for r in rows.collect())
    assert got == [
        ("a.csv", 2, "a.jpg", "yes"), ("a.csv", 3, "b.jpg", "two\nlines"), ("a.csv", 4, "c.jpg", "no"),
        ("b.csv", 2, "c.jpg", "yes"), ("b.csv", 3, "d.jpg", None),
    ]
    assert label_csv.count_rows(spark, str(tmp_path)).first()[0] == 5


def test_csv_rows_and_numbers(spark, tmp_path):
    path = tmp_path / "labels.csv"
    lines = ["image_filename,annotation_value,extra"] + [f"f{i}.jpg,{'NA' if i % 5 == 0 else i}, x" for i in range(2000)]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    conf = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for key, setting in conf.items():
        spark.conf.set(key, setting)
    try:
        rows = label_csv.read_import_rows(spark, str(path), multi_line=False)
        assert rows.rdd.getNumPartitions() > 3
        got = sorted(map(tuple, rows.drop("file").collect()))
    finally:
        for key, setting in old.items():
            spark.conf.set(key, setting)
    assert got == [(i + 2, f"f{i}.jpg", None if i % 5 == 0 else str(i)) for i in range(2000)]
    assert label_csv.count_rows(spark, str(path)).first()[0] == 2000


def test_csv_quotes_line_breaks_and_bom(spark, tmp_path):
    path = tmp_path / "labels.csv"
    text = 'image_filename,annotation_value,dataset_name\n"a ""b"".jpg","two\nlines",d\n007.jpg,1.0,\n'
    path.write_text(text, encoding="utf-8-sig")
    rows = sorted(map(tuple, label_csv.read_import_rows(spark, str(path), multi_line=True).drop("file").collect()))
    assert rows == [(2, 'a "b".jpg', "two\nlines", "d"), (3, "007.jpg", "1.0", None)]
    assert label_csv.count_rows(spark, str(path), multi_line=True).first()[0] == 2
    bad = tmp_path / "bad.csv"
    bad.write_text("wrong_col\nx\n")
    with pytest.raises(label_csv.ImportFormatError, match="Missing columns"):
        label_csv.read_import_rows(spark, str(bad))


def plain_records(text):
    """Records of a text by one automaton over its characters."""
    out, own, inside, at_start, i = [], [], False, True, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                own.append('""')
                i += 2
                continue
            inside = c != '"'
        elif c == "\n":
            out.append("".join(own).removesuffix("\r"))
            own, at_start, i = [], True, i + 1
            continue
        elif c == '"' and at_start:
            inside = True
        at_start = not inside and c == ","
        own.append(c)
        i += 1
    return [r for r in [*out, "".join(own).removesuffix("\n").removesuffix("\r")] if r]


@pytest.mark.parametrize("seed", [1, 5])
def test_csv_in_many_splits_equals_one_reading(spark, tmp_path, seed):
    """Quoted breaks, doubled and stray quotes, empty lines, and a header that goes over several splits."""
    rng = random.Random(seed)
    bits = ["a", "b c", ",", ",", '"', '""', "\n", "\r\n", '"x\ny"', '"a ""q""\n\nb"', 'in"ch', "ü", "\n\n"]
    head = 'image_filename,annotation_value,"a long\nname, with ""quotes""\n' + "z\n" * 30 + '"\n'
    text = head + "".join(rng.choice(bits) for _ in range(1500))
    (tmp_path / "f.csv").write_bytes(text.encode())
    (tmp_path / "g.csv").write_bytes(("\ufeff" + "image_filename,annotation_value\r\n" + '"a","1\r\n2"\r\n' * 40).encode())
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for key, setting in conf.items():
        spark.conf.set(key, setting)
    try:
        records, splits = csv_records.read_records(spark, str(tmp_path))
        got = sorted((r["file"][-5:], r["record"], r["value"]) for r in records.collect())
        assert splits.count() > 20
        rows = label_csv.read_import_rows(spark, str(tmp_path / "g.csv")).collect()
        assert sorted((r["row_no"], r["image_filename"], r["annotation_value"]) for r in rows) == [(i, "a", "1\r\n2") for i in range(2, 42)]
        assert label_csv.count_rows(spark, str(tmp_path / "g.csv")).first()[0] == 40
        assert label_csv.read_import_rows(spark, str(tmp_path / "f.csv")).columns == ["file", "row_no", "image_filename", "annotation_value"]
    finally:
        for key, setting in old.items():
            spark.conf.set(key, setting)
    assert [v for f, _, v in got if f == "f.csv"] == plain_records(text)
    assert [(n, v) for f, n, v in got if f == "g.csv"] == list(enumerate(["image_filename,annotation_value"] + ['"a","1\r\n2"'] * 40, 1))


def test_error_report(spark, tmp_path):
    errors = spark.createDataFrame([(3, 'Invalid "x", sorry')], "row_no bigint, error string")
    label_csv.write_error_report(errors, str(tmp_path / "report"))
    parts = [p.read_text().splitlines() for p in (tmp_path / "report").glob("part-*")]
    assert all(lines[0] == "Row,Error" for lines in parts)
    assert [line for lines in parts for line in lines[1:]] == ['3,"Invalid ""x"", sorry"']


def test_results_export(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1, 2], " a ")], "id int, steps array<int>, text string")
    label_csv.write_results(frame, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True).first()
    assert (back["id"], back["steps"], back["text"]) == ("1", "[1,2]", " a ")
    label_csv.write_results(frame, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first()["steps"] == [1, 2]


def test_stats_and_next(spark):
    import datetime as dt

    pictures = spark.createDataFrame(
        [(f"i{i}", "d", f"f{i}", dt.datetime(2024, 1, 9 - i)) for i in range(4)],
        "image_id string, dataset_id string, filename string, uploaded_at timestamp",
    )
    old = marks(spark, ("i3", (True, None, None), False, True, "x"), ("i0", None, True, False, "x"))
    stats = oa.annotation_stats(pictures, old).first()
    assert [stats[c] for c in ("total", "annotated", "skipped", "flagged", "remaining", "progress_percent")] == [4, 1, 1, 1, 2, 50.0]
    assert oa.next_unannotated(pictures, old).first()["image_id"] == "i2"
    busy = spark.createDataFrame([("d", "processing")], "dataset_id string, processing_status string")
    assert oa.next_unannotated(pictures, old, busy).count() == 0
    update = marks(spark, ("i1", (False, None, None), False, False, "y"))
    assert oa.save_annotations(old, update, busy, pictures).count() == 2
    ready = busy.withColumn("processing_status", F.lit("ready"))
    assert oa.save_annotations(old, update, ready, pictures).count() == 3

"""Streams restarted with duplicate, late and repeated input."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation, functions as F

from gradeflow.operators.inference import Reply, Retry
from gradeflow.operators.labelling import scan_files, take_up, upload_totals
from gradeflow.streaming import discover as sd, labelling as sl, progress as sp, uploads as su

START = dt.datetime(2024, 1, 1, 12, 0, 0)
FILES = "job_id bigint, object_name string, time_created timestamp, size bigint"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def files_stream(spark, folder):
    stream = spark.readStream.schema(FILES).parquet(folder)
    return stream.withColumn("full_path", F.concat(F.lit("gs://b/"), F.col("object_name")))


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def model():
    def answer(requests):
        return [
            ValueError("unreadable") if "bad" in r["full_path"] else Reply("yes" if "dog" in r["full_path"] else "no", 1, 1, 3)
            for r in requests
        ]

    return answer


@pytest.mark.parametrize("delay", ["1 minute", None])
def test_each_path_once_and_late_files(spark, tmp_path, delay):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        found = sd.discover(files_stream(spark, source), prefix="in/", delay=delay).select("object_name")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
            availableNow=True
        ).start().awaitTermination()
        return sorted(r["object_name"] for r in spark.read.schema("object_name string").parquet(out).collect())

    put(spark, source, [(1, "in/a.jpg", at(0), 1), (1, "in/a.jpg", at(10), 1), (1, "in/x.txt", at(10), 1), (1, "in/", at(10), 1),
                        (1, "other/b.jpg", at(10), 1), (1, "in/top.JPG", at(600), 1)], FILES)
    assert run() == ["in/a.jpg", "in/top.JPG"]
    # Again, 30 s behind the mark, and five minutes behind it.
    put(spark, source, [(1, "in/top.JPG", at(610), 1), (1, "in/late.png", at(570), 1), (1, "in/lost.png", at(300), 1)], FILES)
    lost = [] if delay else ["in/lost.png"]  # found all the same where no delay is set
    assert run() == sorted(["in/a.jpg", "in/late.png", "in/top.JPG", *lost])
    put(spark, source, [(1, "in/late.png", at(590), 1), (1, "in/new.gif", at(700), 1)], FILES)
    assert run() == sorted(["in/a.jpg", "in/late.png", "in/new.gif", "in/top.JPG", *lost])


def test_marks_repeats_and_one_path_in_two_jobs(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")

    def run(checkpoint):
        listing = scan_files(files_stream(spark, source))
        sl.label_stream(
            listing, "A dog?", "binary", model, sink, str(tmp_path / checkpoint), retry=Retry(max_attempts=1)
        ).awaitTermination()
        rows = [r.asDict() for r in sl.read_runs(spark, sink).collect()]
        names = ("images_discovered", "already_known", "images_ingested", "ingest_failed")
        return sorted((r["job_id"], r["last_processed_timestamp"], *[r[n] for n in names]) for r in rows)

    put(spark, source, [(1, "dog.jpg", at(0), 1), (1, "cat.jpg", at(3), 1), (1, "dog.jpg", at(50), 1), (2, "dog.jpg", at(1), 1)], FILES)
    first = [(1, at(50), 3, 1, 2, 0), (2, at(1), 1, 0, 1, 0)]
    assert run("cp") == first
    # A lost checkpoint finds nothing new, and no known file is a failure.
    assert run("other") == sorted([*first, (1, at(50), 3, 3, 0, 0), (2, at(1), 1, 1, 0, 0)])
    assert sl.read_results(spark, sink).count() == 3


def test_labelling_runs_are_idempotent(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")

    def run(checkpoint):
        found = sd.discover(files_stream(spark, source), delay="1 minute")
        sl.label_stream(
            found, "A dog?", "binary", model, sink, str(tmp_path / checkpoint), retry=Retry(max_attempts=1)
        ).awaitTermination()
        rows = sl.read_results(spark, sink).collect()
        return {r["object_name"]: (r["model_response"], r["parsed"] and r["parsed"]["value_bool"], r["error"]) for r in rows}, len(rows)

    put(spark, source, [(1, "dog.jpg", at(0), 1), (1, "cat.jpg", at(1), 1), (2, "bad.jpg", at(2), 1)], FILES)
    first, count = run("cp")
    assert count == 3
    assert first == {"dog.jpg": ("yes", True, None), "cat.jpg": ("no", False, None), "bad.jpg": ("", None, "unreadable")}
    runs = {r["job_id"]: r for r in sl.read_runs(spark, sink).collect()}
    assert (runs[1]["images_discovered"], runs[1]["images_labeled"], runs[2]["images_failed"]) == (2, 2, 1)
    assert runs[1]["last_processed_timestamp"] == at(1)
    put(spark, source, [(1, "dog.jpg", at(400), 1), (1, "dog2.jpg", at(401), 1)], FILES)
    second, count = run("cp")  # dog.jpg comes back after its state is gone
    assert count == 4 and second["dog2.jpg"] == ("yes", True, None)
    # A lost checkpoint starts over at batch 0: nothing doubles, and nothing is overwritten.
    third, count = run("other")
    assert third == second and count == 4
    # A batch that failed after its results were written is repeated with the same outcome.
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    fourth, count = run("cp")
    assert fourth == second and count == 4


def test_take_up_in_the_stream_reads_no_history(spark, tmp_path, monkeypatch):
    """Image rows equal the batch rule, over batches and a lost checkpoint; a batch reads only its own tables."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    schema = FILES + ", dataset_id string, project_id string"
    before = spark.createDataFrame([("d", "x.jpg"), ("e", "y.jpg")], "dataset_id string, filename string")
    rows = [
        [(1, "a/x.jpg", at(0), 1, "d", "p"), (1, "b/y.jpg", at(2), 1, "d", "p"), (1, "c/y.jpg", at(1), 1, "d", "p")],
        [(1, "b/y.jpg", at(9), 1, "d", "p"), (2, "b/y.jpg", at(8), 1, "e", "p"), (3, "z/y.jpg", at(7), 1, "d", "p")],
        [(3, "z/n.jpg", at(10), 1, "d", "p"), (2, "b/y.jpg", at(12), 1, "e", "p")],
    ]
    opened = []
    whole = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **kw: opened.extend(paths) or whole(self, *paths, **kw))

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        listing = scan_files(stream.withColumn("full_path", F.concat(F.lit("gs://b/"), F.col("object_name"))))
        sl.label_stream(listing, "A dog?", "binary", model, sink, str(tmp_path / checkpoint), retry=Retry(max_attempts=1), images=before).awaitTermination()
        return sorted((r["dataset_id"], r["full_path"], r["filename"], r["original_name"], r["storage_path"]) for r in whole(spark.read, f"{sink}/images").collect())

    for part in rows[:2]:
        put(spark, source, part, schema)
    run("cp")
    put(spark, source, rows[2], schema)
    got = run("cp")
    every = spark.createDataFrame([r for part in rows for r in part], schema).withColumn("full_path", F.concat(F.lit("gs://b/"), F.col("object_name")))
    first = every.groupBy("job_id", "dataset_id", "project_id", "full_path").agg(F.min("time_created").alias("time_created"))
    # The batch rule names by time over the whole listing, the stream batch by batch: here both have one order.
    want = take_up(first.withColumn("filename", F.substring_index("full_path", "/", -1)), before)
    assert got == sorted((r["dataset_id"], r["full_path"], r["filename"], r["original_name"], r["storage_path"]) for r in want.collect())
    assert sl.read_results(spark, sink).count() == len(got) == 6
    per_batch = [p for p in opened if "/batch=" in p]
    batches = spark.read.parquet(f"{sink}/runs").select("batch").distinct().count()
    assert batches == 3 and all(f"{sink}/{kind}/batch=" in p for p in per_batch for kind in [p.split("/")[-2]])
    assert len(per_batch) == 2 * batches and len({p.split("batch=")[1] for p in per_batch}) == batches
    assert run("lost") == got and sl.read_results(spark, sink).count() == 6


def test_live_counters(spark, tmp_path):
    schema = "evaluation_id string, error string, is_correct boolean, latency_ms bigint"
    source = str(tmp_path / "in")
    put(spark, source, [("a", None, True, 5), ("a", "x", None, None), ("b", None, False, 7)], schema)
    stream = spark.readStream.schema(schema).parquet(source)
    query = sp.live_counters(stream).writeStream.outputMode("update").format("memory").queryName("live").trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    got = {r["evaluation_id"]: (r["completed"], r["failed"], r["correct"], r["latency_ms"]) for r in spark.table("live").collect()}
    assert got == {"a": (2, 1, 1, 5), "b": (1, 0, 0, 7)}


def test_observed_counters(spark):
    rows = spark.createDataFrame([(None,), ("x",), (None,)], "error string")
    seen = Observation("run")
    counted = rows.observe(seen, *sp.counters())
    assert counted.count() == 3 and seen.get == {"completed": 3, "failed": 1}


CHUNKS = "chunk_id bigint, dataset_id string, uploaded_at timestamp, status_before string, announced bigint, uploaded bigint"
STORY = [
    (1, "d", at(0), "ready", 10, 9), (2, "d", at(1), "processing", 5, 5), (3, "e", at(1), "processing", 2, 1),
    (4, "d", at(2), "processing", 3, 1), (5, "d", at(3), "failed", 4, 2), (6, "d", at(4), "processing", 6, 6),
    (7, "e", at(5), "processing", 1, 1),
]


def plain_totals(story):
    out = {}
    for _, dataset, _, status, announced, uploaded in story:
        total, done, count = out.get(dataset, (0, 0, 0))
        out[dataset] = (total + announced, done + uploaded, count + 1) if status == "processing" else (uploaded, uploaded, 1)
    return out


@pytest.mark.parametrize("cuts", [[7], [2, 5, 7], [1, 2, 3, 4, 5, 6, 7]])
def test_upload_totals(spark, tmp_path, cuts):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    begin = 0
    for end in cuts:
        put(spark, source, STORY[begin:end], CHUNKS)
        begin = end
        stream = spark.readStream.schema(CHUNKS).parquet(source)
        su.upload_totals_stream(stream, checkpoint).awaitTermination()
        names = ("total_files", "uploaded_files", "chunks")
        got = {r["dataset_id"]: tuple(r[n] for n in names) for r in su.read_totals(spark, checkpoint).collect()}
        assert got == plain_totals(STORY[:end])
    batch = upload_totals(spark.createDataFrame(STORY, CHUNKS))
    assert {r["dataset_id"]: (r["total_files"], r["uploaded_files"], r["chunks"]) for r in batch.collect()} == plain_totals(STORY)


LATE = [
    (21, "d", at(60), "processing", 4, 3), (20, "d", at(50), "ready", 9, 8), (5, "d", at(5), "ready", 99, 99), (6, "d", at(6), "processing", 7, 7),
    (22, "d", at(70), "processing", 2, None), (9, "d", at(50), "failed", 1, 1), (30, "f", at(9), None, 3, 2), (31, "f", at(1), "processing", 1, 1),
    (40, "g", at(2), "ready", 5, 5), (100, "g", at(2), "processing", 6, 6), (41, "g", at(2), "processing", 1, 1),
]


@pytest.mark.parametrize("cuts", [2, 6])
def test_uploads_in_any_order(spark, tmp_path, cuts):
    """A start that is older than the kept one comes late, chunks come before their start, and starts share a time."""
    rng = random.Random(cuts)
    for trial in range(2):
        source, checkpoint = str(tmp_path / f"in{trial}"), str(tmp_path / f"cp{trial}")
        story = LATE if trial == 0 else rng.sample(LATE, len(LATE))
        step = -(-len(story) // cuts)
        for begin in range(0, len(story), step):
            put(spark, source, story[begin : begin + step], CHUNKS)
        stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(source)
        su.upload_totals_stream(stream, checkpoint, parts=3).awaitTermination()
        names = ("dataset_id", "total_files", "uploaded_files", "chunks")
        want = sorted(tuple(r[n] for n in names) for r in upload_totals(spark.createDataFrame(LATE, CHUNKS)).collect())
        assert sorted(tuple(r[n] for n in names) for r in su.read_totals(spark, checkpoint).collect()) == want
        assert not list((tmp_path / f"cp{trial}").glob("totals*"))


def test_names_share_groups_of_state(spark, tmp_path, monkeypatch):
    """A batch calls the state once a group of names, not once a name; names in one group don't meet."""
    monkeypatch.setattr(sl, "GROUPS", 2)
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    schema = FILES + ", dataset_id string, project_id string"
    images = spark.createDataFrame([("d", "f3.jpg"), ("d", None), (None, "f5.jpg")], "dataset_id string, filename string")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        listing = scan_files(stream.withColumn("full_path", F.concat(F.lit("gs://b/"), F.col("object_name"))))
        sl.label_stream(listing, "A dog?", "binary", model, sink, str(tmp_path / checkpoint), retry=Retry(max_attempts=1), images=images).awaitTermination()
        return sorted((r["full_path"], r["filename"] == r["original_name"]) for r in sl.read_images(spark, sink).collect())

    first = [(1, f"a/f{i}.jpg", at(i), 1, "d", "p") for i in range(40)]
    again = [(1, f"{folder}/f{i}.jpg", at(100 + i), 1, "d", "p") for i in range(0, 40, 4) for folder in "ab"]
    put(spark, source, first + first[:5], schema)
    put(spark, source, again, schema)
    want = sorted([(f"gs://b/a/f{i}.jpg", i != 3) for i in range(40)] + [(f"gs://b/b/f{i}.jpg", False) for i in range(0, 40, 4)])
    assert run("cp") == want
    state = spark.read.format("statestore").option("stateVarName", "first").load(str(tmp_path / "cp"))
    assert state.select("key").distinct().count() == 2 and state.count() == 40
    assert run("lost") == want


def test_parts_share_groups_of_state(spark, tmp_path, monkeypatch):
    """Many datasets in two groups of state, their chunks in pieces of two, in an order that makes late starts take chunks over."""
    monkeypatch.setattr(su, "GROUPS", 2)
    monkeypatch.setattr(su, "PIECE", 2)
    rng = random.Random(3)
    story = [(c, f"d{rng.randrange(5)}", at(c // 2), rng.choice(["processing"] * 9 + ["ready"]), c, c // 2) for c in range(150)] + [(900, None, at(1), "processing", 4, 3)]
    rng.shuffle(story)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    for begin in range(0, len(story), 60):
        put(spark, source, story[begin : begin + 60], CHUNKS)
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(source)
    su.upload_totals_stream(stream, checkpoint, parts=2).awaitTermination()
    names = ("dataset_id", "total_files", "uploaded_files", "chunks")
    rows = lambda df: {tuple(r[n] for n in names) for r in df.where("dataset_id IS NOT NULL").collect()}
    assert rows(su.read_totals(spark, checkpoint)) == rows(upload_totals(spark.createDataFrame(story, CHUNKS)))
    state = spark.read.format("statestore").option("stateVarName", "totals").load(checkpoint)
    assert state.select("key").distinct().count() == 2 and state.count() == 11

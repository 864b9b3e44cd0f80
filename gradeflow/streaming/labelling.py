"""Incremental labelling of arriving files with Structured Streaming."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gradeflow.functions.answers import parse_answer
from gradeflow.functions.paths import basename
from gradeflow.operators.inference import Predictor, Retry, run_inference
from gradeflow.operators.labelling import high_water_mark, named_image, run_counters
from gradeflow.streaming.state import GROUPS, rocksdb_state

RESULTS, RUNS, FILES, IMAGES = "results", "runs", "files", "images"
DEFAULT_INTERVAL = "15 minutes"


def label_batch(
    files: DataFrame,
    question: Column,
    system_message: Column,
    question_type: str,
    predictor: Callable[[], Predictor],
    retry: Retry = Retry(),
    parallel_calls: int | None = None,
) -> DataFrame:
    """One prompt per file; a failing row has response "", no answer and its error."""
    chain = F.array(
        F.struct(F.lit(1).alias("step_number"), system_message.alias("system_message"), question.alias("prompt"))
    )
    answered = run_inference(files, chain, predictor, ["full_path"], retry, parallel_calls)
    step = F.get("steps", F.lit(0))
    return answered.select(
        *files.columns,
        F.coalesce("model_response", F.lit("")).alias("model_response"),
        F.when(F.col("error").isNull(), parse_answer("model_response", question_type)).alias("parsed"),
        step["latency_ms"].alias("latency_ms"),
        "error",
    )


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that no batch may have written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _stream_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id Spark gave the stream of this checkpoint, the same after a restart; none before its first start."""
    metadata = _existing_text(spark, f"{checkpoint}/metadata")
    return metadata.select(F.get_json_object("value", "$.id")).first()[0] if metadata is not None else None


def _existing_text(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class _Known(StatefulProcessor):
    """Of a group of names: the place that took each name first, and the further places known.

    A name belongs to its dataset (or job), a place is a path of a job.  A name that an image has is taken by
    no place.  Most names have one place, which then costs one look-up and one update.

    Beside an initial state Spark hands computed columns on without their names, so they go by their place.
    """

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "owner string, name string", "job string, path string")
        self.further = handle.getMapState("further", "owner string, job string, path string", "seen boolean")

    def _take(self, name: tuple[str, str], place: tuple[str, str]) -> tuple[bool, bool]:
        """Whether the place is new, and whether another has its name; from now on it is known."""
        first = self.first.getValue(name)
        if first is None:
            self.first.updateValue(name, place)
            return True, False
        if tuple(first) == place or self.further.containsKey((name[0], *place)):
            return False, False
        self.further.updateValue((name[0], *place), (True,))
        return True, True

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        for _, owner, name, job, path in initial.itertuples(index=False, name=None):
            if path is not None:
                self._take((owner, name), (job, path))
            elif self.first.getValue((owner, name)) is None:
                self.first.updateValue((owner, name), (None, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        parts = [part for part in rows if len(part)]  # a key of the initial state may have no rows
        if not parts:
            return
        given = pd.concat([part.set_axis(self.names, axis=1) for part in parts], ignore_index=True).sort_values(["time_created", "full_path"], kind="stable")
        seen, fresh, clash = set(), [], []
        for owner, name, *place in zip(given["_owner"], given["_name"], given["_job"], given["_path"]):
            known = (owner, *place)
            new, taken = (False, False) if known in seen else self._take((owner, name), tuple(place))
            seen.add(known)
            fresh.append(new)
            clash.append(taken)
        yield given.assign(_fresh=fresh, _clash=clash)

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, filename: Column) -> DataFrame:
    """Keys of the state: the dataset (or, without one, the job) and the file name, in groups; the place that is known within."""
    owner = F.col("dataset_id") if "dataset_id" in rows.columns else F.col("job_id")
    named = rows.select(
        "*", F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.coalesce(filename, F.lit("")).alias("_name"),
        F.coalesce(F.col("job_id").cast("string"), F.lit("")).alias("_job"), F.coalesce("full_path", F.lit("")).alias("_path"),
    )
    return named.select("*", _group())


def _group() -> Column:
    return F.pmod(F.xxhash64("_owner", "_name"), F.lit(GROUPS)).cast("int").alias("_group")


def with_known(files: DataFrame, results: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Streamed files with ``_fresh`` (a path new to its job) and ``_clash`` (fresh, but its name is taken).

    What is known is keyed state, so a batch reads no earlier result.  ``results`` (job_id, full_path, the name in
    ``original_name`` or the path) and ``images`` (dataset_id, filename) are the state that a new checkpoint begins with.
    """
    names = ["_group", "_owner", "_name", "_job", "_path"]
    known = []
    if results is not None:
        known.append(_keyed(results, basename("full_path")).select(*names))
    if images is not None and "dataset_id" in files.columns:
        held = images.select(F.col("dataset_id").cast("string").alias("_owner"), F.col("filename").alias("_name")).dropna()  # others take no name
        known.append(held.select(_group(), "*", F.lit(None).cast("string").alias("_job"), F.lit(None).cast("string").alias("_path")))
    rows = _keyed(files, basename("full_path"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_fresh", T.BooleanType()), T.StructField("_clash", T.BooleanType())])
    begins = functools.reduce(DataFrame.unionByName, known).groupBy("_group") if known else None
    return rows.groupBy("_group").transformWithStateInPandas(_Known(rows.columns), schema, "Append", "None", initialState=begins).drop(*names)


def label_stream(
    files: DataFrame,
    question: str,
    question_type: str,
    predictor: Callable[[], Predictor],
    sink: str,
    checkpoint: str,
    system_message: str | None = None,
    retry: Retry = Retry(),
    every: str | None = None,
    parallel_calls: int | None = None,
    images: DataFrame | None = None,
) -> StreamingQuery:
    """Label every discovered file once and keep results, image rows and run counters under ``sink``.

    ``files`` has job_id, full_path and time_created, one row per listing; repeats
    are left out here, after they were counted and the mark was taken, so the
    listing goes in as :func:`scan_files` gives it.  Without ``every`` the query takes what
    is there and stops, to be started again by the scheduler at hand.  Each
    micro-batch is one run.  It overwrites its own folder, named by stream and
    batch, so a batch that is repeated after a failure leaves the same rows, and
    a new checkpoint touches nothing that is there.

    Known paths are state of the stream: a batch costs what it brings, however
    much was labelled before.  A new checkpoint begins with the results that other
    streams left under ``sink``; one stream at a time writes there.  Where files have
    dataset_id and project_id, every fresh file becomes an image row as
    :func:`~gradeflow.operators.labelling.take_up` makes it, under a name that neither ``images``
    (dataset_id, filename) nor an earlier file of the dataset has; the row is written before its file is labelled.
    """
    spark = files.sparkSession
    question_column, message = F.lit(question), F.lit(system_message).cast("string")
    takes_up = {"dataset_id", "project_id"} <= set(files.columns)
    own = _stream_id(spark, checkpoint)
    results = _existing(spark, f"{sink}/{RESULTS}")
    if results is not None and own:  # what batch 0 wrote before it failed isn't known to its repetition
        results = results.filter(~F.col("batch").startswith(f"{own}-"))

    def one_run(batch: DataFrame, batch_id: int) -> None:
        # The stream is read once; everything after starts from the table written here.
        name = f"{_stream_id(spark, checkpoint)}-{batch_id}"
        seen = f"{sink}/{FILES}/batch={name}"
        batch.write.mode("overwrite").parquet(seen)
        marked = spark.read.schema(batch.schema).parquet(seen)
        discovered, fresh = marked.drop("_fresh", "_clash"), marked.filter("_fresh")
        known = marked.filter("NOT _fresh").select("job_id")
        if takes_up:
            fresh = named_image(fresh.withColumn("filename", basename("full_path")), F.col("_clash"))
            fresh.drop("_fresh", "_clash").write.mode("overwrite").parquet(f"{sink}/{IMAGES}/batch={name}")
        labelled = label_batch(
            fresh.drop("_fresh", "_clash"), question_column, message, question_type, predictor, retry, parallel_calls
        )
        target = f"{sink}/{RESULTS}/batch={name}"
        labelled.write.mode("overwrite").parquet(target)
        written = spark.read.schema(labelled.schema).parquet(target)  # the model is not asked again
        counters = run_counters(discovered, written, written, "job_id", known).join(high_water_mark(discovered), "job_id")
        counters.write.mode("overwrite").parquet(f"{sink}/{RUNS}/batch={name}")

    with rocksdb_state(spark):
        writer = with_known(files, results, images).writeStream.foreachBatch(one_run).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_results(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/{RESULTS}")


def read_runs(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/{RUNS}")


def read_images(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/{IMAGES}")

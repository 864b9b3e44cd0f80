"""A whole evaluation run over a log of kept answers.

Answers of a paid model are asked for once.  They go to an append-only log, a
folder of Parquet files per run and attempt, and every result is read from
there: a second action, a lost executor or a restarted run asks only for what the
log does not hold yet.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeflow.operators import scoring, selection
from gradeflow.operators.inference import DEFAULT_PARALLEL_CALLS, MAX_PARALLEL_CALLS, Predictor, Retry, run_inference
from gradeflow.schemas import STEPS
from gradeflow.session import new_work_path

#: Images whose answers one task asks for, about, before they are committed to the log.
AT_RISK = 500
# Fixed value: message of a run without images.
NOTHING_SELECTED = "No annotated images in dataset (or selection criteria matched none)"


class EvaluationError(ValueError):
    """A run that can't begin."""


def log_folder(log: str, evaluation_id: str) -> str:
    """The folder of one run inside the log."""
    return f"{log.rstrip('/')}/evaluation_id={quote(str(evaluation_id), safe='')}"


def logged_answers(spark: SparkSession, log: str, evaluation_id: str, id_type: str = "bigint") -> DataFrame:
    """The kept answers of a run: image_id, model_response, steps, error, attempt; one row per image.

    Tasks that ran twice (speculation, a commit cut off) may have left two
    answers; the first by attempt and file counts, in every reading alike.  A run
    without a log has no rows.
    """
    schema = f"image_id {id_type}, model_response string, steps {STEPS}, error string, attempt int"
    try:
        rows = spark.read.schema(schema).parquet(log_folder(log, evaluation_id))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    answer = F.struct("model_response", "steps", "error", "attempt")
    place = F.struct("attempt", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    first = rows.groupBy("image_id").agg(F.min_by(answer, place).alias("_answer"))
    return first.select("image_id", "_answer.*")


def answer_images(
    chosen: DataFrame,
    chain: Column | Sequence[Mapping],
    predictor: Callable[[], Predictor],
    payload: Sequence[str],
    log: str,
    evaluation_id: str,
    retry: Retry = Retry(),
    parallel_calls: int = DEFAULT_PARALLEL_CALLS,
    at_risk: int = AT_RISK,
) -> int:
    """Ask the model for every image the log has no answer of; returns how many those were.

    The images go in rounds of ``parallel_calls`` tasks with about ``at_risk``
    images each.  A task's answers are in the log as soon as it ends, whatever
    happens to the others, their executors or the driver; what can be asked twice is the
    images of tasks under way.  A row that ended in an error is an answer.
    Ids must be unique and not NULL.  One run at a time writes to an evaluation's log.
    """
    if not 1 <= parallel_calls <= MAX_PARALLEL_CALLS:
        raise ValueError(f"parallel_calls must be 1-{MAX_PARALLEL_CALLS}")
    if at_risk < 1:
        raise ValueError("at_risk must be 1 or more")
    spark, id_type = chosen.sparkSession, chosen.schema["image_id"].dataType.simpleString()
    known = logged_answers(spark, log, evaluation_id, id_type)
    before = known.agg(F.max("attempt")).first()[0]
    columns = [*dict.fromkeys(["image_id", *payload])]
    if isinstance(chain, Column):  # it may read any column of the images
        chosen, chain = chosen.withColumn("_prompts", chain), F.col("_prompts")
        columns.append("_prompts")
    todo = selection.remaining_images(chosen, known).select(*columns)
    waiting = todo.select("image_id").count()
    if not waiting:
        return 0
    # The list is written once, laid out by round, so that a round reads only its own images.
    rounds = -(-waiting // (parallel_calls * at_risk))
    listed = new_work_path(spark, "todo")
    turn = F.pmod(F.xxhash64("image_id"), F.lit(rounds)).alias("_round")
    todo.select("*", turn).repartition("_round").write.partitionBy("_round").parquet(listed)
    rows = spark.read.schema(f"{todo.schema.toDDL()}, _round bigint").parquet(listed)
    target = f"{log_folder(log, evaluation_id)}/attempt={(before or 0) + 1}"
    for number in range(rounds):
        mine = rows.filter(F.col("_round") == number).drop("_round")
        # By id and not in turn: a repeated task gets the same images again.
        mine = mine.repartition(parallel_calls, F.hash("image_id"))
        answered = run_inference(mine, chain, predictor, payload, retry)
        answered.select("image_id", "model_response", "steps", "error").write.mode("append").option(
            # A task moves its file into the log when it ends, not when the job does.
            "mapreduce.fileoutputcommitter.algorithm.version", "2"
        ).parquet(target)
    return waiting


def evaluate_run(
    images: DataFrame,
    annotations: DataFrame,
    chain: Column | Sequence[Mapping],
    predictor: Callable[[], Predictor],
    payload: Sequence[str],
    log: str,
    evaluation_id: str,
    config: dict | None = None,
    seed: int = 0,
    strict: bool = False,
    **calls,
) -> DataFrame:
    """Select, resume, infer, keep and score: the scored rows of a whole run.

    ``images`` carry question_type and ``annotations`` ground_truth (or the other
    way round); ``config`` selects among the annotated images; ``calls`` are the
    settings of :func:`answer_images`.  The model has been asked when this
    returns, and the rows come from the log, so using them asks nothing again.
    A run that is called again goes on where it ended.  Raises EvaluationError
    where nothing is selected, before any call.
    """
    usable = selection.evaluable_images(images, annotations)
    chosen = selection.select_images(usable, config, seed)
    if chosen.select("image_id").isEmpty():
        raise EvaluationError(NOTHING_SELECTED)
    answer_images(chosen, chain, predictor, payload, log, evaluation_id, **calls)
    id_type = chosen.schema["image_id"].dataType.simpleString()
    kept = logged_answers(images.sparkSession, log, evaluation_id, id_type)
    rows = chosen.join(kept, "image_id").withColumn("evaluation_id", F.lit(str(evaluation_id)))
    return scoring.score(rows, strict)

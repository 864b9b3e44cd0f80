"""A whole run: kept answers, resumed and repeated runs, and workers that die."""

import os

import pytest
from py4j.protocol import Py4JJavaError

from gradeflow.operators import evaluation, scoring
from gradeflow.operators.inference import ModelError, Reply, Retry

CHAIN = ({"step_number": 1, "system_message": None, "prompt": "First?"}, {"step_number": 2, "system_message": None, "prompt": "{output1} again?"})
QUIET = Retry(max_attempts=1, sleep=lambda seconds: None)


def model(calls, dies_at=None):
    """A model by rule that writes down what it is asked; its worker dies once at an image."""

    def build():
        def answer(requests):
            with open(calls, "a") as asked:
                for r in requests:
                    asked.write(f"{r['image_id']} {r['prompt']}\n")
            if dies_at is not None and any(r["image_id"] == dies_at for r in requests):
                os._exit(1)
            return [ModelError("busy", 429) if r["image_id"] % 9 == 0 else Reply(f"yes {r['prompt']}", 3, 1, 5) for r in requests]

        return answer

    return build


def tables(spark, n=60):
    images = spark.range(n).selectExpr("id AS image_id", "'binary' AS question_type", "'img' AS filename", "IF(id % 10 = 7, 'failed', 'completed') AS processing_status", "'x' AS error_note")
    truth = "named_struct('value_bool', id % 2 = 0, 'value_count', CAST(NULL AS DECIMAL(38,0)), 'value_str', CAST(NULL AS STRING)) AS ground_truth"
    return images, spark.range(0, n, 1).filter("id % 4 <> 3").selectExpr("id AS image_id", truth)


def run(spark, calls, log, dies_at=None, **more):
    return evaluation.evaluate_run(*tables(spark), CHAIN, model(str(calls), dies_at), ["image_id"], str(log), "a/b@1", retry=QUIET, parallel_calls=2, at_risk=4, **more)


def rows(frame):
    return sorted((r["image_id"], r["model_response"], r["error"], r["is_correct"], len(r["steps"]), r["evaluation_id"]) for r in frame.collect())


def asked(calls):
    return [line for line in calls.read_text().splitlines() if line.endswith(" First?")]


def test_resumed_run_equals_a_fresh_one(spark, tmp_path):
    fresh = rows(run(spark, tmp_path / "c1", tmp_path / "fresh"))
    assert [r[0] for r in fresh] == [i for i in range(60) if i % 4 != 3 and i % 10 != 7]
    assert {r[2] for r in fresh if r[0] % 9 == 0} == {"busy"} and all(r[3] == (r[0] % 2 == 0) for r in fresh if r[0] % 9)
    with pytest.raises(Py4JJavaError):
        run(spark, tmp_path / "c2", tmp_path / "killed", dies_at=fresh[len(fresh) // 2][0])
    kept = {r["image_id"] for r in evaluation.logged_answers(spark, str(tmp_path / "killed"), "a/b@1").collect()}
    assert 0 < len(kept) < len(fresh)
    before = asked(tmp_path / "c2")
    resumed = run(spark, tmp_path / "c2", tmp_path / "killed")
    again = {int(line.split()[0]) for line in asked(tmp_path / "c2")[len(before) :]}
    assert again == {r[0] for r in fresh} - kept  # what was kept is never asked for again
    assert rows(resumed) == fresh
    assert {r["attempt"] for r in resumed.collect()} == {1, 2}


def test_finished_tasks_of_a_failed_round_are_kept(spark, tmp_path):
    chosen = tables(spark)[0].filter("image_id < 40").coalesce(1)

    def slow(calls, dies_at):
        build = model(calls, dies_at)

        def late():
            call = build()

            def answer(requests):
                if any(r["image_id"] == dies_at for r in requests):
                    import time

                    time.sleep(6)
                return call(requests)

            return answer

        return late

    with pytest.raises(Py4JJavaError):  # one round of two tasks: the other one has ended when this one dies
        evaluation.answer_images(chosen, CHAIN, slow(str(tmp_path / "c"), 11), ["image_id"], str(tmp_path / "log"), "r", QUIET, 2, 1000)
    kept = evaluation.logged_answers(spark, str(tmp_path / "log"), "r").count()
    assert 0 < kept < 40
    assert evaluation.answer_images(chosen, CHAIN, model(str(tmp_path / "c")), ["image_id"], str(tmp_path / "log"), "r", QUIET, 2, 1000) == 40 - kept


def test_actions_and_repeated_runs_ask_nothing(spark, tmp_path):
    first = run(spark, tmp_path / "c", tmp_path / "log", config={"mode": "random_count", "count": 10})
    assert first.count() == 10 and scoring.summarize(first).first()["total"] == 10
    assert len(asked(tmp_path / "c")) == 10
    whole = run(spark, tmp_path / "c", tmp_path / "log")  # a wider selection asks for the others only
    assert len(rows(whole)) == len(asked(tmp_path / "c")) == len(set(asked(tmp_path / "c")))
    run(spark, tmp_path / "c", tmp_path / "log").count()
    assert len(asked(tmp_path / "c")) == whole.count()


def test_nothing_selected_and_repeated_answers(spark, tmp_path):
    images, truths = tables(spark)
    with pytest.raises(evaluation.EvaluationError, match="No annotated images"):
        evaluation.evaluate_run(images, truths.limit(0), CHAIN, model(str(tmp_path / "c")), ["image_id"], str(tmp_path / "log"), "e")
    assert evaluation.logged_answers(spark, str(tmp_path / "log"), "e").count() == 0
    answer = spark.sql(f"SELECT 1L AS image_id, 'old' AS model_response, CAST(NULL AS {evaluation.STEPS}) AS steps, CAST(NULL AS STRING) AS error")
    folder = evaluation.log_folder(str(tmp_path / "log"), "e")
    answer.write.parquet(f"{folder}/attempt=1")
    answer.selectExpr("image_id", "'new' AS model_response", "steps", "error").write.parquet(f"{folder}/attempt=2")
    assert [(r["model_response"], r["attempt"]) for r in evaluation.logged_answers(spark, str(tmp_path / "log"), "e").collect()] == [("old", 1)]

"""Inference, embeddings, images and similar items."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import imaging, inference as inf, similarity as sim
from gradeflow.operators.progress import processing_outcome

CHAIN = (
    {"step_number": 1, "prompt": "First."},
    {"step_number": 2, "prompt": "Given {output1}, what?"},
)


class Flaky:
    """Fails with a status a number of times per prompt, then answers."""

    def __init__(self, failures):
        self.failures, self.calls = list(failures), 0

    def __call__(self, requests):
        self.calls += 1
        return [inf.ModelError("busy", self.failures.pop(0)) if self.failures else inf.Reply("ok") for _ in requests]


def test_retry_waits_and_gives_up():
    waits = []
    retry = inf.Retry(sleep=waits.append)
    model = Flaky([429, 503])
    (reply, attempts), = inf.call_with_retry(model, [{}], retry)
    assert reply.text == "ok" and attempts == 3 and waits == [2, 4]
    waits.clear()
    (reply, attempts), = inf.call_with_retry(Flaky([500] * 9), [{}], retry)
    assert isinstance(reply, inf.ModelError) and attempts == 5 and waits == [2, 4, 8, 16]
    assert inf.Retry().wait(9) == 30
    (reply, attempts), = inf.call_with_retry(Flaky([400]), [{}], retry)
    assert isinstance(reply, inf.ModelError) and attempts == 1


def test_embedding_retry_is_for_rate_limits_only():
    assert inf.EMBEDDING_RETRY.wants(inf.ModelError("x", 429)) and not inf.EMBEDDING_RETRY.wants(inf.ModelError("x", 503))
    assert [inf.EMBEDDING_RETRY.wait(a) for a in (1, 2)] == [2, 2] and inf.EMBEDDING_RETRY.max_attempts == 3


def test_only_failed_requests_are_sent_again():
    seen = []

    def model(requests):
        seen.append([r["n"] for r in requests])
        return [inf.ModelError("x", 429) if r["n"] == 2 and len(seen) == 1 else inf.Reply(str(r["n"])) for r in requests]

    got = inf.call_with_retry(model, [{"n": 1}, {"n": 2}], inf.Retry(sleep=lambda s: None))
    assert seen == [[1, 2], [2]] and [(r.text, a) for r, a in got] == [("1", 1), ("2", 2)]


def test_chain_keeps_steps_before_a_failure(spark):
    def model():
        def answer(requests):
            return [
                ValueError("refused") if r["image_id"] == 3 and r["prompt"] != "First." else inf.Reply(f"<{r['prompt']}>", 2, 1)
                for r in requests
            ]

        return answer

    frame = spark.range(5).select(F.col("id").alias("image_id"), F.lit("x").alias("other"))
    rows = {r["image_id"]: r for r in inf.run_inference(frame, CHAIN, model, ["image_id"], parallel_calls=2).collect()}
    assert len(rows) == 5 and rows[0]["model_response"] == "<Given <First.>, what?>" and rows[0]["other"] == "x"
    assert [s["step_number"] for s in rows[0]["steps"]] == [1, 2] and rows[0]["error"] is None
    assert rows[3]["model_response"] is None and rows[3]["error"] == "refused"
    assert [s["raw_output"] for s in rows[3]["steps"]] == ["<First.>"]


def test_a_failing_batch_fails_its_rows_not_its_task(spark):
    def model():
        def answer(requests):
            raise RuntimeError("no connection")

        return answer

    rows = inf.run_inference(spark.range(3), CHAIN[:1], model, ["id"]).collect()
    assert [r["error"] for r in rows] == ["no connection"] * 3 and all(r["steps"] == [] for r in rows)


def test_chain_per_row(spark):
    frame = spark.createDataFrame([(1, "A"), (2, "B")], "id int, prompt string")
    chain = F.array(F.struct(F.lit(1).alias("step_number"), F.lit(None).cast("string").alias("system_message"), "prompt"))

    def echo():
        return lambda requests: [inf.Reply(r["prompt"]) for r in requests]

    got = {r["id"]: r["model_response"] for r in inf.run_inference(frame, chain, echo, ["id"]).collect()}
    assert got == {1: "A", 2: "B"}


def test_arguments_are_checked(spark):
    for bad in (0, 101):
        with pytest.raises(ValueError):
            inf.run_inference(spark.range(1), CHAIN, lambda: None, ["id"], parallel_calls=bad)
    with pytest.raises(ValueError):
        inf.chain_literal([{"step_number": 2, "prompt": "x"}])
    with pytest.raises(ValueError):
        inf.chain_literal([])


def test_dispatch():
    call = inf.dispatch({"a": lambda rs: [inf.Reply("A")] * len(rs), "b": lambda rs: [inf.Reply("B")] * len(rs)})
    got = call([{"provider": p} for p in ("b", "a", "x", "b")])
    assert [g.text for i, g in enumerate(got) if i != 2] == ["B", "A", "B"]
    assert str(got[2]) == "Unknown provider: x"


def test_embeddings(spark):
    def embedders():
        def embedder(requests, size):
            return [inf.Embedded(text=[1.0] * size, video=[(0.0, 2.0, [0.5])]) for _ in requests]

        return {"google_multimodal": embedder}

    frame = spark.createDataFrame([(1, "a")], "id int, text string")
    got = inf.embed(frame, embedders, ["text"]).first()
    assert len(got["text_embedding"]) == got["dimension"] == 1408 and got["image_embedding"] is None
    assert got["video_embeddings"][0]["end_offset_sec"] == 2.0 and got["error"] is None
    wrong = inf.embed(frame, embedders, ["text"], provider="other").first()
    assert wrong["error"] == "Unknown embedding provider: other" and wrong["text_embedding"] is None


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\0\0\0"
GIF = b"GIF89a" + struct.pack("<HH", 32, 16) + b"\0" * 4
BMP = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc4\0\x03x\xff\xc2\0\x11\x08" + struct.pack(">HH", 300, 400) + b"\x03"
WEBP_X = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
WEBP_L = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (((19 << 14) | 9)).to_bytes(4, "little") + b"\0" * 8
WEBP = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 176, 144)


@pytest.mark.parametrize(
    "data, size",
    [(PNG, (640, 480)), (GIF, (32, 16)), (BMP, (7, 9)), (JPEG, (400, 300)), (WEBP_X, (100, 50)), (WEBP_L, (10, 20)), (WEBP, (176, 144))],
)
def test_image_size(data, size):
    assert imaging.image_size(data) == size


def test_read_dimensions_and_processing(spark):
    frame = spark.createDataFrame([("a", PNG), ("b", b"nothing"), ("c", None)], "path string, content binary")
    got = {r["path"]: (r["width"], r["height"], r["error"] is None) for r in imaging.read_dimensions(frame).collect()}
    assert got == {"a": (640, 480, True), "b": (None, None, False), "c": (None, None, False)}

    def thumbnail(data):
        return data[:4] if data.startswith(b"\x89") else imaging.image_size(data)

    images = frame.filter("path <> 'c'").selectExpr(
        "path AS image_id", "'d' AS dataset_id", "path AS filename", "'pending' AS processing_status", "content"
    )
    done = imaging.process_images(images, thumbnail)
    assert {r["image_id"]: (r["processing_status"], r["payload"]) for r in done.collect()} == {
        "a": ("completed", bytearray(b"\x89PNG")), "b": ("failed", None)
    }
    outcome = processing_outcome(done).first()
    assert (outcome["processing_status"], outcome["progress_percent"]) == ("failed", 50.0)
    assert outcome["processing_errors"] == ["b: Unable to read image: no size in its header"]


@pytest.mark.parametrize("pivots, block, k", [(1, 7, 1), (5, 16, 4), (16, 4096, 3)])
def test_nearest_items_are_exact(spark, pivots, block, k):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(3, 8))
    # Two thirds of the items crowd around one center.
    vectors = [centers[0 if i % 3 else i % 9 // 3] + rng.normal(size=8) * 0.2 for i in range(150)]
    vectors[10] = vectors[20]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "item_id bigint, embedding array<double>")
    queries = frame.withColumnRenamed("item_id", "query_id")
    got = sim.nearest_items(queries, frame, k, pivot_count=pivots, block=block).collect()
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    exact = np.round(unit @ unit.T, 9)
    assert len(got) == 150 * k
    for query in range(150):
        order = sorted((j for j in range(150) if j != query), key=lambda j: (-exact[query, j], j))[:k]
        mine = sorted((r["place"], r["item_id"]) for r in got if r["query_id"] == query)
        assert [i for _, i in mine] == order


def test_few_items(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id bigint, embedding array<double>")
    got = sim.nearest_items(frame.withColumnRenamed("item_id", "query_id"), frame, 5).collect()
    assert sorted((r["query_id"], r["item_id"]) for r in got) == [(1, 2), (2, 1)]
    none = sim.nearest_items(frame.withColumnRenamed("item_id", "query_id"), frame.limit(0), 5)
    assert none.count() == 0
    prompts = spark.createDataFrame([(1, "Q?"), (7, "Z?")], "query_id bigint, prompt string")
    nearest = spark.createDataFrame([(1, 2, 0.5, 1)], "query_id bigint, item_id bigint, similarity double, place bigint")
    labels = spark.createDataFrame([(2, "cat")], "item_id bigint, label string")
    got = {r["query_id"]: r["prompt"] for r in sim.few_shot_prompts(prompts, nearest, labels).collect()}
    assert got == {1: "Example 1: cat\nQ?", 7: "Z?"}


def test_what_meets_grows_with_the_items(spark, monkeypatch):
    """Blocks are a share of the items, so every item is sent to about as many blocks at each size; ties go by id."""
    monkeypatch.setattr(sim, "BLOCK", 8)
    sent, rng = {}, np.random.default_rng(5)
    best = sim._best
    for tile in (3, 512):
        monkeypatch.setattr(sim, "TILE", tile)
        vectors = rng.integers(-1, 2, size=(200, 4)).astype(float)  # many equal angles, and zeros
        unit = sim._unit(list(vectors))
        exact = np.round(unit @ unit.T, 9)
        places, _ = best(unit, np.arange(200), unit, np.arange(200), 3)
        for q in range(200):
            assert places[q].tolist() == sorted((j for j in range(200) if j != q), key=lambda j: (-exact[q, j], j))[:3]
    for count in (160, 640):
        vectors = rng.normal(size=(count, 16))
        frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "item_id bigint, embedding array<double>")
        met = spark.sparkContext.accumulator(0)

        def counted(asked, query_ids, items, item_ids, k):
            met.add(len(asked))
            return best(asked, query_ids, items, item_ids, k)

        monkeypatch.setattr(sim, "_best", counted)
        assert sim.nearest_items(frame.withColumnRenamed("item_id", "query_id"), frame, 3).count() == 3 * count
        sent[count] = met.value / count
        monkeypatch.setattr(sim, "_best", best)
    assert sent[640] <= 2 * max(sent[160], 8)

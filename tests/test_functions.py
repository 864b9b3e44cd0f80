"""Prompts, costs, paths and arithmetic."""

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import cost as fc, paths as fp, prompts as pr
from gradeflow.functions.text import half_up_ratio
from gradeflow.functions.keywords import keyword_labels
from gradeflow.operators import catalog
from gradeflow.operators.labelling import success_rate
from gradeflow.operators.progress import eta_seconds
from gradeflow.schemas import PRICING, PROMPT_CHAIN


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_substitution(spark):
    prompt = F.lit("Given {output1} and {output2}, what do you see?")
    outputs = [(1, F.lit("yes")), (2, F.lit("no"))]
    assert value(spark, pr.substitute(prompt, outputs)) == "Given yes and no, what do you see?"
    assert pr.substitute_text("Given {output1}", {1: "yes"}) == "Given yes"
    doubled = F.lit("{{output1}} / {output3}")
    assert value(spark, pr.substitute(doubled, outputs)) == "yes / {output3}"
    chained = value(spark, pr.substitute(F.lit("{output1}"), [(1, F.lit("see {output2}")), (2, F.lit("it"))]))
    assert chained == "see it" == pr.substitute_text("{output1}", {1: "see {output2}", 2: "it"})


def test_references(spark):
    assert value(spark, pr.references(F.lit("Is {output1} correct? And {output2}?"))) == [1, 2]
    assert value(spark, pr.references(F.lit("{output10} {output2} {output2} {output}"))) == [2, 2, 10]
    error = lambda text, step: value(
        spark, pr.reference_error(F.lit(text), F.lit(step), F.array(F.lit(1)))
    )
    assert error("Previous: {output1}", 2) is None
    assert error("{output2}", 2) == "Cannot reference {output2} from step 2"
    assert error("{output2} {output1}", 4) == "Variable {output2} not available (step may have failed)"


@pytest.mark.parametrize(
    "chain, error",
    [
        (None, None), ([(1, None, "a")], None), ([], "Prompt chain must have 1-5 steps"),
        ([(i, None, "a") for i in range(1, 7)], "Prompt chain must have 1-5 steps"),
        ([(1, None, "a"), (3, None, "b")], "Step 2 has incorrect step_number: expected 2, got 3"),
        ([(1, None, None)], "Step 1 missing required field: prompt"),
        ([(None, None, "a")], "Step 1 missing required field: step_number"),
    ],
)
def test_chain_validation(spark, chain, error):
    frame = spark.createDataFrame([(chain,)], f"chain {PROMPT_CHAIN}")
    assert frame.select(pr.chain_error("chain").alias("x")).first()["x"] == error


def test_system_prompt_without_options_keeps_mark(spark):
    text = value(spark, pr.system_prompt("multiple_choice", F.array().cast("array<string>")))
    assert "{options}" in text
    assert value(spark, pr.system_prompt("other")) == "Answer the question based on the image."


@pytest.mark.parametrize(
    "width, height, tokens", [(1024, 1024, 765), (512, 512, 255), (768, 768, 765), (4096, 8192, 1105), (1, 1, 255), (2048, 2049, 765)]
)
def test_tile_tokens(spark, width, height, tokens):
    assert value(spark, fc.tile_tokens(F.lit(width), F.lit(height))) == tokens


def test_image_tokens(spark):
    assert value(spark, fc.area_tokens(F.lit(1000), F.lit(750))) == 1000
    unread = F.lit(None).cast("int")
    for provider, tokens in {"openai": 765, "anthropic": 1600, "gemini": 258, "vertex": 258}.items():
        assert value(spark, fc.image_tokens(F.lit(provider), unread, unread)) == tokens
    assert value(spark, fc.text_tokens(F.lit("x" * 11))) == 2
    assert value(spark, fc.text_tokens(F.lit(None).cast("string"))) == 0


def pricing(inp="1", out="2", mode=None, image=None, discount=None):
    def money(v):
        return F.lit(v).cast("decimal(12,6)")

    return F.struct(
        money(inp).alias("a"), money(out).alias("b"), F.lit(mode).cast("string").alias("c"), money(image).alias("d"),
        F.lit(discount).cast("decimal(5,2)").alias("e"),
    ).cast(PRICING)


@pytest.mark.parametrize(
    "provider, prices, image, expected",
    [
        ("openai", {}, True, 0.00002), ("anthropic", {"discount": "50"}, True, 0.00001),
        ("gemini", {"image": "0.0011"}, True, 0.00112), ("gemini", {"image": "0.0011"}, False, 0.00002),
        ("vertex", {"image": "0.0011", "mode": "per_token"}, True, 0.00002),
        ("vertex", {"inp": "0.15", "out": "0.15"}, True, 0.000002),  # 2.25 millionths, rounded
        ("gemini", {"inp": "0.15", "out": "0.15"}, True, 0.00000225), ("elsewhere", {}, True, 0.0),
        ("openai", {"inp": None, "out": None}, True, 0.0), ("openai", {"discount": "12.5"}, True, 0.0000175),
    ],
)
def test_actual_cost(spark, provider, prices, image, expected):
    cost = fc.actual_cost(F.lit(provider), F.lit(10), F.lit(5), pricing(**prices), image)
    assert float(value(spark, cost)) == expected


def test_no_pricing_costs_nothing(spark):
    cost = fc.actual_cost(F.lit("openai"), F.lit(10), F.lit(5), F.lit(None).cast(PRICING), True)
    assert value(spark, cost) == 0


def test_estimates(spark):
    ten = F.lit(10).cast("bigint")
    cost = lambda p, **k: float(value(spark, fc.estimate_cost(F.lit(p), ten, ten, F.lit(100), F.lit(2), pricing(**k))))
    assert cost("openai") == 0.00013  # (10 + 100) x 1 + 10 x 2
    assert cost("gemini", image="0.5") == 1.00003
    assert cost("vertex", mode="per_token") == 0.000546  # 10 + 2 x 258 + 20
    rough = value(spark, fc.rough_estimate(pricing("3", "15", image="0.0011", discount="10"), F.lit(7)))
    assert float(rough["avg_cost_per_image"]) == 0.0054 and float(rough["estimated_cost"]) == 0.0378


def test_read_response(spark):
    raw = '{"candidates":[{"content":{"parts":[{"text":"hi"}]}}],"usageMetadata":{"promptTokenCount":3}}'
    reply = value(spark, fc.read_response(F.lit("gemini"), F.lit(raw)))
    assert reply.asDict() == {"text": "hi", "prompt_tokens": 3, "completion_tokens": 0, "total_tokens": 0}
    broken = value(spark, fc.read_response(F.lit("openai"), F.lit('{"choices":[]}')))
    assert broken["text"] == "" and broken["prompt_tokens"] == 0


@pytest.mark.parametrize(
    "path, bucket, prefix, error",
    [
        ("gs://b/p/q", "b", "p/q", None), ("gs://b", "b", "", None), ("gs://b//p", "b", "p", None),
        ("s3://b/p", None, None, "GCS path must start with gs://. Got: s3://b/p"),
        ("gs:///p", None, None, "Invalid GCS path: gs:///p. Bucket name is required."),
    ],
)
def test_object_paths(spark, path, bucket, prefix, error):
    assert tuple(value(spark, fp.parse_object_path(F.lit(path)))) == (bucket, prefix, error)


@pytest.mark.parametrize(
    "name, mime, ok",
    [("a.jpg", None, True), ("a.JPG", "", True), ("a.Jpg", None, False), ("a.Jpg", "image/png", True),
     ("a", "application/octet-stream", False), (".jpg", None, False), ("x.tar.gif", None, True)],
)
def test_upload_check(spark, name, mime, ok):
    assert value(spark, fp.is_uploadable(F.lit(name), F.lit(mime).cast("string"))) is ok


def test_names(spark):
    assert value(spark, fp.extension(F.lit("a/b.c/d.PNG"))) == ".PNG"
    assert value(spark, fp.extension(F.lit("a/b"))) == ""
    assert value(spark, fp.mime_type(F.lit("x.bmp"), "labelling")) == "image/bmp"
    assert value(spark, fp.mime_type(F.lit("x.bmp"))) == "image/jpeg"
    assert value(spark, fp.mime_type(F.lit("x.bmp"), "serve")) == "application/octet-stream"
    assert value(spark, fp.sanitize_filename(F.lit("a/b:é *.csv"))) == "a_b_é _.csv"
    assert len(value(spark, fp.sanitize_filename(F.lit("x" * 300)))) == 200
    assert value(spark, fp.clash_name(F.lit("a.b.jpg"), F.lit("p"))) == "a.b_83878c91.jpg"
    assert value(spark, fp.clash_name(F.lit("a"), F.lit("p"))) == "a_83878c91."


def test_keywords(spark):
    text = "A Cat and a DOG, people by a tree near the building with food, a person in a car"
    assert value(spark, keyword_labels(F.lit(text))) == ["person", "people", "car", "building", "tree"]
    assert value(spark, keyword_labels(F.lit("nothing"))) == []


@pytest.mark.parametrize("num, den, scale, factor, expected", [
    (1, 32, 2, 100, 3.13), (0, 5, 2, 100, 0.0), (1, 0, 2, 100, 0.0), (2, 3, 2, 100, 66.67), (5, 2, 0, 1, 3.0), (7, 7, 1, 100, 100.0)])
def test_half_up(spark, num, den, scale, factor, expected):
    column = half_up_ratio(F.lit(num).cast("bigint"), F.lit(den).cast("bigint"), scale, factor)
    assert value(spark, column) == expected


def test_eta_and_success_rate(spark):
    eta = lambda ms, done, left, by: value(
        spark, eta_seconds(*[F.lit(x).cast("bigint") for x in (ms, done, left, by)])
    )
    assert eta(10_000, 10, 30, 3) == 10.0
    assert eta(10_000, 2, 30, 3) is None
    rate = lambda a, b: value(spark, success_rate(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")))
    assert (rate(1, 8), rate(0, 0), rate(2, 3), rate(5, 5)) == (13, 0, 67, 100)


def test_project_fault(spark):
    none = F.lit(None).cast("array<string>")
    fault = lambda t, o=none: value(spark, catalog.project_fault(F.lit(t).cast("string"), o))
    assert fault("binary") is None and fault("count") is None
    assert fault("x").startswith("Invalid question_type") and fault(None).startswith("Invalid question_type")
    assert fault("multiple_choice") == "question_options required for multiple_choice type"
    assert fault("multiple_choice", F.array(F.lit("a"))) is None


def test_comparison_arguments():
    assert catalog.comparison_error(1, 1) and catalog.comparison_error(7, 1) and catalog.comparison_error(3, 2)
    assert catalog.comparison_error(2, 1) is None and catalog.comparison_error(6, 1) is None

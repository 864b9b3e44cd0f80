"""Answers, scores, summaries and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions import answers as fa, cost as fc
from gradeflow.operators import estimate, scoring
from gradeflow.operators.ordering import page
from gradeflow.plans.registry import query
from gradeflow.plans.tables import MODELS, Tables, with_views
from gradeflow.schemas import ANSWER, PRICING, STEPS
from gradeflow.session import new_work_path
from gradeflow.sources.label_csv import write_results


def pricing_struct() -> Column:
    return F.struct(
        F.col("in_price").alias("input_price_per_1m"), F.col("out_price").alias("output_price_per_1m"),
        F.col("image_mode").alias("image_price_mode"), F.col("image_val").alias("image_price_val"),
        F.col("discount").alias("discount_percent"),
    ).cast(PRICING)


def _step(number: int, output: Column) -> Column:
    return F.struct(
        F.lit(number).alias("step_number"), output.alias("raw_output"),
        F.col(f"latency{number}").alias("latency_ms"), F.col(f"prompt{number}").alias("prompt_tokens"),
        F.col(f"completion{number}").alias("completion_tokens"), F.lit(1).alias("attempts"),
        F.lit(None).cast("string").alias("error"),
    )


def results(t: Tables) -> DataFrame:
    """The answers view as a results table."""
    truth = F.struct(
        F.col("truth_bool").alias("value_bool"), F.col("truth_count").alias("value_count"),
        F.col("truth_str").alias("value_str"),
    ).cast(ANSWER)
    steps = F.array_compact(
        F.array(
            F.when(F.col("has_step1"), _step(1, F.lit("step one"))),
            F.when(F.col("has_step2"), _step(2, F.col("model_response"))),
        )
    ).cast(STEPS)
    return t.view("answers").select(
        "*", truth.alias("ground_truth"), steps.alias("steps"), pricing_struct().alias("pricing")
    )


def scored(t: Tables) -> DataFrame:
    return scoring.score(results(t))


def line_results(t: Tables) -> DataFrame:
    """Answers at the size of the largest table, scored and priced."""
    models = t.view("models").select("idx", "provider", pricing_struct().alias("pricing"))
    rows = t.view("line_answers").join(models, "idx")  # six models: Spark broadcasts them
    rows = rows.select(
        "*", F.lit("binary").alias("question_type"),
        F.struct(
            F.col("truth_bool").alias("value_bool"), F.lit(None).alias("value_count"), F.lit(None).alias("value_str")
        ).cast(ANSWER).alias("ground_truth"),
        F.col("prompt1").alias("prompt_tokens"), F.col("completion1").alias("completion_tokens"),
        fc.actual_cost("provider", F.col("prompt1"), F.col("completion1"), "pricing", True).alias("cost"),
    )
    return scoring.score(rows)


# --- check queries ---------------------------------------------------------

PARSED_SQL = """, parsed AS (
  SELECT *,
    CASE WHEN error IS NOT NULL OR question_type <> 'binary' THEN NULL
         WHEN regexp_matches(lower(model_response), 'yes|true|1') THEN TRUE
         WHEN regexp_matches(lower(model_response), 'no|false|0') THEN FALSE END AS p_bool,
    CASE WHEN error IS NULL AND question_type = 'count'
         THEN CAST(nullif(regexp_extract(model_response, '[0-9]+'), '') AS BIGINT) END AS p_count,
    CASE WHEN error IS NULL AND question_type IN ('multiple_choice', 'text') THEN trim(model_response) END AS p_str
  FROM answers
), judged AS (
  SELECT *,
    CASE WHEN error IS NOT NULL THEN NULL
         WHEN question_type = 'binary' THEN coalesce(p_bool = truth_bool, FALSE)
         WHEN question_type = 'count' THEN coalesce(p_count = truth_count, FALSE)
         ELSE lower(p_str) = lower(coalesce(truth_str, 'none')) END AS is_correct
  FROM parsed
)
"""


def percent_sql(part: str, whole: str) -> str:
    """Percent with two places, half up, in whole numbers."""
    return (
        f"CASE WHEN ({whole}) > 0 THEN ((20000 * ({part}) + ({whole})) // (2 * ({whole}))) / CAST(100 AS DOUBLE)"
        " ELSE CAST(0 AS DOUBLE) END"
    )


def cost_sql(prompt: str, completion: str, image: bool = True) -> str:
    """Cost of one request in millionths of a millionth of a dollar, in whole numbers."""
    base = (
        f"CAST({prompt} AS HUGEINT) * CAST(in_price * 1000000 AS HUGEINT)"
        f" + CAST({completion} AS HUGEINT) * CAST(out_price * 1000000 AS HUGEINT)"
    )
    if image:
        base += (
            " + CASE WHEN provider IN ('gemini', 'vertex') AND coalesce(image_mode, 'per_image') = 'per_image'"
            " THEN coalesce(CAST(image_val * 1000000 AS HUGEINT), 0) * 1000000 ELSE 0 END"
        )
    off = f"((({base}) * (100 - CAST(discount AS HUGEINT)) * 2 + 100) // 200)"
    return f"CASE WHEN provider = 'vertex' THEN (({off} + 500000) // 1000000) * 1000000 ELSE {off} END"


_COUNTS_SQL = """count(*) AS total, count(error) AS failed, count(*) - count(error) AS successful,
       count(*) FILTER (is_correct) AS correct,
       count(*) FILTER (error IS NULL AND p_bool IS NULL AND p_count IS NULL AND p_str IS NULL) AS unparsed,
       count(*) FILTER (is_correct IS NOT NULL AND truth_bool AND p_bool) AS tp,
       count(*) FILTER (is_correct IS NOT NULL AND NOT truth_bool AND NOT p_bool) AS tn,
       count(*) FILTER (is_correct IS NOT NULL AND NOT truth_bool AND p_bool) AS fp,
       count(*) FILTER (is_correct IS NOT NULL AND truth_bool AND NOT p_bool) AS fn"""

_RATES_SQL = f"""CASE WHEN successful > 0 THEN correct / successful ELSE CAST(0 AS DOUBLE) END AS accuracy,
       {percent_sql("correct", "successful")} AS accuracy_percent,
       {percent_sql("failed", "total")} AS failure_rate_percent,
       CASE WHEN 2 * failed > total THEN 'failed' ELSE 'completed' END AS status"""

_USAGE_SQL = """CAST(prompt_tokens + completion_tokens AS BIGINT) AS total_tokens,
       cost4 / CAST(10000 AS DOUBLE) AS actual_cost,
       CAST((200 * cost4 + total) // (2 * total) AS DOUBLE) / 100 / 10000 AS average_cost_per_image"""

_SUMMARY_SQL = f"""
SELECT * EXCLUDE (cost4), {_RATES_SQL}, {_USAGE_SQL}
FROM (SELECT evaluation_id, question_type, {_COUNTS_SQL},
        CAST(sum(CASE WHEN has_step1 THEN prompt1 ELSE 0 END + CASE WHEN has_step2 THEN prompt2 ELSE 0 END) AS BIGINT)
          AS prompt_tokens,
        CAST(sum(CASE WHEN has_step1 THEN completion1 ELSE 0 END + CASE WHEN has_step2 THEN completion2 ELSE 0 END)
          AS BIGINT) AS completion_tokens,
        CAST((sum(CASE WHEN has_step1 THEN {cost_sql("prompt1", "completion1")} ELSE 0 END
                + CASE WHEN has_step2 THEN {cost_sql("prompt2", "completion2")} ELSE 0 END) + 50000000)
             // 100000000 AS BIGINT) AS cost4
      FROM judged GROUP BY evaluation_id, question_type) AS s"""


def _summary_out(df: DataFrame) -> DataFrame:
    return df.withColumn("actual_cost", F.col("actual_cost").cast("double"))


@query(with_views("answers") + PARSED_SQL + _SUMMARY_SQL)
def eval_summary(t: Tables) -> DataFrame:
    """Everything about a run: counts, accuracy, status, confusion matrix, tokens, cost."""
    return _summary_out(scoring.summarize(scored(t), ["evaluation_id", "question_type"], usage="steps"))


@query(
    with_views("line_answers", "models")
    + f""", judged AS (
  SELECT *, p_bool IS NOT NULL AND p_bool = truth_bool AS is_right
  FROM (SELECT *, CASE WHEN model_response ILIKE '%yes%' THEN TRUE WHEN model_response ILIKE '%no%' THEN FALSE END AS p_bool
        FROM line_answers JOIN models USING (idx)) AS p)
SELECT * EXCLUDE (cost4), {_RATES_SQL}, {_USAGE_SQL}
FROM (SELECT evaluation_id, count(*) AS total, count(error) AS failed, count(*) - count(error) AS successful,
        count(*) FILTER (error IS NULL AND is_right) AS correct,
        count(*) FILTER (error IS NULL AND p_bool IS NULL) AS unparsed,
        count(*) FILTER (truth_bool AND p_bool) AS tp, count(*) FILTER (NOT truth_bool AND NOT p_bool) AS tn,
        count(*) FILTER (NOT truth_bool AND p_bool) AS fp, count(*) FILTER (truth_bool AND NOT p_bool) AS fn,
        CAST(sum(prompt1) AS BIGINT) AS prompt_tokens, CAST(sum(completion1) AS BIGINT) AS completion_tokens,
        CAST((sum({cost_sql("prompt1", "completion1")}) + 50000000) // 100000000 AS BIGINT) AS cost4
      FROM judged GROUP BY evaluation_id) AS s"""
)
def eval_summary_lines(t: Tables) -> DataFrame:
    """The run summary over the largest table."""
    return _summary_out(scoring.summarize(line_results(t), usage="columns"))


@query(with_views("answers") + PARSED_SQL + "SELECT evaluation_id, image_id, p_bool, p_count, p_str, is_correct FROM judged")
def check_answers(t: Tables) -> DataFrame:
    """Parsed answer and correctness of every result."""
    return scored(t).select(
        "evaluation_id", "image_id", F.col("parsed.value_bool").alias("p_bool"),
        F.col("parsed.value_count").cast("bigint").alias("p_count"), F.col("parsed.value_str").alias("p_str"), "is_correct",
    )


@query("""
SELECT conv_id, turn,
  CASE WHEN regexp_matches(lower(text), 'yes|true|1') THEN TRUE
       WHEN regexp_matches(lower(text), 'no|false|0') THEN FALSE END AS value,
  CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(yes|true|1)([^a-z0-9]|$)') THEN TRUE
       WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(no|false|0)([^a-z0-9]|$)') THEN FALSE END AS strict_value
FROM conversations""")
def parse_binary(t: Tables) -> DataFrame:
    """Yes/no out of all turns, by substring and by whole word."""
    turns = t.given("conversations")
    return turns.select(
        "conv_id", "turn", fa.parse_binary("text").alias("value"), fa.parse_binary("text", strict=True).alias("strict_value")
    )


@query("""
SELECT event_id, CAST(nullif(regexp_extract(props, '[0-9]+'), '') AS BIGINT) AS value,
       CASE WHEN regexp_extract(props, '[0-9]+') = '' THEN props END AS raw
FROM events""")
def parse_count(t: Tables) -> DataFrame:
    """First number in a text."""
    parsed = fa.parse_answer("props", "count")
    return t.given("events").select(
        "event_id", parsed["value_count"].cast("bigint").alias("value"), parsed["raw"].alias("raw")
    )


@query("SELECT conv_id, turn, md5(trim(text, chr(9) || chr(10) || chr(13) || ' ')) AS value FROM conversations")
def parse_text(t: Tables) -> DataFrame:
    """Free-text answers, stripped."""
    return t.given("conversations").select(
        "conv_id", "turn", F.md5(fa.parse_answer("text", "text")["value_str"]).alias("value")
    )


@query(
    with_views("answers") + PARSED_SQL
    + """SELECT which, evaluation_id, count(*) AS results, CAST(sum(image_id) AS BIGINT) AS ids
FROM (SELECT *, unnest(list_filter(['all',
          CASE WHEN is_correct THEN 'correct' END, CASE WHEN NOT is_correct THEN 'incorrect' END,
          CASE WHEN is_correct AND p_bool THEN 'tp' END, CASE WHEN is_correct AND NOT p_bool THEN 'tn' END,
          CASE WHEN NOT is_correct AND p_bool THEN 'fp' END, CASE WHEN NOT is_correct AND NOT p_bool THEN 'fn' END],
          lambda x: x IS NOT NULL)) AS which FROM judged) AS f
GROUP BY which, evaluation_id"""
)
def result_filters(t: Tables) -> DataFrame:
    """Size of every result class of every run."""
    return scoring.class_sizes(scored(t))


@query(
    with_views("answers", "images") + PARSED_SQL
    + """SELECT judged.image_id, evaluation_id, images.filename, model_response, latency1 + latency2 AS latency_ms
FROM judged JOIN images USING (image_id)
WHERE NOT is_correct AND p_bool ORDER BY evaluation_id, image_id LIMIT 50 OFFSET 50"""
)
def results_page(t: Tables) -> DataFrame:
    """Second page of the false positives, with file names from the images."""
    rows = scoring.filter_results(scoring.add_usage(scored(t)), "fp").drop("filename")
    listed = rows.join(t.view("images").select("image_id", "filename"), "image_id")
    return page(listed, [F.col("evaluation_id"), F.col("image_id")], skip=50, limit=50).select(
        "image_id", "evaluation_id", "filename", "model_response", "latency_ms"
    )


_ERRORS_SQL = """, failing AS (
  SELECT evaluation_id, image_id, 'Image ' || filename || ': ' || error AS message,
         row_number() OVER (PARTITION BY evaluation_id ORDER BY image_id) AS place,
         count(*) OVER (PARTITION BY evaluation_id) AS error_count
  FROM answers WHERE error IS NOT NULL
), messages AS (
  SELECT evaluation_id, error_count,
         string_agg(message, '; ' ORDER BY place) FILTER (place <= 3)
         || CASE WHEN error_count > 3 THEN ' (and ' || (error_count - 3) || ' more errors)' ELSE '' END AS errors
  FROM failing GROUP BY evaluation_id, error_count
)
"""


@query(with_views("answers") + _ERRORS_SQL + "SELECT * FROM messages")
def first_errors(t: Tables) -> DataFrame:
    """First three errors per run."""
    return scoring.first_errors(results(t))


@query(
    with_views("answers") + _ERRORS_SQL
    + """SELECT evaluation_id, failed, total, 'Evaluation failed: ' || printf('%.1f', ((2000 * failed + total) // (2 * total)) / CAST(10 AS DOUBLE))
       || '% of predictions failed (' || failed || '/' || total || '). Errors: ' || errors AS error_message
FROM (SELECT evaluation_id, count(*) AS total, count(error) AS failed FROM answers GROUP BY evaluation_id) AS c
JOIN messages USING (evaluation_id) WHERE 2 * failed > total"""
)
def failed_runs(t: Tables) -> DataFrame:
    """Message of every run with too many failures."""
    return scoring.failure_messages(results(t))


@query(
    with_views("answers") + PARSED_SQL
    + f"""SELECT evaluation_id, to_json({{'correct': correct, 'total': total, 'successful': successful, 'failed': failed}}) AS counts,
       {percent_sql("failed", "total")} AS failure_rate_percent, {percent_sql("correct", "successful")} AS accuracy_percent,
       CASE WHEN question_type = 'binary' THEN tp END AS tp, CASE WHEN question_type = 'binary' THEN tn END AS tn,
       CASE WHEN question_type = 'binary' THEN fp END AS fp, CASE WHEN question_type = 'binary' THEN fn END AS fn
FROM (SELECT evaluation_id, question_type, {_COUNTS_SQL} FROM judged GROUP BY evaluation_id, question_type) AS s"""
)
def run_summary(t: Tables) -> DataFrame:
    """The summary struct of a run; no matrix unless the question is binary."""
    summary = scoring.summarize(scored(t), ["evaluation_id", "question_type"])
    s = F.col("results_summary")
    matrix = s["confusion_matrix"]
    return scoring.run_summary(summary).select(
        "evaluation_id",
        F.to_json(F.struct(*[s[c].alias(c) for c in ("correct", "total", "successful", "failed")])).alias("counts"),
        s["failure_rate_percent"].alias("failure_rate_percent"), s["accuracy_percent"].alias("accuracy_percent"),
        *[matrix[c].alias(c) for c in ("tp", "tn", "fp", "fn")],
    )


@query(
    with_views("answers")
    + f"""SELECT provider, model_name, step_number, count(*) AS steps, CAST(sum(p) AS BIGINT) AS prompt_tokens,
       CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(CAST(sum(cost) AS DECIMAL(26, 0)) * 0.000000000001::DECIMAL(12, 12) AS DOUBLE) AS cost
FROM (SELECT provider, model_name, 1 AS step_number, prompt1 AS p, completion1 AS c, {cost_sql("prompt1", "completion1")} AS cost
      FROM answers WHERE has_step1
      UNION ALL
      SELECT provider, model_name, 2, prompt2, completion2, {cost_sql("prompt2", "completion2")} FROM answers WHERE has_step2) AS s
GROUP BY provider, model_name, step_number"""
)
def cost_by_provider(t: Tables) -> DataFrame:
    """Steps, tokens and actual cost per model and step."""
    steps = results(t).select("provider", "model_name", "pricing", F.explode("steps").alias("step"))
    units = fc.actual_cost_units("provider", F.col("step.prompt_tokens"), F.col("step.completion_tokens"), "pricing", True)
    return steps.groupBy("provider", "model_name", F.col("step.step_number").alias("step_number")).agg(
        F.count("*").alias("steps"), F.sum("step.prompt_tokens").alias("prompt_tokens"),
        F.sum("step.completion_tokens").alias("completion_tokens"),
        fc.sum_money(units).cast("double").alias("cost"),
    )


@query("""
WITH sized AS (SELECT doc_id, n_chars % 4000 + 1 AS width, (n_chars * 7) % 5000 + 1 AS height FROM documents),
fitted AS (SELECT *, CASE WHEN greatest(width, height) > 2048 THEN floor(width * least(2048.0::DOUBLE / width, 2048.0::DOUBLE / height)) ELSE width END AS w1,
                  CASE WHEN greatest(width, height) > 2048 THEN floor(height * least(2048.0::DOUBLE / width, 2048.0::DOUBLE / height)) ELSE height END AS h1 FROM sized),
short AS (SELECT *, CASE WHEN w1 < h1 AND w1 > 768 THEN 768 WHEN w1 >= h1 AND h1 > 768 THEN floor(w1 * (768.0::DOUBLE / h1)) ELSE w1 END AS w2,
                 CASE WHEN w1 < h1 AND w1 > 768 THEN floor(h1 * (768.0::DOUBLE / w1)) WHEN w1 >= h1 AND h1 > 768 THEN 768 ELSE h1 END AS h2 FROM fitted)
SELECT doc_id AS image_id, CAST(ceil(w2 / 512) * ceil(h2 / 512) * 170 + 85 AS BIGINT) AS tile_tokens,
       CAST(85 AS BIGINT) AS low_tokens, CAST((width * height + 749) // 750 AS BIGINT) AS area_tokens FROM short""")
def image_tokens(t: Tables) -> DataFrame:
    """Image tokens by the tile and the area rule."""
    sized = t.given("documents").selectExpr(
        "doc_id AS image_id", "n_chars % 4000 + 1 AS width", "(n_chars * 7) % 5000 + 1 AS height"
    )
    return sized.select(
        "image_id", fc.tile_tokens("width", "height").alias("tile_tokens"),
        fc.tile_tokens("width", "height", "low").alias("low_tokens"), fc.area_tokens("width", "height").alias("area_tokens"),
    )


_ESTIMATE_SQL = """((CASE WHEN provider IN ('openai', 'anthropic')
     THEN (tokens_in + image_tokens) * CAST(in_price * 1000000 AS HUGEINT) + tokens_out * CAST(out_price * 1000000 AS HUGEINT)
     ELSE tokens_in * CAST(in_price * 1000000 AS HUGEINT) + tokens_out * CAST(out_price * 1000000 AS HUGEINT)
        + images * CASE WHEN image_mode = 'per_image' THEN CAST(image_val * 1000000 AS HUGEINT) * 1000000
                        ELSE 258 * CAST(in_price * 1000000 AS HUGEINT) END
   END * (100 - CAST(discount AS HUGEINT)) * 2 + 100) // 200)"""


@query(
    with_views("models")
    + f"""SELECT doc_id, provider, model_name, {_ESTIMATE_SQL} / CAST(1000000000000 AS DOUBLE) AS estimate
FROM (SELECT doc_id, models.*, CAST(length(text) // 4 AS HUGEINT) AS tokens_in, CAST(100 AS HUGEINT) AS tokens_out,
             CAST(n_chars % 3 AS HUGEINT) AS images, CAST((n_chars % 3) * 765 AS HUGEINT) AS image_tokens
      FROM documents CROSS JOIN models) AS e"""
)
def cost_estimate(t: Tables) -> DataFrame:
    """Expected cost of sending every document to every model, with 0 to 2 images."""
    priced = t.per_model(t.given("documents")).withColumn("pricing", pricing_struct())
    priced = priced.select("*", fc.text_tokens("text").alias("tokens_in"), (F.col("n_chars") % 3).alias("images"))
    estimate = fc.estimate_cost(
        "provider", F.col("tokens_in"), F.lit(100).cast("bigint"), F.col("images") * 765, F.col("images"), "pricing"
    )
    return priced.select("doc_id", "provider", "model_name", estimate.cast("double").alias("estimate"))


_ROUGH_SQL = """((((1000 * CAST(in_price * 1000000 AS HUGEINT) + 200 * CAST(out_price * 1000000 AS HUGEINT)
    + coalesce(CAST(image_val * 1000000 AS HUGEINT), 0)) * (100 - CAST(discount AS HUGEINT))) * 2 + 100) // 200)"""


@query(
    with_views("images", "models")
    + f"""SELECT dataset_id, model_id, n AS image_count, ((({_ROUGH_SQL} * n) + 500000) // 1000000) / CAST(1000000 AS DOUBLE) AS estimated_cost,
       (({_ROUGH_SQL} + 500000) // 1000000) / CAST(1000000 AS DOUBLE) AS avg_cost_per_image
FROM (SELECT dataset_id, count(*) AS n FROM images GROUP BY dataset_id) AS d CROSS JOIN models"""
)
def rough_estimate(t: Tables) -> DataFrame:
    """The fixed-size estimate per dataset and model."""
    counts = t.view("images").groupBy("dataset_id").agg(F.count("*").alias("n"))
    priced = t.per_model(counts).withColumn("pricing", pricing_struct())
    return priced.select("dataset_id", "model_id", fc.rough_estimate("pricing", F.col("n")).alias("e")).select(
        "dataset_id", "model_id", F.col("e.image_count").alias("image_count"),
        F.col("e.estimated_cost").cast("double").alias("estimated_cost"),
        F.col("e.avg_cost_per_image").cast("double").alias("avg_cost_per_image"),
    )


# Sizes out of the file size; one image in nine cannot be read, one in seven not be fetched.
_SIZED = (
    "CASE WHEN file_size % 9 <> 0 THEN file_size % 3000 + 1 END AS width",
    "CASE WHEN file_size % 9 <> 0 THEN file_size % 1700 + 1 END AS height", "file_size % 7 <> 0 AS readable",
)


@query(
    with_views("images", "models")
    + f""", sized AS (SELECT *, {", ".join(_SIZED)}, row_number() OVER (PARTITION BY dataset_id ORDER BY image_id) AS place,
    count(*) OVER (PARTITION BY dataset_id) AS n FROM images),
fitted AS (SELECT *, CASE WHEN greatest(width, height) > 2048 THEN floor(width * least(2048.0::DOUBLE / width, 2048.0::DOUBLE / height)) ELSE width END AS w1,
                  CASE WHEN greatest(width, height) > 2048 THEN floor(height * least(2048.0::DOUBLE / width, 2048.0::DOUBLE / height)) ELSE height END AS h1 FROM sized WHERE place <= 5),
short AS (SELECT *, least(w1, h1) AS s, greatest(w1, h1) AS l FROM fitted),
tiled AS (SELECT *, CAST(ceil(least(s, 768) / 512) * ceil(CASE WHEN s > 768 THEN floor(l * (768.0::DOUBLE / s)) ELSE l END / 512) * 170 + 85 AS BIGINT) AS tiles FROM short),
asked AS (SELECT t.*, m.*, CAST(0 AS HUGEINT) AS tokens_in, CAST(0 AS HUGEINT) AS tokens_out, CAST(1 AS HUGEINT) AS images,
    CAST(CASE provider WHEN 'openai' THEN coalesce(tiles, 765) WHEN 'anthropic' THEN coalesce((width * height + 749) // 750, 1600) ELSE 258 END AS HUGEINT) AS image_tokens
  FROM tiled AS t CROSS JOIN models AS m WHERE readable),
sampled AS (SELECT dataset_id, model_id, count(*) AS sampled_images, sum({_ESTIMATE_SQL}) AS cost FROM asked GROUP BY ALL),
texts AS (SELECT d.dataset_id, d.n, model_id, {_ESTIMATE_SQL} AS text_cost
  FROM (SELECT DISTINCT dataset_id, n FROM sized) AS d
  CROSS JOIN (SELECT *, CAST(13 AS HUGEINT) AS tokens_in, CAST(100 AS HUGEINT) AS tokens_out, CAST(0 AS HUGEINT) AS images, CAST(0 AS HUGEINT) AS image_tokens FROM models) AS m),
means AS (SELECT dataset_id, model_id, n, coalesce(sampled_images, 0) AS sampled_images, text_cost,
    coalesce((2 * cost + sampled_images) // (2 * sampled_images), 0) AS mean FROM texts LEFT JOIN sampled USING (dataset_id, model_id))
SELECT dataset_id, model_id, n AS image_count, CAST(sampled_images AS BIGINT) AS sampled_images,
  ((text_cost + 500000) // 1000000) / CAST(1000000 AS DOUBLE) AS text_cost_per_request, ((mean + 500000) // 1000000) / CAST(1000000 AS DOUBLE) AS avg_cost_per_image,
  (((text_cost + mean) * n + 50000000) // 100000000) / CAST(10000 AS DOUBLE) AS estimated_cost FROM means"""
)
def sampled_estimate(t: Tables) -> DataFrame:
    """Estimate per dataset and model, from the first five images of each dataset."""
    images = t.per_model(t.view("images").selectExpr("dataset_id", "image_id", *_SIZED))
    images = images.withColumn("pricing", pricing_struct())
    text = estimate.chain_input_text(
        F.lit(None).cast("array<struct<system_message: string, prompt: string>>"), F.lit("Reply only true or false."),
        F.lit("Is there a dog in the image?"),
    )
    estimates = estimate.sampled_estimate(images, ["dataset_id", "model_id"], text)
    numbers = ("text_cost_per_request", "avg_cost_per_image", "estimated_cost")
    return estimates.withColumns({c: F.col(c).cast("double") for c in numbers})


@query(
    with_views("answers", "images")
    + f""", sizes AS (SELECT project_id, count(*) AS n FROM images GROUP BY project_id),
estimates AS (SELECT model_id || '@' || project_id AS evaluation_id, ((({_ROUGH_SQL} * n) + 500000) // 1000000) / CAST(1000000 AS DOUBLE) AS estimated_cost
  FROM sizes CROSS JOIN models),
actual AS (SELECT evaluation_id, ((sum(CASE WHEN has_step1 THEN {cost_sql("prompt1", "completion1")} ELSE 0 END
    + CASE WHEN has_step2 THEN {cost_sql("prompt2", "completion2")} ELSE 0 END) + 50000000) // 100000000) / CAST(10000 AS DOUBLE) AS actual_cost
  FROM answers GROUP BY evaluation_id)
SELECT evaluation_id, estimated_cost, actual_cost, round(actual_cost - estimated_cost, 4) AS difference FROM estimates LEFT JOIN actual USING (evaluation_id)"""
)
def estimate_vs_actual(t: Tables) -> DataFrame:
    """What every run was to cost, and what it did cost."""
    counts = t.view("images").groupBy("project_id").agg(F.count("*").alias("n"))
    priced = t.per_model(counts).withColumn("pricing", pricing_struct())
    run = F.concat_ws("@", "model_id", "project_id").alias("evaluation_id")
    estimates = priced.select(run, fc.rough_estimate("pricing", F.col("n"))["estimated_cost"].alias("estimated_cost"))
    compared = estimate.estimate_against_actual(estimates, scoring.summarize(scored(t), usage="steps"))
    return compared.withColumns(
        {
            "estimated_cost": F.col("estimated_cost").cast("double"), "actual_cost": F.col("actual_cost").cast("double"),
            "difference": F.round(F.col("actual_cost").cast("double") - F.col("estimated_cost").cast("double"), 4),
        }
    )


@query(
    with_views("answers") + PARSED_SQL
    + """SELECT evaluation_id, CAST(image_id AS VARCHAR) AS image_id, model_response, CAST(is_correct AS VARCHAR) AS is_correct, error FROM judged"""
)
def results_export(t: Tables) -> DataFrame:
    """Results written as CSV and read back."""
    path = new_work_path(t.spark, "results")
    rows = scored(t).select("evaluation_id", "image_id", "model_response", "is_correct", "error", "steps")
    write_results(rows, path)
    back = t.spark.read.csv(
        path, header=True, quote='"', escape='"',
        schema="evaluation_id string, image_id string, model_response string, is_correct string, error string, steps string",
    )
    return back.drop("steps")


_RAW = {
    "openai": """to_json(named_struct('choices', array(named_struct('message', named_struct('content', text))),
        'usage', named_struct('prompt_tokens', conv_id, 'completion_tokens', turn, 'total_tokens', conv_id + turn)))""",
    "anthropic": """to_json(named_struct('content', array(named_struct('text', text)),
        'usage', named_struct('input_tokens', conv_id, 'output_tokens', turn)))""",
    "vertex": """to_json(named_struct('candidates', array(named_struct('content', named_struct('parts', array(named_struct('text', text))))),
        'usageMetadata', named_struct('promptTokenCount', conv_id, 'candidatesTokenCount', turn, 'totalTokenCount', conv_id + turn)))""",
}


@query("""
SELECT conv_id, turn, provider, CASE WHEN provider = 'other' THEN md5('') ELSE md5(text) END AS text_md5,
  CASE WHEN provider = 'other' THEN 0 ELSE conv_id END AS prompt_tokens,
  CASE WHEN provider = 'other' THEN 0 ELSE turn END AS completion_tokens,
  CASE WHEN provider = 'other' THEN 0 ELSE conv_id + turn END AS total_tokens
FROM (SELECT *, CASE role WHEN 'assistant' THEN 'openai' WHEN 'user' THEN 'anthropic' WHEN 'system' THEN 'vertex' ELSE 'other' END AS provider
      FROM conversations) AS c""")
def read_responses(t: Tables) -> DataFrame:
    """Text and token use out of stored provider replies."""
    rows = t.given("conversations").selectExpr(
        "*",
        "CASE role WHEN 'assistant' THEN 'openai' WHEN 'user' THEN 'anthropic' WHEN 'system' THEN 'vertex' ELSE 'other' END AS provider",
    ).selectExpr("*", f"CASE provider WHEN 'openai' THEN {_RAW['openai']} WHEN 'anthropic' THEN {_RAW['anthropic']} ELSE {_RAW['vertex']} END AS raw")
    reply = fc.read_response("provider", "raw")
    return rows.select(
        "conv_id", "turn", "provider", F.md5(reply["text"]).alias("text_md5"),
        *[reply[c].alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )


@query(
    with_views("answers") + PARSED_SQL
    + f"""SELECT evaluation_id, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp) / (2 * tp + fp + fn) END AS f1
FROM (SELECT evaluation_id, {_COUNTS_SQL} FROM judged WHERE question_type = 'binary' GROUP BY evaluation_id) AS s"""
)
def precision_recall(t: Tables) -> DataFrame:
    """Precision, recall and F1 of the binary runs."""
    binary = scored(t).filter(F.col("question_type") == "binary")
    return scoring.precision_recall_f1(scoring.summarize(binary)).select("evaluation_id", "precision", "recall", "f1")


@query(
    with_views("answers") + PARSED_SQL
    + f"""SELECT question_type, total, failed, successful, correct, unparsed, {percent_sql("correct", "successful")} AS accuracy_percent
FROM (SELECT question_type, {_COUNTS_SQL} FROM judged GROUP BY ROLLUP (question_type)) AS s"""
)
def accuracy_by_question(t: Tables) -> DataFrame:
    """Accuracy per question type, and over all."""
    return scoring.accuracy_by_question(scored(t))


@query(
    with_views("answers") + PARSED_SQL
    + f"""SELECT evaluation_id, question_type, overall, total, failed, successful, correct, unparsed, {percent_sql("correct", "successful")} AS accuracy_percent
FROM (SELECT evaluation_id, question_type, grouping(evaluation_id) = 1 AS overall, {_COUNTS_SQL} FROM judged GROUP BY GROUPING SETS ((evaluation_id, question_type), ())) AS s"""
)
def accuracy_by_run_and_question(t: Tables) -> DataFrame:
    """Accuracy per run and question type, and one marked row over all."""
    return scoring.accuracy_by_question(scored(t), ["evaluation_id", "question_type"], overall="overall")


@query(
    with_views("answers") + PARSED_SQL
    + f""", daily AS (SELECT evaluation_id, date_trunc('hour', completed_at) AS period, count(*) - count(error) AS successful,
                 count(*) FILTER (is_correct) AS correct FROM judged GROUP BY ALL),
rated AS (SELECT *, {percent_sql("correct", "successful")} AS accuracy_percent FROM daily)
SELECT evaluation_id, CAST(CAST(period AS TIMESTAMP) AS VARCHAR) AS period, successful, correct, accuracy_percent,
       round(accuracy_percent - lag(accuracy_percent) OVER (PARTITION BY evaluation_id ORDER BY period), 2) AS change
FROM rated"""
)
def accuracy_trend(t: Tables) -> DataFrame:
    """Accuracy of each run per hour, with its change."""
    trend = scoring.accuracy_trend(scored(t), "completed_at", "hour", ["evaluation_id"])
    return trend.withColumn("period", F.col("period").cast("timestamp_ntz").cast("string"))


@query(
    with_views("answers") + PARSED_SQL
    + f"""SELECT evaluation_id, bin, total, correct, {percent_sql("correct", "total")} AS accuracy_percent
FROM (SELECT evaluation_id, least(CAST(confidence AS BIGINT) // 10 + 1, 10) AS bin, count(*) AS total,
             count(*) FILTER (is_correct) AS correct FROM judged GROUP BY ALL) AS b"""
)
def confidence_histogram(t: Tables) -> DataFrame:
    """Results and accuracy per tenth of the confidence score."""
    rows = scored(t).withColumn("score", F.col("confidence") / 100.0)
    return scoring.confidence_histogram(rows, "score", 10, ["evaluation_id"])


@query(
    with_views("answers")
    + """SELECT evaluation_id, count(*) AS total, unnest([5, 25, 50, 75, 95]) AS percent, TRUE AS within_error FROM answers GROUP BY evaluation_id"""
)
def confidence_percentiles(t: Tables) -> DataFrame:
    """Percentiles of the confidence per run out of sketches merged from those per image source, each held against the exact ranks."""
    rows = results(t).select("evaluation_id", "dataset_id", (F.col("confidence") / 100.0).alias("score"))
    sketches = scoring.confidence_sketches(rows, "score", ["evaluation_id", "dataset_id"])
    found = scoring.percentiles(sketches, by=["evaluation_id"])
    asked = F.col("percent") / 100
    ranks = rows.join(found, "evaluation_id").groupBy("evaluation_id", "total", "percent").agg(
        (F.count_if(F.col("score") < F.col("value")) / F.col("total")).alias("below"),
        (F.count_if(F.col("score") <= F.col("value")) / F.col("total")).alias("upto"),
    )
    # Several sketches were merged and many values are compared: twice the error of one.
    error = F.lit(2 * scoring.sketch_rank_error())
    within = (F.col("below") - error <= asked) & (asked <= F.col("upto") + error)
    return ranks.select("evaluation_id", "total", "percent", within.alias("within_error"))


@query(
    with_views("answers") + PARSED_SQL
    + f""", met AS (SELECT a.evaluation_id AS first_id, b.evaluation_id AS second_id, a.is_correct AS x, b.is_correct AS y
  FROM judged AS a JOIN judged AS b ON a.image_id = b.image_id AND a.project_id = b.project_id AND a.idx = 0 AND b.idx > 0
  WHERE a.is_correct IS NOT NULL AND b.is_correct IS NOT NULL),
counted AS (SELECT first_id, second_id, count(*) AS paired, count(*) FILTER (x AND y) AS both_right, count(*) FILTER (x AND NOT y) AS only_first,
  count(*) FILTER (NOT x AND y) AS only_second, count(*) FILTER (NOT x AND NOT y) AS both_wrong FROM met GROUP BY ALL)
SELECT *, {percent_sql("both_right + only_first", "paired")} AS first_percent, {percent_sql("both_right + only_second", "paired")} AS second_percent,
  CASE WHEN only_first + only_second > 0 THEN CAST(greatest(abs(only_first - only_second) - 1, 0) ** 2 AS DOUBLE) / CAST(only_first + only_second AS DOUBLE) END AS statistic
FROM counted"""
)
def paired_runs(t: Tables) -> DataFrame:
    """Every run against the run of the first model over the same images, as zero-shot against few-shot is compared."""
    rows = scored(t).select("evaluation_id", "image_id", "is_correct")
    projects = t.view("images").select("project_id").distinct()
    pairs = t.per_model(projects).filter("idx > 0").select(
        F.concat(F.lit(f"{MODELS[0][0]}@"), "project_id").alias("first_id"), F.concat_ws("@", "model_id", "project_id").alias("second_id")
    )
    return scoring.paired_outcomes(rows, pairs)


_CHOICES = (
    "CASE idx WHEN 0 THEN NULL WHEN 1 THEN 'manual' WHEN 2 THEN 'random' WHEN 3 THEN 'random' WHEN 4 THEN 'manual' ELSE 'all' END AS mode",
    "CASE idx WHEN 2 THEN 5 WHEN 3 THEN 1000000 END AS {limit}",
)


@query(
    with_views("images", "models")
    + f""", chosen AS (SELECT dataset_id, model_id, idx, count(*) AS n, in_price, out_price, image_val, discount FROM images CROSS JOIN models GROUP BY ALL),
counted AS (SELECT *, CASE idx WHEN 1 THEN 7 WHEN 2 THEN least(5, n) ELSE n END AS taken,
    ((1000 * CAST(in_price * 1000000 AS HUGEINT) + 200 * CAST(out_price * 1000000 AS HUGEINT) + CAST(coalesce(image_val, 0) * 1000000 AS HUGEINT))
      * (100 - CAST(discount AS HUGEINT)) * 2 + 100) // 200 AS units FROM chosen)
SELECT dataset_id, model_id, CASE WHEN idx = 5 THEN 0 ELSE taken END AS image_count,
  CASE WHEN idx = 5 THEN 0 ELSE (units * taken + 500000) // 1000000 END / CAST(1000000 AS DOUBLE) AS estimated_cost,
  CASE WHEN idx = 5 THEN 'No pricing configuration available for this model' END AS fault FROM counted"""
)
def selection_estimates(t: Tables) -> DataFrame:
    """The fixed-size estimate by selection mode; one model has no prices."""
    images = t.view("images")
    runs = t.per_model(images.select("dataset_id").distinct()).selectExpr("*", _CHOICES[0], _CHOICES[1].format(limit="`limit`"))
    runs = runs.select(
        "dataset_id", "model_id", "mode", "limit", F.when(F.col("idx") == 1, F.sequence(F.lit(1), F.lit(7))).alias("image_ids"),
        F.when(F.col("idx") < 5, pricing_struct()).alias("pricing"),
    )
    priced = estimate.selection_estimates(runs, images)
    return priced.select("dataset_id", "model_id", "image_count", F.col("estimated_cost").cast("double").alias("estimated_cost"), "fault")

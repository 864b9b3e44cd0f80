"""Inference, embeddings, images, similarity, and files on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeflow.operators import annotations as oa, evaluation, imaging, inference as inf, similarity as sim
from gradeflow.plans.annotations_queries import _IMPORT_SQL, _UPSERT_SQL, _import, _truth_answers, _upserted
from gradeflow.plans.catalog_queries import write_json_lists
from gradeflow.plans.registry import query
from gradeflow.plans.tables import Tables, with_views
from gradeflow.schemas import ANSWER
from gradeflow.session import new_work_path
from gradeflow.sources import catalogue as sc, label_csv


def length_model():
    """An offline model by rule: step one reads the length, step two repeats what it was asked."""

    def answer(requests):
        replies = []
        for request in requests:
            size = int(request["n_chars"])
            if request["prompt"].startswith("Describe"):
                replies.append(
                    inf.ModelError("rate limited", 429) if size % 19 == 0
                    else inf.Reply("long" if size > 1000 else "short", size, 2, 10)
                )
            elif size % 11 == 0:
                replies.append(ValueError("refused"))
            else:
                replies.append(inf.Reply(f"yes: {request['prompt']}", 7, 3, 20))
        return replies

    return answer


_CHAIN = (
    {"step_number": 1, "system_message": "Be brief.", "prompt": "Describe it."},
    {"step_number": 2, "system_message": None, "prompt": "Is {output1} right?"},
)


@query("""
SELECT doc_id, CASE WHEN n_chars % 19 = 0 THEN NULL WHEN n_chars % 11 = 0 THEN NULL
    ELSE 'yes: Is ' || CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END || ' right?' END AS model_response,
  CASE WHEN n_chars % 19 = 0 THEN 'rate limited' WHEN n_chars % 11 = 0 THEN 'refused' END AS error,
  CASE WHEN n_chars % 19 = 0 THEN 0 WHEN n_chars % 11 = 0 THEN 1 ELSE 2 END AS steps,
  CASE WHEN n_chars % 19 = 0 THEN 0 WHEN n_chars % 11 = 0 THEN n_chars ELSE n_chars + 7 END AS prompt_tokens
FROM documents""")
def inference_chain(t: Tables) -> DataFrame:
    """A chain of two prompts over every document, with failures kept apart."""
    from gradeflow.operators.scoring import step_total

    rows = t.given("documents").select("doc_id", "n_chars")
    retry = inf.Retry(max_attempts=2, sleep=lambda seconds: None)
    answered = inf.run_inference(rows, _CHAIN, length_model, ["n_chars"], retry=retry, parallel_calls=3)
    return answered.select(
        "doc_id", "model_response", "error", F.size("steps").alias("steps"),
        step_total("steps", "prompt_tokens").alias("prompt_tokens"),
    )


def judging_model():
    """An offline model by rule: step one names the length, step two judges it."""

    def answer(requests):
        replies = []
        for request in requests:
            size = int(request["n_chars"])
            if request["prompt"].startswith("Describe"):
                replies.append(ValueError("refused") if size % 11 == 0 else inf.Reply("long" if size > 1000 else "short", size, 2, 10))
            elif size % 19 == 0:
                replies.append(inf.ModelError("rate limited", 429))
            elif size % 5 == 0:
                replies.append(inf.Reply("unsure", 7, 3, 20))
            else:
                replies.append(inf.Reply("Yes, it is" if request["prompt"] == "Is long right?" else "No.", 7, 3, 20))
        return replies

    return answer


@query("""
SELECT *, CASE WHEN error IS NULL THEN coalesce(answered = truth, false) END AS is_correct
FROM (SELECT doc_id AS image_id,
        CASE WHEN n_chars % 11 = 0 THEN 'refused' WHEN n_chars % 19 = 0 THEN 'rate limited' END AS error,
        CASE WHEN n_chars % 11 = 0 THEN 0 WHEN n_chars % 19 = 0 THEN 1 ELSE 2 END AS steps,
        CASE WHEN n_chars % 11 = 0 OR n_chars % 19 = 0 OR n_chars % 5 = 0 THEN NULL ELSE n_chars > 1000 END AS answered,
        quality = 1 AS truth
      FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 300) AS t""")
def evaluation_run(t: Tables) -> DataFrame:
    """A whole run: a third of the images first, then all of them, which asks for the others only."""
    images = t.given("documents").selectExpr(
        "doc_id AS image_id", "n_chars", "'binary' AS question_type",
        "IF(n_chars < 300, 'failed', 'completed') AS processing_status",
    )
    truth = F.struct(F.expr("quality = 1 AS value_bool"), F.lit(None).alias("value_count"), F.lit(None).alias("value_str"))
    truths = t.given("labels").select(F.col("doc_id").alias("image_id"), truth.cast(ANSWER).alias("ground_truth"))
    log, retry = new_work_path(t.spark, "answers"), inf.Retry(max_attempts=2, sleep=lambda seconds: None)

    def run(config: dict | None) -> DataFrame:
        return evaluation.evaluate_run(
            images, truths, _CHAIN, judging_model, ["n_chars"], log, "judging", config,
            retry=retry, parallel_calls=8, at_risk=5000,
        )

    run({"mode": "random_percent", "percent": 33})
    return run(None).select(
        "image_id", "error", F.size("steps").alias("steps"), F.col("parsed.value_bool").alias("answered"),
        F.col("ground_truth.value_bool").alias("truth"), "is_correct",
    )


def _providers():
    def upper(requests):
        return [inf.Reply(r["role"].upper()) for r in requests]

    def count(requests):
        return [inf.Reply(str(len(r["text"]))) for r in requests]

    return inf.dispatch({"upper": upper, "count": count})


@query("""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN CAST(length(text) AS VARCHAR) END AS model_response,
  CASE WHEN role = 'system' THEN 'Unknown provider: none' END AS error FROM conversations""")
def provider_dispatch(t: Tables) -> DataFrame:
    """Requests sent to the provider each row names."""
    rows = t.given("conversations").withColumn(
        "provider", F.expr("CASE role WHEN 'user' THEN 'upper' WHEN 'assistant' THEN 'count' ELSE 'none' END")
    )
    steps = ({"step_number": 1, "prompt": "Answer."},)
    answered = inf.run_inference(rows, steps, _providers, ["provider", "role", "text"])
    return answered.select("conv_id", "turn", "model_response", "error")


def _vowel_embedder():
    def embedder(requests, dimension):
        out = []
        for request in requests:
            text = request["text"]
            counts = [float(text.count(c)) for c in "aeiou"[:dimension]]
            out.append(ValueError("empty") if len(text) < 50 else inf.Embedded(text=counts))
        return out

    return {"vowels": embedder}


@query("""
SELECT doc_id, CASE WHEN length(text) < 50 THEN NULL ELSE CAST(CAST(length(text) - length(replace(text, 'a', '')) AS BIGINT) AS VARCHAR) || ','
  || CAST(CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS VARCHAR) END AS embedding,
  2 AS dimension, CASE WHEN length(text) < 50 THEN 'empty' END AS error FROM documents""")
def embed_texts(t: Tables) -> DataFrame:
    """Embeddings of whole texts by an injected embedder."""
    embedded = inf.embed(t.given("documents").select("doc_id", "text"), _vowel_embedder, ["text"], "vowels", 2)
    vector = F.array_join(F.transform("text_embedding", lambda x: x.cast("bigint").cast("string")), ",")
    return embedded.select("doc_id", vector.alias("embedding"), "dimension", "error")


_PNG = "'89504E470D0A1A0A0000000D49484452' || lpad(hex(doc_id + 1), 8, '0') || lpad(hex(n_chars), 8, '0') || '0802000000'"


@query("""
SELECT doc_id, CASE WHEN n_chars % 4 < 3 THEN doc_id + 1 END AS width, CASE WHEN n_chars % 4 < 3 THEN n_chars END AS height,
  CASE WHEN n_chars % 4 = 3 THEN 'Unable to read image: no size in its header' END AS error FROM documents""")
def image_dimensions(t: Tables) -> DataFrame:
    """Width and height out of image headers (PNG and JPEG), one in four unreadable."""
    jpeg = (
        "'FFD8FFE000104A46494600010100000100010000' || 'FFFE0006' || '41424344' || 'FFC0001108'"
        " || lpad(hex(n_chars % 65536), 4, '0') || lpad(hex((doc_id + 1) % 65536), 4, '0') || '03011100'"
    )
    stored = t.given("documents").selectExpr(
        "doc_id",
        f"unhex(CASE WHEN n_chars % 4 = 3 THEN '0011' WHEN n_chars % 4 = 1 AND n_chars < 65536 AND doc_id < 65535 THEN {jpeg} ELSE {_PNG} END) AS content",
    )
    return imaging.read_dimensions(stored, "doc_id", "content")


@query(
    with_views("images")
    + """SELECT image_id, CASE WHEN n_chars % 7 = 0 THEN 'failed' ELSE 'completed' END AS processing_status,
  CASE WHEN n_chars % 7 = 0 THEN 'broken image' END AS processing_error, CASE WHEN n_chars % 7 <> 0 THEN n_chars END AS payload_bytes
FROM images JOIN documents ON image_id = doc_id WHERE processing_status = 'pending'"""
)
def image_processing(t: Tables) -> DataFrame:
    """A processing pass over the pending images."""
    broken = F.expr("CASE WHEN n_chars % 7 = 0 THEN NULL ELSE CAST(rpad('x', CAST(n_chars AS INT), 'x') AS BINARY) END")
    content = t.given("documents").select(F.col("doc_id").alias("image_id"), broken.alias("content"))
    images = t.view("images").select("image_id", "processing_status").join(content, "image_id")

    def thumbnail(data):
        if data is None:
            raise ValueError("broken image")
        return data

    done = imaging.process_images(images, thumbnail)
    return done.select(
        "image_id", "processing_status", "processing_error", F.octet_length("payload").cast("bigint").alias("payload_bytes")
    )


_NEAREST_SQL = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label AS label,
            round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS similarity
          FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS place FROM pairs)
"""


def _nearest(t: Tables) -> DataFrame:
    vectors = t.given("embeddings")
    return sim.nearest_items(
        vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
        vectors.select(F.col("vec_id").alias("item_id"), "embedding"), k=3,
    )


@query(_NEAREST_SQL + "SELECT query_id, item_id, place, round(similarity, 6) AS similarity FROM ranked WHERE place <= 3")
def nearest_examples(t: Tables) -> DataFrame:
    """Three most similar items of every item."""
    return _nearest(t).withColumn("similarity", F.round("similarity", 6))


@query(
    _NEAREST_SQL + """SELECT query_id, string_agg('Example ' || place || ': ' || label, chr(10) ORDER BY place) || chr(10) || 'What is it?' AS prompt
FROM ranked WHERE place <= 3 GROUP BY query_id"""
)
def few_shot_prompts(t: Tables) -> DataFrame:
    """Prompts with the ground truth of the nearest items."""
    vectors = t.given("embeddings")
    prompts = vectors.select(F.col("vec_id").alias("query_id"), F.lit("What is it?").alias("prompt"))
    labels = vectors.select(F.col("vec_id").alias("item_id"), "label")
    return sim.few_shot_prompts(prompts, _nearest(t), labels)


# --- files on disk ---------------------------------------------------------


def _write_import_files(t: Tables) -> str:
    """Import rows as CSV files, in row order; the third column holds each row's number in its file."""
    path = new_work_path(t.spark, "import")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + label_csv.FIRST_ROW
    rows = t.view("import_rows").select("row_no", "image_filename", "annotation_value")
    rows.repartitionByRange(8, "row_no").sortWithinPartitions("row_no").select(
        "image_filename", "annotation_value", place.alias("dataset_name")
    ).write.csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


@query(
    with_views("import_rows")
    + """SELECT image_filename, CASE WHEN annotation_value <> '' THEN annotation_value END AS annotation_value, TRUE AS in_place
FROM import_rows"""
)
def csv_import_rows(t: Tables) -> DataFrame:
    """Import rows read from CSV files, each with its row number in its file."""
    rows = label_csv.read_import_rows(t.spark, _write_import_files(t))
    return rows.select(
        "image_filename", "annotation_value", (F.col("row_no") == F.col("dataset_name").cast("bigint")).alias("in_place")
    )


@query("SELECT count(*) AS rows FROM documents")
def csv_row_count(t: Tables) -> DataFrame:
    """Data rows of the import files."""
    return label_csv.count_rows(t.spark, _write_import_files(t))


@query(_UPSERT_SQL)
def csv_import_upsert(t: Tables) -> DataFrame:
    """Annotations after an import of several files, some with swapped columns and line breaks in quotes."""
    path = new_work_path(t.spark, "import")
    rows = t.view("import_rows").repartitionByRange(8, "row_no").sortWithinPartitions("row_no")
    # The rows of an image are in files of one kind, whose names keep their order.
    swapped = F.xxhash64(F.trim("image_filename")) % 2 == 0
    plain = rows.filter(~swapped).select("image_filename", "annotation_value")
    other = rows.filter(swapped).select("annotation_value", F.lit('a "note"\nin two lines').alias("note"), "image_filename")
    for name, part in (("plain", plain), ("swapped", other)):
        part.write.csv(
            f"{path}/{name}", header=True, quote='"', escape='"', emptyValue="", nullValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    read = label_csv.read_import_rows(t.spark, f"{path}/*")
    return _upserted(t, oa.import_annotations(read, t.view("copies"), t.view("marks"), "binary"))


@query(_IMPORT_SQL + "SELECT row_no, error FROM outcomes WHERE outcome = 'error'")
def csv_error_report(t: Tables) -> DataFrame:
    """The error report of an import, written and read back."""
    path = new_work_path(t.spark, "errors")
    label_csv.write_error_report(_import(t).errors(), path)
    return t.spark.read.csv(path, header=True, quote='"', escape='"', schema="row_no bigint, error string")


@query("SELECT 'c' || s_suppkey AS model_config_id, s_name AS name, CAST(s_nationkey AS DOUBLE) AS price FROM supplier")
def json_config_export(t: Tables) -> DataFrame:
    """Model configurations exported without their keys, and read back."""
    path = new_work_path(t.spark, "configs")
    configs = t.given("supplier").select(
        F.expr("'c' || s_suppkey").alias("model_config_id"), F.col("s_name").alias("name"), F.lit("secret").alias("api_key"),
        F.struct(F.col("s_nationkey").alias("input_price_per_1m")).alias("pricing"),
    )
    sc.write_model_configs(configs, path)
    back = t.spark.read.json(path)
    return back.select(
        *[c for c in back.columns if c != "pricing"], F.col("pricing.input_price_per_1m").cast("double").alias("price")
    )


@query(
    with_views("images", "truths")
    + """SELECT CAST(images.image_id AS VARCHAR) AS image_id, filename AS image_filename,
  CASE WHEN truth_bool THEN 'yes' WHEN NOT truth_bool THEN 'no' ELSE coalesce(truth_str, CAST(truth_count AS VARCHAR)) END AS annotation_value
FROM images LEFT JOIN truths USING (image_id)"""
)
def csv_export(t: Tables) -> DataFrame:
    """The annotation export as CSV files, read back."""
    from gradeflow.operators.annotations import export_annotations

    path = new_work_path(t.spark, "export")
    label_csv.write_export(export_annotations(t.view("images"), _truth_answers(t), F.col("question_type")), path)
    back = t.spark.read.csv(path, header=True, schema="image_id string, image_filename string, annotation_value string, dataset_name string")
    return back.select("image_id", "image_filename", "annotation_value")


@query("""
SELECT 's' || s_suppkey AS id, s_name AS display_name, CAST(s_nationkey AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS description FROM supplier""")
def json_catalogue(t: Tables) -> DataFrame:
    """A model catalogue written as JSON and read back by its schema."""
    models = t.given("supplier").select(
        "s_suppkey", F.expr("'s' || s_suppkey").alias("id"), F.col("s_name").alias("display_name"),
        F.struct(F.lit("token_based").alias("mode"), F.col("s_nationkey").alias("input_price_per_1m")).alias("pricing_config"),
    )
    back = sc.read_catalogue(t.spark, write_json_lists(t, models, "id", "s_suppkey"))
    return back.select("id", "display_name", F.col("pricing.input_price_per_1m").cast("double").alias("price"), "description")

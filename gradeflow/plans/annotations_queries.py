"""Label validation, import, export and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeflow.functions import answers as fa
from gradeflow.operators import annotations as oa
from gradeflow.operators.joins import delete_cascade, merge_by_key
from gradeflow.plans.registry import query
from gradeflow.plans.tables import Tables, with_views
from gradeflow.schemas import ANSWER

_COUNT_TEXTS = (
    "CASE n_chars % 8 WHEN 0 THEN '3.7' WHEN 1 THEN '1e3' WHEN 2 THEN '-1' WHEN 3 THEN '-0.5' WHEN 4 THEN 'abc'"
    " WHEN 5 THEN ' 12 ' WHEN 6 THEN 'inf' ELSE CAST(n_chars AS STRING) END"
)
_CHOICE_TEXTS = (
    "CASE n_chars % 5 WHEN 0 THEN 'Cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'Bird' WHEN 3 THEN ' DOG ' ELSE lang END"
)


def _truth_answers(t: Tables) -> DataFrame:
    """Annotations with a typed answer."""
    answer = F.struct(
        F.col("truth_bool").alias("value_bool"), F.col("truth_count").alias("value_count"),
        F.col("truth_str").alias("value_str"),
    ).cast(ANSWER)
    return t.view("truths").select(
        "image_id", "question_type", answer.alias("answer"), "is_skipped", "is_flagged", F.lit("u1").alias("annotator_id")
    )


@query(
    with_views("import_rows")
    + """SELECT row_no, CASE WHEN lower(trim(annotation_value)) IN ('yes', 'y', 'true', 't', '1', '1.0') THEN TRUE
            WHEN lower(trim(annotation_value)) IN ('no', 'n', 'false', 'f', '0', '0.0') THEN FALSE END AS value,
       CASE WHEN annotation_value IS NULL OR annotation_value = '' THEN NULL
            WHEN lower(trim(annotation_value)) IN ('yes', 'y', 'true', 't', '1', '1.0', 'no', 'n', 'false', 'f', '0', '0.0') THEN NULL
            ELSE 'Invalid binary value: ''' || annotation_value || '''. Accepted: yes/no, y/n, true/false, t/f, 1/0' END AS error
FROM import_rows"""
)
def normalize_label(t: Tables) -> DataFrame:
    """Yes/no labels of an import."""
    checked = fa.validate_label("annotation_value", "binary")
    return t.view("import_rows").select(
        "row_no", checked["answer"]["value_bool"].alias("value"), checked["error"].alias("error")
    )


@query(f"""
SELECT doc_id, CASE lower(trim(label)) WHEN 'cat' THEN 'Cat' WHEN 'dog' THEN 'Dog' END AS value,
  CASE WHEN lower(trim(label)) NOT IN ('cat', 'dog') THEN 'Invalid option: ''' || trim(label) || '''. Valid options: Cat, Dog' END AS error,
  'No question options defined for multiple choice question' AS without_options
FROM (SELECT doc_id, {_CHOICE_TEXTS} AS label FROM documents) AS d""")
def validate_choice(t: Tables) -> DataFrame:
    """Multiple choice labels against two options, and against none."""
    labels = t.given("documents").selectExpr("doc_id", f"{_CHOICE_TEXTS} AS label")
    checked = fa.validate_label("label", "multiple_choice", F.array(F.lit("Cat"), F.lit("Dog")))
    bare = fa.validate_label("label", "multiple_choice")
    return labels.select(
        "doc_id", checked["answer"]["value_str"].alias("value"), checked["error"].alias("error"),
        bare["error"].alias("without_options"),
    )


@query(f"""
SELECT doc_id, CASE label WHEN '3.7' THEN 3 WHEN '1e3' THEN 1000 WHEN '-0.5' THEN 0 WHEN ' 12 ' THEN 12
    ELSE TRY_CAST(CASE WHEN label IN ('-1', 'inf') THEN NULL ELSE label END AS BIGINT) END AS value,
  CASE WHEN label IN ('-1', 'abc', 'inf') THEN 'Invalid count value: ''' || label || '''. Must be a non-negative integer.' END AS error
FROM (SELECT doc_id, {_COUNT_TEXTS} AS label FROM documents) AS d""")
def validate_count(t: Tables) -> DataFrame:
    """Count labels."""
    labels = t.given("documents").selectExpr("doc_id", f"{_COUNT_TEXTS} AS label")
    checked = fa.validate_label("label", "count")
    return labels.select(
        "doc_id", checked["answer"]["value_count"].cast("bigint").alias("value"), checked["error"].alias("error")
    )


@query(
    "SELECT doc_id, CASE WHEN lang = 'en' THEN md5(trim(text, chr(9) || chr(10) || chr(13) || ' ')) END AS value,"
    " CASE WHEN lang <> 'en' THEN 'Unknown question type: ' || lang END AS error FROM documents"
)
def validate_text(t: Tables) -> DataFrame:
    """Free-text labels, and a question type that does not exist."""
    checked = fa.validate_label("text", F.when(F.col("lang") == "en", "text").otherwise(F.col("lang")))
    return t.given("documents").select(
        "doc_id", F.md5(checked["answer"]["value_str"]).alias("value"), checked["error"].alias("error")
    )


_IMPORT_SQL = with_views("import_rows", "copies", "marks") + """, lookup AS (
  SELECT filename, min(image_id) AS image_id FROM copies GROUP BY filename
), checked AS (
  SELECT row_no, l.image_id, m.image_id IS NOT NULL AS annotated, trim(image_filename) AS name, annotation_value AS raw,
         CASE WHEN lower(trim(annotation_value)) IN ('yes', 'true', '1.0') THEN TRUE
              WHEN lower(trim(annotation_value)) IN ('no', '0') THEN FALSE END AS value
  FROM import_rows AS r LEFT JOIN lookup AS l ON trim(r.image_filename) = l.filename LEFT JOIN marks AS m ON m.image_id = l.image_id
), numbered AS (
  SELECT *, CASE WHEN image_id IS NOT NULL AND value IS NOT NULL
                 THEN row_number() OVER (PARTITION BY image_id, value IS NOT NULL ORDER BY row_no) END AS place
  FROM checked
), outcomes AS (
  SELECT row_no, image_id, CASE WHEN image_id IS NOT NULL THEN value END AS value,
    CASE WHEN image_id IS NULL THEN 'error' WHEN raw IS NULL OR raw = '' THEN 'skipped' WHEN value IS NULL THEN 'error'
         WHEN NOT annotated AND place = 1 THEN 'created' ELSE 'updated' END AS outcome,
    CASE WHEN image_id IS NULL THEN 'Image not found: ' || name
         WHEN raw <> '' AND value IS NULL THEN 'Invalid binary value: ''' || raw || '''. Accepted: yes/no, y/n, true/false, t/f, 1/0' END AS error
  FROM numbered
)
"""


def _import(t: Tables) -> oa.ImportResult:
    return oa.import_annotations(t.view("import_rows"), t.view("copies"), t.view("marks"), "binary")


@query(_IMPORT_SQL + "SELECT * FROM outcomes")
def import_outcomes(t: Tables) -> DataFrame:
    """What became of every import row."""
    return _import(t).outcomes.select(
        "row_no", "image_id", F.col("answer.value_bool").alias("value"), "outcome", "error"
    )


@query(
    _IMPORT_SQL + """SELECT count(*) AS processed, count(*) FILTER (outcome = 'created') AS created,
  count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped,
  count(*) FILTER (outcome = 'error') AS error_count FROM outcomes"""
)
def import_counters(t: Tables) -> DataFrame:
    """Counters of an import."""
    return _import(t).counters()


@query(_IMPORT_SQL + "SELECT row_no, error FROM outcomes WHERE outcome = 'error' ORDER BY row_no LIMIT 1000")
def import_errors(t: Tables) -> DataFrame:
    """The errors an import keeps."""
    return _import(t).stored_errors()


_UPSERT_SQL = (
    _IMPORT_SQL + """, latest AS (
  SELECT image_id, arg_max(value, row_no) AS value FROM outcomes WHERE outcome IN ('created', 'updated') GROUP BY image_id
), old AS (SELECT doc_id AS image_id, CASE WHEN NOT (quality = 0 AND toxic = 1) THEN quality = 1 END AS value,
                  quality = 0 AND toxic = 1 AS is_skipped, toxic = 1 AS is_flagged FROM labels)
SELECT image_id, CASE WHEN l.image_id IS NOT NULL THEN l.value ELSE o.value END AS value,
       coalesce(is_skipped, FALSE) AS is_skipped, coalesce(is_flagged, FALSE) AS is_flagged,
       CASE WHEN l.image_id IS NOT NULL THEN 'importer' ELSE 'u1' END AS annotator_id
FROM old AS o FULL JOIN latest AS l USING (image_id)"""
)


def _upserted(t: Tables, result: oa.ImportResult) -> DataFrame:
    labels = t.given("labels").selectExpr(
        "doc_id AS image_id", "quality = 0 AND toxic = 1 AS is_skipped", "toxic = 1 AS is_flagged", "quality"
    )
    value = F.when(~F.col("is_skipped"), F.col("quality") == 1)
    answer = F.struct(
        value.alias("value_bool"), F.lit(None).alias("value_count"), F.lit(None).alias("value_str")
    ).cast(ANSWER)
    old = labels.select("image_id", answer.alias("answer"), "is_skipped", "is_flagged", F.lit("u1").alias("annotator_id"))
    return result.applied(old, "importer").select(
        "image_id", F.col("answer.value_bool").alias("value"), "is_skipped", "is_flagged", "annotator_id"
    )


@query(_UPSERT_SQL)
def import_upsert(t: Tables) -> DataFrame:
    """Annotations after an import."""
    return _upserted(t, _import(t))


@query(
    _IMPORT_SQL + """SELECT count(*) AS total, count(*) FILTER (outcome IN ('created', 'updated')) AS valid,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors,
  count(*) FILTER (outcome = 'error') = 0 AS can_confirm FROM outcomes"""
)
def import_preview(t: Tables) -> DataFrame:
    """What an import would do."""
    return oa.import_preview(_import(t))


@query(
    with_views("import_rows")
    + "SELECT trim(image_filename) AS filename, count(*) AS rows FROM import_rows GROUP BY 1 HAVING count(*) > 1"
)
def import_repeats(t: Tables) -> DataFrame:
    """File names an import mentions more than once."""
    return oa.duplicate_filename_warnings(t.view("import_rows"))


@query(
    with_views("import_rows")
    + "SELECT DISTINCT dataset_name FROM import_rows WHERE dataset_name IS NOT NULL AND trim(dataset_name) <> 'en'"
)
def import_name_mismatch(t: Tables) -> DataFrame:
    """Dataset names in an import that are not the target."""
    return oa.mismatched_dataset_names(t.view("import_rows"), "en")


@query(
    with_views("images", "truths")
    + """SELECT images.image_id, filename AS image_filename, dataset_id AS dataset_name,
  CASE WHEN truths.image_id IS NULL THEN '' WHEN truth_bool THEN 'yes' WHEN NOT truth_bool THEN 'no'
       ELSE coalesce(truth_str, CAST(truth_count AS VARCHAR), '') END AS annotation_value
FROM images LEFT JOIN truths USING (image_id)"""
)
def export_annotations(t: Tables) -> DataFrame:
    """Every image with the text of its annotation."""
    return oa.export_annotations(t.view("images"), _truth_answers(t), F.col("question_type"))


@query(
    with_views("images", "marks")
    + """SELECT dataset_id, count(*) AS total, count(*) FILTER (NOT is_skipped) AS annotated, count(*) FILTER (is_skipped) AS skipped,
  count(*) FILTER (is_flagged) AS flagged, count(*) - count(is_skipped) AS remaining,
  count(is_skipped) * CAST(100 AS DOUBLE) / count(*) AS progress_percent
FROM images LEFT JOIN marks USING (image_id) GROUP BY dataset_id"""
)
def annotation_stats(t: Tables) -> DataFrame:
    """Annotation progress per dataset."""
    return oa.annotation_stats(t.view("images"), t.view("marks"))


_DATASET_STATES = """, datasets AS (
  SELECT dataset_id, CASE WHEN count(*) FILTER (processing_status = 'failed') > 2 THEN 'processing'
                          WHEN count(*) FILTER (processing_status = 'pending') > 2 THEN 'ready' ELSE 'completed' END AS processing_status
  FROM images GROUP BY dataset_id)
"""


def _dataset_states(t: Tables) -> DataFrame:
    status = F.col("processing_status")
    return t.view("images").groupBy("dataset_id").agg(
        F.when(F.count_if(status == "failed") > 2, "processing")
        .when(F.count_if(status == "pending") > 2, "ready").otherwise("completed").alias("processing_status")
    )


@query(
    with_views("images", "marks") + _DATASET_STATES
    + """SELECT dataset_id, image_id, filename, CAST(uploaded_at AS VARCHAR) AS uploaded_at
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY uploaded_at, image_id) AS place
      FROM images ANTI JOIN marks USING (image_id)) AS open
SEMI JOIN (SELECT * FROM datasets WHERE processing_status IN ('ready', 'completed')) AS d USING (dataset_id) WHERE place = 1"""
)
def next_unannotated(t: Tables) -> DataFrame:
    """Oldest open image of every dataset that is ready."""
    found = oa.next_unannotated(t.view("images"), t.view("marks"), _dataset_states(t))
    return found.withColumn("uploaded_at", F.col("uploaded_at").cast("string"))


@query(
    with_views("images", "truths")
    + """SELECT images.image_id, dataset_id, truths.image_id IS NOT NULL AS is_annotated, truth_bool AS value,
  coalesce(is_skipped, FALSE) AS is_skipped, coalesce(is_flagged, FALSE) AS is_flagged
FROM images LEFT JOIN truths USING (image_id)"""
)
def annotation_listing(t: Tables) -> DataFrame:
    """Images with their annotation state."""
    marks = _truth_answers(t).drop("question_type", "annotator_id")
    return oa.annotation_listing(t.view("images"), marks).select(
        "image_id", "dataset_id", "is_annotated", F.col("answer.value_bool").alias("value"), "is_skipped", "is_flagged"
    )


@query(
    with_views("images", "marks")
    + """SELECT image_id, filename FROM images
ORDER BY uploaded_at DESC, image_id LIMIT 100 OFFSET 100"""
)
def image_page(t: Tables) -> DataFrame:
    """Second page of the images, newest first."""
    from gradeflow.operators.ordering import page

    return page(t.view("images"), [F.col("uploaded_at").desc(), F.col("image_id")], 100, 100).select("image_id", "filename")


@query(
    with_views("images", "marks") + _DATASET_STATES
    + """, updates AS (SELECT image_id, FALSE AS is_skipped, file_size > 5000000 AS is_flagged
  FROM images SEMI JOIN (SELECT * FROM datasets WHERE processing_status IN ('ready', 'completed')) AS d USING (dataset_id)
  WHERE file_size > 3000000)
SELECT image_id, is_skipped, is_flagged FROM updates
UNION ALL SELECT image_id, is_skipped, is_flagged FROM marks ANTI JOIN updates USING (image_id)"""
)
def annotation_save(t: Tables) -> DataFrame:
    """Annotations after saving new marks for the large images of ready datasets."""
    images = t.view("images")
    updates = images.filter(F.col("file_size") > 3000000).selectExpr(
        "image_id", "false AS is_skipped", "file_size > 5000000 AS is_flagged"
    )
    return oa.save_annotations(t.view("marks"), updates, _dataset_states(t), images)


@query(
    with_views("images", "marks")
    + """, gone AS (SELECT dataset_id FROM images GROUP BY dataset_id HAVING count(*) FILTER (processing_status = 'failed') > 1)
SELECT 'images' AS level, image_id FROM images ANTI JOIN gone USING (dataset_id)
UNION ALL SELECT 'annotations', image_id FROM marks
  ANTI JOIN (SELECT image_id FROM images SEMI JOIN gone USING (dataset_id)) AS g USING (image_id)"""
)
def delete_datasets(t: Tables) -> DataFrame:
    """Images and annotations that remain when datasets with failed images are deleted."""
    images, marks = t.view("images"), t.view("marks")
    failed = F.count_if(F.col("processing_status") == "failed")
    datasets = images.groupBy("dataset_id").agg(failed.alias("failed"))
    left = delete_cascade(
        datasets, datasets.filter(F.col("failed") > 1), "dataset_id",
        [("images", images, "dataset_id", "image_id"), ("annotations", marks, "image_id", "image_id")],
    )
    return left["images"].select(F.lit("images").alias("level"), "image_id").unionByName(
        left["annotations"].select(F.lit("annotations").alias("level"), "image_id")
    )


@query(
    with_views("marks", "images")
    + """, updates AS (SELECT image_id, FALSE AS is_skipped, TRUE AS is_flagged FROM images WHERE processing_status = 'pending')
SELECT * FROM updates UNION ALL SELECT * FROM marks ANTI JOIN updates USING (image_id)"""
)
def annotation_upsert(t: Tables) -> DataFrame:
    """Marks after flagging every pending image."""
    updates = t.view("images").filter(F.col("processing_status") == "pending").selectExpr(
        "image_id", "false AS is_skipped", "true AS is_flagged"
    )
    return merge_by_key(t.view("marks"), updates, ["image_id"])

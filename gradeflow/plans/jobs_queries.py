"""Scheduled labelling, progress, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradeflow.functions.paths import basename
from gradeflow.operators import labelling, paging, progress
from gradeflow.operators.catalog import latest_result_per_job
from gradeflow.operators.inference import Reply, Retry
from gradeflow.operators.joins import first_by
from gradeflow.plans.registry import query
from gradeflow.plans.scoring_queries import results
from gradeflow.plans.tables import Tables, with_views
from gradeflow.session import new_work_path
from gradeflow.streaming import discover as sd, labelling as sl, progress as sp, uploads as su

_MARK = "2024-01-15 00:00:00"
_SCANNED = f"""regexp_matches(lower(object_name), '\\.(jpg|jpeg|png|gif|bmp|webp|tiff)$')
  AND time_created > TIMESTAMP '{_MARK}' - INTERVAL 1 MINUTE"""


def _found(t: Tables) -> DataFrame:
    files = t.view("files").withColumn("full_path", F.concat(F.lit("gs://bucket/"), F.col("object_name")))
    mark = F.expr(f"TIMESTAMP_NTZ '{_MARK}'")
    return labelling.scan_files(files, high_water=mark).withColumn("filename", basename("object_name"))


@query(with_views("files") + f"SELECT file_id, object_name FROM files WHERE {_SCANNED}")
def scan_incremental(t: Tables) -> DataFrame:
    """Files after the last mark, less its overlap."""
    return _found(t).select("file_id", "object_name")


@query(
    with_views("files")
    + f"""SELECT object_name, min(time_created)::VARCHAR AS first_seen FROM files WHERE {_SCANNED} AND object_name LIKE 'click/%'
  AND object_name NOT IN (SELECT object_name FROM files WHERE time_created <= TIMESTAMP '{_MARK}') GROUP BY object_name"""
)
def scan_new_paths(t: Tables) -> DataFrame:
    """Files of one folder that no earlier scan has seen."""
    files = t.view("files").withColumn("full_path", F.concat(F.lit("gs://bucket/"), F.col("object_name")))
    mark = F.expr(f"TIMESTAMP_NTZ '{_MARK}'")
    known = files.filter(F.col("time_created") <= mark).select("full_path").distinct()
    fresh = labelling.new_paths_only(labelling.scan_files(files, "click/", mark), known)
    return fresh.select("object_name", F.col("time_created").cast("string").alias("first_seen"))


@query(
    with_views("files")
    + f""", found AS (SELECT *, 'gs://bucket/' || object_name AS full_path, split_part(object_name, '/', -1) AS name,
    row_number() OVER (PARTITION BY event_type, split_part(object_name, '/', -1) ORDER BY time_created, 'gs://bucket/' || object_name) AS place
  FROM (SELECT object_name, event_type, min(time_created) AS time_created FROM files WHERE {_SCANNED} GROUP BY ALL) AS f),
taken AS (SELECT DISTINCT event_type, split_part(object_name, '/', -1) AS name FROM files WHERE time_created < TIMESTAMP '2024-01-05 00:00:00')
SELECT full_path, name AS original_name, 'projects/p/datasets/' || f.event_type || '/' || CASE WHEN place = 1 AND t.name IS NULL THEN f.name
  ELSE regexp_extract(f.name, '^(.*)\\.', 1) || '_' || substr(md5(full_path), 1, 8) || '.' || split_part(f.name, '.', -1) END AS storage_path
FROM found AS f LEFT JOIN taken AS t USING (event_type, name)"""
)
def take_up_files(t: Tables) -> DataFrame:
    """Image rows for found files, renamed where the name is taken."""
    found = first_by(_found(t), ["full_path"], ["time_created", "file_id"])
    found = found.select("full_path", "filename", "time_created", F.col("event_type").alias("dataset_id"), F.lit("p").alias("project_id"))
    before = F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'")
    images = t.view("files").filter(F.col("time_created") < before).select(
        F.col("event_type").alias("dataset_id"), basename("object_name").alias("filename")
    )
    return labelling.take_up(found, images).select("full_path", "original_name", "storage_path")


@query(
    with_views("files")
    + f"""SELECT file_id, object_name, row_number() OVER (ORDER BY time_created, file_id) AS position FROM files WHERE {_SCANNED}"""
)
def scan_oldest(t: Tables) -> DataFrame:
    """All files after the mark, with their place in the order they came."""
    return labelling.by_arrival(_found(t), "file_id").select("file_id", "object_name", "position")


_RUNS = """, per_run AS (
  SELECT job_id, date_trunc('day', time_created)::VARCHAR AS run_id, count(*) AS images_discovered,
    count(*) FILTER (size >= 1000) AS images_ingested, count(*) FILTER (size >= 1000 AND event_type <> 'error') AS images_labeled,
    count(*) FILTER (size >= 1000 AND event_type = 'error') AS images_failed
  FROM files GROUP BY ALL)
"""


def _run_counters(t: Tables) -> DataFrame:
    files = t.view("files").withColumn("day", F.date_trunc("day", "time_created").cast("timestamp_ntz").cast("string"))
    files = files.withColumn("run_id", F.concat_ws(" ", F.col("job_id").cast("string"), "day"))
    taken = files.filter(F.col("size") >= 1000)
    labelled = taken.withColumn("error", F.when(F.col("event_type") == "error", "model error"))
    counters = labelling.run_counters(files, taken, labelled)
    return counters.withColumn("job_id", F.substring_index("run_id", " ", 1).cast("bigint")).withColumn(
        "run_id", F.expr("substr(run_id, instr(run_id, ' ') + 1)")
    )


@query(with_views("files") + _RUNS + "SELECT *, images_discovered - images_ingested AS ingest_failed FROM per_run")
def run_counters(t: Tables) -> DataFrame:
    """Counters of every labelling run."""
    return _run_counters(t)


@query(
    with_views("files") + _RUNS
    + """SELECT job_id, count(*) AS total_runs, CAST(sum(images_ingested) AS BIGINT) AS total_images_processed,
  CAST(sum(images_labeled) AS BIGINT) AS total_images_labeled, CAST(sum(images_failed) AS BIGINT) AS total_errors,
  CAST(CASE WHEN sum(images_ingested) > 0 THEN (200 * sum(images_labeled) + sum(images_ingested)) // (2 * sum(images_ingested)) ELSE 0 END AS BIGINT) AS success_rate
FROM per_run GROUP BY job_id"""
)
def job_totals(t: Tables) -> DataFrame:
    """Totals and success rate of every job."""
    return labelling.job_totals(_run_counters(t))


@query(with_views("files") + "SELECT job_id, max(time_created)::VARCHAR AS last_processed_timestamp FROM files GROUP BY job_id")
def high_water(t: Tables) -> DataFrame:
    """Mark of every job for its next scan."""
    marks = labelling.high_water_mark(t.view("files"))
    return marks.withColumn("last_processed_timestamp", F.col("last_processed_timestamp").cast("string"))


@query(
    with_views("files")
    + """SELECT c_custkey AS job_id, f.file_id, f.object_name FROM customer
LEFT JOIN (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY time_created DESC, file_id DESC) = 1) AS f ON f.job_id = c_custkey"""
)
def latest_per_job(t: Tables) -> DataFrame:
    """Jobs with their latest result."""
    jobs = t.given("customer").select(F.col("c_custkey").alias("job_id"))
    files = t.view("files").select("job_id", "file_id", "object_name", "time_created")
    return latest_result_per_job(jobs, files, "time_created", "file_id").select("job_id", "file_id", "object_name")


@query(
    with_views("files")
    + """SELECT job_id, day, CAST(floor(epoch(completed) - epoch(started)) AS BIGINT) AS duration_seconds FROM (
  SELECT job_id, date_trunc('day', time_created)::VARCHAR AS day, min(time_created) AS started, max(time_created) AS completed FROM files GROUP BY ALL) AS r"""
)
def run_duration(t: Tables) -> DataFrame:
    """Length of every labelling run in whole seconds."""
    day = F.date_trunc("day", "time_created").cast("timestamp_ntz").cast("string").alias("day")
    runs = t.view("files").groupBy("job_id", day).agg(
        F.min("time_created").alias("started"), F.max("time_created").alias("completed")
    )
    return runs.select("job_id", "day", labelling.duration_seconds("started", "completed").alias("duration_seconds"))


@query(
    with_views("files")
    + "SELECT file_id, object_name FROM files WHERE job_id = 7 ORDER BY time_created DESC, file_id LIMIT 50"
)
def job_result_page(t: Tables) -> DataFrame:
    """First page of the results of one job, newest first."""
    from gradeflow.operators.ordering import page

    mine = t.view("files").filter(F.col("job_id") == 7)
    return page(mine, [F.col("time_created").desc(), F.col("file_id")], 0, 50).select("file_id", "object_name")


_JOBS = """, jobs AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 <> 0 THEN 'd' || CAST(c_nationkey AS VARCHAR) END AS dataset_id, c_nationkey AS project_id FROM customer),
latest AS (SELECT job_id, object_name AS image_id FROM files WHERE event_type <> 'error'
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY time_created DESC, file_id DESC) = 1)
SELECT jobs.job_id, n_name AS dataset_name, latest.image_id AS latest_image_id, CASE WHEN latest.image_id LIKE '%.jpg' THEN md5(latest.image_id) END AS thumbnail
FROM jobs LEFT JOIN latest USING (job_id) LEFT JOIN nation ON 'd' || CAST(n_nationkey AS VARCHAR) = jobs.dataset_id"""


@query(with_views("files") + _JOBS)
def job_list(t: Tables) -> DataFrame:
    """Jobs with dataset name and the thumbnail of their latest result that has an image; failed ones have none."""
    jobs = t.given("customer").selectExpr(
        "c_custkey AS job_id", "CASE WHEN c_custkey % 5 <> 0 THEN 'd' || c_nationkey END AS dataset_id", "c_nationkey AS project_id", "c_acctbal AS created_at",
    )
    datasets = t.given("nation").selectExpr("'d' || n_nationkey AS dataset_id", "n_name AS name")
    results = t.view("files").selectExpr(
        "job_id", "file_id AS result_id", "time_created AS created_at", "CASE WHEN event_type <> 'error' THEN object_name END AS image_id"
    )
    images = t.view("files").filter("object_name LIKE '%.jpg'").select(
        F.col("object_name").alias("image_id"), F.md5("object_name").alias("thumbnail")
    ).distinct()
    return labelling.labelling_jobs(jobs, datasets, results, images).select("job_id", "dataset_name", "latest_image_id", "thumbnail")


@query(
    with_views("files")
    + """SELECT date_trunc('day', time_created)::VARCHAR AS run_id, CAST(floor(epoch(max(time_created)) - epoch(min(time_created))) AS BIGINT) AS duration_seconds
FROM files WHERE job_id = 7 GROUP BY 1 ORDER BY min(time_created) DESC, 1 LIMIT 5 OFFSET 2"""
)
def job_runs_page(t: Tables) -> DataFrame:
    """A page of the runs of one job, newest first."""
    day = F.date_trunc("day", "time_created").cast("timestamp_ntz").cast("string").alias("run_id")
    runs = t.view("files").groupBy("job_id", day).agg(F.min("time_created").alias("started_at"), F.max("time_created").alias("completed_at"))
    return labelling.runs_page(runs, 7, skip=2, limit=5).select("run_id", "duration_seconds")


@query(with_views("files") + "SELECT file_id, object_name FROM files WHERE job_id = 7 AND date_trunc('day', time_created) = TIMESTAMP '2024-01-15'")
def run_results(t: Tables) -> DataFrame:
    """Results of one run of one job."""
    rows = t.view("files").withColumn("run_id", F.to_date("time_created"))
    return labelling.results_of(rows, 7, F.lit("2024-01-15").cast("date")).select("file_id", "object_name")


@query(
    with_views("files")
    + """SELECT job_id, file_id, object_name, place FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY time_created DESC, file_id) AS place FROM files WHERE job_id IN (7, 8)) AS f
WHERE place BETWEEN 6 AND 30 AND job_id = 7 OR place BETWEEN 11 AND 15 AND job_id = 8"""
)
def job_result_pages(t: Tables) -> DataFrame:
    """Pages far in, of two jobs, out of results that were written in order once."""
    path = new_work_path(t.spark, "pages")
    files = t.view("files").select("job_id", "time_created", "file_id", "object_name")
    paging.write_pages(files, path, ["job_id"], [F.col("time_created").desc(), "file_id"], slice_rows=5_000)
    pages = [paging.read_page(t.spark, path, skip, limit, {"job_id": job}) for job, skip, limit in ((7, 5, 25), (8, 10, 5))]
    back = pages[0].unionByName(pages[1])
    order = Window.partitionBy("job_id").orderBy(F.col("time_created").desc(), "file_id")
    place = F.row_number().over(order) + F.when(F.col("job_id") == 7, 5).otherwise(10)  # at most 30 rows
    return back.select("job_id", "file_id", "object_name", place.cast("bigint").alias("place"))


# --- progress --------------------------------------------------------------

_LOG = """, logged AS (
  SELECT evaluation_id, image_id, filename, row_number() OVER (PARTITION BY evaluation_id ORDER BY completed_at, image_id) AS completed,
         count(*) OVER (PARTITION BY evaluation_id) AS total, completed_at FROM answers)
"""


@query(
    with_views("answers") + _LOG
    + """SELECT evaluation_id, image_id, completed, total, CAST(floor(completed / total * 100) AS BIGINT) AS progress,
  string_agg(completed || '/' || total || ': ' || filename, '; ') OVER (PARTITION BY evaluation_id ORDER BY completed ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS latest_images
FROM logged"""
)
def progress_log(t: Tables) -> DataFrame:
    """Progress lines of every run, with the last five at each point."""
    log = progress.progress_log(t.view("answers"), "evaluation_id", "completed_at", "image_id", "filename")
    return log.select(
        "evaluation_id", "image_id", "completed", "total", "progress", F.array_join("latest_images", "; ").alias("latest_images")
    )


@query(
    with_views("answers")
    + """, seen AS (SELECT evaluation_id, count(*) AS total_images, idx + 1 AS concurrency,
    count(*) FILTER (completed_at < TIMESTAMP '2024-02-01 01:30:00') AS completed,
    CAST(coalesce(sum(CASE WHEN has_step1 THEN latency1 ELSE 0 END + CASE WHEN has_step2 THEN latency2 ELSE 0 END) FILTER (completed_at < TIMESTAMP '2024-02-01 01:30:00'), 0) AS BIGINT) AS latency
  FROM answers GROUP BY evaluation_id, idx)
SELECT evaluation_id, completed, total_images, CAST(floor(completed / total_images * 100) AS BIGINT) AS progress,
  CASE WHEN completed > 0 THEN ((20 * latency + completed) // (2 * completed)) / CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS mean_latency_ms,
  CASE WHEN completed >= concurrency AND latency > 0
       THEN ((20 * latency * (total_images - completed) + completed * concurrency * 1000) // (2 * completed * concurrency * 1000)) / CAST(10 AS DOUBLE) END AS eta_seconds
FROM seen"""
)
def run_progress(t: Tables) -> DataFrame:
    """State of every run after ninety minutes: percent, mean latency, time left."""
    from gradeflow.operators.scoring import step_total

    rows = results(t).select("evaluation_id", "idx", "completed_at", step_total("steps", "latency_ms").alias("latency_ms"))
    runs = rows.groupBy("evaluation_id", (F.col("idx") + 1).alias("concurrency")).agg(F.count("*").alias("total_images"))
    done = rows.filter(F.col("completed_at") < F.expr("TIMESTAMP_NTZ '2024-02-01 01:30:00'"))
    return progress.run_progress(done, runs)


@query(
    with_views("runs")
    + """SELECT evaluation_id, last_activity::VARCHAR AS last_activity FROM (
  SELECT r.evaluation_id, status, coalesce(max(l_shipdate), any_value(created_at)) AS last_activity
  FROM runs AS r LEFT JOIN lineitem ON l_orderkey = evaluation_id GROUP BY r.evaluation_id, status) AS a
WHERE status = 'running' AND last_activity < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 2 MINUTE"""
)
def stale_runs(t: Tables) -> DataFrame:
    """Running runs that went quiet."""
    rows = t.given("lineitem").select(F.col("l_orderkey").alias("evaluation_id"), F.col("l_shipdate").alias("completed_at"))
    stale = progress.stale_runs(t.view("runs"), rows, F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    return stale.select("evaluation_id", F.col("last_activity").cast("string").alias("last_activity"))


@query(
    with_views("images")
    + """SELECT dataset_id, count(*) AS total_files, count(*) FILTER (processing_status <> 'failed') AS processed_files,
  count(*) FILTER (processing_status = 'failed') AS failed_files,
  CASE WHEN count(*) FILTER (processing_status = 'failed') = 0 THEN 'completed' ELSE 'failed' END AS processing_status,
  ((20000 * count(*) FILTER (processing_status <> 'failed') + count(*)) // (2 * count(*))) / CAST(100 AS DOUBLE) AS progress_percent,
  coalesce(string_agg(filename || ': too short', '; ' ORDER BY image_id) FILTER (processing_status = 'failed' AND place <= 10), '') AS processing_errors
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, processing_status = 'failed' ORDER BY image_id) AS place FROM images) AS i GROUP BY dataset_id"""
)
def processing_outcome(t: Tables) -> DataFrame:
    """Dataset status after a processing pass."""
    images = t.view("images").withColumn(
        "processing_status", F.when(F.col("processing_status") == "failed", "failed").otherwise("completed")
    ).withColumn("processing_error", F.when(F.col("processing_status") == "failed", "too short"))
    return progress.processing_outcome(images).withColumn("processing_errors", F.array_join("processing_errors", "; "))


_CHUNKS = (
    "event_id AS chunk_id", "CAST(user_id AS STRING) AS dataset_id", "ts AS uploaded_at",
    "CASE WHEN event_type = 'signup' THEN 'ready' WHEN event_type = 'error' AND value > 100 THEN 'failed' ELSE 'processing' END AS status_before",
    "CAST(ceil(value) AS BIGINT) AS announced", "CAST(floor(value) AS BIGINT) AS uploaded",
)
_TOTALS = f"""WITH chunks AS (SELECT {", ".join(_CHUNKS)} FROM events),
sessions AS (SELECT *, count(*) FILTER (status_before <> 'processing') OVER (PARTITION BY dataset_id ORDER BY uploaded_at, chunk_id) AS session FROM chunks),
last AS (SELECT *, max(session) OVER (PARTITION BY dataset_id) AS newest FROM sessions)
SELECT dataset_id, CAST(sum(CASE WHEN status_before = 'processing' THEN announced ELSE uploaded END) AS BIGINT) AS total_files,
  CAST(sum(uploaded) AS BIGINT) AS uploaded_files, count(*) AS chunks FROM last WHERE session = newest GROUP BY dataset_id"""


@query(_TOTALS)
def upload_totals(t: Tables) -> DataFrame:
    """Totals of the current upload of every dataset."""
    return labelling.upload_totals(t.given("events").selectExpr(*_CHUNKS))


# --- streaming -------------------------------------------------------------


def _event_stream(t: Tables) -> DataFrame:
    """The events table as a stream of files."""
    return t.spark.readStream.schema(t.given("events").schema).parquet(f"{t.sf_dir}/event[s].parquet")


def _event_batches(t: Tables, batches: int = 6) -> DataFrame:
    """The events as a stream of several micro-batches, each a share of the ids: paths repeat, and files come late."""
    folder = new_work_path(t.spark, "events")
    events = t.given("events")
    events.withColumn("_batch", F.pmod(F.xxhash64("event_id"), F.lit(batches))).repartition(batches, "_batch").sortWithinPartitions(
        "_batch"
    ).write.partitionBy("_batch").parquet(folder)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _file_stream(t: Tables) -> DataFrame:
    """The events as arriving files."""
    name = """event_type || '/' || CAST(user_id AS STRING) || '/f' || CAST(event_id % 1500 AS STRING) ||
              CASE event_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.tiff' WHEN 3 THEN '.txt'
              WHEN 4 THEN '/' WHEN 5 THEN '.webp' ELSE '' END AS object_name"""
    return _event_batches(t).selectExpr(
        "event_id AS file_id", "user_id AS job_id", "CAST(ts AS TIMESTAMP) AS time_created", name,
        "CAST(round(value * 1000) AS BIGINT) AS size",
    ).withColumn("full_path", F.concat(F.lit("gs://bucket/"), F.col("object_name")))


@query(
    with_views("files")
    + """SELECT DISTINCT 'gs://bucket/' || object_name AS full_path FROM files
WHERE regexp_matches(lower(object_name), '\\.(jpg|jpeg|png|gif|bmp|webp|tiff)$')"""
)
def stream_discover(t: Tables) -> DataFrame:
    """Arriving files, each path once."""
    work = new_work_path(t.spark, "discover")
    found = sd.discover(_file_stream(t)).select("full_path")
    found.writeStream.format("parquet").option("path", f"{work}/found").option(
        "checkpointLocation", f"{work}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("full_path string").parquet(f"{work}/found")


def rule_model():
    """An offline model: answers from the path alone, and fails for error folders."""

    def answer(requests):
        replies = []
        for request in requests:
            path = request["full_path"]
            if path.startswith("gs://bucket/error/"):
                replies.append(ValueError("cannot read " + path))
            else:
                replies.append(Reply("Yes" if path.endswith(".jpg") else "no idea", 1, 1, 5))
        return replies

    return answer


_STREAM_SQL = with_views("files") + """, found AS (
  SELECT job_id, 'gs://bucket/' || object_name AS full_path, min(time_created) AS first_seen FROM files
  WHERE regexp_matches(lower(object_name), '\\.(jpg|jpeg|png|gif|bmp|webp|tiff)$') GROUP BY ALL)
"""


def _label_stream(t: Tables) -> str:
    work = new_work_path(t.spark, "labels")
    sl.label_stream(
        labelling.scan_files(_file_stream(t)), "Is it so?", "binary", rule_model, f"{work}/sink", f"{work}/checkpoint", retry=Retry(max_attempts=1)
    ).awaitTermination()
    return f"{work}/sink"


@query(
    _STREAM_SQL + """SELECT job_id, full_path, CASE WHEN full_path LIKE 'gs://bucket/error/%' THEN '' WHEN full_path LIKE '%.jpg' THEN 'Yes' ELSE 'no idea' END AS model_response,
  CASE WHEN full_path LIKE 'gs://bucket/error/%' THEN NULL ELSE full_path LIKE '%.jpg' END AS value,
  CASE WHEN full_path LIKE 'gs://bucket/error/%' THEN 'cannot read ' || full_path END AS error FROM found"""
)
def stream_labels(t: Tables) -> DataFrame:
    """Arriving files labelled once each."""
    return sl.read_results(t.spark, _label_stream(t)).select(
        "job_id", "full_path", "model_response", F.col("parsed.value_bool").alias("value"), "error"
    )


@query(
    _STREAM_SQL + """SELECT job_id, l.listed AS images_discovered, l.listed - count(*) AS already_known, count(*) AS images_ingested,
  count(*) FILTER (full_path NOT LIKE 'gs://bucket/error/%') AS images_labeled,
  count(*) FILTER (full_path LIKE 'gs://bucket/error/%') AS images_failed, CAST(0 AS BIGINT) AS ingest_failed, CAST(l.mark AS VARCHAR) AS mark
FROM found JOIN (SELECT job_id, count(*) AS listed, max(time_created) AS mark FROM files
  WHERE regexp_matches(lower(object_name), '\\.(jpg|jpeg|png|gif|bmp|webp|tiff)$') GROUP BY job_id) AS l USING (job_id) GROUP BY job_id, l.listed, l.mark"""
)
def stream_runs(t: Tables) -> DataFrame:
    """Counters and marks kept by the labelling stream, over its runs."""
    runs = sl.read_runs(t.spark, _label_stream(t))
    counters = ("images_discovered", "already_known", "images_ingested", "images_labeled", "images_failed", "ingest_failed")
    mark = F.max("last_processed_timestamp").cast("timestamp_ntz").cast("string")
    return runs.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in counters], mark.alias("mark"))


@query(_TOTALS)
def stream_upload_totals(t: Tables) -> DataFrame:
    """Totals of chunked uploads, kept by a stream."""
    checkpoint = new_work_path(t.spark, "uploads")
    su.upload_totals_stream(_event_stream(t).selectExpr(*_CHUNKS), checkpoint).awaitTermination()
    return su.read_totals(t.spark, checkpoint)


@query("""
SELECT CAST(user_id AS VARCHAR) AS evaluation_id, count(*) AS completed, count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type = 'purchase') AS correct, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS latency_ms
FROM events GROUP BY user_id""")
def stream_counters(t: Tables) -> DataFrame:
    """Live counters per run, taken from a stream of results."""
    work = new_work_path(t.spark, "counters")
    rows = _event_stream(t).selectExpr(
        "CAST(user_id AS STRING) AS evaluation_id", "CASE WHEN event_type = 'error' THEN 'failed' END AS error",
        "event_type = 'purchase' AS is_correct", "CAST(round(value * 1000) AS BIGINT) AS latency_ms",
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/sink")

    sp.live_counters(rows).writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", f"{work}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{work}/sink")


@query("""
SELECT user_id AS job_id, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS VARCHAR) AS start, count(*) AS files,
  CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY ALL""")
def arrivals(t: Tables) -> DataFrame:
    """Files and bytes per job and quarter of an hour."""
    counted = sd.arrivals(t.view("files").withColumn("time_created", F.col("time_created").cast("timestamp")))
    start = F.col("window.start").cast("timestamp_ntz").cast("string")
    return counted.select("job_id", start.alias("start"), "files", "bytes")

"""Files: paths, checks, batches and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeflow.functions import paths as fp
from gradeflow.functions.keywords import keyword_labels as keywords_of
from gradeflow.operators import dedup, quality
from gradeflow.operators.batching import size_batches as batches_of
from gradeflow.plans.registry import query
from gradeflow.plans.tables import Tables, with_views

# Object paths out of page addresses, broken ones among them.
_OBJECT_PATHS = (
    "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'gs://' || split_part(url, '://', 2)"
    " WHEN 2 THEN 'gs:///' || split_part(url, '://', 2) WHEN 3 THEN 'gs://' || split_part(split_part(url, '://', 2), '/', 1)"
    " ELSE 'gs://bucket//' || split_part(url, '://', 2) END"
)


@query(f"""
WITH p AS (SELECT page_id, {_OBJECT_PATHS} AS path FROM pages),
s AS (SELECT *, substr(path, 6) AS rest FROM p),
b AS (SELECT *, CASE WHEN position('/' IN rest) > 0 THEN substr(rest, 1, position('/' IN rest) - 1) ELSE rest END AS head FROM s)
SELECT page_id, CASE WHEN path LIKE 'gs://%' AND head <> '' THEN head END AS bucket,
  CASE WHEN path LIKE 'gs://%' AND head <> '' THEN CASE WHEN position('/' IN rest) > 0 THEN ltrim(substr(rest, position('/' IN rest) + 1), '/') ELSE '' END END AS prefix,
  CASE WHEN path NOT LIKE 'gs://%' THEN 'GCS path must start with gs://. Got: ' || path
       WHEN head = '' THEN 'Invalid GCS path: ' || path || '. Bucket name is required.' END AS error
FROM b""")
def path_parse(t: Tables) -> DataFrame:
    """Bucket and prefix of object paths."""
    rows = t.given("pages").selectExpr("page_id", f"{_OBJECT_PATHS} AS path")
    return rows.select("page_id", fp.parse_object_path("path").alias("p")).select("page_id", "p.bucket", "p.prefix", "p.error")


@query("""
SELECT page_id, split_part(url, '/', -1) AS basename,
  CASE WHEN position('.' IN split_part(url, '/', -1)) > 0 THEN '.' || split_part(split_part(url, '/', -1), '.', -1) ELSE '' END AS extension,
  left(regexp_replace(url, '[^\\w\\s\\-.]', '_', 'g'), 200) AS sanitized,
  'projects/p/datasets/' || page_id || '/' || split_part(url, '/', -1) AS destination
FROM pages""")
def path_names(t: Tables) -> DataFrame:
    """File name, extension, safe name and target path."""
    return t.given("pages").select(
        "page_id", fp.basename("url").alias("basename"), fp.extension("url").alias("extension"),
        fp.sanitize_filename("url").alias("sanitized"),
        fp.destination_path(F.lit("p"), F.col("page_id").cast("string"), fp.basename("url")).alias("destination"),
    )


@query(
    with_views("images")
    + """SELECT image_id,
  CASE regexp_extract(lower(filename), '\\.[a-z]+$') WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS model_type,
  CASE regexp_extract(lower(filename), '\\.[a-z]+$') WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' WHEN '.bmp' THEN 'image/bmp' ELSE 'image/jpeg' END AS labelling_type,
  CASE regexp_extract(lower(filename), '\\.[a-z]+$') WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS serve_type
FROM images"""
)
def mime_types(t: Tables) -> DataFrame:
    """Content type by extension, in its three variants."""
    return t.view("images").select(
        "image_id", *[fp.mime_type("filename", v).alias(f"{v}_type") for v in ("model", "labelling", "serve")]
    )


@query(
    with_views("images")
    + "SELECT image_id, filename FROM images WHERE regexp_matches(lower(filename), '\\.(jpg|jpeg|png|gif|bmp|webp|tiff)$')"
)
def ext_allow_list(t: Tables) -> DataFrame:
    """Images a folder scan would take."""
    return t.view("images").filter(fp.is_scannable("filename")).select("image_id", "filename")


_UPLOADS = "CASE file_size % 3 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'image/png' ELSE NULL END AS content_type"


@query(
    with_views("images")
    + f"""SELECT image_id, filename || ': ' || CASE WHEN regexp_extract(filename, '\\.[^.]*$') = '' THEN 'No file extension'
    ELSE 'Invalid file extension ''' || regexp_extract(filename, '\\.[^.]*$') || '''' END || ' (allowed: .jpg, .jpeg, .png, .gif, .webp)' AS message
FROM (SELECT *, {_UPLOADS} FROM images) AS u
WHERE coalesce(content_type, '') <> 'image/png' AND NOT regexp_matches(filename, '\\.(jpg|jpeg|png|gif|webp|JPG|JPEG|PNG|GIF|WEBP)$')"""
)
def rejected_uploads(t: Tables) -> DataFrame:
    """Files refused as no images."""
    return quality.rejected_uploads(t.view("images").selectExpr("*", _UPLOADS)).select("image_id", "message")


@query(
    with_views("images")
    + """, large AS (SELECT dataset_id, image_id, filename || ' (' || printf('%.1f', ((20 * file_size + 1048576) // 2097152) / CAST(10 AS DOUBLE)) || 'MB)' AS name,
       row_number() OVER (PARTITION BY dataset_id ORDER BY image_id) AS place FROM images WHERE file_size > 2097152)
SELECT dataset_id, count(*) AS oversized, count(*) || ' file(s) exceed 2MB limit: ' || string_agg(name, ', ' ORDER BY place) FILTER (place <= 3)
  || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS message
FROM large GROUP BY dataset_id"""
)
def oversize_report(t: Tables) -> DataFrame:
    """Files over a size limit, per dataset."""
    return quality.oversize_reports(t.view("images"), order="image_id", limit=2 * 1024 * 1024)


@query(with_views("images") + "SELECT image_id, file_size FROM images WHERE file_size <= 10485760")
def within_size(t: Tables) -> DataFrame:
    """Files up to the upload limit."""
    return quality.within_size(t.view("images")).select("image_id", "file_size")


@query(
    with_views("images").replace("WITH images", "WITH RECURSIVE images", 1)
    + """, placed AS (SELECT project_id, image_id, file_size, row_number() OVER (PARTITION BY project_id ORDER BY image_id) AS place FROM images),
walk AS (
  SELECT project_id, image_id, place, file_size AS held, CAST(1 AS BIGINT) AS batch_no FROM placed WHERE place = 1
  UNION ALL
  SELECT p.project_id, p.image_id, p.place, CASE WHEN w.held + p.file_size > 26214400 THEN p.file_size ELSE w.held + p.file_size END,
         CASE WHEN w.held + p.file_size > 26214400 THEN w.batch_no + 1 ELSE w.batch_no END
  FROM walk AS w JOIN placed AS p ON p.project_id = w.project_id AND p.place = w.place + 1)
SELECT project_id, image_id, batch_no FROM walk"""
)
def size_batches(t: Tables) -> DataFrame:
    """Upload batches of at most 25 MB, in image order."""
    files = t.view("images").select("project_id", "image_id", "file_size")
    return batches_of(files, by="project_id", order=("image_id",), block=128).select("project_id", "image_id", "batch_no")


@query(with_views("copies") + "SELECT dataset_id, filename, count(*) AS copies FROM copies GROUP BY ALL HAVING count(*) > 1")
def dup_groups(t: Tables) -> DataFrame:
    """Groups of images with one name in one dataset."""
    return dedup.duplicate_groups(t.view("copies"))


_PLACED = ", placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, filename ORDER BY uploaded_at DESC, image_id) AS place FROM copies) "


@query(with_views("copies") + _PLACED + "SELECT dataset_id, filename, image_id FROM placed WHERE place > 1")
def dup_cleanup_plan(t: Tables) -> DataFrame:
    """Images a cleanup would delete."""
    return dedup.cleanup_plan(t.view("copies")).select("dataset_id", "filename", "image_id")


@query(with_views("copies") + _PLACED + "SELECT dataset_id, image_id FROM placed WHERE place = 1")
def dup_keep_latest(t: Tables) -> DataFrame:
    """Images that remain after a cleanup."""
    return dedup.after_cleanup(t.view("copies")).select("dataset_id", "image_id")


@query(
    with_views("copies")
    + """, here AS (SELECT * FROM copies WHERE uploaded_at < TIMESTAMP '2024-01-01 05:00:00'),
uploads AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, filename ORDER BY image_id) AS place
            FROM copies WHERE uploaded_at >= TIMESTAMP '2024-01-01 05:00:00')
SELECT image_id, CASE WHEN place > 1 OR EXISTS (SELECT 1 FROM here WHERE here.dataset_id = uploads.dataset_id AND here.filename = uploads.filename)
                      THEN 'Duplicate file (already exists in dataset)' END AS error FROM uploads"""
)
def upload_check(t: Tables) -> DataFrame:
    """Uploads whose name is taken."""
    cut = F.expr("TIMESTAMP_NTZ '2024-01-01 05:00:00'")
    copies = t.view("copies")
    checked = dedup.check_uploads(
        copies.filter(F.col("uploaded_at") >= cut), copies.filter(F.col("uploaded_at") < cut), F.col("image_id")
    )
    return checked.select("image_id", "error")


@query("""
SELECT doc_id, array_to_string(list_slice(list_filter(['person', 'people', 'car', 'building', 'tree', 'animal', 'dog', 'cat', 'food', 'nature',
  'urban', 'indoor', 'outdoor'], lambda w: contains(lower(text), w)), 1, 5), ',') AS labels FROM documents""")
def keyword_labels(t: Tables) -> DataFrame:
    """Keyword labels of whole texts."""
    return t.given("documents").select("doc_id", F.array_join(keywords_of("text"), ",").alias("labels"))

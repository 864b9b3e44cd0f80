"""The domain tables of this package as views over the given Parquet tables.

Every view is defined once, as SQL text that Spark and the checking engine both
read, so that queries and checks start from the same rows.  The operators are
never written in this text; they are what the checks are for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

# Model catalogue with prices in USD per million tokens.
MODELS = (
    ("openai-gpt-4o-mini", "openai", "gpt-4o-mini", "0.15", "0.60", "per_tile", None),
    ("anthropic-claude-3-5-sonnet", "anthropic", "claude-3-5-sonnet-20240620", "3.00", "15.00", "per_token", None),
    ("vertex-gemini-3-pro", "vertex", "gemini-3-pro-preview", "2.00", "12.00", "per_image", "0.0011"),
    ("vertex-gemini-2-5-pro", "vertex", "gemini-2.5-pro", "1.25", "10.00", "per_token", None),
    ("vertex-gemini-2-5-flash", "vertex", "gemini-2.5-flash", "0.30", "2.50", "per_token", None),
    ("vertex-gemini-2-5-flash-lite", "vertex", "gemini-2.5-flash-lite", "0.10", "0.40", "per_token", None),
)


def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


def _price(value: str | None) -> str:
    return f"CAST({'NULL' if value is None else repr(value)} AS DECIMAL(12,6))"


def _model_rows() -> list[str]:
    """Rows of the models view; every model gets a discount of its own, to exercise it."""
    return [
        f"(CAST({i} AS BIGINT), {_text(m[0])}, {_text(m[1])}, {_text(m[2])}, {_price(m[3])}, {_price(m[4])},"
        f" {_text(m[5])}, {_price(m[6])}, CAST({5 * i} AS DECIMAL(5,2)))"
        for i, m in enumerate(MODELS)
    ]


_MODEL_COLUMNS = "idx, model_id, provider, model_name, in_price, out_price, image_mode, image_val, discount"

_QUESTION_TYPE = (
    "CASE lang WHEN 'en' THEN 'binary' WHEN 'fr' THEN 'count' WHEN 'de' THEN 'multiple_choice' ELSE 'text' END"
)
_EXTENSION = (
    "CASE n_chars % 11 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png'"
    " WHEN 4 THEN '.gif' WHEN 5 THEN '.webp' WHEN 6 THEN '.bmp' WHEN 7 THEN '' WHEN 8 THEN '.Jpg'"
    " WHEN 9 THEN '.tiff' ELSE '.txt' END"
)
_HUNDREDS = "CAST(floor(n_chars / 100) AS BIGINT)"


def _minutes(engine: str, count: str, unit: str = "MINUTE", start: str = "2024-01-01 00:00:00") -> str:
    """A time ``count`` units after ``start``, without a time zone."""
    if engine == "duckdb":
        return f"(TIMESTAMP '{start}' + ({count}) * INTERVAL 1 {unit})"
    return f"timestampadd({unit}, CAST({count} AS INT), TIMESTAMP_NTZ '{start}')"


def view_sql(engine: str) -> dict[str, str]:
    """SQL of every view, in an order in which each uses only earlier ones."""
    at = lambda *args: _minutes(engine, *args)
    values = ", ".join(_model_rows())
    return {
        "models": f"SELECT * FROM (VALUES {values}) AS m({_MODEL_COLUMNS})",
        # Images: documents; project = language, dataset = language and source.
        "images": f"""
            SELECT doc_id AS image_id, lang AS project_id, lang || '/' || source AS dataset_id,
                   'img_' || CAST(doc_id AS STRING) || {_EXTENSION} AS filename, n_chars * 1000 AS file_size,
                   CASE WHEN n_chars < 300 THEN 'failed' WHEN n_chars < 600 THEN 'pending' ELSE 'completed' END
                     AS processing_status,
                   {at("doc_id")} AS uploaded_at, {_QUESTION_TYPE} AS question_type
            FROM documents""",
        # Images whose file name stands for their content, so that copies share it.
        "copies": f"""
            SELECT doc_id AS image_id, lang AS dataset_id, md5(text) || '.jpg' AS filename,
                   n_chars * 1000 AS file_size, {at("doc_id")} AS uploaded_at
            FROM documents""",
        "marks": """
            SELECT doc_id AS image_id, quality = 0 AND toxic = 1 AS is_skipped, toxic = 1 AS is_flagged
            FROM labels""",
        # Ground truth by question type; a skipped image has a row without a value.
        "truths": f"""
            SELECT image_id, question_type, is_skipped, is_flagged,
                   CASE WHEN question_type = 'binary' AND NOT is_skipped THEN quality = 1 END AS truth_bool,
                   CASE WHEN question_type = 'count' AND NOT is_skipped THEN hundreds END AS truth_count,
                   CASE WHEN is_skipped THEN NULL
                        WHEN question_type = 'multiple_choice' THEN CASE WHEN quality = 1 THEN 'Good' ELSE 'Bad' END
                        WHEN question_type = 'text' THEN CASE WHEN toxic = 1 THEN 'Unsafe' ELSE 'Safe' END
                   END AS truth_str
            FROM (SELECT labels.doc_id AS image_id, {_QUESTION_TYPE} AS question_type,
                         quality = 0 AND toxic = 1 AS is_skipped, toxic = 1 AS is_flagged,
                         quality, toxic, {_HUNDREDS} AS hundreds
                  FROM labels JOIN documents ON labels.doc_id = documents.doc_id) AS t""",
        # One answer per annotated image and model, by rule: right, wrong, unreadable or an error.
        "answers": f"""
            SELECT model_id || '@' || project_id AS evaluation_id, image_id, project_id, dataset_id, filename,
                   question_type, truth_bool, truth_count, truth_str, idx, provider, model_name, in_price, out_price,
                   image_mode, image_val, discount, h, n_chars,
                   CASE WHEN h < thr THEN
                     CASE h % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate limit: 429' ELSE 'server error: 503' END
                   END AS error,
                   CASE WHEN h < thr THEN NULL
                     WHEN question_type = 'binary' THEN
                       CASE WHEN h % 7 = 0 THEN 'I cannot tell' WHEN h % 7 = 1 THEN 'maybe'
                            WHEN (n_chars + idx) % 3 = 0 THEN 'No.' ELSE '  Yes, it is TRUE' END
                     WHEN question_type = 'count' THEN
                       CASE WHEN h % 9 = 0 THEN 'none visible'
                            ELSE 'About ' || CAST(hundreds + CASE WHEN h % 4 = 0 THEN 1 ELSE 0 END AS STRING)
                                 || '.5 items, maybe 7' END
                     WHEN question_type = 'multiple_choice' THEN
                       CASE h % 4 WHEN 0 THEN ' Good' WHEN 1 THEN 'good ' WHEN 2 THEN 'BAD' ELSE 'unsure' END
                     ELSE CASE h % 3 WHEN 0 THEN ' safe' WHEN 1 THEN 'Unsafe ' ELSE 'none' END
                   END AS model_response,
                   h >= thr OR h % 2 = 0 AS has_step1, h >= thr AS has_step2,
                   CAST(floor(n_chars / 4) AS BIGINT) + 50 AS prompt1, h % 5 + 5 AS completion1, 200 + h * 10 AS latency1,
                   h + 60 AS prompt2, h % 11 + 1 AS completion2, h + 100 AS latency2,
                   {at("image_id * 10 + idx", "SECOND", "2024-02-01 00:00:00")} AS completed_at,
                   h * 37 % 101 AS confidence
            FROM (SELECT truths.*, lang AS project_id, lang || '/' || source AS dataset_id,
                         'img_' || CAST(doc_id AS STRING) || {_EXTENSION} AS filename,
                         n_chars, {_HUNDREDS} AS hundreds, models.*,
                         (doc_id * 7 + idx * 13 + n_chars) % 100 AS h,
                         CASE WHEN idx = 5 THEN 60 ELSE 4 * idx + 2 END AS thr
                  FROM truths JOIN documents ON truths.image_id = documents.doc_id CROSS JOIN models) AS a""",
        # Answers at the size of the largest table: one per order line, runs by supplier.
        "line_answers": """
            SELECT 'supplier-' || CAST(l_suppkey AS STRING) AS evaluation_id,
                   l_orderkey * 8 + l_linenumber AS image_id,
                   CASE WHEN l_tax > 0.075 THEN 'timeout' END AS error,
                   CASE WHEN l_tax > 0.075 THEN NULL WHEN l_returnflag = 'R' THEN 'Yes.'
                        WHEN l_returnflag = 'A' THEN ' NO' ELSE 'unsure' END AS model_response,
                   l_linestatus = 'O' AS truth_bool,
                   CAST(l_quantity AS BIGINT) * 20 AS prompt1, CAST(l_quantity AS BIGINT) AS completion1,
                   l_suppkey % 6 AS idx
            FROM lineitem""",
        # Import rows: one per document, naming it by content.
        "import_rows": """
            SELECT doc_id + 2 AS row_no,
                   CASE WHEN n_chars % 13 = 0 THEN 'missing_' || CAST(doc_id AS STRING) || '.jpg'
                        ELSE '  ' || md5(text) || '.jpg ' END AS image_filename,
                   CASE n_chars % 8 WHEN 0 THEN 'yes' WHEN 1 THEN ' NO ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0'
                        WHEN 4 THEN 'maybe' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE '1.0' END AS annotation_value,
                   CASE WHEN n_chars % 17 = 0 THEN ' ' || lang || ' ' ELSE source END AS dataset_name
            FROM documents""",
        # Runs: orders; a dataset is a customer, a project a nation, a model a priority.
        "runs": """
            SELECT o_orderkey AS evaluation_id, c_nationkey AS project_id, o_custkey AS dataset_id,
                   o_orderpriority AS model_config_id, o_orderdate AS created_at,
                   CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
                   CASE WHEN o_orderkey % 9 = 0 THEN NULL
                        ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 1000 AS DECIMAL(18,9)) * CAST(0.001 AS DECIMAL(4,3))
                   END AS accuracy,
                   'order ' || CAST(o_orderkey AS STRING) AS activity
            FROM orders JOIN customer ON o_custkey = c_custkey""",
        "run_projects": "SELECT n_nationkey AS project_id, n_name AS name, n_regionkey AS created_by_id FROM nation",
        "run_datasets": "SELECT c_custkey AS dataset_id, c_name AS name, c_nationkey AS project_id FROM customer",
        "run_models": """
            SELECT DISTINCT o_orderpriority AS model_config_id, substr(o_orderpriority, 1, 1) AS provider,
                   substr(o_orderpriority, 3) AS model_name
            FROM orders""",
        # Found files: events; a job is a user, a folder an event type.  A path comes back now and then.
        "files": """
            SELECT event_id AS file_id, user_id AS job_id, ts AS time_created,
                   event_type || '/' || CAST(user_id AS STRING) || '/f' || CAST(event_id % 1500 AS STRING) ||
                   CASE event_id % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.tiff' WHEN 3 THEN '.txt'
                        WHEN 4 THEN '/' WHEN 5 THEN '.webp' ELSE '' END AS object_name,
                   CAST(round(value * 1000) AS BIGINT) AS size, event_type, value
            FROM events""",
    }


class Tables:
    """The given tables and the views over them, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _views(self) -> dict[str, str]:
        return view_sql("spark")

    def view(self, name: str) -> DataFrame:
        """A view; Spark prunes the columns and pushes the filters of what is made of it."""
        parts = {n: self.given(n) for n in _SOURCES[name]}
        views = {n: self.view(n) for n in _USES.get(name, ())}
        if name == "answers":
            return self._answers(parts["documents"], views["truths"])
        return self.spark.sql(_named(self._views[name], {**parts, **views}), **parts, **views)

    def per_model(self, df: DataFrame) -> DataFrame:
        """Every row once per model of the catalogue, multiplied in place."""
        rows = ", ".join(f"struct{row}" for row in _model_rows())
        names = [c.strip() for c in _MODEL_COLUMNS.split(",")]
        return df.selectExpr("*", f"inline(array({rows}))").toDF(*df.columns, *names)

    def _answers(self, documents: DataFrame, truths: DataFrame) -> DataFrame:
        """Every annotated image once per model."""
        spread = self.per_model(truths.join(documents, truths["image_id"] == documents["doc_id"]))
        inner = self._views["answers"]
        outer, _, _ = inner.partition("FROM (SELECT truths.*")
        added = spread.selectExpr(
            "*", "lang AS project_id", "lang || '/' || source AS dataset_id",
            f"'img_' || CAST(doc_id AS STRING) || {_EXTENSION} AS filename", f"{_HUNDREDS} AS hundreds",
            "(doc_id * 7 + idx * 13 + n_chars) % 100 AS h", "CASE WHEN idx = 5 THEN 60 ELSE 4 * idx + 2 END AS thr",
        )
        answers = self.spark.sql(outer + "FROM {added}", added=added)
        # Compute the long rules above once per row: Catalyst would otherwise copy
        # them into every expression and filter that reads these columns.
        return answers.select(F.inline(F.array(F.struct("*"))))


# Given tables and earlier views each view reads.
_SOURCES = {
    "models": (), "images": ("documents",), "copies": ("documents",), "marks": ("labels",),
    "truths": ("labels", "documents"), "answers": ("documents",), "line_answers": ("lineitem",),
    "import_rows": ("documents",), "runs": ("orders", "customer"), "run_projects": ("nation",),
    "run_datasets": ("customer",), "run_models": ("orders",), "files": ("events",),
}
_USES = {"answers": ("truths", "models")}


def _named(sql: str, frames: dict[str, DataFrame]) -> str:
    """Put ``{name}`` where the text reads a table called ``name``, and keep that name for columns."""
    for name in frames:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name} ", f"{word} {{{name}}} AS {name} ")
            sql = sql.replace(f"{word} {name}\n", f"{word} {{{name}}} AS {name}\n")
            if sql.endswith(f"{word} {name}"):
                sql = sql[: -len(name)] + f"{{{name}}} AS {name}"
            sql = sql.replace(f"{word} {name})", f"{word} {{{name}}} AS {name})")
    return sql


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views (and those they use) for the checking engine."""
    views, wanted = view_sql("duckdb"), []

    def need(name: str) -> None:
        for used in _USES.get(name, ()):
            need(used)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{name} AS ({views[name]})" for name in wanted) + "\n"

"""Projects, datasets, runs and model configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions.cost import text_tokens as tokens_of
from gradeflow.operators import catalog, scoring
from gradeflow.plans.registry import query
from gradeflow.plans.scoring_queries import PARSED_SQL, scored
from gradeflow.plans.tables import Tables, with_views
from gradeflow.schemas import PRICING
from gradeflow.session import new_work_path
from gradeflow.sources import catalogue as sc

_RUN_VIEWS = with_views("runs", "run_projects", "run_datasets", "run_models")
_LISTED = _RUN_VIEWS + """, listed AS (
  SELECT evaluation_id, p.name AS project_name, d.name AS dataset_name, m.provider || '/' || m.model_name AS model,
         status, accuracy, created_at, CASE WHEN status = 'running' THEN activity END AS activity, r.project_id
  FROM runs AS r JOIN run_projects AS p ON r.project_id = p.project_id JOIN run_datasets AS d ON r.dataset_id = d.dataset_id
  JOIN run_models AS m ON r.model_config_id = m.model_config_id)
"""


def _listed(t: Tables, project_id=None) -> DataFrame:
    return catalog.evaluation_list(
        t.view("runs"), t.view("run_projects"), t.view("run_datasets"), t.view("run_models"), project_id
    )


@query(_LISTED + "SELECT evaluation_id, project_name, dataset_name, model, status, activity FROM listed")
def eval_list(t: Tables) -> DataFrame:
    """Every run with project, dataset and model."""
    return _listed(t).select("evaluation_id", "project_name", "dataset_name", "model", "status", "activity")


@query(
    _LISTED + """SELECT evaluation_id, project_name, model, CAST(created_at AS VARCHAR) AS created_at FROM listed WHERE project_id = 3"""
)
def eval_list_newest(t: Tables) -> DataFrame:
    """All runs of one project, newest first."""
    newest = catalog.newest_first(_listed(t, project_id=3), "created_at", "evaluation_id")
    return newest.select("evaluation_id", "project_name", "model", F.col("created_at").cast("string").alias("created_at"))


@query(
    _LISTED + """, groups AS (SELECT project_name, dataset_name, count(*) AS evaluations, max(created_at) AS dataset_modified FROM listed GROUP BY ALL)
SELECT project_name, dataset_name, evaluations, CAST(dataset_modified AS VARCHAR) AS dataset_modified,
  CAST(max(dataset_modified) OVER (PARTITION BY project_name) AS VARCHAR) AS project_modified FROM groups"""
)
def eval_groups(t: Tables) -> DataFrame:
    """Runs per project and dataset, newest first."""
    groups = catalog.evaluation_groups(_listed(t))
    return groups.select(
        "project_name", "dataset_name", "evaluations", F.col("dataset_modified").cast("string").alias("dataset_modified"),
        F.col("project_modified").cast("string").alias("project_modified"),
    )


@query(
    _LISTED + """SELECT evaluation_id, project_name, dataset_name FROM listed WHERE (project_name, dataset_name) =
  (SELECT (project_name, dataset_name) FROM listed GROUP BY project_name, dataset_name ORDER BY max(created_at) DESC, project_name, dataset_name LIMIT 1)
ORDER BY created_at DESC, evaluation_id LIMIT 6"""
)
def latest_group(t: Tables) -> DataFrame:
    """The default comparison: newest runs of the newest dataset."""
    return catalog.latest_group_runs(_listed(t)).select("evaluation_id", "project_name", "dataset_name")


@query(
    with_views("answers") + PARSED_SQL
    + """, s AS (SELECT evaluation_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, count(error) AS failed,
    CASE WHEN 2 * count(error) > count(*) THEN 'failed' ELSE 'completed' END AS status,
    count(*) FILTER (is_correct IS NOT NULL AND truth_bool AND p_bool) AS tp, count(*) FILTER (is_correct IS NOT NULL AND NOT truth_bool AND p_bool) AS fp,
    CAST(sum(CASE WHEN has_step1 THEN prompt1 + completion1 ELSE 0 END + CASE WHEN has_step2 THEN prompt2 + completion2 ELSE 0 END) AS BIGINT) AS total_tokens
  FROM judged GROUP BY ALL)
SELECT r.evaluation_id, status, total, correct, failed, tp, fp, total_tokens, 'Is it so?' AS prompt, m.provider AS provider, m.model_name AS model_name,
  CASE WHEN m.provider IS NOT NULL THEN CAST(0.5 AS DOUBLE) END AS temperature
FROM (SELECT DISTINCT evaluation_id, split_part(evaluation_id, '@', 1) AS model_id FROM answers WHERE project_id = 'en') AS r
JOIN s USING (evaluation_id) LEFT JOIN (SELECT * FROM models WHERE provider <> 'openai') AS m USING (model_id)"""
)
def eval_compare(t: Tables) -> DataFrame:
    """Six runs of one project side by side; one has lost its model configuration."""
    runs = t.view("answers").select(
        "evaluation_id", F.substring_index("evaluation_id", "@", 1).alias("model_config_id"), "project_id"
    ).distinct().withColumn("prompt", F.lit("Is it so?"))
    models = t.view("models").filter(F.col("provider") != "openai").select(
        F.col("model_id").alias("model_config_id"), "provider", "model_name", F.lit(0.5).alias("temperature")
    )
    chosen = runs.filter(F.col("project_id") == "en").select("evaluation_id")
    compared = catalog.compare_runs(scored(t), runs, models, chosen, lambda rows: scoring.summarize(rows, usage="steps"))
    return compared.select(
        "evaluation_id", "status", "total", "correct", "failed", "tp", "fp", "total_tokens", "prompt", "provider",
        "model_name", "temperature",
    )


@query(
    _RUN_VIEWS + """SELECT (SELECT count(*) FROM run_projects) AS projects, (SELECT count(*) FROM run_datasets) AS datasets, count(*) AS evaluations,
  round(CAST(avg(CAST(accuracy AS DOUBLE)) FILTER (status = 'completed') * 100 AS DOUBLE), 1) AS avg_accuracy FROM runs"""
)
def dashboard(t: Tables) -> DataFrame:
    """The four numbers of the start page."""
    return catalog.dashboard(t.view("run_projects"), t.view("run_datasets"), t.view("runs"))


@query(
    _RUN_VIEWS + """SELECT d.dataset_id, d.name, count(r.evaluation_id) AS image_count FROM run_datasets AS d
LEFT JOIN runs AS r ON r.dataset_id = d.dataset_id GROUP BY d.dataset_id, d.name"""
)
def dataset_counts(t: Tables) -> DataFrame:
    """Rows per dataset, empty ones included."""
    return catalog.dataset_counts(t.view("run_datasets").select("dataset_id", "name"), t.view("runs"))


@query(
    _RUN_VIEWS + """SELECT p.project_id, p.name, r_name AS creator_name, count(d.dataset_id) AS dataset_count FROM run_projects AS p
LEFT JOIN run_datasets AS d ON d.project_id = p.project_id JOIN region ON r_regionkey = p.created_by_id GROUP BY ALL"""
)
def project_counts(t: Tables) -> DataFrame:
    """Datasets per project, with the project's creator."""
    users = t.given("region").selectExpr("r_regionkey AS user_id", "r_name AS name")
    counted = catalog.project_counts(t.view("run_projects"), t.view("run_datasets"))
    return catalog.projects_with_creator(counted, users).select("project_id", "name", "creator_name", "dataset_count")


# A model catalogue out of parts: brand and type name a model, some fields are absent.
_CATALOGUE = (
    "CASE WHEN p_size = 1 THEN NULL ELSE CAST(p_partkey % 1700 AS STRING) END AS id",
    "CASE p_size % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'gemini' WHEN 3 THEN 'vertex' ELSE 'elsewhere' END AS provider",
    "p_name AS model_name",
    "CASE WHEN p_size = 2 THEN NULL ELSE p_brand END AS display_name",
    "p_type AS description", "'endpoint' AS endpoint",
    "CASE WHEN p_size = 3 THEN NULL ELSE 'api_key' END AS auth_type",
    "CASE WHEN p_size = 4 THEN NULL ELSE 'token_based' END AS mode",
    "CAST(CASE WHEN p_size = 5 THEN NULL WHEN p_size = 6 THEN -1 ELSE p_size END AS DECIMAL(12,6)) AS in_price",
    "CAST(p_size AS DECIMAL(12,6)) AS out_price",
    "CASE WHEN p_size = 7 THEN NULL ELSE 'per_image' END AS image_mode",
    "p_size = 8 AS unpriced",
)


@query(
    "WITH m AS (SELECT " + ", ".join(_CATALOGUE) + """ FROM part), f AS (
  SELECT coalesce(id, '?') AS id, unnest(list_filter([
    CASE WHEN id IS NULL THEN 'missing field: id' END, CASE WHEN display_name IS NULL THEN 'missing field: display_name' END,
    CASE WHEN auth_type IS NULL THEN 'missing field: auth_type' END, CASE WHEN unpriced THEN 'missing field: pricing_config' END,
    CASE WHEN NOT unpriced AND mode IS NULL THEN 'missing pricing field: mode' END,
    CASE WHEN NOT unpriced AND in_price IS NULL THEN 'missing pricing field: input_price_per_1m' END,
    CASE WHEN NOT unpriced AND image_mode IS NULL THEN 'missing pricing field: image_price_mode' END,
    CASE WHEN NOT unpriced AND provider = 'elsewhere' THEN 'unknown provider' END,
    CASE WHEN NOT unpriced AND provider <> 'elsewhere' AND 55 * in_price + 36 * out_price < 0 THEN 'negative cost' END],
    lambda x: x IS NOT NULL)) AS fault FROM m)
SELECT * FROM f UNION ALL SELECT id, 'duplicate id' FROM m WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1"""
)
def catalogue_faults(t: Tables) -> DataFrame:
    """Faults of a model catalogue."""
    rows = t.given("part").selectExpr(*_CATALOGUE)
    pricing = F.struct(
        "mode", F.col("in_price").alias("input_price_per_1m"), F.col("out_price").alias("output_price_per_1m"),
        F.col("image_mode").alias("image_price_mode"), F.lit(None).cast("decimal(12,6)").alias("image_price_val"),
        F.lit(None).cast("decimal(5,2)").alias("discount_percent"),
    )
    return catalog.catalogue_faults(rows.withColumn("pricing_config", F.when(~F.col("unpriced"), pricing)))


def _pricing(price: str) -> Column:
    return F.struct(
        F.expr(price).alias("input_price_per_1m"), F.lit(None).alias("output_price_per_1m"),
        F.lit(None).alias("image_price_mode"), F.lit(None).alias("image_price_val"), F.lit(None).alias("discount_percent"),
    ).cast(PRICING)


def write_json_lists(t: Tables, items: DataFrame, key: str, order: str) -> str:
    """Items as JSON files, each a list in order; the items of a key are in one file."""
    path = new_work_path(t.spark, "lists")
    fields = [c for c in items.columns if c != order]
    lists = items.groupBy(F.pmod(F.xxhash64(key), F.lit(16)).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(order, *fields))).alias("items")
    )
    text = F.to_json(F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in fields])))
    lists.select("part", text.alias("value")).repartition(16, "part").write.partitionBy("part").text(path)
    return path


@query("""
WITH configs AS (SELECT 'c' || s_suppkey AS model_config_id, CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE 'me' END AS owner_id,
  'p' || (s_suppkey // 2 % 4) AS provider, 'm' || (s_suppkey // 2) AS model_name, s_name AS name, s_nationkey AS price, s_suppkey % 7 + 1 AS concurrency FROM supplier),
fresh AS (SELECT 'p' || (c_custkey // 3 % 4) AS provider, 'm' || (c_custkey // 3) AS model_name, arg_max(c_name, c_custkey) AS name,
  arg_max(c_nationkey + 100, c_custkey) AS price, arg_max(c_nationkey * 10 + 1, c_custkey) AS max_tokens FROM customer GROUP BY ALL),
meant AS (SELECT min(model_config_id) AS model_config_id, provider, model_name FROM configs WHERE owner_id = 'me' GROUP BY provider, model_name),
target AS (SELECT f.*, m.model_config_id FROM fresh AS f LEFT JOIN meant AS m USING (provider, model_name))
SELECT c.model_config_id, owner_id, c.provider, c.model_name, coalesce(t.name, c.name) AS name, CASE WHEN t.name IS NULL THEN 'old' ELSE 'api_key' END AS auth_type,
  CASE WHEN t.name IS NULL THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS temperature, CAST(coalesce(t.max_tokens, 7) AS BIGINT) AS max_tokens, 'secret' AS api_key,
  CAST(coalesce(t.price, c.price) AS DOUBLE) AS price, CAST(c.concurrency AS BIGINT) AS concurrency, CASE WHEN t.name IS NULL THEN 'unchanged' ELSE 'updated' END AS outcome
FROM configs AS c LEFT JOIN target AS t ON t.model_config_id = c.model_config_id
UNION ALL
SELECT 'new', 'me', provider, model_name, name, 'api_key', 0, 1024, 'sk-placeholder', CAST(price AS DOUBLE), 3, 'imported' FROM target WHERE model_config_id IS NULL""")
def catalogue_merge(t: Tables) -> DataFrame:
    """A catalogue file merged into the configurations of its owner; both name some models twice."""
    configs = t.given("supplier").select(
        F.expr("'c' || s_suppkey").alias("model_config_id"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE 'me' END").alias("owner_id"),
        F.expr("'p' || (s_suppkey div 2 % 4)").alias("provider"), F.expr("'m' || (s_suppkey div 2)").alias("model_name"),
        F.col("s_name").alias("name"), F.lit("old").alias("auth_type"), F.lit(0.5).alias("temperature"), F.lit(7).alias("max_tokens"),
        F.lit("secret").alias("api_key"), _pricing("s_nationkey").alias("pricing"), F.expr("s_suppkey % 7 + 1").alias("concurrency"), F.lit(True).alias("is_active"),
    )
    items = t.given("customer").select(
        "c_custkey", F.expr("'p' || (c_custkey div 3 % 4)").alias("provider"), F.expr("'m' || (c_custkey div 3)").alias("model_name"),
        F.col("c_name").alias("display_name"), F.expr("c_nationkey * 10 + 1").alias("max_tokens"),
        F.struct(F.expr("c_nationkey + 100").alias("input_price_per_1m")).alias("pricing_config"),
    )
    catalogue = sc.read_catalogue(t.spark, write_json_lists(t, items, "model_name", "c_custkey"))
    merged = catalog.merge_catalogue(configs, catalogue, "me")
    return merged.select(
        F.when(F.col("outcome") == "imported", "new").otherwise(F.col("model_config_id")).alias("model_config_id"),
        "owner_id", "provider", "model_name", "name", "auth_type", "temperature", F.col("max_tokens").cast("bigint").alias("max_tokens"), "api_key",
        F.col("pricing.input_price_per_1m").cast("double").alias("price"), F.col("concurrency").cast("bigint").alias("concurrency"), "outcome",
    )


@query("""
WITH configs AS (SELECT 'c' || s_suppkey AS id, s_name AS name, s_nationkey % 5 AS concurrency FROM supplier),
items AS (SELECT 'c' || (c_custkey // 2) AS id, c_custkey AS place, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS concurrency,
  CASE WHEN c_nationkey % 3 = 0 THEN 'key ' || c_custkey ELSE '' END AS api_key FROM customer WHERE c_mktsegment <> 'MACHINERY'),
given AS (SELECT id, arg_max(name, place) AS name, arg_max(concurrency, place) FILTER (concurrency IS NOT NULL) AS concurrency,
  arg_max(api_key, place) FILTER (api_key <> '') AS api_key FROM items GROUP BY id)
SELECT coalesce(g.name, c.name) AS name, CAST(coalesce(g.concurrency, c.concurrency) AS BIGINT) AS concurrency, coalesce(g.api_key, 'old key') AS api_key,
  CASE WHEN g.id IS NULL THEN 'unchanged' ELSE 'updated' END AS outcome FROM configs AS c LEFT JOIN given AS g USING (id)
UNION ALL
SELECT name, coalesce(concurrency, 3), CASE WHEN api_key = '' THEN 'sk-placeholder' ELSE api_key END, 'imported'
FROM items WHERE id NOT IN (SELECT id FROM configs)""")
def model_config_import(t: Tables) -> DataFrame:
    """Model configurations imported by id from a file that names some ids twice."""
    items = t.given("customer").selectExpr(
        "c_custkey", "'c' || (c_custkey div 2) AS id", "c_name AS name", "'p' AS provider",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'm' END AS model_name",
        "CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS concurrency",
        "CASE WHEN c_nationkey % 3 = 0 THEN 'key ' || c_custkey ELSE '' END AS api_key",
    )
    read = sc.read_model_configs(t.spark, write_json_lists(t, items, "id", "c_custkey"))
    configs = t.given("supplier").selectExpr(
        "'c' || s_suppkey AS model_config_id", "s_name AS name", "'p' AS provider", "'m' AS model_name",
        "CAST(s_nationkey % 5 AS INT) AS concurrency", "'old key' AS api_key",
    )
    return catalog.import_model_configs(configs, read).select(
        "name", F.col("concurrency").cast("bigint").alias("concurrency"), "api_key", "outcome"
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 6 = 5 THEN 'Invalid question_type. Must be one of: [''binary'', ''multiple_choice'', ''text'', ''count'']'
       WHEN p_size % 6 = 4 OR (p_size % 6 = 1 AND p_size % 4 = 1) THEN 'question_options required for multiple_choice type' END AS fault
FROM part""")
def project_faults(t: Tables) -> DataFrame:
    """Projects that could not be created."""
    qtype = F.expr(
        "CASE p_size % 6 WHEN 0 THEN 'binary' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'text' WHEN 3 THEN 'count'"
        " WHEN 4 THEN 'multiple_choice' ELSE 'ranking' END"
    )
    options = F.expr(
        "CASE WHEN p_size % 6 = 1 AND p_size % 4 <> 1 THEN array(p_brand, p_type) WHEN p_size % 6 = 4 THEN array() END"
    ).cast("array<string>")
    return t.given("part").select("p_partkey", catalog.project_fault(qtype, options).alias("fault"))


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def text_tokens(t: Tables) -> DataFrame:
    """Estimated tokens of whole texts."""
    return t.given("documents").select("doc_id", tokens_of("text").alias("tokens"))

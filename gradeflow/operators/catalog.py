"""Projects, datasets, runs and model configurations as dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeflow.functions.cost import PROVIDERS, estimate_cost
from gradeflow.functions.text import as_col, half_up_ratio
from gradeflow.operators.joins import first_by
from gradeflow.schemas import QUESTION_TYPES

MAX_COMPARED = 6
# Fields a model of the catalogue must have.
REQUIRED_MODEL_FIELDS = (
    "id", "provider", "model_name", "display_name", "description", "endpoint", "auth_type", "pricing_config",
)
REQUIRED_PRICING_FIELDS = ("mode", "input_price_per_1m", "output_price_per_1m", "image_price_mode")
# Defaults of a new model configuration.
DEFAULT_TEMPERATURE, DEFAULT_MAX_TOKENS, DEFAULT_CONCURRENCY = 0.0, 1024, 3


def evaluation_list(
    evaluations: DataFrame, projects: DataFrame, datasets: DataFrame, models: DataFrame, project_id=None
) -> DataFrame:
    """Runs with project, dataset and model label; activity is shown for running runs only.

    The joins are on unique dimension keys; small dimensions are broadcast by
    their size, and of large ones adaptive execution splits a hot key.
    """
    if project_id is not None:
        evaluations = evaluations.filter(F.col("project_id") == project_id)
    named_datasets = datasets.select("dataset_id", F.col("name").alias("dataset_name"))
    named_projects = projects.select("project_id", F.col("name").alias("project_name"))
    label = F.concat_ws("/", "provider", "model_name")
    listed = evaluations.join(named_datasets, "dataset_id").join(named_projects, "project_id").join(
        models.select("model_config_id", label.alias("model")), "model_config_id"
    )
    if "activity" in evaluations.columns:
        listed = listed.withColumn("activity", F.when(F.col("status") == "running", F.col("activity")))
    return listed


def newest_first(df: DataFrame, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(tie))


def evaluation_groups(listed: DataFrame) -> DataFrame:
    """Runs per project and dataset with the time of the newest run at both levels, newest first.

    The project level is an aggregate of its own, combined partially like the
    other, and the listing is a distributed sort: no task holds a project.
    """
    pairs = listed.groupBy("project_name", "dataset_name").agg(
        F.count("*").cast("bigint").alias("evaluations"), F.max("created_at").alias("dataset_modified")
    )
    whole = pairs.groupBy("project_name").agg(F.max("dataset_modified").alias("project_modified"))
    return pairs.join(whole, "project_name").orderBy(
        F.col("project_modified").desc(), "project_name", F.col("dataset_modified").desc(), "dataset_name"
    )


def latest_group_runs(listed: DataFrame, limit: int = MAX_COMPARED) -> DataFrame:
    """The newest runs of the newest dataset of the newest project: the default comparison."""
    newest = listed.groupBy("project_name", "dataset_name").agg(F.max("created_at").alias("_modified"))
    order = [F.col("_modified").desc(), F.col("project_name"), F.col("dataset_name")]
    first = newest.orderBy(*order).limit(1).select("project_name", "dataset_name")
    runs = listed.join(F.broadcast(first), ["project_name", "dataset_name"], "left_semi")  # one row
    return runs.orderBy(F.col("created_at").desc(), F.col("evaluation_id")).limit(limit)


def chosen_runs(evaluations: DataFrame, chosen: DataFrame) -> list:
    """Ids of the runs to compare; ValueError for other than two to six runs of one project.

    At most one id more than may be compared is read, which settles the case.
    """
    picked = evaluations.join(chosen.select("evaluation_id"), "evaluation_id", "left_semi").select("evaluation_id", "project_id").distinct()
    rows = picked.limit(MAX_COMPARED + 1).collect()
    problem = comparison_error(len(rows), len({r["project_id"] for r in rows}))
    if problem:
        raise ValueError(problem)
    return sorted(r["evaluation_id"] for r in rows)


def compare_runs(results: DataFrame, evaluations: DataFrame, models: DataFrame, chosen: DataFrame, summarize) -> DataFrame:
    """Two to six chosen runs side by side; a run whose model is gone keeps its row.

    Only results of the chosen runs are given to ``summarize``.
    """
    ids = chosen_runs(evaluations, chosen)
    picked = evaluations.filter(F.col("evaluation_id").isin(ids))
    summaries = summarize(results.filter(F.col("evaluation_id").isin(ids)))
    return picked.join(summaries, "evaluation_id", "left").join(models, "model_config_id", "left")


def comparison_error(count: int, projects: int) -> str | None:
    """Why a set of runs cannot be compared, or None."""
    if not 2 <= count <= MAX_COMPARED:
        return f"choose 2 to {MAX_COMPARED} evaluations"
    return None if projects == 1 else "choose evaluations of one project"


def dashboard(projects: DataFrame, datasets: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row: projects, datasets, evaluations, mean accuracy of completed runs in percent."""
    done = (F.col("status") == "completed") & F.col("accuracy").isNotNull()
    numbers = evaluations.agg(
        F.count("*").cast("bigint").alias("evaluations"),
        F.sum(F.when(done, F.col("accuracy").cast("decimal(18,9)"))).alias("_sum"),
        F.count_if(done).cast("bigint").alias("_done"),
    )
    scaled = (F.col("_sum") * F.lit(10**9).cast("decimal(10,0)")).cast("bigint")
    mean = half_up_ratio(scaled, F.col("_done"), scale=0) / F.lit(1e7)
    rows = (
        projects.agg(F.count("*").cast("bigint").alias("projects"))
        .unionByName(datasets.agg(F.count("*").cast("bigint").alias("datasets")), allowMissingColumns=True)
        .unionByName(
            numbers.select("evaluations", F.round(F.coalesce(mean, F.lit(0.0)), 1).alias("avg_accuracy")),
            allowMissingColumns=True,
        )
    )
    return rows.agg(*[F.max(c).alias(c) for c in ("projects", "datasets", "evaluations", "avg_accuracy")])


def dataset_counts(datasets: DataFrame, images: DataFrame) -> DataFrame:
    """Images per dataset, 0 for an empty one."""
    counts = images.groupBy("dataset_id").agg(F.count("*").cast("bigint").alias("image_count"))
    return datasets.join(counts, "dataset_id", "left").fillna(0, ["image_count"])


def project_counts(projects: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets per project, 0 for an empty one."""
    counts = datasets.groupBy("project_id").agg(F.count("*").cast("bigint").alias("dataset_count"))
    return projects.join(counts, "project_id", "left").fillna(0, ["dataset_count"])


def projects_with_creator(projects: DataFrame, users: DataFrame) -> DataFrame:
    creators = users.select(F.col("user_id").alias("created_by_id"), F.col("name").alias("creator_name"))
    return projects.join(creators, "created_by_id")


def last_of(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One item per key: the last by ``position`` where items have one, else the greatest by its fields."""
    fields = [c for c in items.columns if c not in keys]
    order = F.col("position") if "position" in fields else F.to_json(F.struct(*fields))
    last = items.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_last"))
    return last.select(*keys, "_last.*").select(*items.columns)


def merge_catalogue(configs: DataFrame, catalogue: DataFrame, owner: str) -> DataFrame:
    """Take up a model catalogue for one owner.

    A configuration of the owner with the same (provider, model_name) gets the
    new name, access, temperature and token limit, and the new prices if there
    are any; it keeps its id, key, concurrency and active mark.  Of several such
    configurations the one with the lowest id is meant, of several catalogue rows
    the last counts.  Other models are added under an id derived from the key.
    """
    keys = ["owner_id", "provider", "model_name"]
    defaults = {"temperature": F.lit(DEFAULT_TEMPERATURE), "max_tokens": F.lit(DEFAULT_MAX_TOKENS)}
    given = {c: F.coalesce(c, v) if c in catalogue.columns else v for c, v in defaults.items()}
    fresh = last_of(catalogue, keys[1:]).select(
        F.lit(owner).alias("owner_id"),
        *keys[1:],
        F.coalesce("display_name", "model_name").alias("_name"),
        F.coalesce("auth_type", F.lit("api_key")).alias("_auth_type"),
        F.col("pricing").alias("_pricing"),
        *[v.alias(f"_{c}") for c, v in given.items()],
        F.lit(True).alias("_listed"),
    )
    meant = configs.filter(F.col("owner_id") == owner).groupBy(*keys).agg(F.min("model_config_id").alias("model_config_id"))
    target = fresh.join(meant, keys, "left")
    updates = target.filter(F.col("model_config_id").isNotNull()).drop(*keys)
    replaced = ("name", "auth_type", *defaults)
    kept = configs.join(updates, "model_config_id", "left")
    columns = ["model_config_id", *keys, *replaced, "api_key", "pricing", "concurrency", "is_active"]
    old = kept.select(
        "model_config_id", *keys,
        *[F.when(F.col("_listed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in replaced],
        "api_key", F.coalesce("_pricing", "pricing").alias("pricing"), "concurrency", "is_active",
        F.when(F.col("_listed"), "updated").otherwise("unchanged").alias("outcome"),
    )
    added = target.filter(F.col("model_config_id").isNull()).select(
        F.md5(F.to_json(F.struct(*keys))).alias("model_config_id"), *keys, F.col("_name").alias("name"), F.col("_auth_type").alias("auth_type"),
        # New rows start from the defaults; only an update takes the listed numbers.
        *[v.alias(c) for c, v in defaults.items()],
        F.lit("sk-placeholder").alias("api_key"), F.col("_pricing").alias("pricing"),
        F.lit(DEFAULT_CONCURRENCY).alias("concurrency"), F.lit(True).alias("is_active"), F.lit("imported").alias("outcome"),
    )
    return old.unionByName(added).select(*columns, "outcome")


def import_model_configs(configs: DataFrame, items: DataFrame) -> DataFrame:
    """Import model configurations by id.

    Items without name, provider or model_name are passed over.  A known id is
    updated field by field, by its items in turn: the last one that holds a field
    wins.  Anything else is added under a new id, a digest of the item and its
    ``position`` where items have one.
    """
    fields = [c for c in configs.columns if c not in ("model_config_id", "api_key")]
    needed = F.col("name").isNotNull() & F.col("provider").isNotNull() & F.col("model_name").isNotNull()
    usable = items.filter(needed)
    known = usable.join(configs.select("model_config_id"), "model_config_id", "left_semi")
    new = usable.join(configs.select("model_config_id"), "model_config_id", "left_anti")
    place = F.col("position") if "position" in items.columns else F.to_json(F.struct(*fields))
    given = [F.when(F.col("api_key") != "", F.col("api_key")).alias("api_key") if c == "api_key" else F.col(c) for c in [*fields, "api_key"]]
    updates = known.select("model_config_id", place.alias("_place"), *given).groupBy("model_config_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(f"_{c}") for c in [*fields, "api_key"]]
    )
    updated = configs.join(updates.withColumn("_hit", F.lit(True)), "model_config_id", "left").select(
        "model_config_id",
        *[F.coalesce(f"_{c}", c).alias(c) for c in [*fields, "api_key"]],
        F.when(F.col("_hit"), "updated").otherwise("unchanged").alias("outcome"),
    )
    defaults = {
        "auth_type": F.lit("api_key"), "temperature": F.lit(DEFAULT_TEMPERATURE),
        "max_tokens": F.lit(DEFAULT_MAX_TOKENS), "concurrency": F.lit(DEFAULT_CONCURRENCY), "is_active": F.lit(True),
    }
    digest = F.md5(F.to_json(F.struct("model_config_id", *[c for c in items.columns if c == "position"], *fields)))
    added = new.select(
        digest.alias("model_config_id"),
        *[(F.coalesce(F.col(c), defaults[c]) if c in defaults else F.col(c)).alias(c) for c in fields],
        F.coalesce(F.when(F.col("api_key") != "", F.col("api_key")), F.lit("sk-placeholder")).alias("api_key"),
        F.lit("imported").alias("outcome"),
    )
    return updated.unionByName(added)


def import_counts(imported: DataFrame) -> DataFrame:
    return imported.agg(
        F.count_if(F.col("outcome") == "imported").cast("bigint").alias("imported_count"),
        F.count_if(F.col("outcome") == "updated").cast("bigint").alias("updated_count"),
    )


def catalogue_faults(catalogue: DataFrame) -> DataFrame:
    """One row per fault of a model catalogue.

    Absent fields, ids used twice, absent pricing fields, unknown providers and
    models whose text cost comes out negative.  ``catalogue`` holds the required
    fields as columns, NULL where absent, with pricing_config as a struct.
    """
    item = F.coalesce(F.col("id"), F.lit("?"))
    pricing = F.col("pricing_config")
    faults = [F.when(F.col(c).isNull(), F.lit(f"missing field: {c}")) for c in REQUIRED_MODEL_FIELDS]
    faults += [
        F.when(pricing.isNotNull() & pricing[c].isNull(), F.lit(f"missing pricing field: {c}"))
        for c in REQUIRED_PRICING_FIELDS
    ]
    zero = F.lit(0).cast("bigint")
    # The two fixed sample texts have 220 and 145 characters.
    cost = estimate_cost(
        F.col("provider"), F.lit(55).cast("bigint"), F.lit(36).cast("bigint"), zero, zero, pricing
    )
    unknown = F.col("provider").isNotNull() & ~F.col("provider").isin(*PROVIDERS)
    faults += [
        F.when(pricing.isNotNull() & unknown, F.lit("unknown provider")),
        F.when(cost < 0, F.lit("negative cost")),
    ]
    each = catalogue.select(item.alias("id"), F.explode(F.array_compact(F.array(*faults))).alias("fault"))
    twice = (
        catalogue.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > 1).select("id", F.lit("duplicate id").alias("fault"))
    )
    return each.unionByName(twice)


def project_fault(question_type: Column | str, options: Column | str) -> Column:
    """Why a project is not valid, or NULL."""
    qtype, options = as_col(question_type), as_col(options)
    names = ", ".join(f"'{name}'" for name in QUESTION_TYPES)
    return F.when(
        qtype.isNull() | ~qtype.isin(*QUESTION_TYPES), F.lit(f"Invalid question_type. Must be one of: [{names}]")
    ).when(
        (qtype == "multiple_choice") & (options.isNull() | (F.size(options) == 0)),
        F.lit("question_options required for multiple_choice type"),
    )


def latest_result_per_job(jobs: DataFrame, results: DataFrame, time: str, tie: str) -> DataFrame:
    """Jobs with their latest result, NULL where there is none."""
    return jobs.join(first_by(results, ["job_id"], [F.col(time).desc(), F.col(tie).desc()]), "job_id", "left")

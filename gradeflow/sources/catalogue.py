"""Model catalogues and model configurations as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CATALOGUE = (
    "id string, provider string, model_name string, display_name string, description string, endpoint string,"
    " auth_type string, temperature double, max_tokens int, pricing_config struct<mode: string, input_price_per_1m: decimal(12,6),"
    " output_price_per_1m: decimal(12,6), image_price_mode: string, image_price_val: decimal(12,6),"
    " image_token_calc: string, discount_percent: decimal(5,2)>, _corrupt_record string"
)
CONFIGS = (
    "id string, name string, provider string, model_name string, api_key string, auth_type string,"
    " temperature double, max_tokens int, concurrency int, pricing_config struct<input_price_per_1m: decimal(12,6),"
    " output_price_per_1m: decimal(12,6), image_price_mode: string, image_price_val: decimal(12,6),"
    " discount_percent: decimal(5,2)>, is_active boolean, _corrupt_record string"
)


class CatalogueFormatError(ValueError):
    """A file that is no JSON list of objects."""


def _read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON lists with their ``position``; a file with another root, or a broken one, is rejected whole."""
    first = F.substring(F.ltrim("value", F.lit(" \t\r\n\ufeff")), 1, 1)
    if not spark.read.text(path, wholetext=True).filter(first != "[").isEmpty():
        raise CatalogueFormatError("JSON root must be a list of model objects")
    items = spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    broken = items.select("id", "_corrupt_record").filter(F.col("_corrupt_record").isNotNull()).first()
    if broken:
        raise CatalogueFormatError(f"Invalid JSON: {broken['_corrupt_record'][:200]}")
    return items.drop("_corrupt_record").withColumn("position", F.monotonically_increasing_id())


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Models of a catalogue file, a JSON list of objects; absent fields are NULL.

    ``position`` is the place in the list.  A catalogue is a small file and is
    read as one; a broken one, or one that is no list, raises CatalogueFormatError.
    """
    return _read_list(spark, path, CATALOGUE).withColumn("pricing", F.struct(*[
        F.col(f"pricing_config.{c}").alias(c)
        for c in ("input_price_per_1m", "output_price_per_1m", "image_price_mode", "image_price_val", "discount_percent")
    ]))


def read_model_configs(spark: SparkSession, path: str) -> DataFrame:
    """Items of a configuration export, ready for the import, with their ``position``; broken files raise CatalogueFormatError."""
    return _read_list(spark, path, CONFIGS).withColumnsRenamed({"id": "model_config_id", "pricing_config": "pricing"})


def write_model_configs(configs: DataFrame, path: str) -> None:
    """Configurations as JSON, keys left out."""
    configs.drop("api_key").write.mode("overwrite").json(path)

"""Annotation CSV files: import rows with row numbers, exports, error reports."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gradeflow.operators.annotations import REQUIRED_COLUMNS, missing_columns_error
from gradeflow.sources.csv_records import read_records

# Texts that mean "no value" in an annotation file.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FIRST_ROW = 2  # the header is row 1
IMPORT_COLUMNS = ("image_filename", "annotation_value", "dataset_name")


class ImportFormatError(ValueError):
    """An import file without its required columns."""


def _names(header: str) -> list[str]:
    return next(csv.reader([header.lstrip("\ufeff")], strict=False), [])


def read_import_rows(
    spark: SparkSession, path: str, multi_line: bool = True, encoding: str = "UTF-8"
) -> DataFrame:
    """Import rows with their file and row number in it; further columns are left out.

    Columns go by the names in each file's own header, so files may order them
    differently; a file without the required ones raises ImportFormatError.
    Files are read in parallel splits, line breaks inside quotes included, in
    the header too (see :func:`~gradeflow.sources.csv_records.read_records`).
    """
    records, splits = read_records(spark, path, multi_line, encoding)
    kinds = [_names(r["first"]) for r in splits.filter(F.col("first").isNotNull()).select("first").distinct().collect()]
    for names in kinds:
        problem = missing_columns_error(names)
        if problem:
            raise ImportFormatError(problem)
    width = max(map(len, kinds), default=len(REQUIRED_COLUMNS))
    kept = [c for c in IMPORT_COLUMNS if c in REQUIRED_COLUMNS or any(c in names for names in kinds)]
    schema = ", ".join(f"_{i} string" for i in range(width))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    parsed = lambda c: F.from_csv(F.col(c), schema, options)
    fields = lambda c: F.array(*(F.col(c)[f"_{i}"] for i in range(width)))
    rows = records.filter(F.col("record") >= FIRST_ROW).withColumn("_own", parsed("value")).withColumn("_head", parsed("first"))
    rows = rows.select("file", F.col("record").alias("row_no"), fields("_own").alias("_fields"), fields("_head").alias("_header"))

    def named(name: str) -> Column:
        value = F.try_element_at("_fields", F.nullif(F.array_position("_header", name), F.lit(0)).cast("int"))
        return F.when(~value.isin(*NA_STRINGS), value).alias(name)

    return rows.select("file", "row_no", *[named(c) for c in kept])


def count_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Records of the files, headers excluded, as one row; line breaks inside quotes do not count."""
    _, splits = read_records(spark, path, multi_line)
    per_file = splits.groupBy("file").agg(F.sum("records").alias("n"))
    return per_file.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("bigint").alias("rows"))


# Spark's CSV writer would otherwise strip values.
_WHOLE = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_export(export: DataFrame, path: str) -> None:
    """Annotation export as CSV; files carry no byte order mark."""
    export.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", **_WHOLE)


def write_error_report(errors: DataFrame, path: str) -> None:
    """Error report: Row, Error (numbers within their file), with every error quoted and quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace("error", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = errors.select(F.concat_ws(",", F.col("row_no").cast("string"), quoted).alias("Row,Error"))
    lines.write.mode("overwrite").csv(path, **{**_WHOLE, "header": True, "quote": "", "sep": "\x01"})


def write_results(results: DataFrame, path: str, fmt: str = "csv") -> None:
    """Results export as CSV (nested columns as JSON) or JSON lines."""
    if fmt == "json":
        results.write.mode("overwrite").json(path)
        return
    nested = {f.name for f in results.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    flat = results.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in results.columns])
    flat.write.mode("overwrite").csv(path, header=True, **_WHOLE)

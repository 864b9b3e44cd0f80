"""Folder listings and stored image bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gradeflow.functions.paths import basename, mime_type

# The listing needs paths, sizes and times only; the bytes are never read for it.
LISTING = ("path", "modificationTime", "length")


def list_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of a folder, one row each; only the listing is used, contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.col("path")
    return files.select(
        path.alias("full_path"),
        path.alias("object_name"),
        basename(path).alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("time_created"),
        mime_type(path, "serve").alias("content_type"),
    )


def read_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of stored images, to be joined to images by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content")


def with_bytes(images: DataFrame, stored: DataFrame) -> DataFrame:
    """Images with their content, joined by storage path; absent files give NULL.

    Paths are unique on both sides, so the bytes are shuffled evenly, once.
    """
    return images.join(stored.withColumnRenamed("path", "storage_path"), "storage_path", "left")


def stream_folder(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """Arriving files as a stream of listing rows."""
    schema = T.StructType.fromDDL("path string, modificationTime timestamp, length bigint, content binary")
    files = (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).load(folder)
    )
    return files.select(
        F.col("path").alias("full_path"),
        F.col("path").alias("object_name"),
        basename("path").alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("time_created"),
    )

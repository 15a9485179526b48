"""Uploaded files: manifest, listing, metadata and storage keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.status import MAX_FILE_SIZE, MAX_PAGES

MIME_TYPES = {"pdf": "application/pdf"}


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def _mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))),
                      F.lit("application/octet-stream"))


def file_metadata(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, name, size, updated_at, mime_type; the content is never read."""
    return _files(spark, path, pattern).select(
        "path", F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("updated_at"), _mime(F.col("path")).alias("mime_type"),
    )


def user_files(spark: SparkSession, root: str, user_id: str, limit: int = 100) -> DataFrame:
    """Newest files in the folder of one user."""
    return file_metadata(spark, f"{root.rstrip('/')}/{user_id}").orderBy(F.desc("updated_at"), "path").limit(limit)


def file_manifest(spark: SparkSession, path: str, max_size: int = MAX_FILE_SIZE, pattern: str | None = None) -> DataFrame:
    """path, size, sha256 and checks. Files over the limit are listed but their content stays unread."""
    files = _files(spark, path, pattern)
    small = files.filter(F.col("length") <= max_size).select("path", "length", F.sha2("content", 256).alias("file_hash"))
    large = files.filter(F.col("length") > max_size).select("path", "length", F.lit(None).cast("string").alias("file_hash"))
    return small.unionByName(large).select(
        "path", F.col("length").alias("size"), "file_hash", (F.col("length") > max_size).alias("too_large"),
        (_mime(F.col("path")) == "application/pdf").alias("type_allowed"),
    )


def text_manifest(documents: DataFrame, max_size: int = MAX_FILE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """The same checks for documents held as text (document_id, text, total_pages)."""
    size = F.octet_length("text")
    return documents.select(
        "document_id", size.alias("size"), F.sha2("text", 256).alias("file_hash"),
        (size > max_size).alias("too_large"), (F.col("total_pages") > max_pages).alias("too_many_pages"),
    )


def storage_key(user_id: Column, stored_at_ms: Column, content: Column, filename: Column) -> Column:
    """`user/time_md5_name`, every unusual character of the name replaced."""
    name = F.regexp_replace(filename, "[^a-zA-Z0-9.-]", "_")
    return F.concat(user_id, F.lit("/"), F.concat_ws("_", stored_at_ms.cast("string"), F.md5(content), name))

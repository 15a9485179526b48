"""Reports on stored chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.scans import previous_in_order


def index_steps(chunks: DataFrame) -> DataFrame:
    """Chunks of each document with the index and page before them."""
    return previous_in_order(chunks, "document_id", "chunk_index", ["page_number"])


def index_gaps(chunks: DataFrame) -> DataFrame:
    """Neighbouring indexes that differ by anything but one."""
    steps = index_steps(chunks.select("document_id", "chunk_index", "page_number"))
    return steps.filter(F.col("chunk_index") != F.col("prev_chunk_index") + 1).select(
        "document_id", F.col("prev_chunk_index").alias("from_index"), F.col("chunk_index").alias("to_index")
    )


def backward_pages(chunks: DataFrame) -> DataFrame:
    steps = index_steps(chunks.select("document_id", "chunk_index", "page_number"))
    return steps.filter(F.col("page_number") < F.col("prev_page_number")).select(
        "document_id", "chunk_index", "prev_page_number", "page_number"
    )


def chunk_validation(chunks: DataFrame) -> DataFrame:
    """Per document: empty chunks, gaps, backward pages, token range, chunks a page, verdict."""
    steps = index_steps(chunks.select("document_id", "chunk_index", "page_number", "chunk_tokens",
                                      tx.is_blank(F.col("chunk_text")).alias("_blank")))
    pages = chunks.groupBy("document_id", "page_number").agg(F.count("*").alias("_n"))
    per_page = pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.max("_n").alias("max_chunks_per_page"))
    report = steps.groupBy("document_id").agg(
        F.count_if("_blank").alias("empty_chunks"),
        F.count_if(F.col("chunk_index") != F.col("prev_chunk_index") + 1).alias("index_gaps"),
        F.count_if(F.col("page_number") < F.col("prev_page_number")).alias("backward_pages"),
        F.min("chunk_tokens").alias("min_tokens"), F.round(F.avg("chunk_tokens"), 6).alias("avg_tokens"),
        F.max("chunk_tokens").alias("max_tokens"),
    )
    issues = F.col("empty_chunks") + F.col("index_gaps") + F.col("backward_pages")
    return report.join(per_page, "document_id").withColumn("valid", issues == 0)


def storage_issues(chunks: DataFrame) -> DataFrame:
    """One row an issue: document_id, issue, detail, rows."""
    missing = (
        chunks.filter(F.col("embedding").isNull() | (F.size("embedding") <= 0))
        .groupBy("document_id").agg(F.count("*").alias("rows"))
        .select("document_id", F.lit("missing embeddings").alias("issue"), F.lit("").alias("detail"), "rows")
    )
    indexes = chunks.groupBy("document_id", "chunk_index").agg(F.count("*").alias("rows"))
    gaps = index_gaps(indexes.withColumn("page_number", F.lit(0))).select(
        "document_id", F.lit("index gap").alias("issue"),
        F.concat_ws("-", "from_index", "to_index").alias("detail"), F.lit(1).cast("bigint").alias("rows"),
    )
    repeats = indexes.filter(F.col("rows") > 1).select(
        "document_id", F.lit("duplicate index").alias("issue"), F.col("chunk_index").cast("string").alias("detail"), "rows"
    )
    sizes = (
        chunks.filter(F.size("embedding") > 0)
        .groupBy("document_id", F.size("embedding").alias("_dim")).agg(F.count("*").alias("_n"))
        .groupBy("document_id").agg(F.array_sort(F.collect_list("_dim")).alias("_dims"), F.sum("_n").alias("rows"))
        .filter(F.size("_dims") > 1)
        .select("document_id", F.lit("mixed dimensions").alias("issue"), F.array_join("_dims", ", ").alias("detail"), "rows")
    )
    return missing.unionByName(gaps).unionByName(repeats).unionByName(sizes)


def embedding_profile(chunks: DataFrame) -> DataFrame:
    """Per chunk: dimension, non-zero values, range, and whether it looks like a real embedding."""
    size = F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0))
    filled = F.coalesce(F.size(F.filter("embedding", lambda v: v != 0)), F.lit(0))
    return chunks.select(
        "chunk_id", size.alias("dim"), filled.alias("non_zero"),
        F.array_min("embedding").alias("min_value"), F.array_max("embedding").alias("max_value"),
        (filled > size * 0.1).alias("looks_real"),
    )


def dimension_histogram(chunks: DataFrame, expected: int) -> DataFrame:
    """dim, vectors, looks_real count, whether it is the expected dimension, whether it is the only one."""
    profile = embedding_profile(chunks)
    counts = profile.groupBy("dim").agg(
        F.count("*").alias("vectors"), F.count_if("looks_real").alias("real_vectors"))
    kinds = counts.agg(F.count("*").alias("_kinds"))
    return counts.withColumn("_kinds", kinds.scalar()).select(
        "dim", "vectors", "real_vectors", (F.col("dim") == expected).alias("expected"),
        (F.col("_kinds") == 1).alias("consistent"),
    )

"""Schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

STATUSES = ("pending", "processing", "completed", "failed")
RESPONSE_STYLES = ("concise", "detailed", "academic", "casual")
PROVIDERS = ("ollama", "openai")

USER_DOCUMENTS = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("total_pages", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("processing_completed_at", T.TimestampType()),
])

SOURCE = T.StructType([
    T.StructField("document_name", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("excerpt", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("section_title", T.StringType()),
])

QUERY_LOG = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("response_text", T.StringType()),
    T.StructField("sources", T.ArrayType(SOURCE)),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("processing_time_ms", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("chunk_text", T.StringType()),
    T.StructField("chunk_tokens", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("page_position_start", T.IntegerType()),
    T.StructField("page_position_end", T.IntegerType()),
    T.StructField("section_title", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("embedding_model", T.StringType()),
])

# What a model is asked to return for a question and for a procedure.
CITATION = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("section", T.StringType()),
])
MODEL_ANSWER = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("steps", T.ArrayType(T.StringType())),
    T.StructField("sections", T.ArrayType(T.StringType())),
    T.StructField("citations", T.ArrayType(CITATION)),
    T.StructField("confidence", T.StringType()),
])

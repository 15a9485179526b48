"""Writing and changing the stored tables: documents, chunks, query log, preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.operators.listing import owned
from quire.operators.quality import split_valid, storable_chunk_rules
from quire.schemas import CHUNKS
from quire.session import checkpoint

# Preferences of a user who has none.
DEFAULT_PREFERENCES = {
    "embedding_provider": "ollama", "llm_provider": "ollama", "default_response_style": "detailed",
    "max_results_per_query": 10, "language": "en",
}


def register_documents(uploads: DataFrame) -> DataFrame:
    """Upload records with defaults: title from the file name, pending, no pages, no chunks, no tags."""
    def given(column: str, kind: str):
        return F.col(column) if column in uploads.columns else F.lit(None).cast(kind)

    empty_title = given("title", "string").isNull() | (given("title", "string") == "")
    return uploads.select(
        "document_id", "user_id", "filename",
        # only the first occurrence goes, as in a plain string replacement
        F.when(empty_title, F.regexp_replace("filename", r"^(.*?)\.pdf", "$1")).otherwise(given("title", "string")).alias("title"),
        F.nullif(given("description", "string"), F.lit("")).alias("description"),
        "file_size", "file_hash", F.lit("pending").alias("status"),
        F.lit(0).alias("total_pages"), F.lit(0).alias("total_chunks"),
        F.coalesce(given("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        "created_at",
    )


def convert_chunks(chunks: DataFrame, model: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Chunk rows ready to store, with defaults filled in, and the rejects with their reasons."""
    for name, kind in (("chunk_id", "string"), ("chunk_tokens", "int"), ("page_position_start", "int"),
                       ("page_position_end", "int"), ("section_title", "string"), ("embedding_model", "string")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    valid, rejects = split_valid(chunks, storable_chunk_rules())
    own_id = F.concat_ws("-chunk-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))
    filled = (
        valid.withColumn("chunk_id", F.coalesce("chunk_id", own_id))
        .withColumn("chunk_tokens", F.coalesce("chunk_tokens", F.lit(0)))
        .withColumn("page_position_start", F.coalesce("page_position_start", F.lit(0)))
        .withColumn("page_position_end", F.coalesce(F.nullif("page_position_end", F.lit(0)), F.length("chunk_text")))
        .withColumn("embedding_model", F.coalesce("embedding_model", F.lit(model)))
    )
    return filled.select(*CHUNKS.fieldNames()), rejects


def store_chunks(chunks: DataFrame, documents: DataFrame, path: str, reject_path: str | None = None,
                 batch_id: int | None = None) -> dict[str, int]:
    """Append the chunks of known (document, user) pairs, partitioned by user; returns counts.

    Rows are rebalanced before the write, so a user with a third of all rows is written by many tasks.
    With a batch id the rows go to the batch's own partitions, which a repeated batch replaces.
    Chunks are checkpointed first: both tables are written from the same rows, cut and embedded once.
    """
    valid, rejects = convert_chunks(checkpoint(owned(chunks, documents)))
    stored, failed = Observation("stored"), Observation("failed")
    put(valid.observe(stored, F.count(F.lit(1)).alias("n")).hint("rebalance", "user_id"), path, ["user_id"], batch_id)
    counted = rejects.observe(failed, F.count(F.lit(1)).alias("n"))
    if reject_path:
        put(counted.drop("embedding"), reject_path, [], batch_id)
    else:
        counted.write.mode("overwrite").format("noop").save()
    return {"stored": stored.get["n"], "failed": failed.get["n"]}


def put(rows: DataFrame, path: str, by: list[str], batch_id: int | None = None) -> None:
    """Append, or write the partitions of one batch so that writing it again changes nothing."""
    if batch_id is None:
        rows.write.mode("append").partitionBy(*by).parquet(path)
        return
    (
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(path)
    )


def append_queries(answers: DataFrame, path: str) -> None:
    """Append answered questions to the query log; unknown durations stay null, unknown times are now."""
    if "processing_time_ms" not in answers.columns:
        answers = answers.withColumn("processing_time_ms", F.lit(None).cast("bigint"))
    if "created_at" not in answers.columns:
        answers = answers.withColumn("created_at", F.current_timestamp())
    answers.select(
        "query_id", "user_id", "query_text", "response_text", "sources", "confidence_score",
        "processing_time_ms", "created_at",
    ).write.mode("append").parquet(path)


def latest_rows(rows: DataFrame, key: str, updated: str = "updated_at") -> DataFrame:
    """One row per key, the latest: an aggregate, so many versions of one key combine early."""
    names = [c for c in rows.columns if c not in (key, updated)]
    newest = F.max(F.struct(updated, *names)).alias("_r")
    return rows.groupBy(key).agg(newest).select(key, "_r.*").select(*rows.columns)


def upsert_preferences(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per user: the user's latest change, else the stored row. updated_at is the change's time."""
    changed = latest_rows(changes, "user_id")
    kept = stored.join(changed.select("user_id"), "user_id", "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


def preferences_of(users: DataFrame, stored: DataFrame) -> DataFrame:
    """Every user's preferences, defaults where nothing is stored."""
    joined = users.select("user_id").join(stored, "user_id", "left")
    return joined.select(
        "user_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULT_PREFERENCES.items()]
    )


def update_document_stats(documents: DataFrame, chunks: DataFrame, now) -> DataFrame:
    """Documents with stored chunks become completed, with their chunk count."""
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("_n"))
    joined = documents.join(counts, "document_id", "left")
    hit = F.col("_n").isNotNull()
    return joined.select(*[
        F.coalesce("_n", "total_chunks").alias(c) if c == "total_chunks"
        else F.when(hit, "completed").otherwise(F.col(c)).alias(c) if c == "status"
        else F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col(c)).alias(c) if c == "updated_at"
        else F.col(c)
        for c in documents.columns
    ])


def delete_documents(requested: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the requested (user_id, document_id) pairs the user owns."""
    gone = documents.join(requested.select("user_id", "document_id"), ["user_id", "document_id"], "left_semi")
    gone = gone.select("document_id")
    return documents.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def delete_user(user_id: str, confirmation: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the user's rows; the confirmation must repeat the id."""
    if confirmation != user_id:
        raise ValueError("user id confirmation required for account deletion")
    return {name: df.filter(~F.col("user_id").eqNullSafe(F.lit(user_id))) for name, df in tables.items()}


def delete_users(confirmed: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same for a table of users (user_id, confirm_user_id); unconfirmed ones stay."""
    gone = confirmed.filter(F.col("user_id") == F.col("confirm_user_id")).select("user_id").distinct()
    return {name: df.join(gone, "user_id", "left_anti") for name, df in tables.items()}

"""Document lists, filters, pages of results, activity and access checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.status import progress
from quire.session import checkpoint, small_side

SORT_COLUMNS = ("created_at", "updated_at", "title", "status")


def of_user(df: DataFrame, user_id) -> DataFrame:
    """Rows of one user; prunes partitions of tables stored by user_id."""
    return df.filter(F.col("user_id") == user_id)


def between_dates(df: DataFrame, start=None, end=None, column: str = "created_at") -> DataFrame:
    """Rows from start to end, both inclusive and optional."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def search_documents(documents: DataFrame, term: str | None = None, status: str | None = None, tags=None) -> DataFrame:
    """Term in title, description or file name (any case); equal status; all of the tags."""
    if term:
        pattern = f"%{term}%"
        hit = [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in ("title", "description", "filename")]
        documents = documents.filter(hit[0] | hit[1] | hit[2])
    if status:
        documents = documents.filter(F.col("status") == status)
    if tags:
        wanted = F.array(*[F.lit(t) for t in tags])
        documents = documents.filter(F.size(F.array_except(wanted, F.col("tags"))) == 0)
    return documents


def sort_columns(by: str = "created_at", order: str = "desc", tie: str = "document_id") -> list[Column]:
    if by not in SORT_COLUMNS:
        raise ValueError(f"sort by one of {', '.join(SORT_COLUMNS)}")
    return [F.asc(by) if order == "asc" else F.desc(by), F.asc(tie)]


def page_of(df: DataFrame, order: list[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """One page of an ordered result."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be at least 1 and limit between 1 and 100")
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_info(df: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    """current_page, total_pages, total_items, has_next, has_prev of the filtered result."""
    pages = F.ceil(F.col("total_items") / F.lit(limit))
    return df.agg(F.count("*").alias("total_items")).select(
        F.lit(page).alias("current_page"), pages.alias("total_pages"), "total_items",
        F.lit(limit).alias("items_per_page"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"),
    )


def page_per_user(df: DataFrame, order: list[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """The same page for every user at once; a task keeps only the first page*limit rows of a user."""
    position = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return (
        df.withColumn("position", position)
        .filter(F.col("position") <= page * limit)
        .filter(F.col("position") > (page - 1) * limit)
    )


def denied_documents(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested (user_id, document_id) pairs the user does not own."""
    return requested.join(documents.select("user_id", "document_id"), ["user_id", "document_id"], "left_anti")


def owned(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose (document, user) exists."""
    return chunks.join(documents.select("document_id", "user_id"), ["document_id", "user_id"], "left_semi")


def first_uploads(uploads: DataFrame, owner: str = "user_id") -> DataFrame:
    """(owner, file_hash) with the earliest upload; partial aggregation absorbs masses of copies."""
    return uploads.groupBy(owner, "file_hash").agg(
        F.min(F.struct("created_at", "document_id"))["document_id"].alias("first_document_id"),
        F.count("*").alias("copies"),
    )


def duplicate_uploads(uploads: DataFrame, owner: str = "user_id") -> DataFrame:
    """Every upload that repeats an earlier one of its owner, with that first document.

    Only hashes that occur twice or more are joined back. Their rows are spread over salts,
    as one hash may hold a large part of all uploads.
    """
    salts = 32
    repeated = first_uploads(uploads, owner).filter(F.col("copies") > 1).select(
        owner, "file_hash", "first_document_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    salted = uploads.withColumn("_salt", F.pmod(F.xxhash64("document_id"), F.lit(salts)).cast("int"))
    return (
        salted.join(repeated, [owner, "file_hash", "_salt"])
        .filter(F.col("document_id") != F.col("first_document_id")).drop("_salt")
    )


def new_uploads(batch: DataFrame, stored: DataFrame, owner: str = "user_id") -> DataFrame:
    """Uploads of a batch whose (owner, hash) is not stored yet."""
    return batch.join(stored.select(owner, "file_hash"), [owner, "file_hash"], "left_anti")


def activity(documents: DataFrame, queries: DataFrame, kind: str = "all") -> DataFrame:
    """Uploads, completions and queries as one table: user_id, type, timestamp, item_id, detail."""
    parts = []
    if kind in ("all", "documents"):
        parts.append(documents.select(
            "user_id", F.lit("document_upload").alias("type"), F.col("created_at").alias("timestamp"),
            F.col("document_id").cast("string").alias("item_id"), F.col("title").alias("detail"),
        ))
        parts.append(documents.filter(F.col("processing_completed_at").isNotNull()).select(
            "user_id", F.lit("document_processed").alias("type"),
            F.col("processing_completed_at").alias("timestamp"),
            F.col("document_id").cast("string").alias("item_id"), F.col("title").alias("detail"),
        ))
    if kind in ("all", "queries"):
        parts.append(queries.select(
            F.col("user_id").cast("string").alias("user_id"), F.lit("query_processed").alias("type"),
            F.col("created_at").alias("timestamp"), F.col("query_id").cast("string").alias("item_id"),
            tx.preview(F.col("query_text")).alias("detail"),
        ))
    if not parts:
        raise ValueError("activity type must be all, documents or queries")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.asc("type"), F.asc("item_id")]


def document_detail(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their live chunk count and progress."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("live_chunks"))
    state = progress(F.col("status"), F.col("processing_stage"), F.col("error_message"))
    return (
        documents.join(counts, "document_id", "left")
        .withColumn("live_chunks", F.coalesce("live_chunks", F.lit(0)))
        .withColumn("progress", state)
    )


def similar_queries(log: DataFrame, asked: DataFrame, n: int = 5) -> DataFrame:
    """Per asked (request_id, user_id, query): logged queries of the user holding all its words, best first.

    A request meets only the queries that hold its rarest word; equal requests of a user are looked up once. Words nobody
    asks for go before anything is shuffled, and the other words of a request are checked inside the met query's own list.
    """
    def distinct_words(text: str) -> Column:
        return F.array_sort(F.array_distinct(tx.words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))))

    requests = asked.select("request_id", "user_id", distinct_words("query").alias("_need"))
    held = log.select("query_id", "user_id", "confidence_score", distinct_words("query_text").alias("_held"))
    needs = checkpoint(requests.select("user_id", "_need").distinct())
    needed = needs.select("user_id", "_need", F.explode("_need").alias("_word"))
    wanted = small_side(checkpoint(needed.select("user_id", "_word").distinct()))
    known = (
        held.select("user_id", F.explode("_held").alias("_word")).join(wanted, ["user_id", "_word"])
        .groupBy("user_id", "_word").agg(F.count("*").alias("_n"))
    )
    rarest = checkpoint(
        needed.join(known, ["user_id", "_word"])
        .groupBy("user_id", "_need").agg(F.min_by("_word", "_n").alias("_word"), F.count("*").alias("_known"))
        .filter(F.col("_known") == F.size("_need")).drop("_known")
    )
    words = held.select("user_id", "query_id", "confidence_score", "_held", F.explode("_held").alias("_word"))
    met = words.join(small_side(rarest), ["user_id", "_word"]).filter(F.size(F.array_except("_need", "_held")) == 0)
    order = [F.desc("confidence_score"), F.asc("query_id")]
    position = F.row_number().over(Window.partitionBy("user_id", "_need").orderBy(*order))
    best = (
        met.select("user_id", "_need", "query_id", "confidence_score").withColumn("rank", position)
        .filter(F.col("rank") <= n)
    )
    return requests.join(small_side(checkpoint(best)), ["user_id", "_need"]).select("request_id", "query_id", "confidence_score", "rank")

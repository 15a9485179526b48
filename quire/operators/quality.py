"""Rules on rows: all violations are reported, valid rows and rejects are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.status import MAX_FILE_SIZE, MAX_PAGES
from quire.schemas import PROVIDERS, RESPONSE_STYLES, STATUSES

Rules = dict[str, Column]


def with_violations(df: DataFrame, rules: Rules) -> DataFrame:
    """Add `violations`: names of every rule whose condition holds (null counts as not)."""
    broken = [F.when(condition, F.lit(name)) for name, condition in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    checked = with_violations(df, rules)
    ok = F.size("violations") == 0
    return checked.filter(ok).drop("violations"), checked.filter(~ok)


def violation_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """rule, rows: one row per broken rule, counted in one pass."""
    named = with_violations(df, rules).select(F.explode("violations").alias("rule"))
    return named.groupBy("rule").agg(F.count("*").alias("rows"))


def _outside(column: str, low, high) -> Column:
    return ~F.col(column).between(low, high)


def document_rules() -> Rules:
    return {
        "pages": _outside("total_pages", 1, MAX_PAGES),
        "file_size": _outside("file_size", 1, MAX_FILE_SIZE),
        "status": ~F.col("status").isin(*STATUSES),
    }


def chunk_rules() -> Rules:
    return {
        "chunk_index": F.col("chunk_index") < 0,
        "page_number": F.col("page_number") <= 0,
        "positions": (F.col("page_position_start") < 0) | (F.col("page_position_end") <= F.col("page_position_start")),
        "chunk_tokens": _outside("chunk_tokens", 1, 1000),
    }


def query_log_rules() -> Rules:
    return {"confidence": _outside("confidence_score", 0, 1)}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count: what a unique constraint would refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def _user(column: str = "user_id") -> Rules:
    text = F.col(column)
    return {
        f"{column}_required": text.isNull(),
        f"{column}_alphanumeric": ~text.rlike("^[A-Za-z0-9]*\\z"),
        f"{column}_length": ~F.length(text).between(1, 50),
    }


def _tags(limit: int = 10) -> Rules:
    return {
        "tags_count": F.size("tags") > limit,
        "tags_length": F.exists("tags", lambda t: F.length(t) > 50),
    }


def question_rules() -> Rules:
    return {
        "query_required": F.col("query").isNull(),
        "query_length": ~F.length("query").between(1, 2000),
        **_user(),
        "document_ids_count": F.size("document_ids") > 20,
        "document_ids_length": F.exists("document_ids", lambda d: ~F.length(d).between(1, 100)),
        "max_results": _outside("max_results", 1, 20),
        "response_style": ~F.col("response_style").isin(*RESPONSE_STYLES),
    }


def upload_rules() -> Rules:
    return {
        **_user(),
        "title_length": ~F.length("title").between(1, 200),
        "description_length": F.length("description") > 1000,
        **_tags(),
    }


def listing_rules() -> Rules:
    return {
        "user_id_required": F.col("user_id").isNull(),
        "user_id_length": ~F.length("user_id").between(1, 100),
        "search_length": F.length("search") > 200,
        "status": ~F.col("status").isin(*STATUSES),
        **_tags(),
        "sort_by": ~F.col("sort_by").isin("created_at", "updated_at", "title", "status"),
        "sort_order": ~F.col("sort_order").isin("asc", "desc"),
    }


def preference_rules() -> Rules:
    return {
        "embedding_provider": ~F.col("embedding_provider").isin(*PROVIDERS),
        "llm_provider": ~F.col("llm_provider").isin(*PROVIDERS),
        "default_response_style": ~F.col("default_response_style").isin(*RESPONSE_STYLES),
        "max_results_per_query": _outside("max_results_per_query", 1, 20),
        "language": F.length("language") != 2,
    }


def setting_rules() -> Rules:
    return {
        "max_file_size": _outside("max_file_size", 1, 500),
        "chunk_size": _outside("chunk_size", 100, 2000),
        "chunk_overlap": _outside("chunk_overlap", 0, 500),
    }


def paging_rules() -> Rules:
    return {"page": F.col("page") < 1, "limit": _outside("limit", 1, 100)}


def storable_chunk_rules() -> Rules:
    """What keeps a chunk row from being stored."""
    return {
        "missing embedding": F.col("embedding").isNull() | (F.size("embedding") <= 0),
        "missing text": tx.is_blank(F.col("chunk_text")),
    }

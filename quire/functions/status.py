"""Processing status, timeframes and file checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Progress shown for each processing stage.
STAGES = {
    "downloading": (10, "Downloading file from storage"),
    "extracting": (30, "Extracting text from PDF"),
    "chunking": (50, "Breaking document into chunks"),
    "embedding": (70, "Generating embeddings"),
    "storing": (90, "Storing in vector database"),
}
# Length of a timeframe.
TIMEFRAMES = {"7d": ("DAY", 7), "30d": ("DAY", 30), "90d": ("DAY", 90), "1y": ("YEAR", 1)}
MAX_FILE_SIZE = 100 * 1024 * 1024
MAX_PAGES = 2000


def progress(status: Column, stage: Column, error: Column) -> Column:
    """struct(percentage, stage, message) of a document. Its percentages and messages."""
    def state(percentage: int, name, message) -> Column:
        name = name if isinstance(name, Column) else F.lit(name)
        message = message if isinstance(message, Column) else F.lit(message)
        return F.struct(F.lit(percentage).alias("percentage"), name.alias("stage"), message.alias("message"))

    out = (
        F.when(status == "completed", state(100, "completed", "Document ready for queries"))
        .when(status == "failed", state(
            0, F.coalesce(stage, F.lit("failed")), F.coalesce(error, F.lit("Processing failed"))))
        .when(status == "pending", state(0, "queued", "Document queued for processing"))
    )
    for name, (percentage, message) in STAGES.items():
        out = out.when((status == "processing") & (stage == name), state(percentage, name, message))
    return (
        out.when(status == "processing", state(50, "processing", "Processing document"))
        .otherwise(state(0, "unknown", "Unknown status"))
    )


def estimated_minutes(size: Column) -> Column:
    """Two minutes a megabyte, rounded up."""
    return F.ceil(size / F.lit(1024.0 * 1024.0) * 2).cast("int")


def timeframe_start(now: Column, timeframe: str, default: str = "30d") -> Column:
    unit, n = TIMEFRAMES.get(timeframe, TIMEFRAMES[default])
    if unit == "YEAR":
        return now - F.make_interval(years=F.lit(n))
    return now - F.make_interval(days=F.lit(n))


def processing_seconds(started: Column, completed: Column) -> Column:
    """Whole seconds between two times, null when either is unknown."""
    return F.round(F.unix_micros(completed) / F.lit(1e6) - F.unix_micros(started) / F.lit(1e6)).cast("bigint")


def ingest_error(message: Column) -> Column:
    """What a user is told about an extraction error. The messages and what they answer to."""
    return (
        F.when(message.contains("Invalid PDF") | message.contains("not a PDF"), "Invalid or corrupted PDF file")
        .when(message.contains("password") | message.contains("encrypted"),
              "Password-protected PDFs are not supported")
        .when(message.contains("parsing failed"), "PDF format not supported or file is corrupted")
        .otherwise(message)
    )

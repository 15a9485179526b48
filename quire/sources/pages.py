"""Document text to page rows, inside the document's own row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx


def page_array(text: Column, lines_per_page: int | None = 20, separator: str = "\f",
               first_pages: int | None = None) -> Column:
    """array<struct<page_number, text>> of a document text.

    Pages are runs of lines, or parts between separators when lines_per_page is None. Text is
    trimmed; blank pages are left out but keep their number. first_pages reads only so many pages.
    """
    if lines_per_page is None:
        parts = F.split(text, separator)
    else:
        parts = tx.let(F.split(text, "\n"), lambda lines: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / F.lit(lines_per_page)).cast("int")),
            lambda p: F.array_join(F.slice(lines, p * lines_per_page + 1, lines_per_page), "\n"),
        ))
    if first_pages is not None:
        parts = F.slice(parts, 1, first_pages)
    numbered = F.transform(
        parts, lambda page, i: F.struct((i + 1).alias("page_number"), tx.strip(page).alias("text")))
    return F.filter(numbered, lambda p: p["text"] != "")


def split_pages(documents: DataFrame, lines_per_page: int | None = 20, **options) -> DataFrame:
    """One row a page: the document's columns, page_number, text."""
    kept = [c for c in documents.columns if c != "text"]
    return documents.select(*kept, F.inline(page_array(F.col("text"), lines_per_page, **options)))


def even_pages(documents: DataFrame, pages: str = "page_count") -> DataFrame:
    """Split a text into a known number of pages of about equal length, at line ends.

    A page closes once its lines hold ceil(length / pages) characters; the last page takes
    the rest, and empty pages fill up to the number.
    """
    kept = [c for c in documents.columns if c != "text"]
    n = F.col(pages).cast("int")
    target = F.ceil(F.length("text") / n).cast("int")
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("cuts"))

    def step(state, line):
        def move(held):
            full = (held >= target) & (F.size(state["cuts"]) < n - 1)
            return F.struct(
                F.when(full, 0).otherwise(held).alias("held"),
                F.when(full, F.concat(state["cuts"], F.array(line["at"]))).otherwise(state["cuts"]).alias("cuts"),
            )
        return tx.let(state["held"] + line["size"], move)

    def page_texts(lines):
        sized = F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), F.length(x).alias("size")))
        # starts with 0: page p holds the lines after ends[p] up to ends[p + 1]
        ends = F.concat(F.array(F.lit(0)), F.aggregate(sized, start, step)["cuts"], F.array(F.size(lines)))
        return tx.let(ends, lambda e: F.transform(
            F.sequence(F.lit(1), n),
            lambda p: F.when(p < F.size(e), tx.strip(F.array_join(F.slice(
                lines, F.try_element_at(e, p) + 1, F.try_element_at(e, p + 1) - F.try_element_at(e, p),
            ), "\n"))).otherwise(""),
        ))

    single = (n == 1) | (F.length("text") == 0)
    texts = F.when(single, F.array("text")).otherwise(tx.let(F.split("text", "\n"), page_texts))
    return (
        documents.select(*kept, F.posexplode(texts).alias("_at", "text"))
        .withColumn("page_number", F.col("_at") + 1).drop("_at")
    )

"""Pages to chunks: a chunk never crosses a page, and its index runs on over the document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import cutting
from quire.operators.arrow import add_columns, struct_lists
from quire.operators.hooks import estimate
from quire.operators.scans import number_pieces
from quire.sources.pages import page_array

SIZE, OVERLAP = 800, 150

_FIELDS = [("chunk_text", pa.string()), ("page_position_start", pa.int32()), ("page_position_end", pa.int32())]
_PIECE = "chunk_text:string,page_position_start:int,page_position_end:int"


def _with_pieces(df: DataFrame, column: str, make, fields, kind: str) -> DataFrame:
    """df with `column` replaced by `_pieces` = make(values of a batch)."""
    return add_columns(
        df, f"_pieces array<struct<{kind}>>",
        lambda batch: [struct_lists(make(batch.column(column).to_pylist()), fields)], drop=(column,))


def cut_texts(df: DataFrame, column: str, cut) -> DataFrame:
    """Replace a text by its pieces: cut(text) -> (chunk_text, start, end)."""
    def make(texts):
        return [cut(text) if text else () for text in texts]

    return _with_pieces(df, column, make, _FIELDS, _PIECE)


def cut_parts(df: DataFrame, column: str, cut) -> DataFrame:
    """Replace an array of (title, text) parts by its pieces: cut(parts) -> (section_title, chunk_text, start, end)."""
    def make(pages):
        return [cut([(p["title"], p["text"]) for p in parts or ()]) for parts in pages]

    return _with_pieces(df, column, make, [("section_title", pa.string()), *_FIELDS], f"section_title:string,{_PIECE}")


def cut_documents(df: DataFrame, column: str, cut) -> DataFrame:
    """Replace an array of page texts by its pieces, each with the page's ordinal and its position in the page."""
    def make(documents):
        return [
            [(at + 1, pos, *piece) for at, text in enumerate(pages or ()) for pos, piece in enumerate(cut(text))]
            for pages in documents
        ]

    fields = [("ordinal", pa.int32()), ("page_pos", pa.int32()), *_FIELDS]
    return _with_pieces(df, column, make, fields, f"ordinal:int,page_pos:int,{_PIECE}")


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")


def _page_cutter(size, overlap, sentences, tokens):
    def cut(text):
        return [
            (text[lead:end], start, end)
            for lead, start, end in cutting.cut_page(text, size, overlap, tokens, sentences)
        ]
    return cut


def header_title(text: Column) -> Column:
    """`number title` of the first header of a page."""
    first = F.try_element_at(tx.page_sections(text), F.lit(1))
    return tx.let(first, lambda h: F.when(h.isNotNull(), F.concat_ws(" ", h["number"], h["title"])))


def page_title(pages: DataFrame) -> DataFrame:
    """section_title = the page's own, else `number title` of its first header."""
    if "section_title" not in pages.columns:
        pages = pages.withColumn("section_title", F.lit(None).cast("string"))
    return pages.withColumn("section_title", F.coalesce("section_title", header_title(F.col("text"))))


def page_pieces(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, sentences: bool = True,
                tokens=estimate, detect_headers: bool = True) -> DataFrame:
    """Pages with `_pieces`, the chunks of each, and without their text."""
    _check(size, overlap)
    if detect_headers:
        pages = page_title(pages)
    elif "section_title" not in pages.columns:
        pages = pages.withColumn("section_title", F.lit(None).cast("string"))
    return cut_texts(pages, "text", _page_cutter(size, overlap, sentences, tokens))


def chunk_pages(pages: DataFrame, **options) -> DataFrame:
    """One row a chunk, with page_pos inside the page; a narrow step, nothing is shuffled."""
    return unpack(page_pieces(pages, **options))


def unpack(df: DataFrame) -> DataFrame:
    """Pieces to rows; an `_offset` before them makes the index within the document."""
    kept = [c for c in df.columns if c not in ("_pieces", "_offset")]
    index = [(F.col("_offset") + F.col("page_pos")).alias("chunk_index")] if "_offset" in df.columns else []
    offset = ["_offset"] if index else []
    rows = df.select(*kept, *offset, F.posexplode("_pieces").alias("page_pos", "_piece"))
    return rows.select(*kept, "page_pos", *index, "_piece.*").withColumn(
        "chunk_tokens", tx.estimate_tokens(F.col("chunk_text")))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id = `<document>-chunk-<index>`."""
    return chunks.withColumn("chunk_id", F.concat_ws("-chunk-", F.col("document_id").cast("string"),
                                                     F.col("chunk_index").cast("string")))


def chunk_page_table(pages: DataFrame, **options) -> DataFrame:
    """A table of pages to chunks with chunk_index, running on over the pages of a document, and chunk_id."""
    return with_chunk_ids(unpack(number_pieces(pages, lambda p: page_pieces(p, **options), "_pieces")))


def chunk_documents(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, sentences: bool = True,
                    tokens=estimate, detect_headers: bool = True, lines_per_page: int | None = 20) -> DataFrame:
    """Documents (document_id, text, ...) straight to indexed chunks.

    Pages and chunks of a document are made inside its row, so its chunks are numbered there
    too: no shuffle, and no second pass for the index.
    """
    _check(size, overlap)
    kept = [c for c in documents.columns if c != "text"]
    pages = F.transform(page_array(F.col("text"), lines_per_page), lambda p: F.struct(
        p["page_number"].alias("page_number"),
        (header_title(p["text"]) if detect_headers else F.lit(None).cast("string")).alias("title"),
        p["text"].alias("text"),
    ))
    split = documents.select(*kept, pages.alias("_pages")).select(
        *kept, F.transform("_pages", lambda p: p.dropFields("text")).alias("_about"),
        F.transform("_pages", lambda p: p["text"]).alias("_texts"),
    )
    made = cut_documents(split, "_texts", _page_cutter(size, overlap, sentences, tokens))
    # each piece takes its page's number and title along, so that no chunk carries those of all pages
    about = F.col("_about")
    placed = F.transform("_pieces", lambda p: p.withField("about", about[p["ordinal"] - 1]))
    rows = made.select(*kept, placed.alias("_pieces")).select(
        *kept, F.posexplode("_pieces").alias("chunk_index", "_p"))
    return with_chunk_ids(rows.select(
        *kept, F.col("_p.about.page_number").alias("page_number"), F.col("_p.about.title").alias("section_title"),
        F.col("chunk_index").cast("bigint").alias("chunk_index"), "_p.page_pos", "_p.chunk_text",
        "_p.page_position_start", "_p.page_position_end",
        tx.estimate_tokens(F.col("_p.chunk_text")).alias("chunk_tokens"),
    ))


def stride_pieces(pages: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """Pages with `_pieces`: fixed windows of `size` words that step by `size - overlap`, all in the JVM."""
    windows = F.transform(word_windows(F.col("text"), size, overlap), lambda w: F.struct(w.alias("chunk_text")))
    return pages.filter(~tx.is_blank(F.col("text"))).withColumn("_pieces", windows).drop("text")


def stride_chunks(pages: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    return unpack(stride_pieces(pages, size, overlap))


def stride_page_table(pages: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """A table of pages to indexed fixed windows."""
    return with_chunk_ids(unpack(number_pieces(pages, lambda p: stride_pieces(p, size, overlap), "_pieces")))


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """array<string>: windows of `size` words; the last one is never overlap alone."""
    _check(size, overlap)
    stride = size - overlap

    def windows(words):
        count = F.greatest(F.lit(1), F.ceil((F.size(words) - overlap) / F.lit(stride)).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.array_join(F.slice(words, i * stride + 1, size), " "),
        )

    return tx.let(tx.words(text), windows)


def stride_documents(documents: DataFrame, size: int = 200, overlap: int = 40, lines_per_page: int | None = 20) -> DataFrame:
    """Documents straight to indexed fixed windows, all in the document's row and in the JVM."""
    kept = [c for c in documents.columns if c != "text"]
    pieces = F.flatten(F.transform(
        page_array(F.col("text"), lines_per_page),
        lambda p: F.transform(word_windows(p["text"], size, overlap), lambda w, i: F.struct(
            p["page_number"].alias("page_number"), i.alias("page_pos"), w.alias("chunk_text"))),
    ))
    rows = documents.select(*kept, F.posexplode(pieces).alias("chunk_index", "_p")).select(
        *kept, F.col("chunk_index").cast("bigint").alias("chunk_index"), "_p.*")
    return with_chunk_ids(rows.withColumn("chunk_tokens", tx.estimate_tokens(F.col("chunk_text"))))


def rechunk(chunks: DataFrame, **options) -> DataFrame:
    """Put the chunks of each page together again and cut the page with new options."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text", "section_title")))
    titles = F.filter("_p", lambda p: p["section_title"].isNotNull() & (p["section_title"] != ""))
    pages = (
        chunks.groupBy("document_id", "page_number").agg(parts.alias("_p"))
        .select(
            "document_id", "page_number",
            F.array_join(F.transform("_p", lambda p: p["chunk_text"]), " ").alias("text"),
            F.try_element_at(titles, F.lit(1))["section_title"].alias("section_title"),
        )
    )
    return chunk_page_table(pages, **options)

"""Section maps, section boundaries and section-aware chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import cutting
from quire.operators.chunking import (
    OVERLAP, SIZE, _check, _page_cutter, cut_parts, header_title, unpack, with_chunk_ids,
)
from quire.operators.hooks import estimate
from quire.operators.matching import TITLE_PREFIX, with_sections_found
from quire.operators.scans import number_pieces
from quire.session import checkpoint



def detect_headers(pages: DataFrame) -> DataFrame:
    """One row a header line: document, page, line, number, title, type, level, parent."""
    return (
        pages.select("document_id", "page_number", F.inline(tx.page_sections(F.col("text"))))
        .withColumn("level", tx.section_level(F.col("number"), F.col("type")))
        .withColumn("parent", tx.parent_section(F.col("number"), F.col("type")))
    )


def section_map(headers: DataFrame) -> DataFrame:
    """One row per (document, number): the last header's values, the first header's place."""
    place = F.struct("page_number", "line")
    return (
        headers.groupBy("document_id", "number")
        .agg(
            F.max_by(F.struct("title", "level", "type", "parent"), place).alias("_v"),
            F.min(place).alias("_p"),
        )
        .select(
            "document_id", "number", "_v.*",
            F.col("_p.page_number").alias("first_page"), F.col("_p.line").alias("first_line"),
        )
    )


def with_boundaries(pages: DataFrame, sections: DataFrame, **options) -> DataFrame:
    """Every page with `bounds`: array<struct<start_line, end_line, section>>, empty without sections.

    A line opens the first section (in map order) whose number and first 20 title
    characters it contains; a section ends before the next one, the last with the page.
    """
    lines = F.transform(F.split("text", "\n"), tx.strip)
    found = with_sections_found(pages, sections, lines, "_hits", both=True, **options)
    starts = F.transform("_hits", lambda x: F.struct(x["place"].alias("start_line"), x["section"].alias("section")))
    return with_extents(found.withColumn("_found", starts).drop("_hits"))


def section_boundaries(pages: DataFrame, sections: DataFrame, **options) -> DataFrame:
    """Only the pages that have sections."""
    return with_boundaries(pages, sections, **options).filter(F.size("bounds") > 0)


def with_extents(pages: DataFrame) -> DataFrame:
    """bounds = found starts, each ending a line before the next, the last with the page."""
    last_line = F.size(F.split("text", "\n")) - 1
    bounds = tx.let(F.col("_found"), lambda found: F.transform(
        found,
        lambda x, i: F.struct(
            x["start_line"].alias("start_line"),
            F.coalesce(F.try_element_at(found, i + 2)["start_line"] - 1, last_line).alias("end_line"),
            x["section"].alias("section"),
        ),
    ))
    return pages.withColumn("bounds", F.coalesce(bounds, F.array())).drop("_found")


def section_pieces(bounded: DataFrame, size: int = SIZE, overlap: int = OVERLAP, tokens=estimate,
                   detect_headers: bool = True) -> DataFrame:
    """Pages (document_id, page_number, text, bounds) with `_pieces`, the chunks of each.

    A section that fits is one chunk, a larger one several; a page without sections is cut
    like any page, and with `detect_headers` its first header line, which no section of the map
    may own, is its title. Texts are taken out of the page inside its row, so all of this is narrow.
    """
    _check(size, overlap)
    plain = _page_cutter(size, overlap, True, tokens)

    def cut(text):
        if tokens(text) <= size:
            return [(text, 0, len(text))]
        return cutting.cut_section(text, size, overlap, tokens)

    def cut_page_parts(parts):
        out = []
        for title, text in parts:
            pieces = plain(text) if title is None else cut(text) if text else ()
            out += [(title, *piece) for piece in pieces]
        return out

    texts = tx.let(F.split("text", "\n"), lambda lines: F.transform("bounds", lambda b: F.struct(
        b["section"]["title"].alias("title"),
        tx.strip(F.array_join(
            F.slice(lines, b["start_line"] + 1, b["end_line"] - b["start_line"] + 1), "\n")).alias("text"),
    )))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("text").alias("text")))
    parts = F.when(F.size("bounds") > 0, texts).otherwise(whole)
    header = F.lit(None).cast("string")
    if detect_headers:
        header = F.when(F.size("bounds") == 0, header_title(F.col("text")))
    pages = bounded.select("document_id", "page_number", header.alias("_header"), parts.alias("_parts"))
    return cut_parts(pages, "_parts", cut_page_parts)


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("section_title", F.coalesce("section_title", "_header")).drop("_header")


def chunk_by_sections(bounded: DataFrame, **options) -> DataFrame:
    """Chunks of pages with boundaries; titles are the section's."""
    return _named(unpack(section_pieces(bounded, **options)))


def with_hierarchy(chunks: DataFrame, sections: DataFrame, **options) -> DataFrame:
    """Chunks with `hierarchy`: the sections, in map order, whose number or first 20 title characters (any case) they contain."""
    found = with_sections_found(
        chunks, sections, F.array("chunk_text"), "_hits", both=False, folded=F.array(F.lower("chunk_text")),
        title_key=F.substring(F.lower("title"), 1, TITLE_PREFIX), **options)
    return found.withColumn("hierarchy", F.transform("_hits", lambda x: x["section"])).drop("_hits")


def chunk_sections(chunks: DataFrame, sections: DataFrame, **options) -> DataFrame:
    """One row per chunk and section of its hierarchy."""
    keys = ["document_id", "page_number", "page_pos"]
    found = with_hierarchy(chunks.select(*keys, "chunk_text"), sections, **options)
    return found.select(*keys, F.explode("hierarchy").alias("_s")).select(*keys, "_s.*")


def stored_map(pages: DataFrame) -> DataFrame:
    """The section map of the pages, checkpointed: it is small and read several times."""
    return checkpoint(section_map(detect_headers(pages)))


def hierarchical_chunks(pages: DataFrame, sections: DataFrame | None = None, plain: Column | None = None,
                        **options) -> DataFrame:
    """Section chunks where a page has sections, plain chunks elsewhere, with procedure flags, references and hierarchy.

    `plain`, a condition on pages, tells which of them may be cut without sections; all may without it.
    """
    pages = pages.select("document_id", "page_number", "text")
    sections = stored_map(pages) if sections is None else sections

    def cut(p):
        bounded = with_boundaries(p, sections)
        if plain is not None:
            bounded = bounded.filter((F.size("bounds") > 0) | plain)
        return section_pieces(bounded, **options)

    made = number_pieces(pages, cut, "_pieces")
    return annotate(with_hierarchy(with_chunk_ids(_named(unpack(made))), sections))


def annotate(chunks: DataFrame) -> DataFrame:
    text = F.col("chunk_text")
    return (
        chunks.withColumn("is_complete_procedure", tx.is_complete_procedure(text))
        .withColumn("contains_steps", tx.contains_steps(text))
        .withColumn("cross_references", tx.cross_references(text))
    )


def hierarchy_summary(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Per document: chunks, complete procedures, chunks with steps, sections."""
    per_chunk = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.count_if("is_complete_procedure").alias("complete_procedures"),
        F.count_if("contains_steps").alias("chunks_with_steps"),
    )
    per_section = sections.groupBy("document_id").agg(F.count("*").alias("sections"))
    return per_chunk.join(per_section, "document_id", "left").withColumn(
        "sections", F.coalesce("sections", F.lit(0))
    )

"""Upload to searchable chunks: documents -> pages -> chunks -> embeddings -> chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.operators.chunking import chunk_documents
from quire.operators.hooks import Embedder, embed
from quire.operators.sections import hierarchical_chunks
from quire.session import spread
from quire.sources.pages import split_pages
from quire.sources.tables import store_chunks


def prepare(documents: DataFrame, lines_per_page: int | None = 20, sections: bool = False, **options) -> DataFrame:
    """Chunks of documents (document_id, user_id, text), not embedded yet."""
    documents = documents.select("document_id", "user_id", "text")
    if not sections:
        return chunk_documents(documents, lines_per_page=lines_per_page, **options)
    pages = split_pages(documents, lines_per_page)
    return hierarchical_chunks(pages, **options).join(documents.select("document_id", "user_id"), "document_id")


def ingest(documents: DataFrame, chunk_path: str, reject_path: str, embedder: Embedder | None = None,
           batch_id: int | None = None, **options) -> dict[str, int]:
    """Cut, embed and store; returns how many chunks were stored and how many were rejected."""
    chunks = embed(prepare(spread(documents, "document_id"), **options), embedder or Embedder())
    return store_chunks(chunks, documents, chunk_path, reject_path, batch_id)

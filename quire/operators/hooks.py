"""Pluggable pieces: embedder, scorer, answerer, token counter.

Each hook is a plain Python object that Spark ships to its tasks; `load` runs once a
task, the batch method once an Arrow batch. Errors of single rows are kept as values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.functions.vectors import hash_embedding
from quire.operators.arrow import add_columns


def estimate(text: str) -> int:
    """Python twin of `estimate_tokens`, used by the sequential cutters."""
    return math.ceil(len(text) / 4)


class Embedder:
    """Batch of texts to vectors. Override `load` to fetch a model once a task."""

    name = "hash"

    def __init__(self, dim: int = 384, batch_size: int = 50):
        self.dim, self.batch_size = dim, batch_size

    def load(self) -> None:
        pass

    def embed(self, texts: list[str]) -> list:
        return hash_embedding(texts, self.dim)


def embed(df: DataFrame, embedder: Embedder, text: str = "chunk_text") -> DataFrame:
    """Add embedding, embedding_error and embedding_model; a row that fails keeps its reason."""
    def vectors(texts: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in embedder.embed(texts)]
        except Exception as problem:  # one bad row must not lose its batch
            return [(None, str(problem))] if len(texts) == 1 else [vectors([t])[0] for t in texts]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, errors = batch.column(text).to_pylist(), batch.column("embedding_error").to_pylist()
        good = [i for i, e in enumerate(errors) if e is None]
        found: list = [None] * len(texts)
        for at in range(0, len(good), embedder.batch_size):
            part = good[at:at + embedder.batch_size]
            for i, (vector, error) in zip(part, vectors([texts[i] for i in part])):
                found[i], errors[i] = vector, error
        return [_float_lists(found), pa.array(errors, pa.string())]

    checked = df.withColumn("embedding_error", embeddable_problem(F.col(text)))
    made = add_columns(
        checked, "embedding array<float>, embedding_error string", make, drop=("embedding", "embedding_error"),
        load=embedder.load)
    return made.withColumn("embedding_model", F.lit(embedder.name))


def _float_lists(vectors: list) -> pa.Array:
    """Vectors, or None, as a list<float> array built from one flat buffer."""
    sizes = [0 if v is None else len(v) for v in vectors]
    flat = [np.asarray(v, np.float32) for v in vectors if v is not None]
    values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.float32))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    missing = np.array([v is None for v in vectors] + [False])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=missing), values)


def embeddable_problem(text: Column, limit: int = 8192) -> Column:
    """Why a text cannot be embedded: blank, or longer than the limit; null when it can."""
    return (
        F.when(tx.is_blank(text), "text is empty")
        .when(F.length(text) > limit, F.lit(f"text is longer than {limit} characters"))
    )


class Answerer:
    """Prompts to texts. The default quotes the first excerpt of the context."""

    name = "extractive"

    def load(self) -> None:
        pass

    def answer(self, prompts: pd.DataFrame) -> pd.DataFrame:
        body = prompts["context"].str.extract(r"Content:\s*(.*?)(?:\n\n|\Z)", flags=16)[0]
        return pd.DataFrame({
            "response_text": body.fillna("No relevant information found in the documents."),
            "prompt_tokens": 0, "completion_tokens": 0, "finish_reason": "stop",
        })


def answer(prompts: DataFrame, answerer: Answerer, drop: tuple[str, ...] = ("context", "system_prompt")) -> DataFrame:
    """Prompts (query_id, system_prompt, user_prompt, context, ...) with the answerer's text, usage and error.

    The prompt columns ride along, less those in `drop`, so nothing has to be joined back.
    """
    kept = [f for f in prompts.schema.fields if f.name not in drop]
    given = ["response_text", "prompt_tokens", "completion_tokens", "finish_reason", "error"]
    schema = T.StructType([*kept, *T._parse_datatype_string(
        "response_text string, prompt_tokens long, completion_tokens long, finish_reason string, error string").fields])

    def answers(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            return answerer.answer(batch).reset_index(drop=True).assign(error=None)
        except Exception as problem:  # one bad prompt must not lose its batch
            if len(batch) > 1:
                return pd.concat([answers(batch.iloc[[i]].reset_index(drop=True)) for i in range(len(batch))],
                                 ignore_index=True)
            return pd.DataFrame({"response_text": [None] * len(batch), "prompt_tokens": 0, "completion_tokens": 0,
                                 "finish_reason": "error", "error": str(problem)})

    def run(batches):
        answerer.load()
        for batch in batches:
            batch = batch.reset_index(drop=True)
            got = answers(batch)
            yield pd.concat([batch[[f.name for f in kept]], got[given]], axis=1)

    return prompts.mapInPandas(run, schema)


def request_problem(prompt: Column, max_tokens: Column, temperature: Column, model_limit: int) -> Column:
    """Why a model request is refused; null when it is fine."""
    return (
        F.when(tx.is_blank(prompt), "prompt is empty")
        .when(max_tokens.isNotNull() & (max_tokens != 0) & ~max_tokens.between(1, model_limit),
              F.lit(f"max_tokens must be between 1 and {model_limit}"))
        .when(temperature.isNotNull() & ~temperature.between(0, 2), "temperature must be between 0 and 2")
    )


Scorer = Callable[[Column, Column], Column]


def lexical_overlap(query_text: Column, chunk_text: Column) -> Column:
    """Default reranking score: share of the question's distinct words found in the chunk."""
    asked = F.array_distinct(tx.words(F.lower(query_text)))
    found = F.array_intersect(asked, tx.words(F.lower(chunk_text)))
    return F.coalesce(F.try_divide(F.size(found), F.size(asked)), F.lit(0.0))

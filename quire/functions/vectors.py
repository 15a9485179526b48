"""Vector functions over array<float> columns, and the default text embedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACE_CHARACTERS


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero when either vector is zero; unequal lengths are an error."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors must have the same length"))
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(same.isNull(), value)


def l2_normalise(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda v: F.coalesce(F.try_divide(v.cast("double"), size), F.lit(0.0)))


def fit_dimension(a: Column, dim: int) -> Column:
    """Cut to `dim` values or pad with zeros."""
    padding = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.slice(F.concat(a.cast("array<float>"), padding), 1, dim)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def is_valid_vector(a: Column) -> Column:
    """Not empty, not all zero, not all the same value."""
    usable = (F.size(a) > 0) & (F.array_min(a) != F.array_max(a))
    return F.coalesce(usable, F.lit(False))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def hash_embedding(texts, dim: int = 384) -> list[np.ndarray]:
    """Character buckets: character j of word i adds 0.1 at (code + i + j) mod dim; unit length."""
    out = []
    for text in texts:
        codes = np.frombuffer((text or "").lower().encode("utf-16-le"), dtype=np.uint16).astype(np.int64)
        blank = _IS_BLANK[codes]
        starts = blank & ~np.concatenate(([False], blank[:-1])) if len(codes) else blank
        word = np.cumsum(starts)
        # position within the word = position minus the position after the last blank
        at = np.arange(len(codes))
        last_blank = np.maximum.accumulate(np.where(blank, at, -1)) if len(codes) else at
        bucket = (codes + word + (at - last_blank - 1)) % dim
        vector = np.bincount(bucket[~blank], minlength=dim).astype(np.float64) * 0.1
        size = np.sqrt(np.dot(vector, vector))
        out.append(vector / size if size > 0 else vector)
    return out


_IS_BLANK = np.zeros(65536, bool)
_IS_BLANK[[ord(c) for c in SPACE_CHARACTERS]] = True

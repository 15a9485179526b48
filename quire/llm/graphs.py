"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.session import ship

# Links that one task may join up in memory (16 bytes each); more take rounds of joins.
FEW_LINKS = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest labels spread over all links at once, with labels replaced by their own labels, until nothing changes."""
    found = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not found:
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*found)]), return_inverse=True)
    u, v = np.split(ends, 2)
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(links: DataFrame, left: str = "a", right: str = "b", few: int = FEW_LINKS) -> DataFrame:
    """node, component (its smallest node) of every node that a link names; a node linked to itself only is left out.

    Up to `few` links, counted, are joined up in one task. Beyond that, each round hangs every node's neighbours on the smallest of them, first the larger ones, then the smaller ones. The
    number of rounds grows with the logarithm of the longest path; no node's neighbours are gathered in one place.
    """
    edges = stored(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                   .where(F.col("u") != F.col("v")).distinct(), "edges")
    if edges.count() <= few:
        ship(edges.sparkSession)
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

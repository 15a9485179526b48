"""Inverted lists as a table: written by list, appended to, assigned anew, searched by the lists that queries probe."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.search import DEFAULT_K, DEFAULT_THRESHOLD, InvertedLists, batched_search
from quire.session import checkpoint, small_side
from quire.sources.tables import put

# Ids of the probed lists are broadcast, so their number is bounded.
MAX_LISTS = 100_000
# Queries whose exact hits tell how many lists have to be probed.
TUNING_QUERIES = 1000


class StoredLists:
    """Vectors in a folder, one partition a list.

    `path` holds one folder a generation (centroids and vectors) and the table `generations`, whose highest row is the
    one in use. Each attempt has its own folder and is entered last, so one that fails midway is never seen. Rows whose
    embedding is null are not stored. Appends take a batch id and can be run again with the same rows; the same chunk
    under two batch ids is stored twice.
    """

    def __init__(self, spark: SparkSession, path: str, probes: int = 10):
        self.spark, self.path, self.probes = spark, path, probes
        latest = spark.read.parquet(f"{path}/generations").agg(F.max(F.struct("generation", "folder")).alias("g")).first()["g"]
        self.generation, self.folder = latest["generation"], f"{path}/{latest['folder']}"
        rows = spark.read.parquet(f"{self.folder}/centroids").orderBy("list_id").collect()  # at most MAX_LISTS
        self.index = InvertedLists(len(rows), probes)
        self.index.centroids = np.array([r["centroid"] for r in rows])

    @classmethod
    def create(cls, chunks: DataFrame, path: str, lists: int = 100, probes: int = 10, seed: int = 7) -> "StoredLists":
        return cls._write(chunks, path, 0, lists, probes, seed)

    @classmethod
    def _write(cls, chunks, path, generation, lists, probes, seed) -> "StoredLists":
        if not 1 <= lists <= MAX_LISTS:
            raise ValueError(f"lists must be between 1 and {MAX_LISTS}")
        spark, name = chunks.sparkSession, f"generation-{generation}-{uuid.uuid4().hex}"
        folder = f"{path}/{name}"
        index = InvertedLists(lists, probes, seed).fit(chunks)
        entries = [(i, c.tolist()) for i, c in enumerate(index.centroids)]
        spark.createDataFrame(entries, "list_id int, centroid array<double>").write.parquet(f"{folder}/centroids")
        cls._put(index.assign(chunks), folder, 0)
        spark.createDataFrame([(generation, name)], "generation long, folder string").write.mode("append").parquet(f"{path}/generations")
        return cls(spark, path, probes)

    @staticmethod
    def _put(assigned: DataFrame, folder: str, batch_id: int) -> None:
        # rebalanced, so that a list with a third of all rows is written by many tasks and small lists share one
        put(assigned.hint("rebalance", "list_id"), f"{folder}/vectors", ["list_id"], batch_id)

    def append(self, chunks: DataFrame, batch_id: int) -> None:
        """Rows go to their nearest list; centroids stay. A batch (id from 1) that comes again with its rows replaces what it wrote."""
        if batch_id < 1:
            raise ValueError("batch ids start at 1; 0 is what a generation began with")
        self._put(self.index.assign(chunks), self.folder, batch_id)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")

    def reassign(self, lists: int | None = None, seed: int = 7) -> "StoredLists":
        """A new generation: centroids from all rows, every row in its nearest list, batches merged into whole files."""
        rows = self.vectors().drop("list_id", "batch_id")
        return self._write(rows, self.path, self.generation + 1, lists or self.index.lists, self.probes, seed)

    def search(self, queries: DataFrame, k: int = DEFAULT_K, threshold: float = DEFAULT_THRESHOLD,
               scope: tuple[str, ...] = ("user_id",), **options) -> DataFrame:
        """Top k of every query (query_id, embedding, scope) in its nearest lists, scored exactly.

        The probed lists prune the partitions that are read, at run time.
        """
        asked = checkpoint(self.index.probed(queries))
        return batched_search(self.probed_vectors(asked), asked, k, threshold, (*scope, "list_id"), **options)

    def tune(self, queries: DataFrame, target: float, k: int = DEFAULT_K, threshold: float = DEFAULT_THRESHOLD,
             scope: tuple[str, ...] = ("user_id",), most: int = TUNING_QUERIES, **options) -> "StoredLists":
        """Raise the number of probes until the target share of exact hits lies in the probed lists.

        Measured by the exact search over all stored rows for at most `most` queries, those with the smallest hash of
        their id. Probes are never lowered; with every list probed the recall is 1.
        """
        if not 0 < target <= 1:
            raise ValueError("the target is a share")
        asked = queries.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("query_id"), "query_id").limit(most)
        asked = checkpoint(asked)
        rows, index = self.vectors(), self.index
        exact = checkpoint(batched_search(rows, asked, k, threshold, scope, **options).select("query_id", "chunk_id"))
        every = InvertedLists(index.lists, len(index.centroids), index.seed)
        every.centroids = index.centroids
        near = every._nearest(asked, len(index.centroids), "_lists").select("query_id", "_lists")
        places = (
            rows.select("chunk_id", "list_id").join(small_side(exact), "chunk_id").join(near, "query_id")
            .groupBy(F.array_position("_lists", F.col("list_id").cast("int")).alias("place")).agg(F.count("*").alias("n"))
            .orderBy("place").collect()  # one row a list
        )
        total, held = sum(r["n"] for r in places), 0
        for r in places:
            if held >= target * total:
                break
            held += r["n"]
            self.probes = index.probes = max(index.probes, r["place"])
        return self

    def probed_vectors(self, asked: DataFrame) -> DataFrame:
        """Stored rows of the lists in `asked`."""
        wanted = asked.select("list_id").distinct().filter(F.col("list_id") >= 0)
        return self.vectors().join(F.broadcast(wanted), "list_id", "left_semi")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact hits, how many of them were found, and their share (null without any)."""
    keys = ["query_id", "chunk_id"]
    hit = exact.select(*keys).join(found.select(*keys).withColumn("_f", F.lit(1)), keys, "left")
    return hit.agg(F.count(F.lit(1)).alias("exact_hits"), F.count("_f").alias("found_hits")).withColumn(
        "recall", F.try_divide("found_hits", "exact_hits"))

"""Cosine top-k search: one query, tables of queries, fallback, reranking, inverted lists.

Similarity is rounded before ranking, so ranks do not depend on the order sums run in;
ties go to the smaller chunk id. Pairs of query and chunk never become rows: a task
multiplies blocks and keeps the best k a query, and only those are shuffled and merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import vectors as vx
from quire.operators.arrow import add_columns
from quire.operators.hooks import Scorer, lexical_overlap
from quire.session import checkpoint, small_batches, small_side

# Defaults and limits of a search request.
DEFAULT_K, MAX_K = 10, 50
DEFAULT_THRESHOLD, FALLBACK_THRESHOLD = 0.65, 0.5

DIGITS = 6
# Up to this many queries are shipped to every task (4096 x 1536 doubles are 48 MB);
# more than that are met through shuffled blocks.
BROADCAST_QUERIES = 4096
# Rows of one side in one shuffled block.
BLOCK_CHUNKS, BLOCK_QUERIES = 20_000, 4096
# Rows and queries multiplied at once: a tile of products is 4 MB, whatever a block holds.
_TILE, _QUERY_TILE = 1024, 512


def search_arguments(k: int | None = None, threshold: float | None = None, user_id=None, vector=None,
                     max_k: int = MAX_K) -> tuple[int, float]:
    """Check a request and fill in defaults; the number of results is capped at max_k."""
    if vector is not None and len(vector) == 0:
        raise ValueError("query embedding is required")
    if user_id is not None and str(user_id).strip() == "":
        raise ValueError("user id is required")
    if k and not 1 <= k <= max_k:
        raise ValueError(f"k must be between 1 and {max_k}")
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError("similarity threshold must be between 0 and 1")
    return capped_k(k, max_k), DEFAULT_THRESHOLD if threshold is None else threshold


def capped_k(k: int | None, max_k: int = MAX_K) -> int:
    return min(k or DEFAULT_K, max_k)


def vector_search(chunks: DataFrame, query_vector, user_id, threshold: float = 0.7, k: int = 10,
                  document_ids=None, documents: DataFrame | None = None, dimensions: int | None = None) -> DataFrame:
    """Exact search for one vector: pushed-down filters, then a per-partition top k.

    document_ids: None means all of the user's documents, an empty list none. With `dimensions`
    (those of the stored vectors) the query vector is cut or padded to them first.
    File names are joined to the k hits, not to the chunks.
    """
    k, threshold = search_arguments(k, threshold, user_id, query_vector)
    if dimensions is not None:
        query_vector = [*query_vector, *[0.0] * dimensions][:dimensions]
    rows = chunks.filter((F.col("user_id") == user_id) & F.col("embedding").isNotNull())
    if document_ids is not None:
        rows = rows.filter(F.col("document_id").isin(sorted({d for d in document_ids if d is not None})))
    cosine = vx.cosine_similarity(F.col("embedding"), vx.literal_vector(query_vector))
    # as an array of one: the optimiser copies a plain column into the filter and computes it twice
    kept = F.filter(F.array(F.round(cosine, DIGITS)), lambda s: s >= threshold)
    hits = (
        rows.withColumn("similarity", F.explode(kept)).drop("embedding")
        .orderBy(F.desc("similarity"), "chunk_id").limit(k)
    )
    return attach_filename(hits, documents) if documents is not None else hits


def attach_filename(hits: DataFrame, documents: DataFrame, small: bool = True) -> DataFrame:
    """Add the file name of each hit; with `small` the hits (at most k rows a search) are broadcast."""
    names = documents.select("document_id", F.col("filename").alias("document_name"))
    return names.join(F.broadcast(hits) if small else hits, "document_id")


# --- block kernel ----------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    """A list column as a row-normalised matrix; rows of zeros stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError("vectors must have the same length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _products(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray):
    """Rounded similarities, tile by tile: place of the tile's first query, ids of its rows, queries x rows."""
    if len(ids) and rows.shape[1] != queries.shape[1]:
        raise ValueError("vectors must have the same length")
    for at in range(0, len(ids), _TILE):
        part, names = rows[at:at + _TILE], ids[at:at + _TILE]
        for first in range(0, len(query_ids), _QUERY_TILE):
            sims = queries[first:first + _QUERY_TILE] @ part.T
            yield first, names, np.round(sims, DIGITS, out=sims)


class _Best:
    """The best k rows of every query seen so far, exact under ties."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float, skip_self: bool):
        self.ids, self.queries, self.k, self.threshold = query_ids, queries, k, threshold
        self.skip_self = skip_self
        self.floor = np.full(len(query_ids), threshold)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for first, names, sims in _products(self.ids, self.queries, ids, rows):
            if self.skip_self:
                sims[self.ids[first:first + len(sims), None] == names[None, :]] = -2.0
            floor = self.floor[first:first + len(sims)]
            if sims.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(sims, -self.k, axis=1)[:, -self.k])
            q, c = np.nonzero(sims >= floor[:, None])
            if len(q):
                self.parts.append((q + first, names[c], sims[q, c]))
                self.held += len(q)
            if self.held > 4 * self.k * len(self.ids) + 100_000:
                self._compact()

    def _compact(self):
        q, names, sims = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((names, -sims, q))
        q, names, sims = q[order], names[order], sims[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.k
        q, names, sims = q[keep], names[keep], sims[keep]
        full = np.bincount(q, minlength=len(self.ids)) == self.k
        lowest = np.full(len(self.ids), np.inf)
        np.minimum.at(lowest, q, sims)
        self.floor = np.where(full, np.maximum(self.floor, lowest), self.floor)
        self.parts, self.held = [(q, names, sims)], len(q)

    def result(self) -> list[np.ndarray]:
        """query_id, chunk_id and similarity of the best."""
        if not self.parts:
            return [self.ids[:0], self.ids[:0], np.empty(0)]
        self._compact()
        q, names, sims = self.parts[0]
        return [self.ids[q], names, sims]


class _Closest:
    """Of every query seen so far the similarity of its closest other row, and its close pairs with larger ids."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, limit: float):
        self.ids, self.queries, self.limit = query_ids, queries, limit
        self.best, self.pairs = np.full(len(query_ids), -2.0), np.zeros(len(query_ids), np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for first, names, sims in _products(self.ids, self.queries, ids, rows):
            here = slice(first, first + len(sims))
            mine = self.ids[here, None]
            sims[mine == names[None, :]] = -2.0
            self.best[here] = np.maximum(self.best[here], sims.max(axis=1))
            q, c = np.nonzero(sims >= self.limit)  # every pair is met from both sides and counted from one
            np.add.at(self.pairs, q + first, self.ids[q + first] < names[c])

    def result(self) -> list[np.ndarray]:
        """query_id, similarity and number of pairs, of queries that met another row."""
        met = self.best > -2.0
        return [self.ids[met], self.best[met], self.pairs[met]]


def _values(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _add_rows(best, rows: pa.Table, ids: str, vectors: str) -> None:
    """Add a block's rows some tiles at a time: only those are held as doubles, beside the block itself."""
    for at in range(0, rows.num_rows, 2 * _TILE):
        part = rows.slice(at, 2 * _TILE)
        best.add(_values(part.column(ids)), _matrix(part.column(vectors)))


def _hits(schema: pa.Schema, found) -> pa.Table:
    if len(found[0]) == 0:
        return schema.empty_table()
    return pa.table([pa.array(values, field.type) for values, field in zip(found, schema)], schema=schema)


def batched_search(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                   threshold: float = DEFAULT_THRESHOLD, scope: tuple[str, ...] = ("user_id",),
                   skip_self: bool = False, broadcast_limit: int = BROADCAST_QUERIES) -> DataFrame:
    """Exact top k of every query among the chunks with equal `scope` columns.

    chunks: chunk_id, embedding, scope; queries: query_id, embedding, scope.
    A scope column that is null equals nothing, on either side: such rows take no part. Queries' scope
    values are read as the type they have in the chunks; what cannot be read so meets nothing.
    Returns query_id, chunk_id, similarity, rank.
    """
    if k < 1 or not -1 <= threshold <= 1:
        raise ValueError("k must be positive and the threshold a cosine")
    given = [F.col(c).try_cast(chunks.schema[c].dataType).alias(c) for c in scope]
    chunks = chunks.dropna(subset=["embedding", *scope])
    queries = queries.select("query_id", "embedding", *given).dropna(subset=["embedding", *scope])
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])

    def make(ids, rows):
        return _Best(ids, rows, k, threshold, skip_self)

    return ranked(_met(chunks, queries, schema, scope, broadcast_limit, make), k)


def _met(chunks: DataFrame, queries: DataFrame, schema: T.StructType, scope: tuple[str, ...], broadcast_limit: int,
         make) -> DataFrame:
    """What make(query ids, query vectors) finds once every chunk in the queries' scope was added to it, block by block."""
    small_batches(chunks.sparkSession)
    # quoted and in a fixed order, so that no two lists of values share a cell
    cell = F.to_json(F.struct(*scope)) if scope else F.lit("")
    queries = queries.select("query_id", "embedding", *scope, cell.alias("_cell"))
    few = queries.limit(broadcast_limit + 1).toArrow()
    slim = (F.col("chunk_id"), F.col("embedding"), cell.alias("_cell"))
    if few.num_rows <= broadcast_limit:
        return _against_broadcast(_in_scope(chunks, few, scope).select(*slim), few, schema, make)
    return _against_blocks(chunks.select(*slim), queries, schema, make)


def _in_scope(chunks: DataFrame, queries: pa.Table, scope, limit: int = 500) -> DataFrame:
    """Only chunks with scope values some query has: plain filters, which the scan and its partitions can use.

    They drop nothing that a query could meet, so rows are the same with and without them.
    """
    for column in scope:
        values = queries.column(column).unique().to_pylist()
        if len(values) <= limit:
            chunks = chunks.filter(F.col(column).isin(values))
    return chunks


def ranked(hits: DataFrame, k: int, score: str = "similarity") -> DataFrame:
    """rank 1..k per query, best first, ties to the smaller chunk id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _against_broadcast(chunks, queries: pa.Table, schema, make):
    spark = chunks.sparkSession
    cells = _values(queries.column("_cell"))
    matrix = _matrix(queries.column("embedding")) if queries.num_rows else np.empty((0, 0))
    shared = {
        cell: (_values(queries.column("query_id"))[cells == cell], matrix[cells == cell])
        for cell in np.unique(cells)
    }
    handle = spark.sparkContext.broadcast(shared)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def run(batches):
        best = {cell: make(ids, rows) for cell, (ids, rows) in handle.value.items()}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cells, names = _values(batch.column("_cell")), _values(batch.column("chunk_id"))
            rows = _matrix(batch.column("embedding"))
            for cell in np.unique(cells):
                if cell in best:
                    mine = cells == cell
                    best[cell].add(names[mine], rows[mine])
        for one in best.values():
            yield from _hits(arrow, one.result()).to_batches()

    return chunks.mapInArrow(run, schema)


def _against_blocks(chunks, queries, schema, make):
    """Blocks of chunks meet blocks of queries; a cell of any size is split on both sides."""
    sizes = (
        chunks.groupBy("_cell").agg(F.count("*").alias("_nc"))
        .join(queries.groupBy("_cell").agg(F.count("*").alias("_nq")), "_cell")
        .select("_cell", F.ceil(F.col("_nc") / BLOCK_CHUNKS).cast("int").alias("_s"),
                F.ceil(F.col("_nq") / BLOCK_QUERIES).cast("int").alias("_t"))
    )

    def spread(df, key, own, other, mine, every):
        # every column gets a fresh alias: both sides may stem from one table
        return df.join(sizes, "_cell").select(
            F.col(key).alias(f"{key}_"), F.col("embedding").alias(f"{key}_vector"),
            F.col("_cell").alias(f"_cell{own}"),
            F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(every),
        )

    left = spread(chunks, "chunk_id", "_s", "_t", "_sb", "_tb")
    right = spread(queries, "query_id", "_t", "_s", "_tq", "_sq")
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or asked.num_rows == 0:
            return arrow.empty_table()
        best = make(_values(asked.column("query_id_")), _matrix(asked.column("query_id_vector")))
        _add_rows(best, rows, "chunk_id_", "chunk_id_vector")
        return _hits(arrow, best.result())

    return (
        left.groupBy("_cell_s", "_sb", "_tb")
        .cogroup(right.groupBy("_cell_t", "_sq", "_tq"))
        .applyInArrow(run, schema)
    )


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[
        kind.simpleString()
    ]


# --- variants ---------------------------------------------------------------------

def search_with_fallback(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                         threshold: float = DEFAULT_THRESHOLD, fallback: float = FALLBACK_THRESHOLD,
                         **options) -> DataFrame:
    """Hits at the threshold; a query without any gets its hits at the fallback. One pass."""
    k, threshold = search_arguments(k, threshold)
    hits = batched_search(chunks, queries, k, min(threshold, fallback), **options)
    if threshold <= fallback:
        return hits
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    lowest = F.when(best >= threshold, threshold).otherwise(fallback)
    return hits.withColumn("_lowest", lowest).filter(F.col("similarity") >= F.col("_lowest")).drop("_lowest")


def merge_searches(hits: DataFrame, k: int = DEFAULT_K, request: str = "request_id") -> DataFrame:
    """One list per request from the lists of its queries: best similarity a chunk, top k."""
    best = hits.groupBy(request, "chunk_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy(request).orderBy(F.desc("similarity"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= capped_k(k))


def search_and_rerank(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                      threshold: float = DEFAULT_THRESHOLD, scorer: Scorer = lexical_overlap,
                      **options) -> DataFrame:
    """Fetch 3k candidates, score question text against chunk text, keep k."""
    k, threshold = search_arguments(k, threshold)
    hits = batched_search(chunks.drop("chunk_text"), queries.drop("query_text"), 3 * k, threshold, **options)
    found = small_side(checkpoint(hits.drop("rank")))
    scored = (
        chunks.select("chunk_id", "chunk_text").join(found, "chunk_id")
        .join(queries.select("query_id", "query_text"), "query_id")
        .withColumn("score", F.round(scorer(F.col("query_text"), F.col("chunk_text")), DIGITS))
        .drop("query_text", "chunk_text")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def closest_others(vectors: DataFrame, scope: tuple[str, ...] = (), **options) -> DataFrame:
    """Each vector's most similar other vector: enough to tell whether all pairs are distinct."""
    asked = vectors.withColumnRenamed("chunk_id", "query_id")
    return (
        batched_search(vectors, asked, 1, -1.0, scope=scope, skip_self=True, **options)
        .select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("closest_id"), "similarity")
    )


def closest_others(vectors: DataFrame, scope: tuple[str, ...] = (), **options) -> DataFrame:
    """Each vector's most similar other vector."""
    asked = vectors.withColumnRenamed("chunk_id", "query_id")
    return (
        batched_search(vectors, asked, 1, -1.0, scope=scope, skip_self=True, **options)
        .select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("closest_id"), "similarity")
    )


def distinctness(vectors: DataFrame, limit: float = 0.99, broadcast_limit: int = BROADCAST_QUERIES) -> DataFrame:
    """One row: vectors, pairs, highest pair similarity, and whether every pair is below the limit.

    `vectors_with_copies` counts vectors, `close_pairs` pairs that reach the limit; pairs are counted block by block
    and never become rows.
    """
    rows = vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    schema = T.StructType([
        T.StructField("query_id", rows.schema["chunk_id"].dataType), T.StructField("similarity", T.DoubleType()),
        T.StructField("pairs", T.LongType()),
    ])
    met = _met(rows, rows.withColumnRenamed("chunk_id", "query_id"), schema, (), broadcast_limit,
               lambda ids, matrix: _Closest(ids, matrix, limit))
    closest = met.groupBy("query_id").agg(F.max("similarity").alias("similarity"), F.sum("pairs").alias("pairs"))
    best = closest.agg(
        F.max("similarity").alias("max_similarity"),
        F.count_if(F.col("similarity") >= limit).alias("vectors_with_copies"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("close_pairs"),
    )
    return best.withColumn("vectors", rows.agg(F.count("*")).scalar()).select(
        "vectors",
        F.floor(F.col("vectors") * (F.col("vectors") - 1) / 2).alias("pairs"),
        "max_similarity", "vectors_with_copies", "close_pairs",
        (F.coalesce(F.col("max_similarity"), F.lit(-1.0)) < limit).alias("all_distinct"),
    )


def search_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.min("similarity").alias("min_similarity"),
        F.round(F.avg("similarity"), DIGITS).alias("avg_similarity"),
        F.max("similarity").alias("max_similarity"),
    )


# --- inverted lists -------------------------------------------------------------------

class InvertedLists:
    """Vectors grouped by nearest centroid; a search looks into the nearest few lists only."""

    def __init__(self, lists: int = 100, probes: int = 10, seed: int = 7):
        self.lists, self.probes, self.seed = lists, probes, seed
        self.centroids: np.ndarray | None = None

    def fit(self, chunks: DataFrame) -> "InvertedLists":
        """Centroids from all rows; every row is assigned later, none is left out."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = chunks.filter(F.col("embedding").isNotNull())
        total = rows.count()
        points = rows.select(array_to_vector(vx.l2_normalise(F.col("embedding"))).alias("features"))
        model = KMeans(k=max(1, min(self.lists, total)), seed=self.seed, maxIter=10).fit(points)
        self.centroids = np.array(model.clusterCenters())
        return self

    def _nearest(self, rows: DataFrame, n: int, out: str) -> DataFrame:
        """Add the n lists with the most similar centroids, nearest first."""
        centroids = self.centroids
        unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            if batch.num_rows == 0:
                return [pa.array([], pa.list_(pa.int32()))]
            order = np.argsort(-(_matrix(batch.column("embedding")) @ unit.T), axis=1, kind="stable")[:, :n]
            offsets = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel().astype(np.int32)))]

        return add_columns(rows, f"{out} array<int>", make)

    def assign(self, chunks: DataFrame) -> DataFrame:
        """Add list_id; write the result partitioned by it so that probes prune files."""
        rows = self._nearest(chunks.filter(F.col("embedding").isNotNull()), 1, "_lists")
        return rows.withColumn("list_id", F.col("_lists")[0]).drop("_lists")

    def search(self, assigned: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
               threshold: float = DEFAULT_THRESHOLD, scope: tuple[str, ...] = ("user_id",), **options) -> DataFrame:
        return batched_search(assigned, self.probed(queries), k, threshold, (*scope, "list_id"), **options)

    def probed(self, queries: DataFrame) -> DataFrame:
        """Queries with list_id, one row a probed list; those without an embedding probe none."""
        probes = min(self.probes, len(self.centroids))
        rows = self._nearest(queries.filter(F.col("embedding").isNotNull()), probes, "_lists")
        return rows.withColumn("list_id", F.explode("_lists")).drop("_lists")


def index_advice(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per user: whether there is anything to search, and hints from the data volume."""
    d = documents.groupBy("user_id").agg(F.count("*").alias("documents"))
    c = chunks.groupBy("user_id").agg(F.count("*").alias("chunks"))
    both = d.join(c, "user_id", "full").select(
        "user_id", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
    )
    hints = F.array_compact(F.array(
        F.when(F.col("chunks") > 10000, "tune the vector index for a large set"),
        F.when(F.col("chunks") > 10000, "cache results of frequent searches"),
        F.when(F.try_divide("chunks", "documents") > 500, "many chunks a document: adjust the chunk size"),
    ))
    return both.withColumn("indexed", (F.col("chunks") > 0) | (F.col("documents") > 0)).withColumn("hints", hints)

"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments; each segment is summed up by its mean and deviation. For two vectors these bound the
squared distance from below, segment by segment: size * ((mean - mean')^2 + (dev - dev')^2); and as the statistics hold
the vectors' lengths exactly, they bound the inner product from above by size * (mean mean' + dev dev'). Candidates are
sifted with few segments, then with more, and what is left is worked out exactly in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import stored
from quire.session import ship

K = 5
LEVELS = (4, 16)     # segments, coarse to fine
BLOCK = 2048         # candidates, and queries, handled as one matrix
PAIRS = 1 << 12      # survivors whose exact scores are worked out at once
LARGEST = 1 << 22    # vectors with components beyond this are worked out apart, in 64 bits or whole numbers of any size
SAFE = float(1 << 62)  # sums below this, also as 64-bit floats tell them, are exact in 64 bits
MOST = (1 << 63) - 1


def whole_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """uid, vec_id, dim, wide, values of the rows that take part.

    Values are 32-bit whole numbers, floor(256 x) of each component; of a wide vector, which has one beyond LARGEST, they
    are the components themselves as 64-bit floats.
    """
    ship(df.sparkSession)
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"),
                     F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten()
            given = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = ~np.isfinite(given)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(256 * given)
            large = ~(np.abs(whole) <= LARGEST)
            ends = np.cumsum(np.append(0, pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))
            wrong = np.append(0, np.cumsum(bad))
            good = np.flatnonzero(wrong[ends[1:]] == wrong[ends[:-1]])
            beyond = np.append(0, np.cumsum(large))
            wide = beyond[ends[1:]] > beyond[ends[:-1]]
            whole, given = np.where(large, 0, whole).astype("<i4"), given.astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["uid", "vec_id"]).take(pa.array(good)).columns,
                 pa.array((ends[1:] - ends[:-1])[good], pa.int32()), pa.array(wide[good]),
                 pa.array([(given if wide[i] else whole)[ends[i]:ends[i + 1]].tobytes() for i in good], pa.binary())],
                names=["uid", "vec_id", "dim", "wide", "values"])

    return rows.mapInArrow(run, "uid long, vec_id long, dim int, wide boolean, values binary")


def _blocks(vectors: DataFrame) -> DataFrame:
    """dim, n, uids, ids, matrix: rows of equal dimension, up to BLOCK together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int, rows: list) -> pa.RecordBatch:
            uids, ids, values = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()),
                 pa.array([np.array(uids, "<i8").tobytes()], pa.binary()),
                 pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(values)], pa.binary())],
                names=["dim", "n", "uids", "ids", "matrix"])

        for batch in batches:
            for uid, vec_id, dim, values in zip(*[c.to_pylist() for c in batch.columns]):
                rows = held.setdefault(dim, [])
                rows.append((uid, vec_id, values))
                if len(rows) == BLOCK:
                    yield block(dim, held.pop(dim))
        for dim, rows in held.items():
            yield block(dim, rows)

    return (vectors.select("uid", "vec_id", "dim", "values")
            .mapInArrow(run, "dim int, n int, uids binary, ids binary, matrix binary"))


def statistics(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its size: inner products of these are the bounds."""
    parts = np.array_split(matrix.astype(np.float64), min(segments, max(matrix.shape[1], 1)), axis=1)
    parts = [p for p in parts if p.shape[1]]
    if not parts:
        return np.zeros((len(matrix), 1))
    roots = [math.sqrt(p.shape[1]) for p in parts]
    return np.stack([r * p.mean(axis=1) for r, p in zip(roots, parts)] + [r * p.std(axis=1) for r, p in zip(roots, parts)], axis=1)


def best_of(queries: np.ndarray, query_uids: np.ndarray, rows: np.ndarray, row_uids: np.ndarray, ids: np.ndarray,
            floor: np.ndarray, k: int = K, levels: tuple = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, row index and score of each query's best k rows that reach its `floor`, which is raised in place."""
    found: list[tuple] = []
    mine = [statistics(queries, s) for s in levels]
    theirs = [statistics(rows, s) for s in levels]
    # 64-bit floats hold whole numbers below 2^53 exactly, and multiply faster
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    wide = np.float64 if largest < 1 << 53 else np.int64
    wide_q, wide_r = queries.astype(wide), rows.astype(wide)
    few = min(2 * k, len(rows))
    for at in range(0, len(queries), 256):
        part = slice(at, min(at + 256, len(queries)))
        own = query_uids[part, None] == row_uids[None, :]
        bound = mine[0][part] @ theirs[0].T
        bound[own] = -np.inf
        slack = 1e-9 * (1 + np.abs(bound[np.isfinite(bound)]).max(initial=0))
        # Exact scores of the most promising rows give each query a score that k rows reach.
        first = np.argpartition(-bound, few - 1, axis=1)[:, :few]
        scores = np.einsum("qd,qrd->qr", wide_q[part], wide_r[first]).astype(np.float64)
        scores[np.take_along_axis(own, first, axis=1)] = -np.inf
        if few >= k:
            floor[part] = np.maximum(floor[part], -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        left = (bound >= floor[part, None] - slack) & ~own
        for own_stats, row_stats in zip(mine[1:], theirs[1:]):
            left &= own_stats[part] @ row_stats.T >= floor[part, None] - slack
        q, r = np.nonzero(left)
        exact = np.zeros(len(q), np.int64)
        for i in range(0, len(q), PAIRS):
            piece = slice(i, i + PAIRS)
            exact[piece] = np.einsum("nd,nd->n", wide_q[q[piece] + at], wide_r[r[piece]])
        near = exact >= floor[q + at]  # k rows reach the floor, so only those that reach it need an order
        q, r, exact = q[near], r[near], exact[near]
        order = np.lexsort((ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        last = rank == k - 1
        floor[q[last] + at] = np.maximum(floor[q[last] + at], exact[last])
        found.append((q[keep] + at, r[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _whole(x: float) -> int:
    """floor(256 x) of a finite x, of any size."""
    return math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x)


def _exact(matrix: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray, list[list[int]] | np.ndarray]:
    """Magnitudes as floats, 64-bit whole numbers (0 in rows that do not fit), and whole numbers of any size, row by row."""
    if len(matrix) == 4 * n * dim:
        small = np.frombuffer(matrix, "<i4").reshape(n, dim).astype(np.int64)
        return np.abs(small).astype(np.float64), small, small
    given = np.frombuffer(matrix, "<f8").reshape(n, dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(256 * given)
    sizes = np.abs(scaled)
    fits = (sizes < SAFE).all(axis=1)
    return sizes, np.where(fits[:, None], scaled, 0).astype(np.int64), [[_whole(x) for x in row] for row in given.tolist()]


def best_of_wide(queries: tuple, query_uids: np.ndarray, rows: tuple, row_uids: np.ndarray, ids: np.ndarray,
                 k: int = K) -> Iterator[tuple[int, int, int]]:
    """Query index, row index and exact score, of any size, of each query's best k rows; both sides from `_exact`."""
    for q, own in enumerate(query_uids):
        with np.errstate(over="ignore", invalid="ignore"):
            fits = (rows[0] @ queries[0][q] < SAFE) & (rows[0] < SAFE).all(axis=1) & (queries[0][q] < SAFE).all()
        scores = (rows[1] @ queries[1][q]).tolist()
        values = [int(v) for v in queries[2][q]]
        for r in np.flatnonzero(~fits):
            scores[r] = sum(int(a) * b for a, b in zip(rows[2][r], values))
        for r in heapq.nsmallest(k, np.flatnonzero(row_uids != own).tolist(), key=lambda r: (-scores[r], ids[r])):
            yield q, r, scores[r]


def ordinal(score: int) -> str:
    """Equal for all scores that fit in 64 bits; puts those beyond in their order among and around them."""
    if -MOST - 1 <= score <= MOST:
        return "5"
    digits = f"{abs(score):x}"  # hexadecimal, as a decimal may have no more than some thousand digits
    line = f"{len(digits):08x}{digits}"
    return "6" + line if score > 0 else "4" + "".join(f"{15 - int(c, 16):x}" for c in line) + "~"


def wide_hits(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """uid, query_id, vec_id, score, ordinal: each query's best k of these rows, for vectors of any size."""
    asked = _blocks(queries).toDF("dim", "q_n", "q_uids", "q_ids", "q_matrix")
    pairs = _blocks(rows).join(asked, "dim").repartition(F.xxhash64("uids", "q_uids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, n, uids, ids, matrix, q_n, q_uids, q_ids, q_matrix in zip(*[batch.column(c).to_pylist() for c in (
                    "dim", "n", "uids", "ids", "matrix", "q_n", "q_uids", "q_ids", "q_matrix")]):
                uids, ids, q_ids, own = (np.frombuffer(x, "<i8") for x in (uids, ids, q_ids, q_uids))
                found = list(best_of_wide(_exact(q_matrix, q_n, dim), own, _exact(matrix, n, dim), uids, ids, k))
                q, r, scores = zip(*found) if found else ((), (), ())
                q, r = np.array(q, np.int64), np.array(r, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[q]), pa.array(q_ids[q]), pa.array(ids[r]),
                     pa.array([max(-MOST - 1, min(MOST, s)) for s in scores], pa.int64()),
                     pa.array([ordinal(s) for s in scores], pa.string())],
                    names=["uid", "query_id", "vec_id", "score", "ordinal"])

    return pairs.mapInArrow(search, "uid long, query_id long, vec_id long, score long, ordinal string")


def top_products(df: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k largest inner products with all other rows of its dimension.

    `is_query` is a condition on vec_id. Scores are of floor(256 x); ties go to the smaller vec_id. Vectors that are
    null or hold a null or a non-finite component, and rows without vec_id take no part. Components may be of any size; a
    score that does not fit in 64 bits is ranked by its exact value and shown as the nearest number that does.
    Rows that repeat a vec_id are rows of their own: each is a query, and a candidate for the others.
    Blocks of candidates stay in one place each; blocks of queries are sent to every place, one copy a task, not a row.
    """
    spark = df.sparkSession
    every = stored(whole_vectors(df, vec_id, embedding), "vectors")
    vectors, wide = every.where(~F.col("wide")), every.where("wide")
    asked = vectors.where(is_query(F.col("vec_id")))
    rows = stored(_blocks(vectors), "blocks")
    places = max(1, min(rows.count(), 4 * spark.sparkContext.defaultParallelism))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("uids"), F.lit(places)))
    queries = _blocks(asked.repartition(max(1, math.ceil(asked.count() / BLOCK))))
    queries = queries.select("dim", F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"),
                             F.col("matrix").alias("q_matrix"),
                             F.explode(F.sequence(F.lit(0), F.lit(places - 1)).cast("array<long>")).alias("place"))
    pairs = rows.join(queries, ["dim", "place"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for dim, uids, ids, matrix, q_uids, q_ids, q_matrix in zip(
                    *[batch.column(c).to_pylist() for c in ("dim", "uids", "ids", "matrix", "q_uids", "q_ids", "q_matrix")]):
                uids, ids, q_ids, own = (np.frombuffer(x, "<i8") for x in (uids, ids, q_ids, q_uids))
                if q_uids not in floors:
                    if len(floors) >= 64:
                        floors.clear()
                    floors[q_uids] = np.full(len(own), -np.inf)
                q, r, score = best_of(np.frombuffer(q_matrix, "<i4").reshape(len(own), dim), own,
                                      np.frombuffer(matrix, "<i4").reshape(len(uids), dim), uids, ids, floors[q_uids], k)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(q_ids[q]), pa.array(ids[r]), pa.array(score)],
                                                 names=["uid", "query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(search, "uid long, query_id long, vec_id long, score long")
    hits = hits.withColumn("ordinal", F.lit("5"))
    if not wide.isEmpty():
        hits = (hits.unionAll(wide_hits(wide, every.where(is_query(F.col("vec_id"))), k))
                .unionAll(wide_hits(vectors, wide.where(is_query(F.col("vec_id"))), k)))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.desc("ordinal"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

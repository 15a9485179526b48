"""Importance resampling towards a target: hashed 1- to 3-grams, gains by bucket, and a draw by Gumbel scores.

The bucket of a feature is its crc32, taken for many features at once. CRC is linear: a span's value is the XOR of one
table entry for each byte, picked by the byte and its distance from the end, and of a constant of the span's length. Spans
beyond the table are cut into blocks from their end, each block is moved on by the zero bytes behind it, and the blocks
of a span are folded together.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii, numbered, pieces, stored, with_text_results
from quire.session import ship

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
BLOCK = 64  # distances from the end that the table holds
CHUNK = 64 << 10  # bytes of words whose features are worked out at once

_ONES = 0xFFFFFFFF
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contribution of each byte (column) at each distance (row), constants of lengths 0 to BLOCK, moves by 2^k bytes."""
    by_place = np.zeros((BLOCK, 256), np.uint32)
    lengths = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)
    for d in range(BLOCK):
        by_place[d] = [zlib.crc32(bytes([b]) + bytes(d)) ^ int(lengths[d + 1]) for b in range(256)]
    # moves[k, j, b]: byte b at place j of a value, moved on by 2^k zero bytes
    moves = np.zeros((32, 4, 256), np.uint32)
    values = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None])
    moves[0] = by_place[0][values & 255] ^ (values >> 8)
    for k in range(1, 32):
        moves[k] = _move(moves[k - 1], moves[k - 1])
    return by_place.ravel(), lengths, moves


def _move(values: np.ndarray, move: np.ndarray) -> np.ndarray:
    return move[0][values & 255] ^ move[1][values >> 8 & 255] ^ move[2][values >> 16 & 255] ^ move[3][values >> 24]


def _moved(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each value moved on by its own count of zero bytes."""
    values, moves = values.copy(), _tables()[2]
    for k in range(int(counts.max(initial=0)).bit_length()):
        at = np.flatnonzero(counts >> k & 1)
        values[at] = _move(values[at], moves[k])
    return values


def _folded(line: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span's bytes; no span is empty or longer than the table."""
    by_place = _tables()[0]
    sizes = ends - begins
    after = np.cumsum(sizes)
    at = np.arange(int(after[-1]) if len(after) else 0) + np.repeat(begins - after + sizes, sizes)
    place = np.repeat(256 * (ends - 1), sizes)
    place -= 256 * at
    place += line[at]
    return np.bitwise_xor.reduceat(by_place[place], after - sizes) if len(after) else np.zeros(0, np.uint32)


def crc32_spans(line: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span [begin, end) of a line of bytes; no span is empty."""
    sizes, lengths = ends - begins, _tables()[1]
    found = np.zeros(len(sizes), np.uint32)
    short = sizes <= BLOCK
    at = np.flatnonzero(short)
    found[at] = _folded(line, begins[at], ends[at]) ^ lengths[sizes[at]]
    for i in np.array_split(np.flatnonzero(~short), int(sizes[~short].sum()) // (4 * CHUNK) + 1):
        if len(i):
            blocks = -(-sizes[i] // BLOCK)
            first = np.cumsum(blocks) - blocks
            behind = np.arange(int(blocks.sum())) - np.repeat(first, blocks)  # blocks between this one and the end
            end = np.repeat(ends[i], blocks) - BLOCK * behind
            begin = np.maximum(np.repeat(begins[i], blocks), end - BLOCK)
            parts = _moved(_folded(line, begin, end), BLOCK * behind)
            constant = _moved(np.full(len(i), _ONES, np.uint32), sizes[i]) ^ np.uint32(_ONES)
            found[i] = np.bitwise_xor.reduceat(parts, first) ^ constant
    return found


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of words: the text each word is in, the text each feature is in, and each feature's bucket."""
    raw = [lower_ascii(t) if t else b"" for t in texts]
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _WORD[buffer]
    edge = np.diff(inside, prepend=False)
    bounds = np.flatnonzero(edge)
    starts, sizes = bounds[::2], bounds[1::2] - bounds[::2]
    if not len(starts):
        return
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(text_ends, starts, side="right")
    inside[bounds[1::2]] = True  # one separator after each word
    line = buffer[inside]
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    line[ends] = 0x20
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + CHUNK, CHUNK), side="right"))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)]):
        if a == b:
            continue
        low, high, of = [], [], []
        for more in range(3):
            last = np.arange(a + more, min(b + more, len(ends)))
            last = last[owner[last - more] == owner[last]]
            low.append(begins[last - more])
            high.append(ends[last])
            of.append(owner[last])
        crc = crc32_spans(line, np.concatenate(low), np.concatenate(high))
        yield owner[a:b], np.concatenate(of), crc % BUCKETS


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Features in each bucket over all texts. Tasks add up their own; at most BUCKETS rows come to the driver."""
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                for _, _, bucket in features(texts):
                    total += np.bincount(bucket, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    counted = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "bucket int, n long")
    found = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row.bucket] = row.n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of target and source, rounded down, of each bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, keep: list[str], gain: np.ndarray, text: str = "text") -> DataFrame:
    """Columns `keep`, then n_words, n_features and weight of every row's whole text (null or no words: zeros)."""
    def start():
        def work(texts):
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for word_of, of, bucket in features(texts):
                n_words += np.bincount(word_of, minlength=len(texts))
                n_features += np.bincount(of, minlength=len(texts))
                weight += np.bincount(of, gain[bucket], len(texts)).astype(np.int64)
            return [n_words.tolist(), n_features.tolist(), weight.tolist()]

        return work

    return with_text_results(df, text, keep, "n_words long, n_features long, weight long", start)


def noise(doc_id: Column) -> Column:
    """Thousandths of a Gumbel value drawn by the id, rounded down; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit("42:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs`; rank is null where the row is not drawn.

    Of the rows with at least MIN_WORDS words, PERCENT of a hundred (rounded down) are drawn by score, ties to the smaller
    doc_id (null last), then to fewer features; rows alike in all columns may change places. Null or empty texts have no
    features, weight 0, and are not drawn. An empty target smooths to equal shares. Rows repeated in `docs` count each.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    weighed = weigh(docs, ["doc_id"], gain)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "weighed")
    may = F.col("n_words") >= MIN_WORDS
    drawn = scored.where(may).count() * PERCENT // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    # Ranges of scores are sorted by themselves and numbered on; only narrow rows move.
    sorted_rows = (scored.where(may).withColumn("__all__", F.lit(0)).repartitionByRange(*order)
                   .sortWithinPartitions(*order))
    rank = (F.col("__rank__") + 1).cast("long")
    ranked = (numbered(sorted_rows, ["__all__"], "ranked", "__rank__")
              .withColumn("rank", F.when(rank <= drawn, rank)))
    rest = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))

"""What the operators share: reading tables, shared storage, Arrow batches of bounded size, words, row numbers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.session import ensure_checkpoint_dir, ship, small_batches

# Bytes of text that a Python worker handles at once; a single longer text is handled alone.
BATCH_BYTES = 4 << 20

# Bytes of a Parquet row group, which is held whole.
ROW_GROUP_BYTES = 32 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read back: cuts lineage, survives lost executors.

    `DataFrame.checkpoint` would work out the rows twice, once for its action and once for its files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_text(value: Column) -> Column:
    """crc32 of a value written as text; a null counts as empty text."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")))


def pieces(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about `limit` bytes, each with the index of its first row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, texts.slice(begin, i - begin).to_pylist()
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, texts.slice(begin).to_pylist()


def schema_of(fields: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(fields) if isinstance(fields, str) else fields


def with_text_results(df: DataFrame, text: str, keep: list[str], result: str | T.StructType,
                      start: Callable[[], Callable[[list[str | None]], list[list]]], limit: int = BATCH_BYTES) -> DataFrame:
    """Columns `keep`, then the columns of `result`, worked out from whole texts.

    `start` runs once a task and returns a function from a list of texts, whole ones of about `limit` bytes together, to one
    list per result column. Only `keep` and
    `text` reach Python, the text once; a name used by both sides belongs to the result.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    made = schema_of(result)
    keep = [c for c in keep if c not in made.names]
    once = text in keep and isinstance(df.schema[text].dataType, T.StringType)
    read = text if once else "__text__"
    source = df.select(*[F.col(f"`{c}`") for c in keep],
                       *[] if once else [F.col(f"`{text}`").cast("string").alias("__text__")])
    out = T.StructType([source.schema[c] for c in keep] + list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = start()
        kinds = [to_arrow_type(f.dataType) for f in made]
        for batch in batches:
            kept = batch.select(keep) if keep else None
            for at, texts in pieces(batch.column(read), limit):
                found = [pa.array(v, t) for v, t in zip(work(texts), kinds)]
                same = kept.slice(at, len(texts)).columns if keep else []
                yield pa.RecordBatch.from_arrays([*same, *found], names=out.names)
        del work
        give_back()

    return source.mapInArrow(run, out)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, and holds what it had at its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_cleaned_text(df: DataFrame, text: str, made: str,
                      start: Callable[[], Callable[[list[str | None]], list[str | None]]]) -> DataFrame:
    """All columns, and in `made` what the function returned by `start` makes of each text; a null stays one.

    Only texts that change come back from Python; the others are taken from the row.
    """
    def changed():
        clean = start()
        return lambda texts: [[None if new == old else new for old, new in zip(texts, clean(texts))]]

    if made == text:
        return with_text_results(df, text, df.columns, f"{made} string", lambda: lambda t, clean=start(): [clean(t)])
    found = with_text_results(df, text, df.columns, f"{made} string", changed)
    return found.withColumn(made, F.coalesce(F.col(f"`{made}`"), F.col(f"`{text}`").cast("string")))


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


class WordHashes(dict):
    """64-bit hash of each word met. Forgets all when it holds `limit` words, so its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        import xxhash

        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._hash(word)
        return value


def numbered(df: DataFrame, keys: list[str], name: str, rank: str = "rank") -> DataFrame:
    """Add a gapless number from 0 within each value of `keys`, without gathering a key's rows in one task.

    Each task counts its own rows per key; the counts, one row per key and task, are summed up in task order and joined
    back. The rows are stored in between, so that both steps see the same order. Rows of a key that one task holds get
    consecutive numbers in that task's order.
    """
    ship(df.sparkSession)
    out = T.StructType([*df.schema, T.StructField("__task__", T.IntegerType()), T.StructField("__at__", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            at = []
            for key in zip(*[batch.column(k).to_pylist() for k in keys]):
                at.append(n := seen.get(key, 0))
                seen[key] = n + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([task] * len(at), pa.int32()), pa.array(at, pa.int64())], names=out.names)

    local = stored(df.mapInArrow(count, out), name)
    sums = local.groupBy(*keys, "__task__").agg(F.count(F.lit(1)).alias("__n__"))
    before = Window.partitionBy(*keys).orderBy("__task__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__task__").alias("__of__"),
                          F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__offset__"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__task__") == F.col("__of__")]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return (local.join(offsets, on).withColumn(rank, F.col("__offset__") + F.col("__at__"))
            .select(*df.columns, rank))

"""Running positions and totals that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import checkpoint


BLOCK_PAGES = 1024


def number_pieces(pages: DataFrame, make, pieces: str, block: int | None = None) -> DataFrame:
    """make(pages) adds an array column `pieces`; add `_offset`: pieces of the document before this page.

    Pages are summed in blocks of page numbers, so no task holds more than a block of one document,
    and everything is made once. Only documents that reach a second block are made again, without
    their texts leaving the task, to learn what their earlier blocks hold.
    """
    block = block or BLOCK_PAGES
    where = F.floor((F.col("page_number") - 1) / block)
    inside = (
        Window.partitionBy("document_id", "_block").orderBy("page_number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    n = F.size(pieces).cast("bigint")
    numbered = make(pages).withColumn("_block", where).withColumn(
        "_offset", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    long_ones = pages.filter(F.col("page_number") > block).select("document_id").distinct()
    if long_ones.isEmpty():
        return numbered.drop("_block")
    across = Window.partitionBy("document_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        make(pages.join(long_ones, "document_id", "left_semi")).withColumn("_block", where)
        .groupBy("document_id", "_block").agg(F.sum(n).alias("_n"))
        .select("document_id", "_block", F.sum("_n").over(across).alias("_before"))
    )
    return (
        numbered.join(before, ["document_id", "_block"], "left")
        .withColumn("_offset", F.col("_offset") + F.coalesce("_before", F.lit(0))).drop("_block", "_before")
    )


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range partitioned and sorted by (keys, order), with their partition as `_part`.

    `order` must tell all rows of a key apart: then partitions are of about equal size however
    the keys are distributed. The checkpoint fixes which row is where, also when a task runs again.
    """
    sort = [*keys, *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return checkpoint(ranged.withColumn("_part", F.spark_partition_id()))


def running_totals(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Running sums per key, in `order`, exact for keys of any size.

    Sums inside a partition come from a window per (key, partition); what lies before a
    partition from a scan over one row per (key, partition).
    """
    fixed = in_order(rows, keys, order)
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = fixed.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    before = sums.select(
        *keys, "_part",
        *[F.coalesce(F.sum(f"_s_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in values],
    )
    out = fixed.select("*", *[F.sum(v).over(inside).alias(f"_i_{n}") for n, v in values.items()])
    out = out.join(before, [*keys, "_part"])
    for n in values:
        out = out.withColumn(n, F.col(f"_i_{n}") + F.col(f"_b_{n}")).drop(f"_i_{n}", f"_b_{n}")
    return out.drop("_part")


def previous_in_order(rows: DataFrame, key: str, index: str, columns: list[str], block: int = 65536) -> DataFrame:
    """Each row with the values of the row before it (`prev_*`), blocks of the index scanned apart.

    Lag is taken per (key, block of the index); the first row of a block gets the last row of
    the nearest earlier block, found among one row per block.
    """
    rows = rows.withColumn("_block", F.floor(F.col(index) / block))
    order = [F.col(index)] + [F.col(c) for c in columns if c != index]
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    picked = F.struct(F.col(index), *[F.col(c) for c in columns if c != index])
    last = rows.groupBy(key, "_block").agg(F.max(picked).alias("_last"))
    carried = last.select(
        key, "_block", F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_carry")
    )
    out = (
        rows.withColumn("_lag", F.lag(picked).over(inside))
        .join(carried, [key, "_block"])
        .withColumn("_prev", F.coalesce("_lag", "_carry"))
    )
    for c in dict.fromkeys([index, *columns]):
        out = out.withColumn(f"prev_{c}", F.col("_prev")[c])
    return out.drop("_block", "_lag", "_carry", "_prev")

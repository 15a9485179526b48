"""Shards of equal size that keep linked documents together, by balanced label propagation.

Every document starts in a shard of its own hash. In each round the links' keys count their documents by shard, and
documents move towards the shard where most of their neighbours are, as far as the quotas allow. In the end shards are
filled up to exactly equal counts with documents that have no links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, stored

SHARDS = 8
ROUNDS = 8


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def propagate(links: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """row, key, size (documents of the key), shard. `links` has row and key; a row may have several keys.

    A round sends each row to the shard that most documents of its keys are in; ties go to the smaller shard. Where
    more want in than the quota allows, keys are let in by their hash, so that a key's documents move together. Keys
    larger than a shard are let in always; what is over is placed afterwards. Ends when nobody wants to move.
    """
    shards = len(capacity)
    sizes = links.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    state = stored(links.join(sizes, "key").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "labels")
    share = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1000))
    for _ in range(rounds):
        votes = state.groupBy("key").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"v{s}") for s in range(shards)])
        wish = (state.join(votes, "key").groupBy("row")
                .agg(F.first("shard").alias("now"), F.min(share).alias("share"), F.max("size").alias("largest"),
                     *[F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)]))
        best = F.greatest(*[F.struct(F.col(f"v{s}").alias("n"), F.lit(-s).alias("s")) for s in range(shards)])
        wish = stored(wish.select("row", "now", "share", "largest", (-best["s"]).alias("best")), "wishes")
        told = wish.groupBy("now", "best", "share", (F.col("largest") > min(capacity)).alias("huge")).count().collect()
        if not any(r.now != r.best for r in told):
            break
        # 8 x 8 x 1000 numbers at most: the share up to which each shard lets rows in.
        limits = []
        for s in range(shards):
            room = capacity[s] - sum(r["count"] for r in told if r.now == r.best == s and not r.huge)
            inflow: dict[int, int] = {}
            for r in told:
                if r.best == s and r.now != s and not r.huge:
                    inflow[r.share] = inflow.get(r.share, 0) + r["count"]
            limit = 0
            while limit < 1000 and room >= inflow.get(limit, 0):
                room -= inflow.get(limit, 0)
                limit += 1
            limits.append(limit)
        let_in = F.element_at(F.array(*map(F.lit, limits)), F.col("best") + 1)
        moved = wish.select("row", F.when((F.col("share") < let_in) | (F.col("largest") > min(capacity)), F.col("best"))
                            .otherwise(F.col("now")).alias("shard"))
        state = stored(state.drop("shard").join(moved, "row"), "labels")
    return state


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of `rows` (which have a unique `row`), shard and slot; shards' counts are at most one apart.

    `links` (row, key) says which rows belong together. Slots are numbered from 0 in each shard.
    """
    capacity = quotas(rows.count(), shards)
    labels = propagate(links, capacity)
    linked = labels.groupBy("row").agg(F.first("shard").alias("shard"), F.min("key").alias("key"), F.max("size").alias("size"))
    # Keys that no shard can hold stand last in theirs, so that they, and no others, are cut.
    linked = linked.withColumn("late", F.col("size") > min(capacity)).sortWithinPartitions("key")
    ranked = numbered(linked, ["shard", "late"], "ranked")
    counts = {(r.shard, r.late): r["count"] for r in ranked.groupBy("shard", "late").count().collect()}
    early = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(counts.get((s, False), 0)))])
    room = F.create_map(*[x for s in range(shards) for x in (F.lit(s), F.lit(capacity[s]))])
    ranked = ranked.withColumn("slot", F.col("rank") + F.when(F.col("late"), early[F.col("shard")]).otherwise(0))
    placed = ranked.where(F.col("slot") < room[F.col("shard")]).select("row", "shard", "slot")

    over = ranked.where(F.col("slot") >= room[F.col("shard")]).select("row", F.lit(0).alias("all"))
    free = rows.join(ranked.select("row"), "row", "left_anti").select("row", F.lit(0).alias("all"))
    over, free = numbered(over, ["all"], "over"), numbered(free, ["all"], "free")
    filler = over.select("row", "rank").unionAll(free.select("row", F.col("rank") + over.count()))
    # The emptiest shards first, so that what is left of a huge key is spread over few.
    held = {s: min(capacity[s], counts.get((s, False), 0) + counts.get((s, True), 0)) for s in range(shards)}
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in sorted(range(shards), key=lambda s: held[s] - capacity[s]):
        end = begin + capacity[s] - held[s]
        inside = (F.col("rank") >= begin) & (F.col("rank") < end)
        shard = F.when(inside, F.lit(s)).otherwise(shard)
        slot = F.when(inside, F.col("rank") - begin + held[s]).otherwise(slot)
        begin = end
    filled = filler.select("row", shard.alias("shard"), slot.alias("slot"))
    return rows.join(placed.select("row", F.col("shard").cast("int"), F.col("slot").cast("long")).unionAll(filled), "row")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents with equal texts are linked; law `rows`.

    A null text is as large as an empty one and linked with nothing. Repeated rows are rows of their own.
    """
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.unhex(F.md5("text")).alias("key")), "rows")
    links = rows.where(F.col("key").isNotNull()).select("row", "key")
    return balanced_shards(rows.drop("key"), links, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

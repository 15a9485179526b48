"""Near-duplicate documents with a MinHash LSH forest.

Documents with the same set of shingles become one node. Every node stands in several sorted orders, one a tree, of its
MinHash labels; nodes that share a long prefix of labels stand side by side. In each order a node meets its neighbours,
as long as they share at least two labels: in a crowded region the nearest ones share more, so the depth adapts to the
region. A sketch of the whole signature sifts the neighbours, and what it lets pass is confirmed on full shingle sets.

A node proposes its nearest fitting neighbour in each tree. Nodes that had more to propose come again in the next round,
with the components found so far, while half of the pairs are links. Then whole regions are gone through: all nodes that share two
labels in a tree and are in different components meet, however many they are, and propose ever more, at last all pairs
that the sketch lets pass. So neither the proposals of a node nor the reach of an order is a cap.

Many texts just below 75 % on one template would all meet there. Two such nodes either share a shingle that few of the
nodes have, and are proposed for it, or share only frequent shingles: of each of BUCKETS buckets of these at most as many as
the one with fewer of them has. If that cannot make 75 %, the pair need not be confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, give_back, lower_ascii, pieces, stored
from quire.llm.graphs import components
from quire.session import ship, small_batches, small_side

SHINGLE = 5
PERCENT = 75
TREES, DEPTH = 16, 8  # a tree orders nodes by 8 labels of 16 bits
LEAST_DEPTH = 2       # a pair at 75 % shares two labels in one of 16 trees but for 2 in a million
REACH = 512           # neighbours that a node meets in each order
PROPOSALS = 1         # pairs that a node proposes a tree and round
# The same when whole regions meet: few first, as their links spare most of the rest, and at last without a limit.
REST = (8, 64, None)
RARE = 64             # a shingle that at most so many of the nodes have proposes all their pairs
BUCKETS = 128         # by which more frequent shingles are counted
TILE = 4096           # nodes of a region that meet as many others in one place
# Of the 128 two-bit fields of a sketch, 104 agree on average at 75 %, with a deviation of 4.4: one in 300,000 has fewer than 84.
LEAST_AGREEING = 84

_HASHES = TREES * DEPTH
_ODD = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PAIRS_OF_BITS = np.uint64(0x5555555555555555)


def shingles(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; of the whole sequence, if it has fewer words."""
    words = lower_ascii(text).split() if text else []  # bytes.split() parts at x20 and x09-x0D
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    value = ids[:len(ids) - width + 1].copy()
    for i in range(1, width):
        value = value * _STEP + ids[i:len(ids) - width + 1 + i]
    value ^= value >> np.uint64(32)
    value *= _MIX
    value ^= value >> np.uint64(29)
    return np.unique(value + np.uint64(width))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over each set, one row a set; sets must not be empty."""
    out = np.zeros((len(sets), _HASHES), np.uint64)
    begin = 0
    while begin < len(sets):
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + len(sets[end]) <= 1 << 15):
            total += len(sets[end])
            end += 1
        part = np.concatenate(sets[begin:end])
        starts = np.cumsum([0, *map(len, sets[begin:end - 1])])
        space = np.empty_like(part)
        for i, odd in enumerate(_ODD):
            np.multiply(part, odd, out=space)
            out[begin:end, i] = np.minimum.reduceat(space, starts)
        begin = end
    return out


def labels_and_sketches(mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit labels in big-endian bytes, so that bytes sort as labels do, and two bits of each value in four words."""
    labels = (mins * _STEP >> np.uint64(48)).astype(">u2")
    bits = (mins * _MIX >> np.uint64(62)).reshape(len(mins), 4, 32)
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return labels, np.bitwise_or.reduce(bits << shifts, axis=2)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    data = np.ascontiguousarray(rows)
    width = data.dtype.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def sets_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, print (of the set), labels, sketch of every row; empty sets have null prints."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
                         F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at, texts in pieces(batch.column("text"), 1 << 20):
                sets = [shingles(t, known) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                mins = np.zeros((len(sets), _HASHES), np.uint64)
                if full:
                    mins[full] = signatures([sets[i] for i in full])
                labels, sketches = labels_and_sketches(mins)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), batch.column("text_hash").slice(at, len(texts)),
                     pa.array(list(map(len, sets)), pa.int64()), pa.array(prints, pa.binary()),
                     _binary(labels), _binary(sketches)],
                    names=["doc_id", "text_hash", "n_shingles", "print", "labels", "sketch"])
        known.clear()
        give_back()

    return source.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, print binary, labels binary, sketch binary")


def proposals(nodes: DataFrame) -> DataFrame:
    """a, b (a < b), more_a, more_b: pairs of neighbours in different components, and which have more to propose.

    A node with more to propose that is in no pair has a row with b null.

    `nodes` has node, component, labels, sketch.
    """
    width = 2 * DEPTH
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("labels", 1 + t * width, width).alias("key"))
                      for t in range(TREES)])
    rows = nodes.select(F.explode(trees).alias("at"), "node", "component", "sketch").select("at.*", "node", "component", "sketch")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Partitions are ranges of the orders: a crowded region is split at a deeper label.
    ordered = rows.repartitionByRange(n, "tree", "key").sortWithinPartitions("tree", "key", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            region = np.frombuffer(b"".join(k[:2 * LEAST_DEPTH] for k in batch.column("key").to_pylist()), ">u4")
            now = [region.astype(np.int64) * TREES + batch.column("tree").to_numpy(),
                   batch.column("node").to_numpy(), batch.column("component").to_numpy(),
                   np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, 4),
                   np.zeros(len(region), np.int64), np.zeros(len(region), bool)]
            old = 0 if carried is None else len(carried[0])
            if old:
                now = [np.concatenate(x) for x in zip(carried, now)]
            yield _pairs(now, old, REACH, PROPOSALS)
            regions = now[0]
            before = np.flatnonzero(regions != regions[-1])
            keep = min(len(regions) - (before[-1] + 1 if len(before) else 0), REACH)
            carried = [x[len(x) - keep:] for x in now]

    return (ordered.mapInArrow(meet, "a long, b long, more_a boolean, more_b boolean")
            .groupBy("a", "b").agg(F.max("more_a").alias("more_a"), F.max("more_b").alias("more_b")))


def rest(nodes: DataFrame, limit: int | None) -> DataFrame:
    """As `proposals`, of all nodes that share two labels in a tree, wherever they stand in its order.

    A pair counts in the first tree that brings it together. A region of n nodes is dealt out as tiles of about TILE by
    TILE nodes, each node in n / TILE of them. `limit` bounds what a node proposes in a tile; None proposes all pairs.
    Where `nodes` has also size and shared, pairs that could not reach 75 % by sharing these shingles are left out.
    """
    counts = [c for c in ("size", "shared") if c in nodes.columns]
    width = 2 * DEPTH
    heads = [F.substring("labels", 1 + t * width, 2 * LEAST_DEPTH) for t in range(TREES)]
    spots = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), h.alias("region")) for t, h in enumerate(heads)]))
    crowds = (nodes.select("component", spots.alias("at")).groupBy("at.tree", "at.region")
              .agg(F.min("component").alias("least"), F.max("component").alias("most"),
                   F.ceil(F.count(F.lit(1)) / TILE).alias("tiles")).where("least < most").select("tree", "region", "tiles"))
    rows = nodes.select(F.concat(*heads).alias("heads"), "node", "component", "sketch", *counts, spots.alias("at"))
    met = rows.select("at.*", "heads", "node", "component", "sketch", *counts).join(small_side(stored(crowds, "crowds")), ["tree", "region"])
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    met = (met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
           .select("tree", "region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                   F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
                   "heads", "node", "component", "sketch", *counts))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = ["tree", "region", "low", "high"]
    ordered = met.repartition(n, *tile).sortWithinPartitions(*tile)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
            known, (sides, firsts, trees), most = rows[:4], rows[4:7], rows[7:]
            return _pairs([*known, np.zeros(len(sides), np.int64), np.zeros(len(sides), bool)], 0, len(sides), limit,
                          (sides, firsts, trees), most)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            trees, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "low", "high"))
            region = np.frombuffer(b"".join(batch.column("region").to_pylist()), ">u4").astype(np.int64)
            now = [((region * TREES + trees << 13) + low << 13) + high, batch.column("node").to_numpy(),
                   batch.column("component").to_numpy(),
                   np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, 4),
                   batch.column("side").to_numpy(),
                   np.frombuffer(b"".join(batch.column("heads").to_pylist()), ">u4").reshape(-1, TREES), trees,
                   *[batch.column(c).flatten().to_numpy().reshape(-1, BUCKETS) if c == "shared" else batch.column(c).to_numpy()
                     for c in counts]]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            before = np.flatnonzero(now[0] != now[0][-1])
            end = before[-1] + 1 if len(before) else 0
            if end:
                yield pairs([x[:end] for x in now])
            held = [x[end:] for x in now]
        if held is not None:
            yield pairs(held)

    return (ordered.mapInArrow(meet, "a long, b long, more_a boolean, more_b boolean")
            .groupBy("a", "b").agg(F.max("more_a").alias("more_a"), F.max("more_b").alias("more_b")))


def _pairs(rows: list[np.ndarray], old: int, reach: int, limit: int | None, tiles: tuple | None = None,
           most: tuple | list = ()) -> pa.RecordBatch:
    """Pairs whose later row is not among the first `old`; counts what each row has proposed in rows[4].

    `tiles`, where regions are tiles, has each row's side (2 meets its own), labels that begin its trees, and tree.
    `most`, where known, has each row's number of shingles and how many of them, by bucket, a partner may share.
    """
    regions, nodes, parts, sketches, proposed, more = rows
    left, right = [], []
    told = more.copy()
    at = np.arange(len(regions))
    for offset in range(1, reach + 1):
        at = at[at + offset < len(regions)]
        at = at[regions[at] == regions[at + offset]]
        if not len(at):
            break
        one = at[at + offset >= old]
        two = one + offset
        other = parts[one] != parts[two]
        if tiles is not None:
            other &= (tiles[0][one] != tiles[0][two]) | (tiles[0][one] == 2)
        one, two = one[other], two[other]
        unlike = sketches[one] ^ sketches[two]
        agreeing = _HASHES - np.bitwise_count((unlike | unlike >> np.uint64(1)) & _PAIRS_OF_BITS).sum(axis=1)
        good = agreeing >= LEAST_AGREEING
        one, two = one[good], two[good]
        if tiles is not None and len(one):
            first = (tiles[1][one] == tiles[1][two]).argmax(axis=1) == tiles[2][one]
            one, two = one[first], two[first]
        if len(most) and len(one):
            sizes, shared = most
            common = np.minimum(shared[one], shared[two]).sum(axis=1)
            fit = 100 * common >= PERCENT * (sizes[one] + sizes[two] - common)
            one, two = one[fit], two[fit]
        if limit is not None:
            free = proposed[one] < limit
            more[one[~free]] = more[two[~free]] = True
            one, two = one[free], two[free]
        proposed[one] += 1
        left.append(one)
        right.append(two)
    left, right = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
    swap = nodes[left] > nodes[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    alone = more & ~told
    alone[left] = alone[right] = False
    none = int(alone.sum())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([nodes[left], nodes[alone]])),
         pa.concat_arrays([pa.array(nodes[right]), pa.nulls(none, pa.int64())]),
         pa.array(np.concatenate([more[left], np.ones(none, bool)])),
         pa.array(np.concatenate([more[right], np.zeros(none, bool)]))], names=["a", "b", "more_a", "more_b"])


def marks(asked: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, component, shingle: all shingles of the nodes in `asked` (node, component, doc_id, text_hash)."""
    source = docs.select(F.col(doc_id).cast("long").alias("of"), F.col(text).cast("string").alias("text"))
    texts = (source.withColumn("hash", F.xxhash64("text"))
             .join(small_side(asked), (F.col("hash") == F.col("text_hash")) & F.col("of").eqNullSafe(F.col("doc_id")))
             .select("node", "component", "text").dropDuplicates(["node"]))  # rows may repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            nodes, parts = batch.column("node").to_numpy(), batch.column("component").to_numpy()
            for at, texts in pieces(batch.column("text"), 1 << 18):
                sets = [shingles(t, known) for t in texts]
                owner = np.repeat(np.arange(at, at + len(sets)), list(map(len, sets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[owner]), pa.array(parts[owner]), pa.array(np.concatenate(sets).view(np.int64))],
                    names=["node", "component", "shingle"])
        known.clear()
        give_back()

    return texts.mapInArrow(run, "node long, component long, shingle long")


def by_rarity(marked: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b (a < b) of different components that share a shingle which at most RARE nodes have, and could reach 75 %;
    and node, size, shared of all nodes: how many shingles it has, and how many of them, by bucket, more than RARE nodes have.

    `marked` has node, component, shingle; `sizes` node, size.
    """
    counts = marked.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = stored(marked.join(counts, "shingle"), "seen")
    bucket = F.pmod(F.xxhash64("shingle"), F.lit(BUCKETS)).cast("int").alias("bucket")
    frequent = (seen.where(F.col("n") > RARE).groupBy("node", bucket).agg(F.count(F.lit(1)).alias("k"))
                .groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "k"))).alias("by")))
    shared = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("by", b), F.lit(0)))
    bounds = stored(sizes.join(frequent, "node", "left").select("node", "size", shared.cast("array<int>").alias("shared")), "bounds")
    # few nodes a shingle; nodes that share many shingles stand in one list, with their number
    lists = (seen.where(F.col("n") <= RARE).groupBy("shingle")
             .agg(F.array_sort(F.collect_list(F.struct("node", "component"))).alias("nodes"))
             .groupBy("nodes").agg(F.count(F.lit(1)).alias("rare")))
    pairs = (lists.select(F.posexplode("nodes").alias("at", "one"), "nodes", "rare")
             .select("one", F.explode(F.slice("nodes", F.col("at") + 2, F.lit(RARE))).alias("two"), "rare")
             .where("one.component != two.component")
             .groupBy(F.col("one.node").alias("a"), F.col("two.node").alias("b")).agg(F.sum("rare").alias("rare")))
    total = bounds.select("node", "size", F.aggregate("shared", F.lit(0), lambda x, y: x + y).alias("shared"))
    for side in ("a", "b"):
        pairs = pairs.join(small_side(total).toDF(side, f"size_{side}", f"shared_{side}"), side)
    common = F.col("rare") + F.least("shared_a", "shared_b")
    fit = 100 * common >= PERCENT * (F.col("size_a") + F.col("size_b") - common)
    return pairs.where(fit).select("a", "b"), bounds


def confirmed(pairs: DataFrame, names: DataFrame, docs: DataFrame, doc_id: str, text: str, fan: int = 64) -> DataFrame:
    """The pairs that hold on full sets. Each text travels once to every hub (the smaller node) that asks for it.

    A hub with many partners is split into parts of about `fan`. A task holds one hub's set and one partner's at a time.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / fan).alias("parts"))
    dealt = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    wanted = (dealt.select("a", "part").distinct().withColumn("node", F.col("a"))
              .unionByName(dealt.select("a", "part", F.col("b").alias("node"))))
    wanted = stored(wanted.join(names, "node").select("a", "part", "node", "doc_id", "text_hash"), "wanted")
    source = docs.select(F.col(doc_id).cast("long").alias("of"), F.col(text).cast("string").alias("text"))
    texts = (source.withColumn("hash", F.xxhash64("text"))
             .join(small_side(wanted), (F.col("hash") == F.col("text_hash")) & F.col("of").eqNullSafe(F.col("doc_id")))
             .select("a", "part", (F.col("node") != F.col("a")).alias("partner"), "node", "text"))
    ordered = texts.repartition("a", "part").sortWithinPartitions("a", "part", "partner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hub, own = WordHashes(), None, None
        for batch in batches:
            hubs, partner, nodes = (batch.column(c).to_pylist() for c in ("a", "partner", "node"))
            left, right = [], []
            for at, texts in pieces(batch.column("text"), 1 << 20):
                for i, content in enumerate(texts, at):
                    found = shingles(content, known)
                    if not partner[i]:
                        hub, own = hubs[i], found
                        continue
                    assert hub == hubs[i]
                    common = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * common >= PERCENT * (len(own) + len(found) - common):
                        left.append(hub)
                        right.append(nodes[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, first of every row.

    A component is what links of 75 % or more reach; its id is its smallest doc_id, and the row that has it is kept.
    Null, empty and wordless texts have no shingles and are linked with nothing. Rows that repeat a doc_id are rows of
    their own, all kept if their doc_id is the component's; a null doc_id never names a component with other ids.
    `first` marks the rows with the component's smallest (doc_id, text_hash): one row, or exact repeats of one.
    """
    rows = stored(sets_of(docs, doc_id, text), "sets")
    full = rows.where(F.col("print").isNotNull())
    first = F.min(F.struct("doc_id", "text_hash", "labels", "sketch"))
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    classes = full.groupBy("print").agg(first.alias("first"), F.min(own).alias("least"),
                                           F.max("n_shingles").alias("size")).select(
        "print", "least", "size", "first.doc_id", "first.text_hash", "first.labels", "first.sketch")
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    names = nodes.select("node", "doc_id", "text_hash")

    found = tested = parts = waiting = bounds = None
    steps = [proposals, *[partial(rest, limit=n) for n in (0, *REST)]]  # 0 only tells who has something to propose
    step = 0
    while step < len(steps):
        active = nodes.select("node", "labels", "sketch")
        active = active if waiting is None else active.join(waiting, "node", "left_semi")
        active = (active.withColumn("component", F.col("node")) if parts is None else
                  active.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
        active = active if bounds is None else active.join(bounds, "node")
        proposed = stored(steps[step](active), "proposals")
        pairs = proposed.where(F.col("b").isNotNull()).select("a", "b")
        if step == 1:
            asked = proposed.select(F.col("a").alias("node"))
            if asked.isEmpty():
                break
            asked = stored(active.select("node", "component").join(asked, "node", "left_semi")
                           .join(nodes.select("node", "size", "doc_id", "text_hash"), "node"), "asked")
            pairs, bounds = by_rarity(stored(marks(asked, docs, doc_id, text), "marks"), asked.select("node", "size"))
        new = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        new = stored(new, "pairs")
        linked = worth = False
        if not new.isEmpty():
            links = stored(confirmed(new, names, docs, doc_id, text), "links")
            tested = new if tested is None else tested.unionAll(new)
            n_links = links.count()
            linked, worth = n_links > 0, 2 * n_links >= new.count()
        if linked:
            found = links if found is None else found.unionAll(links)
            parts = stored(components(found), "parts")
        waiting = (proposed.where("more_a").select(F.col("a").alias("node"))
                   .unionAll(proposed.where("more_b").select("b")))
        if step == 0:
            if not worth or waiting.isEmpty():
                step, waiting = 1, None  # every node has a say in the regions
        elif waiting.isEmpty():
            break
        else:
            step += 1

    named = nodes.select("print", "node", "least")
    if found is None:
        whole = named.select("print", "least")
    else:
        parted = stored(named.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
        linked = parted.join(parts.select("component").distinct(), "component", "left_semi")
        smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
        whole = parted.join(smallest, "component", "left").select("print", F.coalesce("smallest", "least").alias("least"))
    return (rows.select("doc_id", "n_shingles", "print", "text_hash").join(whole, "print", "left")
            .withColumn("least", F.coalesce("least", own)).select(
                "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"),
                F.col("doc_id").eqNullSafe(F.col("least.doc_id")).alias("kept"), "text_hash",
                (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")))
                .alias("first")))

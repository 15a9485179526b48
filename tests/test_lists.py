"""Stored inverted lists: run-time pruning, files read, appends, generations, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import lists, search

CHUNKS = "chunk_id long, user_id long, embedding array<float>"


@pytest.fixture(scope="module")
def vectors():
    """A third of all vectors are near one centre; null vectors and users, and ties, are among them."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(24, 16))
    near = lambda c: (centres[c] + 0.15 * rng.normal(size=16)).tolist()
    rows = [(i, i % 3 or None, None if i % 50 == 7 else near(0 if i % 3 == 0 else i % 24)) for i in range(2400)]
    rows += [(10_000 + i, 1, rows[1][2]) for i in range(5)]
    asked = [(i, 1 + i % 2, None if i == 3 else near(i % 24)) for i in range(60)]
    return rows, asked


@pytest.fixture(scope="module")
def tables(spark, vectors):
    rows, asked = vectors
    return (spark.createDataFrame(rows, CHUNKS).repartition(4),
            spark.createDataFrame(asked, CHUNKS.replace("chunk_id", "query_id")))


@pytest.fixture(scope="module")
def stored(tables, tmp_path_factory):
    return lists.StoredLists.create(tables[0], str(tmp_path_factory.mktemp("lists") / "s"), lists=24, probes=4)


def _files(df) -> int:
    """Files that the scans of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        node = leaves.apply(i)
        stack = [node]
        while stack:
            n = stack.pop()
            if n.metrics().contains("numFiles"):
                total += n.metrics().apply("numFiles").value()
            if hasattr(n, "plan") and "QueryStage" in n.getClass().getSimpleName():
                inner = n.plan().collectLeaves()
                stack += [inner.apply(j) for j in range(inner.size())]
    return total


def _pairs(df):
    return {(r["query_id"], r["chunk_id"], r["similarity"], r["rank"]) for r in df.collect()}


def test_plan_prunes_at_run_time(stored, tables):
    asked = stored.index.probed(tables[1])
    plan = stored.probed_vectors(asked)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan


def test_files_read_fall_with_probes(stored, tables):
    few = tables[1].where("query_id = 5")
    read = []
    for probes in (1, 6, 24):
        stored.index.probes = probes
        read.append(_files(stored.probed_vectors(stored.index.probed(few))))
    stored.index.probes = 4
    assert 0 < read[0] < read[1] < read[2]


def test_recall_of_few_probes(stored, tables):
    exact = search.batched_search(*tables, 10, 0.5)
    got = lists.recall(stored.search(tables[1], 10, 0.5), exact).first()
    assert got["recall"] >= 0.9 and got["exact_hits"] > 300


def test_all_probes_equal_the_exact_search(stored, tables):
    stored.index.probes = 24
    try:
        found = _pairs(stored.search(tables[1], 10, 0.5))
    finally:
        stored.index.probes = 4
    assert found == _pairs(search.batched_search(*tables, 10, 0.5))


def test_appends_and_generations(spark, vectors, tables, tmp_path):
    rows, asked = vectors
    path = str(tmp_path / "s")
    old, new = tables[0].where("chunk_id % 3 <> 1"), tables[0].where("chunk_id % 3 = 1")
    made = lists.StoredLists.create(old, path, lists=8, probes=8)
    with pytest.raises(ValueError):
        made.append(new, 0)
    made.append(new, 1)
    made.append(new, 1)      # a batch that is written again changes nothing
    have = sum(v is not None for _, _, v in rows)
    assert made.vectors().count() == made.vectors().select("chunk_id").distinct().count() == have
    before = _pairs(made.search(tables[1], 5, 0.5))
    # an attempt that was never entered is not seen
    made.vectors().limit(3).write.parquet(f"{path}/generation-9-left/vectors")
    moved = made.reassign(lists=12)
    again = lists.StoredLists(spark, path, probes=12)
    assert (made.generation, moved.generation, again.generation, len(again.index.centroids)) == (0, 1, 1, 12)
    assert again.vectors().count() == have and again.vectors().agg(F.max("batch_id")).first()[0] == 0
    assert _pairs(again.search(tables[1], 5, 0.5)) == before == _pairs(search.batched_search(*tables, 5, 0.5))


def test_no_queries(stored, tables):
    assert stored.search(tables[1].limit(0), 5, 0.5).count() == 0


def test_probes_rise_until_the_recall_is_reached(spark, tmp_path):
    """Vectors without clusters: few lists hold too little, and a sample of queries tells how many are needed."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(size=16).tolist()) for i in range(900)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = chunks.withColumnRenamed("chunk_id", "query_id")
    exact = search.batched_search(chunks, asked, 5, 0.0, skip_self=True)
    made = lists.StoredLists.create(chunks, str(tmp_path / "s"), lists=10, probes=2)
    assert lists.recall(made.search(asked, 5, 0.0, skip_self=True), exact).first()["recall"] < 0.7
    made.tune(asked, 0.94, 5, 0.0, most=300, skip_self=True)
    got = lists.recall(made.search(asked, 5, 0.0, skip_self=True), exact).first()["recall"]
    assert got >= 0.9 and 2 < made.index.probes <= 10
    assert made.tune(asked, 0.1, 5, 0.0, most=300, skip_self=True).index.probes == made.probes  # never lowered

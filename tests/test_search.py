"""Search kernels against brute force, with ties, copies and one user holding most rows."""

import numpy as np
import pytest

from quire.operators import search


def brute(rows, asked, k, t, skip_self=False):
    out = set()
    for qid, user, q in asked:
        found = []
        for cid, cuser, c in rows:
            if cuser != user or (skip_self and cid == qid):
                continue
            a, b = np.float64(np.float32(q)), np.float64(np.float32(c))
            size = np.linalg.norm(a) * np.linalg.norm(b)
            s = round(float(a @ b / size), 6) if size else 0.0
            if s >= t:
                found.append((-s, cid))
        for rank, (s, cid) in enumerate(sorted(found)[:k], 1):
            out.add((qid, cid, -s, rank))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    same = [1.0, 0.0, 0.0, 1.0]
    # a third are copies of one vector, most belong to one user
    rows = [(i, 0 if i % 4 else i % 3, same if i % 3 == 0 else rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(600)]
    asked = [(i, i % 3, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)]
    schema = "user_id long, embedding array<float>"
    return (rows, asked, spark.createDataFrame(rows, "chunk_id long, " + schema).repartition(5),
            spark.createDataFrame(asked, "query_id long, " + schema))


def as_set(df):
    return {(r["query_id"], r["chunk_id"], round(r["similarity"], 6) + 0.0, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("limit", [4096, 0])
@pytest.mark.parametrize("k, t", [(5, 0.3), (50, -1.0), (3, 0.99)])
def test_exact_search(data, monkeypatch, limit, k, t):
    rows, asked, chunks, queries = data
    monkeypatch.setattr(search, "BLOCK_CHUNKS", 37)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 11)
    assert as_set(search.batched_search(chunks, queries, k, t, broadcast_limit=limit)) == brute(rows, asked, k, t)


def test_batched_is_the_union_of_single(data):
    rows, asked, chunks, queries = data
    batched = as_set(search.batched_search(chunks, queries, 5, 0.2))
    for qid, user, vector in asked[:3]:
        single = search.vector_search(chunks, vector, user, 0.2, 5).collect()
        assert {(r["chunk_id"], r["similarity"]) for r in single} == {(c, s) for q, c, s, _ in batched if q == qid}


def test_string_ids_and_no_hits(spark):
    chunks = spark.createDataFrame([("a", "u", [1.0, 0.0])], "chunk_id string, user_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", "u", [0.0, 1.0]), ("r", "v", [1.0, 0.0])], "query_id string, user_id string, embedding array<float>")
    assert search.batched_search(chunks, asked, 5, 0.5).collect() == []
    assert [r["chunk_id"] for r in search.batched_search(chunks, asked, 5, 0.0).collect()] == ["a"]


def test_unequal_lengths_are_an_error(spark):
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0])], "chunk_id long, user_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0])], "query_id long, user_id long, embedding array<float>")
    with pytest.raises(Exception, match="same length"):
        search.batched_search(chunks, asked, 5, 0.0).collect()


def test_fallback(spark):
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.1]), (2, 1, [0.8, 0.7])], "chunk_id long, user_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0])], "query_id long, user_id long, embedding array<float>")
    got = as_set(search.search_with_fallback(chunks, asked, 5, 0.9, 0.5))
    assert {(q, c) for q, c, _, _ in got} == {(1, 1), (2, 2)}


def test_distinctness_sees_copies(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.999, 0.001]), (3, [0.0, 1.0])]
    got = search.distinctness(spark.createDataFrame(rows, "chunk_id long, embedding array<float>")).first()
    assert (got["vectors"], got["pairs"], got["vectors_with_copies"], got["all_distinct"]) == (3, 3, 2, False)


def test_inverted_lists_recall(spark):
    """Clustered vectors: probing a few lists finds nearly everything the exact search finds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, 1, (centres[i % 20] + 0.15 * rng.normal(size=16)).tolist()) for i in range(2000)]
    asked = [(i, 1, (centres[i % 20] + 0.15 * rng.normal(size=16)).tolist()) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, user_id long, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id long, user_id long, embedding array<float>")
    exact = {(q, c) for q, c, _, _ in as_set(search.batched_search(chunks, queries, 10, 0.5))}
    index = search.InvertedLists(lists=20, probes=4).fit(chunks)
    near = {(q, c) for q, c, _, _ in as_set(index.search(index.assign(chunks), queries, 10, 0.5))}
    assert len(near & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("bad", [{"k": 51}, {"k": -1}, {"threshold": 1.5}, {"user_id": " "}, {"vector": []}])
def test_argument_rules(bad):
    with pytest.raises(ValueError):
        search.search_arguments(**bad)


def test_argument_defaults():
    assert search.search_arguments() == (10, 0.65)
    assert search.capped_k(None) == 10 and search.capped_k(70) == 50


def test_plan_of_one_search(spark, data):
    """Filters stay below the top k, and no shuffle of chunks happens."""
    plan = search.vector_search(data[2], [1.0, 0.0, 0.0, 0.0], 0, 0.1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("limit", [4096, 0])
def test_null_scopes_meet_nothing(spark, limit):
    """A null scope value finds nothing and is found by nothing, however the search is carried out."""
    values = [("x", None), (None, "x"), (None, None), ("x", "y"), ("x\u001fy", "z"), ("x", "y\u001fz")]
    schema = "user_id string, document_id string, embedding array<float>"
    chunks = spark.createDataFrame([(i, a, b, [1.0, 0.0]) for i, (a, b) in enumerate(values)], "chunk_id long, " + schema)
    asked = spark.createDataFrame([(i, a, b, [1.0, 0.0]) for i, (a, b) in enumerate(values)], "query_id long, " + schema)
    got = search.batched_search(chunks, asked, 5, 0.5, ("user_id", "document_id"), broadcast_limit=limit).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(3, 3), (4, 4), (5, 5)}
    got = search.batched_search(chunks, asked, 5, 0.5, broadcast_limit=limit).collect()
    same = {(q, c) for q, (a, _) in enumerate(values) for c, (b, _) in enumerate(values) if a is not None and a == b}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == same


@pytest.mark.parametrize("limit", [4096, 0])
def test_scope_types_may_differ(spark, limit):
    chunks = spark.createDataFrame([(1, 7, [1.0, 0.0])], "chunk_id long, user_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, "7", [1.0, 0.0]), (2, "seven", [1.0, 0.0])], "query_id long, user_id string, embedding array<float>")
    got = search.batched_search(chunks, asked, 5, 0.5, broadcast_limit=limit).collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(1, 1)]


@pytest.mark.parametrize("limit", [4096, 0])
def test_document_lists_of_questions(spark, limit):
    """Repeated ids count once, a null list means all documents, an empty one none."""
    from quire.plans.answering import retrieve

    chunks = spark.createDataFrame(
        [(f"c{d}", 1, d, 1, "s", "text", [1.0, 0.0]) for d in (1, 2, 3)],
        "chunk_id string, user_id long, document_id long, page_number int, section_title string, chunk_text string, embedding array<float>")
    documents = spark.createDataFrame([(d, f"f{d}") for d in (1, 2, 3)], "document_id long, filename string")
    asked = spark.createDataFrame(
        [(1, 1, [1.0, 0.0], [1, 1, 2]), (2, 1, [1.0, 0.0], None), (3, 1, [1.0, 0.0], []), (4, None, [1.0, 0.0], None), (5, 1, [1.0, 0.0], [None, 3])],
        "query_id long, user_id long, embedding array<float>, document_ids array<long>")
    got = retrieve(asked, chunks, documents, scoped=True, broadcast_limit=limit).collect()
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in got) == [
        (1, 1, "c1"), (1, 2, "c2"), (2, 1, "c1"), (2, 2, "c2"), (2, 3, "c3"), (5, 1, "c3")]


def test_one_search_checks_its_request(spark, data):
    for bad in ({"k": 10**9}, {"threshold": 7}, {"query_vector": []}, {"user_id": ""}):
        with pytest.raises(ValueError):
            search.vector_search(**{"chunks": data[2], "query_vector": [1.0, 0.0, 0.0, 0.0], "user_id": 0, **bad})
    fitted = search.vector_search(data[2], [1.0, 0.0, 0.0, 1.0, 9.0], 0, 0.1, 5, dimensions=4).collect()
    assert fitted == search.vector_search(data[2], [1.0, 0.0, 0.0, 1.0], 0, 0.1, 5).collect()
    assert search.search_arguments(threshold=0) == (10, 0)


def test_blocks_become_doubles_some_tiles_at_a_time(monkeypatch):
    import pyarrow as pa

    sizes = []
    matrix = search._matrix
    monkeypatch.setattr(search, "_matrix", lambda column: sizes.append(len(column)) or matrix(column))
    rows = np.random.default_rng(3).standard_normal((5000, 4))
    block = pa.table({"id": np.arange(5000), "vector": pa.array(rows.tolist())})
    ids, queries = np.arange(7), matrix(pa.array(rows[:7].tolist()))
    parts, whole = (search._Best(ids, queries, 5, 0.1, True) for _ in range(2))
    search._add_rows(parts, block, "id", "vector")
    whole.add(np.arange(5000), matrix(pa.array(rows.tolist())))
    assert max(sizes) <= 2 * search._TILE and sum(sizes) == 5000
    assert all(np.array_equal(a, b) for a, b in zip(parts.result(), whole.result()))

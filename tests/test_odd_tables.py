"""Registered queries against their SQL on small tables with odd rows: values near zero, copies, repeated questions."""

import pyarrow as pa
import pyarrow.parquet as pq

from checks import ORACLE, QUERIES
from checks.compare import compare
from checks.views import Views
from quire.operators import search


def _same(spark, folder, name, **tables):
    """Write the tables and run a query beside its SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    rows, same, note = compare(spark, con, str(folder), QUERIES[name], ORACLE[name])
    assert same, note
    return rows


def _vectors(rows):
    return pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())),
                     "label": pa.array([i % 3 for i in range(len(rows))], pa.int32())})


def test_cache_keys_keep_the_sign_of_small_values(spark, tmp_path):
    rows = [[-0.00001, 0.00001, -0.0, 0.03125, -0.03125], [-0.00005, 0.00005, 0.00015, -0.12345, 0.12345],
            [-0.00004999, 1.5, -2.99995, 0.99995, 123.00005]]
    assert _same(spark, tmp_path, "cache_keys", embeddings=_vectors(rows)) == 3


def test_distinct_vectors_count_pairs_of_copies(spark, tmp_path):
    rows = [[1.0, 0.0, 0.5]] * 3 + [[0.0, 1.0, 0.0]] * 2 + [[0.3, 0.2, -1.0]]  # 3 + 1 pairs, 5 vectors
    assert _same(spark, tmp_path, "distinct_vectors", embeddings=_vectors(rows)) == 1
    vectors = Views(spark, str(tmp_path)).chunk_vectors
    for limit in (100, 1):  # queries broadcast, and met in blocks
        got = search.distinctness(vectors, broadcast_limit=limit).first()
        assert (got["close_pairs"], got["vectors_with_copies"], got["max_similarity"]) == (4, 5, 1.0)


def test_equal_questions_are_answered_once(spark, tmp_path):
    """Each different question reaches the answerer once, and every row gets its answer."""
    from quire.operators.hooks import Answerer, Embedder, embed
    from quire.plans import answering

    class Counting(Answerer):
        def answer(self, prompts):
            with open(tmp_path / "seen", "a") as log:
                log.writelines(f"{i}\n" for i in prompts["query_id"])
            return super().answer(prompts)

    texts = spark.createDataFrame([("c1", "u1", 7, 1, None, "alpha beta gamma"), ("c2", "u2", 8, 1, None, "alpha beta gamma")],
                                  "chunk_id string, user_id string, document_id long, page_number int, section_title string, chunk_text string")
    documents = spark.createDataFrame([(7, "seven.pdf"), (8, "eight.pdf")], "document_id long, filename string")
    rows = [(i, f"u{1 + i % 2}", "alpha beta" if i < 40 else "zeta") for i in range(50)] + [(99, None, None), (98, None, None)]
    asked = spark.createDataFrame(rows, "query_id long, user_id string, query_text string")
    got = answering.answer_questions(asked, embed(texts, Embedder(64)), documents, Embedder(64), Counting(), threshold=0.3).collect()
    assert sorted(r.query_id for r in got) == sorted(r[0] for r in rows)
    assert sorted((tmp_path / "seen").read_text().split()) == ["0", "1", "40", "41", "98"]
    by_id = {r.query_id: r for r in got}
    assert all(r.sources_found == (1 if r.query_id < 40 else 0) for r in got)
    assert by_id[6].sources[0].document_name == "seven.pdf" and by_id[7].sources[0].document_name == "eight.pdf"


def test_similar_queries_shuffle_no_word_lists(spark):
    """Long questions take no more to look up than short ones: words nobody asks for are not shuffled."""
    from quire.operators import listing

    def shuffled(more):
        extra = f"array_join(transform(sequence(1, {more}), i -> substr(md5(concat(id, '-', i)), 1, 9)), ' ')"
        log = spark.range(2000).selectExpr("id AS query_id", "id % 5 AS user_id", "0.5D AS confidence_score",
                                           f"concat('common w', id % 50, ' ', {extra}) AS query_text")
        asked = spark.range(20).selectExpr("id AS request_id", "id % 5 AS user_id", "concat('common w', id % 50) AS query")
        status = spark.sparkContext._jsc.sc().statusStore()
        before = {status.jobsList(None).apply(i).jobId() for i in range(status.jobsList(None).size())}
        assert listing.similar_queries(log, asked).count() > 0
        jobs, total = status.jobsList(None), 0
        for i in range(jobs.size()):
            if jobs.apply(i).jobId() not in before:
                ids = jobs.apply(i).stageIds()
                total += sum(status.lastStageAttempt(ids.apply(k)).shuffleWriteBytes() for k in range(ids.size()))
        return total

    assert shuffled(80) < 2 * shuffled(2) + 20_000


def test_window_stream_holds_numbers_and_leaves_in_slices():
    """One busy key: its events take a few numbers each, and never leave as one frame."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from quire.streaming import jobs

    taken = {}

    class Frame:
        """Stands for a streaming frame; keeps the step."""
        sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda name: "1"))
        schema = {"id": T.StructField("id", T.LongType())}

        def __getattr__(self, name):
            return lambda *a, **k: self

        def applyInPandasWithState(self, step, *rest):
            taken["step"] = step
            return self

    class State:
        hasTimedOut, exists, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, at):
            self.at = at

    n = 600_000
    rng = np.random.default_rng(1)
    times = rng.permutation(n).astype(np.int64) * 1_000_000

    def batches():
        for at in range(0, n, 10_000):
            part = times[at:at + 10_000]
            yield pd.DataFrame({"k": "a", "id": np.arange(at, at + len(part)), "t": pd.to_datetime(part, unit="us"), "_us": part})

    from unittest import mock

    with mock.patch.object(jobs, "F", mock.MagicMock()):
        jobs.window_stream(Frame(), "k", "t", "id", 900)
    state, held, rows = State(), [], 0
    tracemalloc.start()
    for frame in taken["step"](("a",), batches(), state):
        held.append(len(frame))
        rows += len(frame)
        if rows == held[0]:
            assert frame["position"].tolist()[:902] == [*range(1, 902), 1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and max(held) <= 50_000
    assert peak < 90 * n
    assert state.get[1] == (n - 1) % 901 + 1


def test_columns_are_made_from_few_rows_at_a_time(spark):
    import pyarrow as arrow

    from quire.operators.arrow import add_columns

    rows = spark.range(3000, numPartitions=1)
    got = add_columns(rows, "n int", lambda b: [arrow.array([b.num_rows] * b.num_rows, arrow.int32())]).groupBy("n").count().collect()
    assert sum(r["count"] for r in got) == 3000 and max(r["n"] for r in got) <= 256


def test_topics_are_counted_where_their_user_lies(spark):
    """No task counts the words of all users: rows are dealt by user first, and counts are not shuffled again."""
    import re

    from quire.operators import analytics

    log = spark.range(3000).selectExpr("id % 7 AS user_id", "concat('alpha w', id % 20, ' w', id % 3) AS query_text").repartition(5)
    found = analytics.common_topics(log)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(user_id", plan) and not re.search(r"hashpartitioning\([^)]*topic", plan)
    assert found.where("position = 1").count() == 7


def test_search_multiplies_small_tiles():
    """A full block of queries against many rows holds products of a tile, not of the block."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    rows, asked = rng.normal(size=(4096, 16)), rng.normal(size=(4096, 16))
    best = search._Best(np.arange(4096), asked, 5, 0.0, False)
    tracemalloc.start()
    best.add(np.arange(4096), rows)
    found = best.result()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 4096 * 5 and peak < 40 << 20


def test_hierarchical_chunks_of_pages_whose_headers_are_renamed_later(spark, tmp_path):
    """A header whose number has another title on a later page opens no section; a manual's page may hold no section."""
    first = "\n".join(["Y. early words of the first page"] + [f"plain line {i} of it" for i in range(19)])
    texts = [first + "\nY. late words of the second page\nmore of it", "no header here", first]
    documents = pa.table({"doc_id": pa.array(range(3), pa.int64()), "text": texts, "lang": ["en"] * 3, "source": ["web"] * 3,
                          "n_chars": pa.array(list(map(len, texts)), pa.int64())})
    keys = list(range(21))  # the second page has one line, without a header
    part = pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_name": [f"red bolt {k}" for k in keys], "p_brand": ["Brand#1"] * 21,
                     "p_type": ["SMALL"] * 21, "p_size": pa.array([k % 50 + 1 for k in keys], pa.int32())})
    assert _same(spark, tmp_path, "hierarchical_chunks", documents=documents, part=part) > 4

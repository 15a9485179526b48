"""Sections found by automata, against plain `in`, in slices and blocks of every size."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import sections
from quire.operators.matching import with_sections_found

PAGE = "document_id long, page_number int, text string, number string"
MAP = "document_id long, first_page int, first_line int, number string, title string, level int, type string, parent string"


def brute(lines, entries):
    found = []
    for at, line in enumerate(lines):
        for e in entries:
            if e[3] is not None and e[4] is not None and e[3] in line and e[4][:20] in line:
                found.append((at, e[3], e[4]))
                break
    return found


@pytest.fixture(scope="module")
def manual(spark):
    """Document 1 holds most pages and sections; shared titles, empty and null values, letters beyond ASCII."""
    rng = random.Random(4)
    words = ["Scope", "Größe und Maß", "Scope of the whole manual, part", "\U0001d4b3 mark", "a", ""]
    maps = {d: [(d, i // 9 + 1, i % 9, f"{i // 7 + 1}.{i % 7}", rng.choice(words) + rng.choice(["", " x", " y"]), 1, "hierarchical", None)
                for i in range(n)] for d, n in ((1, 300), (2, 3), (3, 0))}
    maps[2] += [(2, 9, 0, None, "Scope", 1, "hierarchical", None), (2, 9, 1, "7", None, 1, "hierarchical", None),
                (2, 9, 2, "", "a", 1, "hierarchical", None)]
    rows = []
    for d, n in ((1, 120), (2, 5), (3, 2), (None, 2)):
        for p in range(1, n + 1):
            source = maps.get(d) or maps[1]
            lines = []
            for _ in range(rng.randint(0, 8)):
                e = rng.choice(source)
                lines.append(rng.choice([f"{e[3]} {e[4]}", f"see {e[3]}", f"{e[4]}", "7 a", ""]))
            rows.append((d, p, "\n".join(lines), "own column"))
    rows.append((1, None, "1.0 Scope\n1.1 Scope x", "own column"))
    rows += [(1, 121, "1.0 " + "Scope " * 60_000, "own column")] * 2
    pages = spark.createDataFrame(rows, PAGE).repartition(3)
    return rows, maps, pages, spark.createDataFrame([e for m in maps.values() for e in m], MAP)


@pytest.mark.parametrize("options", [{}, {"slice_size": 7}, {"block_pages": 4}, {"slice_size": 1, "block_pages": 1}])
def test_first_section_of_each_line(manual, options):
    rows, maps, pages, mapped = manual
    got = with_sections_found(pages, mapped, F.split("text", "\n"), "hits", True, **options)
    assert got.columns == [*pages.columns, "hits"]
    found = sorted((str(r["document_id"]), str(r["page_number"]), r["text"], r["number"],
                    [(h["place"], h["section"]["number"], h["section"]["title"]) for h in r["hits"]]) for r in got.collect())
    # in map order: null numbers come first there, and are found nowhere
    ordered = {d: sorted(m, key=lambda e: (e[1], e[2], e[3] is not None, e[3] or "")) for d, m in maps.items()}
    want = sorted((str(d), str(p), t, n, brute(t.split("\n"), ordered.get(d, []))) for d, p, t, n in rows)
    assert found == want
    assert sum(len(f[-1]) for f in found) > 50  # the rows are not empty of hits


@pytest.mark.parametrize("options", [{}, {"slice_size": 7, "block_pages": 4}])
def test_hierarchy_of_chunks(manual, options):
    rows, maps, pages, mapped = manual
    chunks = pages.select("document_id", "page_number", F.col("text").alias("chunk_text"))
    got = sections.with_hierarchy(chunks, mapped, **options)
    for r in got.collect():
        want = [(e[3], e[4]) for e in sorted(maps.get(r["document_id"], []), key=lambda e: e[1:3])
                if (e[3] is not None and e[3] in r["chunk_text"])
                or (e[4] is not None and e[4].lower()[:20] in r["chunk_text"].lower())]
        assert [(s["number"], s["title"]) for s in r["hierarchy"]] == want


def test_empty_tables(spark, manual):
    _, _, pages, mapped = manual
    none = with_sections_found(pages.limit(0), mapped, F.split("text", "\n"), "hits", True)
    assert none.count() == 0
    unmapped = with_sections_found(pages, mapped.limit(0), F.split("text", "\n"), "hits", True)
    assert {len(r["hits"]) for r in unmapped.collect()} == {0} and unmapped.count() == pages.count()


def test_a_large_document_is_split(spark):
    """Pages of one document lie in many tasks, each with the map; one plan for any size."""
    pages = spark.range(1, 8001).select(F.lit(1).cast("long").alias("document_id"), F.col("id").cast("int").alias("page_number"),
                                        F.format_string("%d.1 Part", F.col("id") + 10_000).alias("text"))
    mapped = sections.section_map(sections.detect_headers(pages))
    found = with_sections_found(pages, mapped, F.split("text", "\n"), "hits", True, slice_size=3000, block_pages=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    try:
        per_task = _per_task(found)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in per_task) == 8000 and len(per_task) > 3 and max(r["count"] for r in per_task) < 5000


def _per_task(found):
    return found.where("hits[0].section.number = page_number + 10000 || '.1'").groupBy(F.spark_partition_id()).count().collect()

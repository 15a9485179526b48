"""Properties of the page cutter, and the skew-safe numbering."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import chunking, cutting, scans, sections
from quire.operators.hooks import estimate
from quire.functions import text as tx

WORDS = st.lists(st.sampled_from(["a", "word", "longer-word", "end.", "why?", "é" * 9, "x" * 60]), min_size=1, max_size=200)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.sampled_from([" ", "\n", "\n\n", "  "]), st.integers(4, 40), st.integers(0, 3))
def test_page_cutter_covers_the_page(words, gap, size, overlap):
    text = gap.join(words)
    spans = cutting.cut_page(text, size, overlap, estimate)
    assert spans
    new = " ".join(text[start:end] for _, start, end in spans).split()
    assert new == text.split()                      # new text alone is the page
    for (lead, start, end), before in zip(spans, [None, *spans]):
        assert lead <= start < end
        if before:
            assert before[1] <= lead                # the lead repeats the chunk before only
            assert estimate(text[lead:start].rstrip()) <= max(overlap, 0) or lead == start
        piece = text[lead:end]
        assert estimate(piece) <= size + 1 or len(text[start:end].split()) == 1


def test_page_that_fits_is_one_chunk():
    assert cutting.cut_page("short page", 800, 150, estimate) == [(0, 0, 10)]
    assert cutting.cut_page("  \n ", 800, 150, estimate) == []


def test_cut_moves_back_to_the_sentence():
    text = "One two three four. Five six seven eight nine ten"
    spans = cutting.cut_page(text, 8, 0, estimate)
    assert text[:spans[0][2]] == "One two three four."


def test_custom_counter_is_used():
    spans = cutting.cut_page("a b c d e f", 2, 0, lambda t: len(t.split()), sentences=False)
    assert [b - a for _, a, b in spans] == [3, 3, 3]


def test_overlap_must_stay_below_size(spark):
    pages = spark.createDataFrame([(1, 1, "a")], "document_id long, page_number int, text string")
    with pytest.raises(ValueError):
        chunking.chunk_pages(pages, size=10, overlap=10)


@given(st.lists(st.sampled_from(["Stay safe", "go", "Sign here now please"]), min_size=1, max_size=30), st.integers(3, 20))
@settings(max_examples=80, deadline=None)
def test_section_cutter_covers_the_section(sentences, size):
    text = ". ".join(sentences) + "."
    pieces = cutting.cut_section(text, size, 2, estimate)
    assert " ".join(text[a:b] for _, a, b in pieces).split() == text.split()


def test_closing_sentences():
    assert cutting.closing_sentences("One. Two is here. Three", 4, estimate) == "Three"
    assert cutting.closing_sentences("One. Two. Three", 5, estimate) == "One. Two. Three"


def test_numbering_runs_over_blocks(spark):
    """A document longer than a block of pages: numbered in blocks, the result is the plain order."""
    rng = random.Random(1)
    rows = [(d, p, " ".join(["w"] * rng.randint(1, 25))) for d in (1, 2) for p in rng.sample(range(1, 60), 40)]
    pages = spark.createDataFrame(rows, "document_id long, page_number int, text string")
    made = scans.number_pieces(pages, lambda x: chunking.stride_pieces(x, 5, 1), "_pieces", block=8)
    got = {}
    for r in chunking.unpack(made).collect():
        got.setdefault(r["document_id"], []).append((r["page_number"], r["page_pos"], r["chunk_index"]))
    for found in got.values():
        assert [i for _, _, i in sorted(found)] == list(range(len(found)))


def test_previous_row_across_blocks(spark):
    rows = [(1, i, i % 4) for i in (0, 1, 2, 7, 8, 9, 30, 31)]
    df = spark.createDataFrame(rows, "document_id long, chunk_index long, page_number long")
    got = {r["chunk_index"]: r["prev_chunk_index"] for r in
           scans.previous_in_order(df, "document_id", "chunk_index", ["page_number"], block=4).collect()}
    assert got == {0: None, 1: 0, 2: 1, 7: 2, 8: 7, 9: 8, 30: 9, 31: 30}


def test_section_manual(spark):
    """Headings, steps, a definition and a reference."""
    text = ("1.1 Purpose\nThis manual is defined as a guide.\n1.2 Procedure\nProcedure: do this\nStep 1: open\nStep 2: close\n"
            "1.2.1 Details\nSee section 1.1 for more.")
    pages = spark.createDataFrame([(1, 1, text)], "document_id long, page_number int, text string")
    headers = [(r["number"], r["type"], r["level"], r["parent"]) for r in
               sections.detect_headers(pages).orderBy("line").collect()]
    assert headers == [("1.1", "hierarchical", 1, "1"), ("1.2", "hierarchical", 1, "1"), ("1", "step", 2, None),
                       ("2", "step", 2, None), ("1.2.1", "hierarchical", 2, "1.2")]
    chunks = sections.hierarchical_chunks(pages).orderBy("chunk_index").collect()
    assert [c["section_title"] for c in chunks][:2] == ["Purpose", "Procedure"]
    assert chunks[-1]["cross_references"] == ["1.1"]


@pytest.mark.parametrize("line, kind", [
    ("1.2.1 Leave", "hierarchical"), ("Chapter 3: Intro", "chapter"), ("Appendix B Forms", "appendix"),
    ("a. first item", "letter_section"), ("I. Scope", "letter_section"), ("iv. Scope", "roman"),
    ("Step 2: sign", "step"), ("1. INTRODUCTION", None), ("2024 was wet", "hierarchical"), ("iron. bar", None),
])
def test_header_lines(spark, line, kind):
    got = spark.range(1).select(tx.page_sections(F.lit(line)).alias("s")).first()["s"]
    assert [s["type"] for s in got] == ([kind] if kind else [])

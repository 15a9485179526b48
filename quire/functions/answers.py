"""Context blocks, model answers, citations and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.schemas import MODEL_ANSWER

# Question patterns per class, matched on lower-cased text.
_WORD_START, _WORD_END = "(?<![a-z0-9_])", "(?![a-z0-9_])"
QUERY_PATTERNS = {
    "procedural": (
        r"how\s+to\s+",
        r"steps?\s+(to|for)",
        r"procedure\s+(for|to)",
        r"process\s+(for|to)",
        r"instructions?\s+(for|to)",
        r"\b(submit|complete|perform|execute|conduct)\b",
    ),
    "definitional": (
        r"what\s+is\s+",
        r"define\s+",
        r"definition\s+of",
        r"meaning\s+of",
        r"\b(explain|describe)\b",
    ),
    "analytical": (
        r"analyze\s+",
        r"compare\s+",
        r"relationship\s+between",
        r"structure\s+of",
        r"organization\s+of",
    ),
}
# Opening lines of a packed context.
CONTEXT_HEADERS = {
    "procedural": "Procedural information and steps from the documents:\n\n",
    "definitional": "Definitions and explanations from the documents:\n\n",
    "analytical": "Analytical information for comparison and analysis:\n\n",
    "general": "Relevant information from the documents:\n\n",
}
# Fixed value: the context when nothing was found.
NO_CONTEXT = "No relevant information found in the documents."
# What is returned when a model answer cannot be read.
UNREADABLE = "I encountered an error processing the response. Please try rephrasing your question."
NO_ANSWER = "No answer available"
# Fixed value: what is returned when answering failed.
APOLOGY = "I apologize, but I encountered an error while processing your question. Please try again."
# Fixed value: what stands where a context was cut.
TRUNCATED = "\n\n[... context truncated for length ...]"
REQUIRED_FIELDS = ("answer", "confidence", "citations")
# Finish reasons.
FINISH_REASONS = {"stop": "completed", "length": "max_tokens", "content_filter": "stop_sequence"}


def _bounded(pattern: str) -> str:
    """ASCII word limits: Java's own \\b also looks at accented letters."""
    if pattern.startswith(r"\b"):
        return _WORD_START + pattern[2:-2] + _WORD_END
    return pattern


def classify_query(query: Column) -> Column:
    """struct(type, confidence, patterns): the class with most matching patterns wins."""
    lower = F.lower(query)
    matched = {
        kind: F.array_compact(F.array(*[F.when(lower.rlike(_bounded(p)), p) for p in patterns]))
        for kind, patterns in QUERY_PATTERNS.items()
    }
    # (count, preference, type, patterns): the greatest wins, ties go to the earlier class
    best_class = F.array_max(F.array(*[
        F.struct(F.size(found).alias("n"), F.lit(-i).alias("o"), F.lit(kind).alias("type"), found.alias("patterns"))
        for i, (kind, found) in enumerate(matched.items())
    ]))
    none = F.struct(
        F.lit("general").alias("type"), F.lit(0.5).alias("confidence"),
        F.array().cast("array<string>").alias("patterns"),
    )
    return tx.let(best_class, lambda best: F.when(best["n"] == 0, none).otherwise(F.struct(
        best["type"].alias("type"),
        F.round(F.least(F.lit(0.95), F.lit(0.6) + best["n"] * F.lit(0.1)), 2).alias("confidence"),
        best["patterns"].alias("patterns"),
    )))


def _line(prefix: str, value: Column, suffix: str = "") -> Column:
    """prefix + value + suffix, or nothing when the value is missing or empty."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(prefix), value, F.lit(suffix))).otherwise("")


def excerpt_block(kind: Column, name: Column, page: Column, section: Column, similarity: Column, text: Column) -> Column:
    """How one hit is shown to the model, by question class."""
    page = page.cast("string")
    procedural = F.concat(
        F.lit("[PROCEDURE SOURCE]\nDocument: "), name, F.lit("\nPage: "), page, _line("\nSection: ", section),
        F.lit("\nSimilarity: "), F.format_string("%.1f", F.round(similarity * 100, 1)),
        F.lit("%\nContent:\n"), text, F.lit("\n\n"),
    )
    definitional = F.concat(
        F.lit("[DEFINITION SOURCE]\nDocument: "), name, F.lit(" (Page "), page, F.lit(")"),
        _line('\n"', section, '"'), F.lit("\nContent: "), text, F.lit("\n\n"),
    )
    plain = F.concat(
        F.lit("Document: "), name, F.lit("\nPage "), page, _line(" - ", section),
        F.lit("\nContent: "), text, F.lit("\n\n"),
    )
    return F.when(kind == "procedural", procedural).when(kind == "definitional", definitional).otherwise(plain)


def context_header(kind: Column) -> Column:
    out = None
    for name in ("procedural", "definitional", "analytical"):
        out = (F if out is None else out).when(kind == name, CONTEXT_HEADERS[name])
    return out.otherwise(CONTEXT_HEADERS["general"])


def fit_prompt(prompt: Column, max_tokens: int) -> Column:
    """Shorten the context in front of a single QUERY: marker until the prompt fits."""
    marker = "\n\nQUERY:"
    parts = F.split(prompt, marker)
    room = F.lit(max_tokens) - tx.estimate_tokens(parts[1]) - 100
    context = F.when(
        F.length(parts[0]) > room * 4, F.concat(F.substring(parts[0], F.lit(1), room * 4), F.lit(TRUNCATED))
    ).otherwise(parts[0])
    fits = (tx.estimate_tokens(prompt) <= max_tokens) | (F.size(parts) != 2)
    return F.when(fits, prompt).when(room <= 0, prompt).otherwise(F.concat(context, F.lit(marker), parts[1]))


def _json_part(text: Column) -> Column:
    """From the first { to the last }, or the whole text when there is no such part."""
    trimmed = tx.strip(text)
    part = F.regexp_extract(trimmed, r"(?s)\{.*\}", 0)
    return F.when(part != "", part).otherwise(trimmed)


def parse_model_answer(raw: Column, required=REQUIRED_FIELDS) -> Column:
    """Model text to struct(answer, steps, sections, citations, confidence, parsed).

    A text that is no JSON object, or lacks a required field, becomes the fixed fallback.
    """
    read = tx.let(_json_part(raw), lambda body: F.struct(
        F.from_json(body, MODEL_ANSWER, _STRICT).alias("data"),
        F.map_keys(F.from_json(body, "map<string,string>", _STRICT)).alias("keys"),
    ))
    return tx.let(read, lambda r: _checked_answer(r["data"], r["keys"], required))


_STRICT = {"allowSingleQuotes": "false"}


def _checked_answer(data: Column, keys: Column, required) -> Column:
    ok = F.coalesce(tx.all_of([F.array_contains(keys, f) for f in required]), F.lit(False))
    confidence = F.coalesce(data["confidence"].try_cast("double"), F.lit(0.0))
    citation = "array<struct<source:string,page:double,section:string>>"
    citations = F.coalesce(F.transform(
        data["citations"],
        lambda c: F.struct(
            F.coalesce(c["source"], F.lit("")).alias("source"),
            F.coalesce(c["page"].try_cast("double"), F.lit(0.0)).alias("page"),
            F.coalesce(c["section"], F.lit("")).alias("section"),
        ),
    ), F.array().cast(citation))
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(ok, data["answer"]).otherwise(UNREADABLE).alias("answer"),
        F.when(ok, F.coalesce(data["steps"], empty)).otherwise(empty).alias("steps"),
        F.when(ok, F.coalesce(data["sections"], empty)).otherwise(empty).alias("sections"),
        F.when(ok, citations).otherwise(F.array().cast(citation)).alias("citations"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(0.1).alias("confidence"),
        ok.alias("parsed"),
    )


def extract_answer(answer: Column, raw: Column) -> Column:
    """The answer; its own `answer` when it is JSON again; else what the raw text offers."""
    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    nested = F.when(
        answer.contains('"answer":') & answer.contains("{"), filled(F.get_json_object(answer, "$.answer"))
    )
    in_text = F.when(raw.contains('"answer":'), filled(F.get_json_object(_json_part(raw), "$.answer")))
    direct = F.when(~raw.contains("{") | ~raw.contains('"'), filled(raw))
    return F.coalesce(nested, filled(answer), in_text, direct, filled(raw), F.lit(NO_ANSWER))


def append_steps(answer: Column, steps: Column) -> Column:
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n")))
    return F.when(F.size(steps) > 0, F.concat(answer, F.lit("\n\nSteps:\n"), F.array_join(numbered, ""))).otherwise(answer)


def clean_citations(text: Column) -> Column:
    """Drop bare section marks such as (1.2) and collapse white space."""
    bare = F.regexp_replace(text, f"[{tx.SPACE}]*" + r"\(\d+(?:\.\d+)*\)", "")
    return tx.strip(F.regexp_replace(bare, f"[{tx.SPACE}]+", " "))


def cite(text: Column, sources: Column) -> Column:
    """Append the two most confident distinct sources unless the text cites a page already."""
    cleaned = clean_citations(text)
    shown = F.array_distinct(F.transform(
        top_sources(sources, 2),
        lambda s: F.format_string("(%s, Page %d)", s["document_name"], s["page_number"]),
    ))
    has = cleaned.contains("(") & cleaned.contains(", Page ")
    appended = F.concat(F.regexp_replace(cleaned, r"\.\z", ""), F.lit(" "), F.array_join(shown, " "), F.lit("."))
    return F.when(has | (F.coalesce(F.size(sources), F.lit(0)) <= 0), cleaned).otherwise(appended)


def top_sources(sources: Column, n: int) -> Column:
    """The n most confident sources, earlier ones first on ties."""
    keyed = F.transform(sources, lambda s, i: F.struct(
        (-F.coalesce(s["confidence"], F.lit(0.0))).alias("c"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["s"])


def answer_confidence(hits: Column, top3_mean: Column, answer: Column) -> Column:
    """0.1 without hits, else a mix of similarity, number of hits and answer length, within 0.1..1."""
    mixed = (
        top3_mean * 0.5
        + F.least(hits / F.lit(5.0), F.lit(1.0)) * 0.3
        + F.least(F.coalesce(F.length(answer), F.lit(0)) / F.lit(100.0), F.lit(1.0)) * 0.2
    )
    return F.when(F.coalesce(hits, F.lit(0)) == 0, 0.1).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), mixed)))


def finish_reason(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FINISH_REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, reason), F.lit("completed"))


def token_usage(prompt: Column, completion: Column, prompt_text: Column, completion_text: Column) -> Column:
    """Reported counts, or estimates where none was reported; total is their sum."""
    p = F.coalesce(F.nullif(prompt, F.lit(0)), tx.estimate_tokens(prompt_text)).cast("bigint")
    c = F.coalesce(F.nullif(completion, F.lit(0)), tx.estimate_tokens(completion_text)).cast("bigint")
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"))


def source_line(position: Column, kind: Column, title: Column, url: Column, filename: Column, content: Column) -> Column:
    """`Source i (type): title (url) [file]` and the content below."""
    return F.concat(
        F.lit("Source "), position.cast("string"), F.lit(" ("), kind, F.lit("):"),
        _line(" ", title), _line(" (", url, ")"), _line(" [", filename, "]"), F.lit("\n"), content,
    )

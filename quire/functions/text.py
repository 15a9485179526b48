"""Text functions: tokens, words, headings, sections, references, excerpts."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TokenCounter = Callable[[Column], Column]

# White space as a JavaScript \s sees it (inside a character class).
SPACE = "\\s\\x0B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
NONSPACE = f"[^{SPACE}]"
SPACE_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Section header patterns, tried in this order.
SECTION_PATTERNS = (
    ("hierarchical", r"^(\d+(?:\.\d+){0,5})\s+(.+)"),
    ("chapter", r"(?i)^(?:chapter|ch\.?)\s+(\d+)[\s:]+(.+)"),
    ("appendix", r"(?i)^(?:appendix|app\.?)\s+([a-z])\s+(.+)"),
    ("letter_section", r"(?i)^([a-z])\.\s+(.+)"),
    ("roman", r"(?i)^([ivx]+)\.\s+(.+)"),
    ("step", r"(?i)^(?:step)\s+(\d+)[\s:]+(.+)"),
)
# Every header starts like this; most lines do not, and are spared the six patterns.
MAYBE_HEADER = r"^(?i:\d|ch|app|step|[a-z]\.|[ivx]+\.)"
# What a heading line looks like.
HEADING_PATTERNS = (
    r"^(?i:Chapter|Section|Part|Article)\s+\d+",
    r"^\d+\.\s+[A-Z]",
    r"^[A-Z][A-Z\s]{5,50}\z",
    r"^[A-Z][a-z\s]{5,50}\z",
)
# Signs of a procedure, of steps, of a definition, of a conclusion.
PROCEDURE_PATTERNS = (
    r"procedure\s*:",
    r"steps?\s*:",
    r"instructions?\s*:",
    r"to\s+(perform|complete|execute)",
)
STEP_PATTERNS = (
    r"(?:^|\n)\s*(?:\d+[\.)]\s+|step\s+\d+|[a-z][\.)]\s+)",
    r"(?:first|second|third|next|then|finally)",
    r"(?:^|\n)\s*[-*•]\s+",
)
DEFINITION_PATTERNS = (
    r"is\s+defined\s+as",
    r"means\s+",
    r"refers\s+to",
    r":\s*the\s+",
    r"definition\s*:",
)
CONCLUSION_PATTERN = r"complete|finished|done|end"
# Cross references.
REFERENCE_PATTERNS = (
    r"(?:see|refer to|reference|chapter|section|appendix|paragraph)\s+(\d+(?:\.\d+)*)",
    r"\((?:ref|see)\s+([^)]+)\)",
    r"(?:page|p\.)\s+(\d+)",
)


def rx(pattern: str) -> Column:
    """A regular expression as a literal column."""
    return F.lit(pattern)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: the optimiser copies an inlined column into every
    place, and into a lambda, where it would run again for each element."""
    return F.transform(F.array(value), body)[0]


def _any_of(text: Column, patterns) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in ["(?i)" + q for q in patterns]))


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(NONSPACE)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


# --- tokens ---------------------------------------------------------------

def estimate_tokens(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("int")


def word_tokens(text: Column) -> Column:
    """Three quarters of a word a token, rounded up."""
    return F.ceil(F.size(words(text)) / F.lit(0.75)).cast("int")


def within_limit(text: Column, limit: int, tokens: TokenCounter = estimate_tokens) -> Column:
    return tokens(text) <= limit


def token_stats(text: Column, tokens: TokenCounter = estimate_tokens) -> Column:
    n_tokens, n_chars, zero = tokens(text), F.length(text), F.lit(0.0)
    return let(F.size(words(text)), lambda n_words: F.struct(
        n_tokens.alias("total_tokens"),
        F.coalesce(F.try_divide(n_tokens, n_words), zero).alias("avg_tokens_per_word"),
        F.coalesce(F.try_divide(n_chars, n_tokens), zero).alias("avg_chars_per_token"),
        n_words.alias("word_count"),
        n_chars.alias("char_count"),
    ))


def _single_spaced(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def split_at_budget(text: Column, budget) -> Column:
    """Longest word prefix whose estimated tokens fit, and the rest, both single spaced."""
    limit = F.lit(budget).cast("int") * 4

    def pair(head: Column, rest: Column) -> Column:
        return F.struct(head.alias("head"), rest.alias("rest"))

    def cut(flat: Column) -> Column:
        head = F.regexp_extract(F.substring(flat, F.lit(1), limit + 1), "(?s)^(.*) ", 1)
        after = let(head, lambda h: pair(
            h, F.substring(flat, F.length(h) + F.when(h == "", 1).otherwise(2), F.length(flat))))
        return F.when(F.length(flat) <= limit, pair(flat, F.lit(""))).otherwise(after)

    return F.when(F.length(text) <= limit, pair(text, F.lit(""))).otherwise(let(_single_spaced(text), cut))


def overlap_text(text: Column, budget: int) -> Column:
    """Longest word suffix whose estimated tokens fit, single spaced."""
    limit = budget * 4
    return let(_single_spaced(text), lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(
        F.regexp_extract(F.right(flat, F.lit(limit + 1)), "(?s)^[^ ]* (.*)\\z", 1)
    ))


def _last_index(text: Column, needle: str) -> Column:
    """Zero-based position of the last occurrence, -1 when there is none."""
    found = F.instr(F.reverse(text), needle[::-1])
    return F.when(found > 0, F.length(text) - found - len(needle) + 1).otherwise(-1)


def sentence_boundary(text: Column, position) -> Column:
    """End of the last sentence before a position, else of the last paragraph, else of the last word."""
    head = F.substring(text, F.lit(1), F.lit(position).cast("int"))
    sentence = F.length(F.regexp_extract(head, f"(?s)^.*[.!?](?:[{SPACE}]|\\z)", 0))
    paragraph, blank = _last_index(head, "\n\n"), _last_index(head, " ")
    return (
        F.when(sentence > 0, sentence)
        .when(paragraph > 0, paragraph + 2)
        .when(blank > 0, blank + 1)
        .otherwise(F.lit(position))
        .cast("int")
    )


# --- cleaning and cutting ------------------------------------------------------

def clean_text(text: Column) -> Column:
    flat = F.regexp_replace(text, f"[{SPACE}]+", " ")
    return strip(F.regexp_replace(flat, r"[^\w\s.,;:!?()-]", ""))


def excerpt(text: Column, limit: int = 200) -> Column:
    """At most `limit` characters, ending at a period when one lies in the last 30 %."""
    cut = F.substring(text, 1, limit)
    period = _last_index(cut, ".")
    return (
        F.when(F.length(text) <= limit, text)
        .when(period > limit * 0.7, F.substring(cut, F.lit(1), period + 1))
        .otherwise(F.concat(cut, F.lit("...")))
    )


def preview(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncate_prompt(text: Column, max_tokens: int) -> Column:
    """Cut at four characters a token, at a blank when one lies in the last 20 %."""
    limit = max_tokens * 4
    cut = F.substring(text, 1, limit)
    blank = _last_index(cut, " ")
    return (
        F.when(estimate_tokens(text) <= max_tokens, text)
        .when(blank > limit * 0.8, F.concat(F.substring(cut, F.lit(1), blank), F.lit("...")))
        .otherwise(F.concat(cut, F.lit("...")))
    )


def format_bytes(size: Column) -> Column:
    """`1.5 KB`: steps of 1024, two decimals without trailing zeros."""
    units = ("Bytes", "KB", "MB", "GB", "TB")
    size = size.cast("double")

    def shown(power: int) -> Column:
        value = F.format_string("%.2f", F.round(size / F.lit(float(1024 ** power)), 2))
        return F.concat(F.regexp_replace(value, r"\.?0+\z", ""), F.lit(" " + units[power]))

    out = F.when(size == 0, F.lit("0 Bytes"))
    for power in range(4):
        out = out.when(size < float(1024 ** (power + 1)), shown(power))
    return out.otherwise(shown(4))


# --- headings and sections ----------------------------------------------------

def looks_like_heading(line: Column) -> Column:
    pattern = "|".join(f"(?:{p})" for p in HEADING_PATTERNS)
    return F.length(line).between(3, 200) & line.rlike(pattern)


def page_section_title(text: Column) -> Column:
    """First of the first five non-empty lines that looks like a heading, cut at 100."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    found = F.try_element_at(F.filter(F.slice(lines, 1, 5), looks_like_heading), F.lit(1))
    return preview(found, 100)


def section_header(line: Column) -> Column:
    """struct(number, title, type) of the first pattern a trimmed line matches, else null."""
    out = None
    for kind, pattern in SECTION_PATTERNS:
        found = F.struct(
            F.regexp_extract(line, pattern, 1).alias("number"),
            strip(F.regexp_extract(line, pattern, 2)).alias("title"),
            F.lit(kind).alias("type"),
        )
        hit = line.rlike(pattern)
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out


def section_level(number: Column, kind: Column) -> Column:
    return (
        F.when(kind == "hierarchical", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))))
        .when(kind.isin("letter_section", "roman"), 1)
        .when(kind == "step", 2)
        .otherwise(0)
        .cast("int")
    )


def parent_section(number: Column, kind: Column) -> Column:
    return F.when(
        (kind == "hierarchical") & number.contains("."),
        F.regexp_replace(number, r"\.[^.]+\z", ""),
    )


def page_sections(text: Column) -> Column:
    """Every header of a page in line order: array<struct<line,number,title,type>>."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("line"), strip(line).alias("text")))
    headers = F.transform(
        F.filter(lines, lambda x: x["text"].rlike(MAYBE_HEADER)),
        lambda x: F.struct(x["line"].alias("line"), section_header(x["text"]).alias("h")),
    )
    return F.transform(
        F.filter(headers, lambda x: x["h"].isNotNull()),
        lambda x: F.struct(
            x["line"].alias("line"), x["h"]["number"].alias("number"),
            x["h"]["title"].alias("title"), x["h"]["type"].alias("type"),
        ),
    )


def contains_definition(text: Column) -> Column:
    return _any_of(text, DEFINITION_PATTERNS)


def contains_procedure(text: Column) -> Column:
    return _any_of(text, PROCEDURE_PATTERNS)


def contains_steps(text: Column) -> Column:
    return _any_of(text, STEP_PATTERNS)


def is_complete_procedure(text: Column) -> Column:
    closing = text.rlike("(?i)" + CONCLUSION_PATTERN) | (F.size(F.split(text, "\n")) > 5)
    return contains_procedure(text) & contains_steps(text) & closing


def cross_references(text: Column) -> Column:
    """Every captured reference, trimmed, distinct, pattern by pattern in text order."""
    found = [F.regexp_extract_all(text, rx("(?i)" + p), F.lit(1)) for p in REFERENCE_PATTERNS]
    return F.array_distinct(F.transform(F.concat(*found), strip))


def section_numbers(text: Column) -> Column:
    """Every captured section number with line anchors, distinct, pattern by pattern."""
    found = [
        F.regexp_extract_all(text, rx("(?m)" + p), F.lit(1)) for _, p in SECTION_PATTERNS
    ]
    return F.array_distinct(F.concat(*found))


def enhanced_metadata(chunk_text: Column, sections: Column) -> Column:
    """What is known of one chunk; a page section is kept when its number or title shows up."""
    kept = F.filter(
        sections,
        lambda s: chunk_text.contains(s["number"]) | chunk_text.contains(F.substring(s["title"], 1, 20)),
    )
    return F.struct(
        contains_procedure(chunk_text).alias("contains_procedure"),
        contains_steps(chunk_text).alias("contains_steps"),
        contains_definition(chunk_text).alias("contains_definition"),
        cross_references(chunk_text).alias("cross_references"),
        section_numbers(chunk_text).alias("section_numbers"),
        kept.alias("detected_sections"),
    )


def topic_words(text: Column, stop_words) -> Column:
    """Lower-case words of more than two characters that are no stop words."""
    flat = F.regexp_replace(F.lower(text), r"[^\w\s]", " ")
    return F.filter(F.split(flat, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)

"""Sequential cutting of one text: where each chunk starts depends on where the last one ended.

These helpers work on a single page inside a task; Spark spreads the pages.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

WORD = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?](?:\s|\Z)")
SENTENCE_BREAK = re.compile(r"[.!?]+")


def _last_boundary(text: str, start: int, end: int) -> int:
    """Offset after the last sentence, else paragraph, else blank in text[start:end]; `end` if none."""
    at = end
    while at > start:
        at = max(text.rfind(mark, start, at) for mark in ".!?")
        if at < 0:
            break
        if at + 1 == end:
            return end
        if text[at + 1].isspace():
            return at + 2
    paragraph = text.rfind("\n\n", start, end)
    if paragraph > start:
        return paragraph + 2
    blank = text.rfind(" ", start, end)
    return blank + 1 if blank > start else end


def _fit(words, first: int, text: str, budget: int, tokens: Callable[[str], int]) -> int:
    """Index after the last word of the longest run from `first` that fits; at least one word."""
    start = words[first][0]
    # a token covers at least one character's worth of text in every counter, so gallop then bisect
    low, step = first, 64
    while low + step < len(words) and tokens(text[start:words[low + step][1]]) <= budget:
        low, step = low + step, step * 2
    high = min(low + step, len(words) - 1)
    found = bisect_left(range(low, high + 1), True,
                        key=lambda i: tokens(text[start:words[i][1]]) > budget)
    return max(low + found, first + 1)


def cut_page(text: str, size: int, overlap: int, tokens, sentences: bool = True):
    """Spans (lead, start, end): new text is [start, end), [lead, start) repeats the chunk before."""
    if not text.strip():
        return []
    if tokens(text) <= size:
        return [(0, 0, len(text))]
    words = [m.span() for m in WORD.finditer(text)]
    spans, at, previous = [], 0, None
    while at < len(words):
        start = lead = words[at][0]
        budget = size
        if previous is not None and overlap > 0:
            first, last = previous
            tail = bisect_left(range(first, last + 1), True,
                               key=lambda i: tokens(text[words[i][0]:words[last][1]]) <= overlap)
            if first + tail <= last:
                lead = words[first + tail][0]
                budget = size - tokens(text[lead:words[last][1]] + " ")
        stop = _fit(words, at, text, budget, tokens)
        end = words[stop - 1][1]
        if sentences and stop < len(words):
            boundary = _last_boundary(text, lead, end)
            if start < boundary < end:
                stop = bisect_left(words, (boundary, 0), at)
                end = words[stop - 1][1]
        spans.append((lead, start, end))
        previous, at = (at, stop - 1), stop
    return spans


def closing_sentences(text: str, budget: int, tokens) -> str:
    """Trailing sentences of a text that fit a token budget together."""
    parts = SENTENCE_BREAK.split(text)
    kept, used = [], 0
    for i in range(len(parts) - 1, -1, -1):
        part = parts[i].strip()
        if not part:
            continue
        part += "." if i < len(parts) - 1 else ""
        cost = tokens(part)
        if used + cost > budget:
            break
        kept.append(part)
        used += cost
    return " ".join(reversed(kept))


def cut_section(text: str, size: int, overlap: int, tokens):
    """Pieces (chunk_text, start, end) of a section; trailing sentences of a piece open the next."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at, previous = [], 0, None
    while at < len(words):
        lead = ""
        if previous and overlap > 0:
            lead = closing_sentences(previous, overlap, tokens) + "\n"
        stop = _fit(words, at, text, size - tokens(lead), tokens)
        start, end = words[at][0], words[stop - 1][1]
        previous = text[start:end]
        out.append(((lead + previous).strip(), start, end))
        at = stop
    return out

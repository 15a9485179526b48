"""Secret scans by assignment-aware lexing.

Source and configuration text is read as pairs of a name and a literal (`name = "literal"`, `"name": "literal"`,
`NAME=literal`, `name: literal`, `name := literal`). A name that is assigned another name takes over that name's
literals, so that `k = "..."; password = k` counts as a password. A literal is scored by how sensitive the names are
that it reaches, and by how little it looks like a word. Beside the pairs stand three plain patterns, whose findings
are always kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from quire.llm.common import with_cleaned_text, with_text_results

# The plain patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is as long as it can be, so asking for its length at once finds the same runs
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

KINDS = ("assign", "access", "hex", "literal")

# How sensitive a name is: the largest weight of its parts (snake, kebab, dotted or camel case).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "bearer": 0.8,
    "auth": 0.6, "authorization": 0.7, "signature": 0.5, "salt": 0.5, "key": 0.4, "cookie": 0.5, "session": 0.4,
}
LEAST_LENGTH = 6
LEAST_SCORE = 0.6  # of literals with a digit
# Of a literal without white space that shows two signs of randomness: oddity that is enough under a name of weight 1,
# and how much more a name of weight 0 would need. A name of weight 0.4 needs 0.75.
LEAST_ODDITY, MORE_ODDITY = 0.33, 0.7
LONG, EVEN = 16, 3.5  # characters, and bits of entropy a character

_EQUALS = re.compile(r"[:=]")
_NAME_END = re.compile(r"[\w.$-]", re.ASCII)
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
_BARE = re.compile(r"[A-Za-z0-9+/_.=$@!%^&*~-]+")
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of what the plain patterns find; too short matches drop."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """0 to 1: the heaviest part of a name, or of two neighbouring parts put together (`api_key`, `privateKey`)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in (*parts, *joined)), default=0.0)


def oddity(literal: str) -> float:
    """0 to 1: how little a literal looks like a word: mixed character classes and evenly used characters."""
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * (classes - 1) + entropy(literal) / 8)


def entropy(literal: str) -> float:
    """Bits a character."""
    return -sum(c / len(literal) * math.log2(c / len(literal)) for c in Counter(literal).values())


def signs(literal: str) -> int:
    """Signs of randomness: a digit, both cases, a symbol that words and paths do not have, an even mix of many characters."""
    return (bool(re.search("[0-9]", literal)) + bool(re.search("[a-z]", literal) and re.search("[A-Z]", literal))
            + bool(re.search(r"[^\w\s./:-]", literal)) + (len(literal) >= LONG and entropy(literal) >= EVEN))


def looks_secret(literal: str, weight: float, plain_name: bool) -> bool:
    """Whether a literal is random enough for the name's weight. `plain_name`: it may be a name that is defined elsewhere."""
    if len(literal) < LEAST_LENGTH or weight <= 0:
        return False
    odd, digit = oddity(literal), bool(re.search("[0-9]", literal))
    if digit and weight * (0.4 + 0.6 * odd) >= LEAST_SCORE:
        return True
    if plain_name and not digit or re.search(r"\s", literal):
        return False
    return odd >= LEAST_ODDITY + MORE_ODDITY * (1 - weight) and signs(literal) >= 2


def pairs(text: str) -> list[tuple[str, str | None, str, int, int]]:
    """Assignments in order: name, name assigned from (or None), literal, and the literal's start and end."""
    found, past = [], 0
    for mark in _EQUALS.finditer(text):
        at = mark.start()
        if at < past:
            continue  # inside the literal before
        if text[at:at + 2] in ("==", "=>", "::") or text[at:at + 3] == "://" or text[at - 1:at] in ("=", "!", "<", ">", ":"):
            if text[at - 1:at + 1] != ":=":
                continue
        end = at - 1 if text[at - 1:at + 1] == ":=" else at
        while end > 0 and text[end - 1] in " \t":
            end -= 1
        quote = end > 0 and text[end - 1] in "\"'`]"
        end -= bool(quote)
        begin = end
        while begin > 0 and _NAME_END.match(text[begin - 1]):
            begin -= 1
        name = text[begin:end]
        if not name or not re.search("[A-Za-z]", name):
            continue
        start = at + 1
        while start < len(text) and text[start] in " \t":
            start += 1
        if quoted := _QUOTED.match(text, start):
            group = quoted.lastindex or 1
            found.append((name, None, quoted[group], quoted.start(group), quoted.end(group)))
            past = quoted.end()
        elif bare := _BARE.match(text, start):
            literal, stop = bare[0].rstrip(".!"), bare.end()
            from_name = literal if _IDENTIFIER.fullmatch(literal) else None
            found.append((name, from_name, literal, start, start + len(literal)))
            past = stop if from_name is None else past
    return found


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that a sensitive name is assigned, directly or through other names, and that look like secrets."""
    found = pairs(text)
    reach: dict[str, float] = {}  # the most sensitive name that each name's value goes to
    for name, *_ in found:
        reach[name] = sensitivity(name)
    sources: dict[str, list[str]] = {}
    for name, source, *_ in found:
        if source is not None and source in reach:
            sources.setdefault(name, []).append(source)
    settled: set[str] = set()
    for weight, first in sorted(((reach[n], n) for n in sources), reverse=True):
        waiting = [first]  # heaviest first, so a name is settled when first reached
        while waiting:
            name = waiting.pop()
            if name not in settled:
                settled.add(name)
                reach[name] = max(reach[name], weight)
                waiting.extend(sources.get(name, ()))
    out = []
    for name, source, literal, start, end in found:
        if source is not None and source in reach:
            continue  # a name that is defined here: its own literal counts
        if looks_secret(literal, reach[name], source is not None):
            out.append(("literal", start, end))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    order = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, n_assign, n_access, n_hex, base_sha256 and spans of every row's whole text.

    A null is empty text: no spans, and the digest of the empty string. Repeated rows get one result each.
    """
    def start():
        def work(texts: list[str | None]) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for content in texts:
                base = plain_spans(content or "")
                kinds = Counter(kind for kind, _, _ in base)
                values = (kinds["assign"], kinds["access"], kinds["hex"],
                          hashlib.sha256(joined(base).encode()).hexdigest(),
                          joined(base + literal_spans(content or "")))
                for column, value in zip(out, values):
                    column.append(value)
            return out

        return work

    return with_text_results(df, text, keep, "n_assign long, n_access long, n_hex long, base_sha256 string, "
                                             "spans string", start)


def redacted(content: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones merged, replaced by `mark`."""
    spans = sorted((start, end) for _, start, end in plain_spans(content) + literal_spans(content))
    if not spans:
        return content
    kept, at = [], 0
    for start, end in spans:
        if start >= at:
            kept += [content[at:start], mark]
        at = max(at, end)
    return "".join(kept) + content[at:]


def redact(df: DataFrame, text: str = "text", made: str = "redacted") -> DataFrame:
    """All columns, and the text without secrets in `made`; null texts stay null."""
    def start():
        return lambda texts: [None if t is None else redacted(t) for t in texts]

    return with_cleaned_text(df, text, made, start)

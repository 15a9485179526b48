"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element. A line weighs as much as the text it holds, or nothing if it belongs
to a menu, header, footer, sidebar, notice, advert, form or comments. Weights are summed over windows of consecutive
lines; text starts where the sums surge from nothing and ends where they dive back to it. In a page that marks its
article every line inside it counts that does not stand aside; the sums decide nothing there. In any other page every
stretch counts whose sums reach SURGE, or every stretch if none does.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame

from quire.llm.common import with_text_results

WINDOW = 3     # lines summed up
SURGE = 80     # characters in a window that make a stretch text, in pages that mark no article
MOST = 0.8     # share of a page's text from which a container is its layout, whatever its class says
LINKED = 0.5   # share of a line's characters inside links from which it is a menu, in such pages

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAMES = re.compile(r"[A-Za-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("aside button datalist dialog footer form head header menu nav object search select".split())
# Words in a class, id or role that mark what is no article text.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promotion related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split())
ARTICLE = frozenset(["article", "main"])
NEVER_NAMED = ARTICLE | {"body", "html"}  # no class word sets these aside
# Words that begin a class which tells of a state (`has-sidebar`, `no-share`), not of what the element is.
STATES = frozenset("has no not with without".split())


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """Text, characters inside links, whether it stands aside, whether inside an article; one a non-empty block."""
    found: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    linked = 0
    open_: list[tuple[str, bool, bool, bool]] = []  # tag, stands aside, article, stands aside by name
    named: list[int] = []  # the open containers that stand aside by name
    asides = articles = links = 0

    def close() -> None:
        nonlocal linked
        if text := " ".join(entities.unescape("".join(parts)).split()):
            found.append((text, linked, asides > 0, articles > 0, tuple(named)))
        parts.clear()
        linked = 0

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            parts.append(page[at:token.start()])
            if links:
                linked += len(parts[-1].strip())
        at = token.end()
        end, tag = token[2], (token[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            close()
        if end:
            if any(name == tag for name, *_ in reversed(open_)):
                while True:
                    name, aside, article, by_name = open_.pop()
                    if aside or article or by_name or name == "a":
                        if name != "a" or aside or by_name:
                            close()
                        if by_name:
                            named.pop()
                        asides, articles, links = asides - aside, articles - article, links - (name == "a")
                    if name == tag:
                        break
        elif tag not in VOID and not token[4].endswith("/"):
            aside = tag in ASIDE
            by_name = not aside and tag not in NEVER_NAMED and _stands_aside(token[4])
            article = tag in ARTICLE or 'role="main"' in token[4]
            if aside or by_name:
                close()
            if by_name:
                named.append(token.start())
            open_.append((tag, aside, article, by_name))
            asides, articles, links = asides + aside, articles + article, links + (tag == "a")
    parts.append(page[at:])
    close()
    held: Counter[int] = Counter()
    for text, _, aside, _, inside in found:
        if not aside:
            held.update({at: len(text) for at in (-1, *inside)})
    layout = {at for at, size in held.items() if size > MOST * held[-1]}
    return [(text, linked, aside or not layout.issuperset(inside), article) for text, linked, aside, article, inside in found]


def _stands_aside(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        for word in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _NAMES.findall(word)
            if parts and parts[0] not in STATES and not ASIDE_NAMES.isdisjoint(parts):
                return True
    return False


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """First line, end and heaviest window of each stretch between a surge of the window sums and the next dive to 0."""
    sums = [sum(weights[i:i + window]) for i in range(len(weights))]
    found, begin = [], None
    for i, total in enumerate([*sums, 0]):
        if begin is None and total > 0:
            begin = i
        elif begin is not None and total == 0:
            found.append((begin, i, max(sums[begin:i])))
            begin = None
    return found


def main_text(page: str | None) -> str:
    """The article's blocks, one a line, white space inside a block as one space."""
    lines = lines_of(page or "")
    marked = any(article for _, _, aside, article in lines if not aside)
    if marked:
        weights = [len(text) if article and not aside else 0 for text, _, aside, article in lines]
        kept = stretches(weights)
    else:
        weights = [0 if aside or linked > LINKED * len(text) else len(text) for text, linked, aside, _ in lines]
        found = stretches(weights)
        kept = [s for s in found if s[2] >= SURGE] or found
    return "\n".join(lines[i][0] for begin, end, _ in kept for i in range(begin, end) if weights[i])


def extract(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Columns `keep`, text and n_chars (code points) of every row; null and empty pages have empty text.

    Whole pages are read, broken markup included: an unclosed comment, script or tag ends with the page. Repeated rows
    get one result each.
    """
    def start():
        def work(pages: list[str | None]) -> list[list]:
            texts = [main_text(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        return work

    return with_text_results(df, html, keep, "text string, n_chars long", start)

"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Turns are rendered as growing prefixes; where one output starts with
the output before it, what was added is the new turn's span; where it does not, the template has rewritten history. So
spans, and with them the loss mask, come from what the template does, not from knowledge of its marks.

A template that is declared append-only (attribute `append_only`) is rendered in windows, in linear work; if what they
give is not what it gives for the whole conversation, that conversation is rendered in whole prefixes like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship

# Turns rendered together by an append-only template. A longer conversation goes on in a new window that starts with the last turn of the one before.
WINDOW = 16

Turn = tuple[str, str]  # role, text
# Renders turns; an append-only one takes a second argument, and renders turns that come after so many others.
Template = Callable[..., str]

_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\e"}
_PLAIN = {mark[1]: char for char, mark in _ESCAPES.items()}
_TURN = re.compile(
    r"<<SYS>>\n(?P<system>[^<]*)\n<</SYS>>\n|\[INST\] (?P<user>[^\[]*) \[/INST\]| (?P<assistant>[^<]*)</s>"
    r"|\[ROLE (?P<role>[^\[\]]*)\] (?P<other>[^\[]*) \[/ROLE\]")


def escape(text: str) -> str:
    """No control string can stand in the result: they all begin with `<` or `[`."""
    return re.sub(r"[\\<\[\]]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def instruct(turns: list[Turn], before: int = 0) -> str:
    """A template in the style of instruction models; other roles than the three get a mark that names them."""
    out = [] if before else ["<s>"]
    for role, text in turns:
        text = escape(text)
        if role == "system":
            out.append(f"<<SYS>>\n{text}\n<</SYS>>\n")
        elif role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text}</s>")
        else:
            out.append(f"[ROLE {escape(role)}] {text} [/ROLE]")
    return "".join(out)


instruct.append_only = True


def read_turn(piece: str) -> Turn:
    """Role and text of one turn as `instruct` has written it."""
    m = _TURN.search(piece)
    if m is None:
        raise ValueError(f"no turn in {piece[:80]!r}")
    if m["role"] is not None:
        return unescape(m["role"]), unescape(m["other"])
    role = m.lastgroup
    return role, unescape(m[role])


class History:
    """Feeds turns one by one to a template; gives each turn's piece of the output and whether history changed.

    Without a window, whole prefixes are rendered, and the template gets one argument.
    """

    def __init__(self, template: Template, window: int | None = None):
        self._template, self._window = template, window
        self._turns: list[Turn] = []
        self._before, self._output = 0, ""
        self.rewritten = 0  # turns that changed what was there before them

    def add(self, turn: Turn) -> str:
        if self._window is not None and len(self._turns) == self._window:
            self._before += self._window - 1
            self._turns = self._turns[-1:]
            self._output = self._template(self._turns, self._before)
        self._turns.append(turn)
        output = self._template(self._turns) if self._window is None else self._template(self._turns, self._before)
        if output.startswith(self._output):
            piece = output[len(self._output):]
        else:
            self.rewritten += 1
            same = next((i for i, (a, b) in enumerate(zip(output, self._output)) if a != b),
                        min(len(output), len(self._output)))
            piece = output[same:]
        self._output = output
        return piece


def rendered(turns: list[Turn], template: Template) -> list[tuple[str, bool]]:
    """Each turn's piece, and whether it changed what was there before it, of a whole conversation."""
    def fed(window: int | None) -> list[tuple[str, bool]]:
        history, out = History(template, window), []
        for turn in turns:
            known = history.rewritten
            piece = history.add(turn)
            out.append((piece, history.rewritten > known))
        return out

    if getattr(template, "append_only", False):
        found = fed(WINDOW)
        if not any(changed for _, changed in found) and "".join(p for p, _ in found) == template(turns):
            return found
    return fed(None)


def format_chats(turns: DataFrame, template: Template = instruct, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, piece, role, text, start, length, masked, rewritten: one row a turn, in the order of `turn`.

    `piece` is what the turn added to the conversation's output and start its place there; concatenated in order, pieces
    are the output. `masked` marks assistant turns, which bear loss. Null roles and texts are empty; turns with equal
    numbers are ordered by role and text, null numbers come first; a null conv_id is a conversation of its own.
    A task holds one conversation at a time, as the template must see all of it.
    """
    ship(turns.sparkSession)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "turn", "role", "text", "piece", "start", "length", "masked", "rewritten"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())

        def result(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns = [t for p in parts for t in zip(p.column("role").to_pylist(), p.column("text").to_pylist())]
            made, start, begin = rendered(turns, template), 0, 0
            for part in parts:
                out = []
                for (said_by, _), (piece, changed) in zip(turns[begin:begin + part.num_rows], made[begin:begin + part.num_rows]):
                    out.append((piece, start, len(piece), said_by == "assistant", changed))
                    start += len(piece)
                begin += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=names)

        held, now = [], None
        for batch in batches:
            ids, at = batch.column("conv_id").to_pylist(), 0
            for end in range(1, len(ids) + 1):
                if end < len(ids) and ids[end] == ids[at]:
                    continue
                if held and (ids[at],) != now:
                    yield from result(held)
                    held = []
                now = (ids[at],)
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from result(held)

    return ordered.mapInArrow(render, "conv_id long, turn long, role string, text string, piece string, start long, "
                                      "length long, masked boolean, rewritten boolean")


def digests(formatted: DataFrame, read: Callable[[str], Turn] = read_turn) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the pieces.

    `formatted` comes from `format_chats` in its order, which a narrow step keeps.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def result():
            n, all_, chars, loss, length = state
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(([now[0]], [n], [all_.hexdigest()], [chars], [loss.hexdigest()], [length]),
                                                (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conversation, piece, masked in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "piece", "masked")]):
                if (conversation,) != now:
                    if state is not None:
                        yield result()
                    now, state = (conversation,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if masked:
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
        if state is not None:
            yield result()

    return formatted.select("conv_id", "piece", "masked").mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations and of number -7, whose two turns hold the template's own control strings."""
    spark = conversations.sparkSession
    hard = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(hard).alias("text"))
    return digests(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))

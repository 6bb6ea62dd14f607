"""Chat formatting that is proved by reading it back.

Every turn is rendered with marks of its own, so that the rendered turns of a conversation simply
follow each other. A deterministic parser reads a rendered turn again; if what it finds is not the
turn, or if a control string shows bare, the conflicting parts of the text are escaped and it is
rendered anew, until it is.

Escaping: after the first character of a control string, one more backslash. A control string with
k backslashes there stands for k - 1, so the text never shows a bare control string, other text stays
as it is, and taking one backslash away gives back exactly what was there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema

#: Fixed values of the template: what opens and closes a turn of each role.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
#: Any other role is written out between these.
ROLE_OPEN, ROLE_CLOSE, OTHER_CLOSE = "<s>[ROLE]", "[/ROLE] ", " </s>"

_AFTER_ANGLE, _AFTER_SQUARE = r"(?=/?s>|</?SYS>>)", r"(?=/?INST\]|/?ROLE\])"
_CONTROL = re.compile(rf"<\\*{_AFTER_ANGLE}|\[\\*{_AFTER_SQUARE}")
_BARE = re.compile(rf"<{_AFTER_ANGLE}|\[{_AFTER_SQUARE}")
_ESCAPED = re.compile(rf"(<\\*)\\{_AFTER_ANGLE}|(\[\\*)\\{_AFTER_SQUARE}")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2], text)


def _render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where in it the text stands."""
    before, after = MARKS.get(role) or (ROLE_OPEN + role + ROLE_CLOSE, OTHER_CLOSE)
    return before + text + after, len(before), len(before) + len(text)


class TurnParser:
    """Reads rendered turns off a stream of text, as soon as they are complete."""

    def __init__(self) -> None:
        self._rest = ""

    def feed(self, text: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end of the text in what was fed since the last call) of each turn."""
        buffer, at, out = self._rest + text, 0, []
        while at < len(buffer):
            turn = self._one(buffer, at)
            if turn is None:
                break
            role, body, a, b, at = turn
            out.append((unescape(role), unescape(body), a, b))
        self._rest = buffer[at:]
        return out

    @property
    def complete(self) -> bool:
        return not self._rest

    @staticmethod
    def _one(buffer: str, at: int) -> tuple[str, str, int, int, int] | None:
        if buffer.startswith(ROLE_OPEN, at):
            mid = buffer.find(ROLE_CLOSE, at)
            role, start, after = buffer[at + len(ROLE_OPEN) : mid], mid + len(ROLE_CLOSE), OTHER_CLOSE
            if mid < 0:
                return None
        else:
            role = next((r for r, (opens, _) in MARKS.items() if buffer.startswith(opens, at)), None)
            if role is None:
                return None
            start, after = at + len(MARKS[role][0]), MARKS[role][1]
        # the mark itself, without the space or line end that belongs to it, can't be in the text
        found = buffer.find(after.strip(), start)
        lead = len(after) - len(after.lstrip())
        end = found - lead
        if found < 0 or end < start or buffer[end : end + len(after)] != after:
            return None
        return role, buffer[start:end], start, end, end + len(after)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered turn and where its text stands, proved by reading it back. A null role or text
    is an empty one."""
    role, text = role or "", text or ""
    shown_role, shown = role, text
    for _ in range(3):
        out = _render(shown_role, shown)
        parser = TurnParser()
        found = parser.feed(out[0])
        if parser.complete and [t[:2] for t in found] == [(role, text)] and not _BARE.search(shown) and (role in MARKS or not _BARE.search(shown_role)):
            return out
        shown_role, shown = (role if role in MARKS else escape(role)), escape(text)
    raise ValueError(f"a turn can't be read back: {role[:40]!r}")


FORMATTED = "conv_id long, turn long, role string, segment string, text_start long, text_end long, in_loss boolean"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, segment, text_start, text_end, in_loss: each turn rendered.

    A conversation's formatted text is its segments in the order of turn, role, segment (so that
    repeated turn numbers have a defined order too; nulls first), put together with nothing between.
    ``in_loss`` marks assistant turns; the loss mask is [text_start, text_end) of their segments.
    A null text or role is an empty one, a null conv_id is a conversation of its own, extra columns
    are ignored, and an empty table gives an empty one.
    """
    fields = arrow_schema(FORMATTED)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                segment, start, end = format_turn(role, text)
                rows.append((conv, turn, role or "", segment, start, end, role == "assistant"))
            if rows:
                yield arrow_batch(zip(*rows), fields)

    c = F.col
    chosen = conversations.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), c("role").cast("string").alias("role"), c("text").cast("string").alias("text"))
    return chosen.mapInArrow(render, FORMATTED)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted text alone: the turns that the parser finds and
    the unescaped text under the loss mask, as counts and SHA-256 digests.

    Segments come sorted and are fed to the parser one after another; what is held is a parser, two
    running digests and a few counts, however long the conversation.
    """
    fields = arrow_schema(READ_BACK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def closed():
            conv, parser, turns, loss, n, loss_chars, chars = state
            if not parser.complete:
                raise ValueError(f"conversation {conv} can't be read back")
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            for conv, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed())
                    state = [conv, TurnParser(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text, _, _ in state[1].feed(segment):
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[4] += 1
                    if role == "assistant":
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                        state[5] += len(text)
                state[6] += len(segment)
            if len(done) >= 4096:
                yield arrow_batch(zip(*done), fields)
                done = []
        if state is not None:
            done.append(closed())
        if done:
            yield arrow_batch(zip(*done), fields)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.select("conv_id", "segment").mapInArrow(read, READ_BACK)

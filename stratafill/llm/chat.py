"""Chat formatting with a grammar that reads its own output back.

    conversation := turn*
    turn         := "[ROLE]" role "[TEXT]" text "</s>"

A deterministic parser cuts turns at the control strings. A turn is first rendered as it is and
parsed again; where the parser does not give the source back, the control strings inside the
role and the text are escaped by a backslash after their first character, and the result is
parsed once more. Strings that already look escaped get one more backslash, so reading back is
exact for every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "[ROLE]", "[TEXT]", "</s>"
#: control strings of this template and of other common ones; none is ever left bare in a text
_REST = r"(?=/?s>|/?INST\]|/?SYS\]|ROLE\]|TEXT\])"
_BARE = re.compile(r"([<\[])(\\*)" + _REST)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _REST)
_TURN = re.compile(r"\[ROLE\](.*?)\[TEXT\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> str:
    return f"{OPEN}{role}{BODY}{text}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; refuses what the grammar does not give."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _reads_back(block: str, role: str, text: str) -> bool:
    try:
        return parse(block) == [(role, text)]
    except ValueError:
        return False


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The block of a turn, and where its text begins and ends in it."""
    for change in (str, escape):
        # other templates' control strings are escaped too, though this parser would read them
        if change is str and (_BARE.search(role) or _BARE.search(text)):
            continue
        own_role, own_text = change(role), change(text)
        block = render(own_role, own_text)
        if _reads_back(block, role, text):
            first = len(OPEN) + len(own_role) + len(BODY)
            return block, first, first + len(own_text)
    raise ValueError("a turn does not read back")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [format_turn(role or "", text or "") for role, text in zip(
            batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), batch.column("role"),
             pa.array([x[0] for x in made], pa.string()),
             pa.array([x[1] if r == "assistant" else None for x, r in zip(
                 made, batch.column("role").to_pylist(), strict=True)], pa.int64()),
             pa.array([x[2] if r == "assistant" else None for x, r in zip(
                 made, batch.column("role").to_pylist(), strict=True)], pa.int64())],
            names=["conv_id", "turn", "role", "formatted", "loss_first", "loss_last"])


FORMATTED = ("conv_id bigint, turn bigint, role string, formatted string, "
             "loss_first bigint, loss_last bigint")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Per turn its formatted block and the code points [loss_first, loss_last) to learn from.

    Joined by turn, the blocks of a conversation are its formatted text. Only assistant turns
    have a loss range, the others null. A null role or text counts as empty; conversations and
    turns may be null. Every row is a turn, repeated rows too; columns other than conv_id, turn,
    role and text play no part. No shuffle: turns are formatted where they are read.
    """
    turns = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                                 F.col("role").cast("string"), F.col("text").cast("string"))
    return turns.mapInArrow(_format, FORMATTED)


class _Conversation:
    def __init__(self):
        self.turns, self.length, self.loss = 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, block: str, first: int | None, last: int | None) -> None:
        ((role, text),) = parse(block)
        self.turns += 1
        self.length += len(block)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if first is not None:
            learned = unescape(block[first:last])
            self.loss += len(learned)
            self.learned.update(learned.encode("utf-8", "surrogatepass"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a conversation is read turn by turn and never held whole."""
    now, key, done = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist()
                   for c in ("conv_id", "formatted", "loss_first", "loss_last")]
        for conv, block, first, last in zip(*columns, strict=True):
            if now is None or conv != key:
                if now is not None:
                    done.append((key, now))
                now, key = _Conversation(), conv
            now.add(block, first, last)
        yield _digests(done)
        done = []
    if now is not None:
        yield _digests([(key, now)])


def _digests(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in done], pa.int64()),
         pa.array([c.turns for _, c in done], pa.int64()),
         pa.array([c.all.hexdigest() for _, c in done], pa.string()),
         pa.array([c.loss for _, c in done], pa.int64()),
         pa.array([c.learned.hexdigest() for _, c in done], pa.string()),
         pa.array([c.length for _, c in done], pa.int64())],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
               "formatted_chars"])


DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
           "loss_sha256 string, formatted_chars bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of the turns and the loss text that the formatted text holds.

    The hash of a conversation runs over its turns in order (turn, then role and block; null
    first), so a conversation is one task's work; rows stream through it in constant memory.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "formatted")
    return ordered.mapInArrow(_digest, DIGESTS)

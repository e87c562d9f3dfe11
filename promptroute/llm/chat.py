"""Chat formatting in windows of bounded size.

A conversation's turns are laid out one after the other; prefix sums of their token counts choose
spans of whole turns that fit a budget.  Every later window starts with the conversation's system
turn and a limited history, both repeated, and the loss covers each assistant text once: in the window
in which its turn is new.

    <|im_start|>role
    text<|im_end|>

A ``<|`` inside a text gets a backslash between its two characters (one more if there are some),
so control strings occur as markup only and every text can be read back.

Null texts and roles are empty.  Turns with the same number are ordered by role and text, repeated
rows stay repeated turns, a null conversation id is a conversation of its own, and an empty table
gives no windows.  A turn larger than the budget gets a window of its own.  Other columns are dropped.
A conversation is streamed, never held as a whole, so its number of turns is not bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import arrow_schema

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, ASSISTANT = "system", "assistant"

WINDOWS = (
    "conv_id long, window long, formatted string, n_repeated long, n_turns long, n_tokens long, "
    "loss array<struct<start:int, stop:int>>"
)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
#: Rows of a batch that a task gives back.
ROWS = 256

_TO_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and the turns and tokens of history that a window may repeat."""

    tokens: int = 2048
    history_turns: int = 2
    history_tokens: int = 512


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = unescape(role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    tokens: int


def layout(turns: list[Turn], n_repeated: int) -> tuple[str, list[dict[str, int]]]:
    """The formatted turns, and where the assistant texts stand that are not repeated ones."""
    pieces, loss, at = [], [], 0
    for i, turn in enumerate(turns):
        head, body = f"{START}{escape_role(turn.role)}\n", escape(turn.text)
        if turn.role == ASSISTANT and i >= n_repeated and body:
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        pieces.append(f"{head}{body}{END}\n")
        at += len(pieces[-1])
    return "".join(pieces), loss


class Windows:
    """The windows of one conversation, from its turns in order."""

    def __init__(self, budget: Budget) -> None:
        self.budget = budget
        self.number = 0
        self.system: Turn | None = None
        self.history: list[Turn] = []  # new turns of earlier windows that the next may repeat
        self.fresh: list[Turn] = []
        self.prefix = 0  # tokens of all turns so far
        self.opened = 0  # the prefix at which the open window's new turns begin

    def repeated(self) -> list[Turn]:
        if not self.number:
            return []
        return [self.system, *self.history] if self.system else list(self.history)

    def add(self, turn: Turn) -> dict | None:
        """The window that this turn closes, if any."""
        room = self.budget.tokens - sum(t.tokens for t in self.repeated())
        closed = None
        if self.fresh and self.prefix + turn.tokens - self.opened > room:
            closed = self.close()
        if not self.prefix and not self.number and not self.fresh and turn.role == SYSTEM:
            self.system = turn
        self.fresh.append(turn)
        self.prefix += turn.tokens
        return closed

    def close(self) -> dict:
        repeated = self.repeated()
        text, loss = layout(repeated + self.fresh, len(repeated))
        row = {
            "window": self.number,
            "formatted": text,
            "n_repeated": len(repeated),
            "n_turns": len(self.fresh),
            "n_tokens": sum(t.tokens for t in repeated) + self.prefix - self.opened,
            "loss": loss,
        }
        history, tokens = [], 0
        for turn in reversed((self.history + self.fresh)[-self.budget.history_turns - 1 :]):
            tokens += turn.tokens
            full = len(history) == self.budget.history_turns or tokens > self.budget.history_tokens
            if full or turn is self.system:
                break
            history.append(turn)
        self.history, self.fresh = history[::-1], []
        self.opened = self.prefix
        self.number += 1
        return row


def format_chats(df: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Windows of the conversations in ``df`` (conv_id, turn, role, text): a row for each.

    Columns: conv_id, window, formatted, n_repeated (turns at the start that stood in an earlier
    window), n_turns (new turns), n_tokens, and loss (spans of ``formatted`` in code points).
    ``conv_id`` is a whole number or null.  The windows of a conversation are next to each other, in order, in one partition.
    Tokens of a turn: its words and the four of its markup.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = (
        df.select(F.col("conv_id").cast("long"), F.col("turn"), role.alias("role"), text.alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    kinds = arrow_schema(WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        current, windows = None, None

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) >= least:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows.clear()

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if windows is None or conv != current:
                    if windows is not None:
                        rows.append({"conv_id": current} | windows.close())
                    current, windows = conv, Windows(budget)
                closed = windows.add(Turn(role, text, 4 + len(text.split())))
                if closed:
                    rows.append({"conv_id": current} | closed)
                yield from flush(ROWS)
        if windows is not None:
            rows.append({"conv_id": current} | windows.close())
        yield from flush(1)

    return turns.mapInArrow(run, WINDOWS)


def read_window(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, digests of what its windows hold, read back from them.

    ``windows`` comes straight from ``format_chats``, with a conversation's windows in order.
    """

    kinds = arrow_schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        row, turns, loss = None, None, None

        def finish() -> None:
            if row is not None:
                row["turns_sha256"], row["loss_sha256"] = turns.hexdigest(), loss.hexdigest()
                done.append(row)

        for batch in batches:
            for w in batch.to_pylist():
                if w["window"] == 0:
                    finish()
                    row = {"conv_id": w["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    if len(done) >= ROWS:
                        yield pa.RecordBatch.from_pylist(done, schema=kinds)
                        done.clear()
                read = read_window(w["formatted"])[w["n_repeated"] :]
                row["n_turns"] += len(read)
                row["formatted_chars"] += len(w["formatted"])
                for role, text in read:
                    turns.update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = unescape(w["formatted"][span["start"] : span["stop"]])
                    row["loss_chars"] += len(text)
                    loss.update(text.encode())
        finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    return windows.mapInArrow(run, DIGESTS)

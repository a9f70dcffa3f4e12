"""Chat formatting by event sourcing.

A conversation is a log.  Events are messages, and what later happens to them: streamed deltas (text
appended to a message), edits (text replaced) and regenerations (the answer's text and all messages that
began between the answer and its regeneration are dropped, a new answer starts in its place).  Logs are dealt by
conversation, sorted by the sequence number at which each event's message began, and folded in one
streaming pass; a finished message is rendered at once, and rendered text leaves in parts of
about ``PART`` characters, so memory holds one message that can still change and one part, however
long a conversation is.

Template: ``### role: text</turn>\\n`` per turn.  Inside roles and texts ``\\`` becomes ``\\\\``, ``<``
``\\l``, ``#`` ``\\h``, and in roles ``:`` ``\\c``, so control strings can't occur there, and reading back
is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_parts

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
PART = 4_000_000
#: Spark types of the event log; ``kind`` is message, delta, edit or regenerate.
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
PARTS = "conv_id long, part long, formatted string, loss_from array<long>, loss_to array<long>, last boolean"

_UNESCAPE = {"\\\\": "\\", "\\l": "<", "\\h": "#", "\\c": ":"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("#", "\\h")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lhc]", lambda m: _UNESCAPE[m[0]], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    head = OPEN + escape(role).replace(":", "\\c") + MID
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_back(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of rendered text: role, text, and the text's place."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        mid, end = formatted.index(MID, at), formatted.index(CLOSE, at)
        yield unescape(formatted[at + len(OPEN) : mid]), unescape(formatted[mid + len(MID) : end]), mid + len(MID), end
        at = end + len(CLOSE)


class Fold:
    """The open message of one conversation; what is settled goes to ``done``.

    A message is dropped if it began after another message and before that one's last regeneration,
    whether or not the other is itself dropped.
    """

    def __init__(self) -> None:
        self.role: str | None = None
        self.message: int | None = None
        self.place: int | None = None
        self.pieces: list[str] = []
        self.done: list[tuple[str, str]] = []
        self.cleared = self.soon = -(1 << 63)  # what began before this is dropped; the same with the open place's messages
        self.kept = False

    def settle(self) -> None:
        if self.role is not None and self.kept:
            self.done.append((self.role, "".join(self.pieces)))
        self.role, self.message, self.pieces = None, None, []

    def apply(self, kind: str, message: int | None, role: str, text: str, place: int | None, until: int | None) -> None:
        """One event; place is where its message began, until the last regeneration of that message."""
        if kind != "message" and self.role is not None and message == self.message:
            if kind == "delta":
                self.pieces.append(text)
                return
            if kind in ("edit", "regenerate"):
                self.pieces = [text]
                self.role = role or self.role if kind == "regenerate" else self.role
                return
        self.settle()  # a message, or an event for a message that isn't there: it starts one
        if place != self.place:
            self.cleared = max(self.cleared, self.soon)
        self.soon = max(self.soon, self.cleared if until is None else until)
        self.kept = place is None or place >= self.cleared
        self.role, self.message, self.pieces, self.place = role, message, [text], place


def order_events(events: DataFrame) -> DataFrame:
    """Bring late changes to their message: ``place`` is the least sequence number of a message's events.

    Events without a message number stand for themselves, at their own sequence number.  ``until`` is a message's last
    regeneration.  So the streaming fold needs only the open message.
    """
    own = Window.partitionBy("conv_id", "message")
    known = F.col("message").isNotNull()
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(own)
    return events.withColumns({"place": F.when(known, F.min("seq").over(own)).otherwise(F.col("seq")), "until": F.when(known, again)})


def _rendered(loss_roles: tuple[str, ...]):
    """From sorted events to rendered parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv, began = Fold(), None, False
        part, size, out, spans = 0, 0, [], []
        rows: list[tuple] = []

        def flush(last: bool) -> None:
            nonlocal part, size, out, spans
            rows.append((conv, part, "".join(out), [s for s, _ in spans], [e for _, e in spans], last))
            part, size, out, spans = (0 if last else part + 1), 0, [], []

        def take() -> None:
            nonlocal size
            for role, text in fold.done:
                if size >= PART:
                    flush(False)
                turn, a, b = render(role, text)
                if role in loss_roles:
                    spans.append((size + a, size + b))
                out.append(turn)
                size += len(turn)
            fold.done = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()), strict=True)], ["conv_id", "part", "formatted", "loss_from", "loss_to", "last"])

        held = 0
        for b in batches:
            for c, message, kind, role, text, place, until in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if began and c != conv:
                    fold.settle()
                    take()
                    flush(True)
                    fold = Fold()
                conv, began = c, True
                fold.apply(kind or "message", message, role or "", text or "", place, until)
                take()
                if rows and (len(rows) >= 2000 or sum(len(r[2]) for r in rows[-1:]) + held > PART):
                    held = 0
                    yield batch()
            held = sum(len(r[2]) for r in rows)
        if began:
            fold.settle()
            take()
            flush(True)
        if rows:
            yield batch()

    return run


def _sorted_events(events: DataFrame) -> DataFrame:
    """Events of dealt conversations in order; the windows over messages need no exchange then."""
    # messages that begin at one place go one after another; without a number, by role and text
    ties = [F.col("message").asc_nulls_first(), F.when(F.col("message").isNull(), F.struct("role", "text"))]
    placed = order_events(events.select("conv_id", "seq", "message", "kind", "role", "text")).sortWithinPartitions("conv_id", "place", *ties, "seq", F.col("kind") != "message", "role", "text")
    return placed.select("conv_id", "message", "kind", "role", "text", "place", "until")


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rendered conversations in parts: conv_id, part, formatted, loss_from, loss_to, last.

    ``events`` has the columns of EVENTS.  Order: where the message began (see order_events), message, seq, then
    role, text, so that ties and repeated rows have one order.  An event without a message number is a message of its
    own, but for a delta, edit or regeneration that directly follows one without a number.  Null kinds count as
    messages, null roles and texts as empty; null conv_ids make one conversation; a conversation of which
    all is dropped is one empty part.  Other columns are ignored.  Within a part loss_from and
    loss_to are code points of the texts of ``loss_roles``.  Parts of a conversation leave one task in order.
    """
    return _sorted_events(deal(events)).mapInArrow(_rendered(loss_roles), PARTS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rendered parts, in order, to a row per conversation."""
    turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for b in batches:
        rows = []
        for conv, formatted, starts, ends, last in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
            for role, text, _, _ in read_back(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for s, e in zip(starts, ends, strict=True):
                said = unescape(formatted[s:e])
                loss.update(said.encode())
                chars += len(said)
            total += len(formatted)
            if last:
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digests(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """What the rendered conversations say when read back, a row per conversation; events come dealt by conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  Rendering and reading back are one pass,
    so the order of parts is the rendering's own.  Rows, nulls and ties as in format_chats.
    """
    render_parts = _rendered(loss_roles)
    return _sorted_events(events).mapInArrow(lambda batches: _digested(render_parts(batches)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def deal(rows: DataFrame) -> DataFrame:
    """Whole conversations in a task."""
    return rows.repartition(shuffle_parts(rows.sparkSession), "conv_id")


def as_log(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log that streaming them leaves: events of EVENTS, dealt by conversation.

    Every turn arrives in two pieces.  A turn of ``loss_roles`` has a first attempt that is regenerated, any other
    a first wording that is edited.  Messages are numbered by turn, then role and text, nulls first, so that
    rows which share conversation and turn, and repeated rows, stay messages of their own.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    change = F.when(F.col("role").isin(*loss_roles), "regenerate").otherwise("edit")
    event = lambda k, kind, text: F.struct((F.col("message") * 4 + k).alias("seq"), kind.alias("kind"), F.coalesce(text, F.lit("")).alias("text"))
    steps = F.array(event(0, F.lit("message"), tail), event(1, change, head), event(2, F.lit("delta"), tail))
    return deal(turns).withColumn("message", nth).select("conv_id", "message", "role", F.explode(steps).alias("e")).select("conv_id", "e.seq", "message", "e.kind", "role", "e.text")

"""Chat formatting with a grammar round trip.

A turn renders as ``### role: text </turn>`` and a line feed. The parser is deterministic: a
backslash makes the next character literal; a turn begins with ``### ``, its role ends at the first
unescaped ``: ``, its text at the first unescaped `` </turn>`` with line feed. Every turn is first
rendered as it is and parsed again; where the parser does not give back its role and text exactly,
conflicting content (backslashes and control strings) is escaped and the turn parsed again. What is
not recovered then stops the job.

Turns are rendered and checked where they lie, before any shuffle; then the rows of a conversation
are brought together and ordered by (turn, role, text), and positions are added up in one streaming
pass, which holds one batch, not a conversation.

Defined cases: null text and role are empty strings; null turns come first. Rows with the same turn
are ordered by role and text. Null conversation ids form one conversation. Extra columns are
ignored. An empty table gives no rows. Texts of any length are rendered and parsed whole, each within
one task; a conversation of any length streams through one task without being held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
LEARNED = "assistant"
ROLE_END, TEXT_END = re.compile(r"\\.|: ", re.S), re.compile(r"\\.| </turn>\n", re.S)
CONTROL = re.compile(r"\\|###|</turn>|: ", re.I)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def _until(end: re.Pattern, s: str, at: int) -> tuple[int, int]:
    for m in end.finditer(s, at):
        if s[m.start()] != "\\":
            return m.span()
    raise ValueError("a turn without its end")


def parse(s: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, where the text starts and ends in ``s``) of each turn."""
    at = 0
    while at < len(s):
        if not s.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        a, b = _until(ROLE_END, s, at + len(OPEN))
        y, z = _until(TEXT_END, s, b)
        yield unescape(s[at + len(OPEN) : a]), unescape(s[b:y]), b, y
        at = z


def render(role: str, text: str) -> str:
    for form in (str, escape):
        out = f"{OPEN}{form(role)}{MID}{form(text)}{CLOSE}"
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError("a turn that the template cannot hold")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pieces = [render(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.string())], names=["conv_id", "turn", "role", "text", "piece"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up positions; the rows come sorted, a conversation may go on in the next batch."""
    conv, at, seq = object(), 0, 0
    for b in batches:
        seqs, starts, loss = [], [], []
        for c, role, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if c != conv:
                conv, at, seq = c, 0, 0
            ((_, _, y, z),) = parse(piece)
            seqs.append(seq)
            starts.append(at)
            loss.append({"start": at + y, "end": at + z} if role == LEARNED else None)
            at, seq = at + len(piece), seq + 1
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()), b.column(2), pa.array(loss, pa.struct([("start", pa.int64()), ("end", pa.int64())]))], names=["conv_id", "seq", "start", "piece", "loss"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, start, piece, loss): the pieces, in order, are the formatted conversation.

    start is the piece's position, loss the span under the loss mask (null: none), both in code
    points of the whole. The rows of a conversation lie together and in order.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rendered = rows.mapInArrow(_rendered, "conv_id long, turn long, role string, text string, piece string")
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "piece")
    return ordered.mapInArrow(_placed, "conv_id long, seq long, start long, piece string, loss struct<start:long,end:long>")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    state: list | None = None  # conv, turns, hash of turns, loss characters, hash of the loss text, characters

    def close() -> None:
        if state is not None:
            conv, n, turns, loss, text, chars = state
            done.append((conv, n, turns.hexdigest(), loss, text.hexdigest(), chars))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return out

    for b in batches:
        for c, start, piece, loss in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if state is None or c != state[0]:
                close()
                state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(piece):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            if loss:
                text = unescape(piece[loss["start"] - start : loss["end"] - start])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(piece)
        yield flush()
    close()
    yield flush()


def op3(conversations: DataFrame) -> DataFrame:
    """Digests of every formatted conversation and of conversation -7, read back from the pieces."""
    both = r"\### Assistant: </turn> ok"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", both), (-7, 1, LEARNED, both)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return format_turns(rows).mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

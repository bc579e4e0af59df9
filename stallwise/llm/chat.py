r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context and
only its reply is trained on. What follows the last reply is kept in a closing example with
nothing to train on, so the examples of a conversation always hold all its turns.

A turn is written as ``### role: text</turn>`` and a line end. Texts cannot break out: a
backslash is put before every backslash, ``###`` and ``</turn>`` of a text (and before a colon
of a role), and reading takes it away again.

The turns of a conversation are sorted by turn, then role and text, nulls first; a null text or
role is empty, a null conversation is one of its own, repeated rows are turns of their own.
Rows stream in that order: a task holds the formatted text of one conversation, since an
example holds its whole context. No conversations give no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, COLON, END = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
CONTROL_OF_ROLE = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
# What a reader steps over or stops at.
ENDS = re.compile(r"\\(?:\\|###|</turn>|:)|(</turn>\n)")
COLONS = re.compile(r"\\(?:\\|###|</turn>|:)|(: )")
TRAINED = "assistant"
BATCH_CHARS = 8_000_000


def escaped(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def opening(role: str) -> str:
    return MARK + escaped(role, CONTROL_OF_ROLE) + COLON


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    begin = 0
    for stop in ENDS.finditer(formatted):
        if stop[1]:
            colon = next(m for m in COLONS.finditer(formatted, begin + len(MARK)) if m[1])
            yield unescaped(formatted[begin + len(MARK) : colon.start()]), unescaped(formatted[colon.end() : stop.start()])
            begin = stop.end()


EXAMPLES = "example long, text string, loss_start long, loss_length long"


def expanding(trained: str):
    """Sorted turns to examples; a conversation's rows are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = kind = None
        rows: list[tuple] = []
        size = 0
        now, parts, length, made, open_end = None, [], 0, 0, False

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], kind), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.schema.field("conv").type
            names = ["conv", "example", "text", "loss_start", "loss_length"]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if now is None or now[0] != conv:
                    if open_end:
                        rows.append((now[0], made, "".join(parts), length, 0))
                        size += length
                    now, parts, length, made = (conv,), [], 0, 0
                head, body = opening(role or ""), escaped(text or "")
                parts += (head, body, END)
                begin, length = length + len(head), length + len(head) + len(body) + len(END)
                open_end = role != trained
                if not open_end:
                    whole = "".join(parts)
                    parts = [whole]
                    rows.append((conv, made, whole, begin, len(body)))
                    made += 1
                    size += length
                if size > BATCH_CHARS:
                    yield out()
                    rows, size = [], 0
        if now is not None and open_end:
            rows.append((now[0], made, "".join(parts), length, 0))
        if rows:
            yield out()

    return run


def examples(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length) from (conv_id, turn, role, text).

    ``text`` is the formatted context with the reply; its ``loss_length`` code points from
    ``loss_start`` on are the reply, still escaped, and the only ones to train on. Examples of a
    conversation follow each other in order.
    """
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text").repartition("conv")
    rows = rows.sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, {EXAMPLES}"
    return rows.mapInArrow(expanding(trained), schema).withColumnRenamed("conv", "conv_id")


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Digest:
    """What the examples of one conversation say, read back one after the other."""

    def __init__(self):
        self.loss, self.loss_chars, self.chars, self.last = hashlib.sha256(), 0, 0, ""

    def add(self, text: str, start: int, length: int) -> None:
        reply = unescaped(text[start : start + length])
        self.loss.update(reply.encode())
        self.loss_chars += len(reply)
        self.chars += len(text)
        self.last = text

    def row(self) -> tuple:
        turns, count = hashlib.sha256(), 0
        for role, text in read_turns(self.last):
            turns.update(f"{role}\n{text}\n".encode())
            count += 1
        return count, turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples, those of a conversation in order, to one row per conversation."""
    now, digest = None, Digest()

    def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        rows = []
        for conv, text, start, length in zip(batch.column("conv").to_pylist(), batch.column("text"), *(batch.column(c).to_pylist() for c in ("loss_start", "loss_length")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append((now[0], *digest.row()))
                now, digest = (conv,), Digest()
            digest.add(text.as_py(), start, length)
        yield out(rows, kind)
    if now is not None:
        yield out([(now[0], *digest.row())], kind)


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from :func:`examples` as they come.

    The turns are read from the last example, the replies from the trainable part of each.
    ``formatted_chars`` counts the code points of all examples.
    """
    rows = made.withColumnRenamed("conv_id", "conv")
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, {DIGESTS}"
    return rows.mapInArrow(reading, schema).withColumnRenamed("conv", "conv_id")

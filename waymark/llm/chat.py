"""Chat formatting by prefix-target expansion.

Every turn becomes one segment of its conversation's formatted text. Every assistant turn is
an example of its own: its context is all of the conversation before it, and only the text of
that reply is trainable. ``format_conversations`` places the turns, ``render_examples`` makes
the examples of them, and all digests are read from the examples. Control strings inside
roles and texts are broken by an escape character and come back whole when read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's own marks and the control strings of common chat templates.
TURN_START = "<|turn|>"
TEXT_START = "<|text|>"
TURN_END = "<|end|>"
CONTROL_OPENINGS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "[SEP]", "[CLS]", "[MASK]", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>"]
ESCAPE = "\\"
ASSISTANT = "assistant"
#: Characters of examples that are handed on at once (one example at least).
_BATCH_CHARS = 1_000_000

_BREAK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL_OPENINGS))
_JOIN = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(re.escape(TURN_START) + "(.*?)" + re.escape(TEXT_START) + "(.*?)" + re.escape(TURN_END), re.DOTALL)


def escape(text: str) -> str:
    """The text without any control string: escape characters doubled, one put after the first character of each."""
    return _BREAK.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE + ESCAPE))


def unescape(text: str) -> str:
    """What escape() was given."""
    return _JOIN.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment and where its escaped text starts and ends in it."""
    head, body = TURN_START + escape(role) + TEXT_START, escape(text)
    return head + body + TURN_END, len(head), len(head) + len(body)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each of a formatted text's segments."""
    at = 0
    for found in _SEGMENT.finditer(text):
        if found.start() != at:
            raise ValueError("not formatted turns")
        at = found.end()
        yield unescape(found[1]), unescape(found[2])
    if at != len(text):
        raise ValueError("not formatted turns")


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: (conv_id, position, segment, segment_start, example, loss_start, loss_end).

    position counts a conversation's turns from 0 in the order of turn (null first; ties by
    role, then text); segment is the formatted turn and segment_start where it begins in the
    conversation's formatted text. For an assistant turn example is its number (from 0) and
    loss_start, loss_end bound, in the segment, the trainable text; else all three are null.
    The example's context is the conversation's text before segment_start. A null role or text
    counts as empty, a null conv_id is a conversation of its own, repeated rows stay; an empty
    table gives an empty result; other columns are ignored.
    One shuffle by conversation, after the turns are escaped where they are read; a task
    passes through its sorted turns and holds only counters, whatever a conversation's length.
    """

    def escape_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(k).to_pylist()] for k in (2, 3))
            made = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            trained = [r == ASSISTANT for r in roles]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([m[0] for m in made], pa.string())]
                + [pa.array([m[k] if t else None for m, t in zip(made, trained, strict=True)], pa.int64()) for k in (1, 2)],
                ["conv_id", "turn", "role", "text", "segment", "loss_start", "loss_end"],
            )

    kind = df.schema[conv_col].dataType.simpleString()
    turn_kind = df.schema[turn_col].dataType.simpleString()
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    made = turns.mapInArrow(escape_all, f"conv_id {kind}, turn {turn_kind}, role string, text string, segment string, loss_start long, loss_end long")
    dealt = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment", "loss_start", "loss_end")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, start, example = object(), 0, 0, 0
        for batch in batches:
            positions, starts, examples = [], [], []
            for conv, segment, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != current:
                    current, position, start, example = conv, 0, 0, 0
                positions.append(position)
                starts.append(start)
                examples.append(None if loss is None else example)
                position, start, example = position + 1, start + len(segment), example + (loss is not None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(positions, pa.int64()), batch.column(1), pa.array(starts, pa.int64()), pa.array(examples, pa.int64()), batch.column(2), batch.column(3)],
                ["conv_id", "position", "segment", "segment_start", "example", "loss_start", "loss_end"],
            )

    return dealt.mapInArrow(place, f"conv_id {kind}, position long, segment string, segment_start long, example long, loss_start long, loss_end long")


def _dealt(rows: DataFrame, order: list) -> DataFrame:
    """Rows of a conversation in one task, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def render_examples(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """One row per assistant turn: (conv_id, example, text, loss_start, loss_end), all turns before the reply and the reply in text.

    loss_start and loss_end bound, in text, the reply's own text. Turns after a conversation's
    last reply (or of one without replies) are no context of any example; they make one row
    more, after the examples, with null in example and loss. The size is, for each conversation,
    that of all its prefixes, as the method asks. Takes the rows of format_conversations() in any
    order and dealt out anyhow, as after they were stored; dealt says that they come straight from
    there, which saves a shuffle. Rows come out by conversation and example; a task holds one
    conversation's text. Null conv_ids are one conversation; an empty table gives an empty one;
    other columns are ignored.
    """
    if not dealt:
        formatted = _dealt(formatted, ["position"])
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, context, tail = object(), "", []
        out, chars, schema = [], 0, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "position", "segment", "segment_start", "example", "loss_start", "loss_end")]
            for conv, position, segment, start, example, a, b in zip(*columns, strict=True):
                if position == 0:
                    if tail:
                        out.append((current, None, "".join(tail), None, None))
                    current, context, tail = conv, "", []
                tail.append(segment)
                if example is not None:
                    context, tail = context + "".join(tail), []
                    out.append((conv, example, context, start + a, start + b))
                    chars += len(context)
                if chars > _BATCH_CHARS or len(out) > 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, chars = [], 0
        if tail:
            out.append((current, None, "".join(tail), None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, f"conv_id {kind}, example long, text string, loss_start long, loss_end long")


def read_examples(examples: DataFrame, dealt: bool = False) -> DataFrame:
    """Per conversation, from its examples: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples).

    turns_sha256 covers role, newline, text, newline of each turn; the loss columns cover the
    text under the examples' loss masks, unescaped; formatted_chars is the length of all rows'
    text, so that a turn counts in each example that holds it. Every example must start with the
    whole of the one before, else an error is raised. Takes the rows of render_examples() in any
    order and dealt out anyhow; dealt says that they come straight from there. The digests of a
    conversation are taken by one task as its examples pass by. Empty texts count as turns; null
    conv_ids are one conversation; an empty table gives an empty result; other columns are ignored.
    """
    if not dealt:
        examples = _dealt(examples, [F.asc_nulls_last("example")])
    kind = examples.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, state, out = object(), "", None, []
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv_id"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "example", "text", "loss_start", "loss_end")]
            for conv, example, text, a, b in zip(*columns, strict=True):
                if conv != current:
                    if state:
                        out.append(_totals(current, state))
                    current, before, state = conv, "", [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                added = text
                if example is not None:
                    if not text.startswith(before):
                        raise ValueError("an example without the turns before it")
                    added, before = text[len(before) :], text
                    trained = unescape(text[a:b])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                    state[5] += 1
                for role, said in read_turns(added):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                state[4] += len(text)
            if len(out) > 1_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state:
            yield pa.RecordBatch.from_pylist([*out, _totals(current, state)], schema)

    return examples.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def read_back(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """What read_examples() finds in the examples of formatted turns, which may come in any order (see render_examples)."""
    return read_examples(render_examples(formatted, dealt), dealt=True)


def _totals(conv, state: list) -> dict:
    return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_examples": state[5]}

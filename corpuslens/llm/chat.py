"""Chat formatting by columnar assembly of bytes in Arrow buffers."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of this template, and control strings of others in common use.
BEGIN, HEAD_END, END = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
#: Stands before a character to break up a control string, and before itself.
ESCAPE = "\x1b"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(f"{ESCAPE}(.)", re.S)


def escape(text: str, also: str = "") -> str:
    """Breaks up control strings by a mark before their second character, and puts one
    before marks and the characters in ``also``; ``unescape`` gives the text back."""
    out = re.sub(f"[{ESCAPE}{also}]", lambda m: ESCAPE + m.group(0), text)
    return _CONTROL.sub(lambda m: m.group(0)[0] + ESCAPE + m.group(0)[1:], out)


def unescape(text: str) -> str:
    """Takes each mark away and leaves the character after it."""
    return _ESCAPED.sub(r"\1", text)


def _escaped(column: pa.Array, also: str = "") -> pa.Array:
    """Escapes those rows that hold a mark; the rest stay in their buffer."""
    found = pc.match_substring(column, ESCAPE)
    for mark in [*CONTROL, *also]:
        found = pc.or_(found, pc.match_substring(column, mark))
    if not pc.any(found).as_py():
        return column
    fixed = pa.array([escape(t, also) for t in column.filter(found).to_pylist()], pa.large_string())
    return pc.replace_with_mask(column, found, fixed)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a large_string column."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def _scatter(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copies segment i of ``data`` to out[at[i]:]: one gather and one scatter for all rows."""
    lengths = np.diff(offsets)
    total = int(lengths.sum())
    if not total:
        return
    within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at, lengths) + within] = data[np.repeat(offsets[:-1], lengths) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, with the first byte and the end of each turn's text in it.

    A turn is BEGIN role HEAD_END text END. Segment lengths give every row's offset by a
    running sum; headers, texts and ends are then copied into one buffer of the exact
    size, which becomes the Arrow column without another copy.
    """
    roles = _escaped(roles.cast(pa.large_string()).fill_null(""), "\n")
    texts = _escaped(texts.cast(pa.large_string()).fill_null(""))
    n = len(texts)
    (ro, rd), (to, td) = _bytes(roles), _bytes(texts)
    begin, head, end = (np.frombuffer(s.encode(), np.uint8) for s in (BEGIN, HEAD_END, END))
    role_n, text_n = np.diff(ro), np.diff(to)
    fixed = len(begin) + len(head) + len(end)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(role_n + text_n + fixed, out=offsets[1:])
    buffer = np.empty(int(offsets[-1]), np.uint8)
    at = offsets[:-1]
    text_at = at + len(begin) + role_n + len(head)
    for segment, where in ((begin, at), (head, text_at - len(head)), (end, text_at + text_n)):
        buffer[where[:, None] + np.arange(len(segment))] = segment
    _scatter(buffer, at + len(begin), ro, rd)
    _scatter(buffer, text_at, to, td)
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(buffer))
    return out, text_at - at, text_at - at + text_n


def format_turns(conversations: DataFrame, trained: str = "assistant", partitions: int | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, mask_begin, mask_end, in the order of the file.

    ``formatted`` is the turn in the template; a conversation is the concatenation of its
    turns. mask_begin and mask_end are the bytes of the turn whose loss counts: the text
    of ``trained`` turns, an empty range elsewhere. Null texts and roles count as empty;
    rows with a null conv_id make one conversation of their own; turns sort by number
    (null first), then role and text, so repeated turns stay and have a fixed order; an
    empty table gives no rows; other columns are not read. Rows are dealt by ranges of
    (conv_id, turn), so one conversation of any length is shared by many tasks.
    """
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches):
        for batch in batches:
            made, a, b = assemble(batch.column(2), batch.column(3))
            masked = np.asarray(pc.fill_null(pc.equal(batch.column(2), trained), False))
            b = np.where(masked, b, a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), made.cast(pa.string()), pa.array(a), pa.array(b)],
                names=["conv_id", "turn", "formatted", "mask_begin", "mask_end"],
            )

    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(*order)
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(
        run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, mask_begin long, mask_end long"
    )


_HEAD_END = re.compile(f"(?:[^\n{ESCAPE}]|{ESCAPE}.)*", re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; the header ends at the first line feed that is not escaped."""
    body = formatted[len(BEGIN) : -len(END)]
    end = _HEAD_END.match(body).end()
    return unescape(body[:end]), unescape(body[end + 1 :])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What the formatted turns hold, read back: one row per conversation.

    Columns: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every
    turn), loss_chars and loss_sha256 (all text under the mask, unescaped),
    formatted_chars. A digest needs the turns in order; they stream through a task in
    sorted batches and only running digests are held, however long a conversation is.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state = None, None
        done: list[tuple] = []

        def close():
            if state:
                done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for conv, formatted, a, b in zip(*columns):
                if now is None or now[0] != conv:
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if b > a:
                    loss = unescape(formatted.encode()[a:b].decode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            if len(done) >= 10_000:
                yield _digest_batch(done, schema)
                done = []
        close()
        if done:
            yield _digest_batch(done, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    names = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = to_arrow_schema(turns.sparkSession.createDataFrame([], names).schema)
    rows = turns.select("conv_id", "turn", "formatted", "mask_begin", "mask_end", F.monotonically_increasing_id().alias("_at"))
    sorted_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_at")
    return sorted_.select("conv_id", "formatted", "mask_begin", "mask_end").mapInArrow(run, names)


def _digest_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

"""Chat formatting by columnar byte assembly.

Template, one block per turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside texts and roles ``<|`` gets a backslash (``<\\|``), and a run of backslashes between ``<`` and ``|`` gets one
more, so no control string survives and the change can be undone.  In roles a backslash and a line end are escaped as
well, since the line end closes the header.

Cases: null text or role counts as empty; a null ``conv_id`` is a conversation of its own; equal ``turn`` values are
ordered by role and text, so repeated rows are repeated turns; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Bytes of turns assembled at once; a conversation that is longer spans several parts.
PART_BYTES = 4 << 20
#: A segment of this many bytes is copied as a whole; bytes that one set of scatter indices covers.
LONG_SEGMENT, SCATTER_BYTES = 1 << 12, 1 << 18
FORMATTED = "conv_id long, part int, body binary, loss_starts array<int>, loss_ends array<int>"


def escape_texts(texts: pa.Array) -> pa.Array:
    """Break every control opener; :func:`unescape_text` restores it."""
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def escape_roles(roles: pa.Array) -> pa.Array:
    """As texts, and backslashes and line ends spelled out first."""
    roles = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape_texts(roles)


def unescape_text(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text)


def unescape_role(role: bytes) -> bytes:
    role = unescape_text(role)
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _scatter(body: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy ``source[start:start + size]`` to ``body[to:]`` for each segment: long ones whole, others by scatter indices, a few at a time."""
    long = size >= LONG_SEGMENT
    for t, a, n in zip(to[long].tolist(), start[long].tolist(), size[long].tolist(), strict=True):
        body[t : t + n] = source[a : a + n]
    to, start, size = to[~long], start[~long], size[~long]
    upto = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SCATTER_BYTES, "right")))
        n = size[lo:hi]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        body[place + np.repeat(to[lo:hi], n)] = source[place + np.repeat(start[lo:hi], n)]
        lo = hi


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """All turns in one Arrow buffer, where each turn starts (and the end), and (start, end) of its text.

    Five segments a turn: opener, role, line end, text, closer.  Their lengths give the offsets by one cumulative sum, which
    gives the size of the buffer; headers and contents are then copied into their places in it.
    """
    n = len(texts)
    (role_bytes, role_at), (text_bytes, text_at) = _buffers(roles), _buffers(texts)
    fixed = {column: np.frombuffer(x.encode(), np.uint8) for column, x in ((0, START), (2, "\n"), (4, END))}
    length = np.empty((n, 5), np.int64)
    for column, x in fixed.items():
        length[:, column] = len(x)
    length[:, 1], length[:, 3] = np.diff(role_at), np.diff(text_at)
    to = np.concatenate([[0], np.cumsum(length.ravel())])
    out = pa.allocate_buffer(int(to[-1]))
    body = np.frombuffer(out, np.uint8)
    begin = to[:-1].reshape(n, 5)
    for column, x in fixed.items():
        body[begin[:, column, None] + np.arange(len(x))] = x
    _scatter(body, begin[:, 1], role_bytes, role_at[:-1], length[:, 1])
    _scatter(body, begin[:, 3], text_bytes, text_at[:-1], length[:, 3])
    return out, to[::5], np.stack([to[3::5], to[4::5]], axis=1) if n else np.zeros((0, 2), np.int64)


def _runs(keys: list) -> list[int]:
    """Where runs of equal neighbours begin, and the end."""
    return [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("body", pa.binary()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])
    last, part = object(), 0
    for batch in batches:
        roles, texts = escape_roles(pc.fill_null(batch["role"], "")), escape_texts(pc.fill_null(batch["text"], ""))
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(sizes, before + PART_BYTES, "right"))))
            ids, assistant = batch["conv_id"].slice(lo, hi - lo).to_pylist(), pc.equal(pc.fill_null(batch["role"], ""), "assistant").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            body, turn_at, text_at = assemble(roles.slice(lo, hi - lo), texts.slice(lo, hi - lo))
            runs = _runs(ids)
            offsets = turn_at[runs]
            parts = []
            for i in runs[:-1]:
                part = part + 1 if ids[i] == last else 0
                last = ids[i]
                parts.append(part)
            masked = np.concatenate([[0], np.cumsum(assistant)])[runs]
            within = (text_at - np.repeat(offsets[:-1], np.diff(runs))[:, None])[assistant].astype(np.int32)
            lists = pa.array(masked, pa.int32())
            column = pa.Array.from_buffers(pa.binary(), len(runs) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), body])
            yield pa.record_batch([pa.array([ids[i] for i in runs[:-1]], pa.int64()), pa.array(parts, pa.int32()), column, pa.ListArray.from_arrays(lists, pa.array(within[:, 0])), pa.ListArray.from_arrays(lists, pa.array(within[:, 1]))], schema=schema)
            lo = hi


def format_chat(turns: DataFrame) -> DataFrame:
    """Format ``(conv_id, turn, role, text)`` rows.

    Returns ``conv_id, part, body, loss_starts, loss_ends``: the bytes of the conversation, in parts of bounded size, and
    the byte spans of assistant texts within each part.  Parts of a conversation stay in one partition and in order, so
    a reader of the partition needs memory for one part only, however long a conversation is.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


BLOCK = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def read_back(body: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of the turns in formatted bytes."""
    return [(unescape_role(m[1]), unescape_text(m[2])) for m in BLOCK.finditer(body)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    open_, state = False, None
    chars = lambda b: len(b.decode("utf-8"))

    def close(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if not open_ or row["conv_id"] != state[0]:
                if open_:
                    done.append(close(state))
                open_, state = True, [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            body = row["body"]
            for role, text in read_back(body):
                state[1] += 1
                state[2].update(role + b"\n" + text + b"\n")
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                text = unescape_text(body[a:b])
                state[3] += chars(text)
                state[4].update(text)
            state[5] += chars(body)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 6, types, strict=True)], names=names)
    if open_:
        yield pa.record_batch([pa.array([x], t) for x, t in zip(close(state), types, strict=True)], names=names)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from :func:`format_chat`'s bytes and loss spans."""
    return formatted.mapInArrow(_digest, DIGESTS)

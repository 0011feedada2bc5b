r"""Chat formatting: conversations as one marked text each, with a loss mask.

A turn becomes ``[INST] role [/INST]text</s>``. Inside roles and texts a
backslash goes after the first character of each control string (and of one
that already has backslashes there), which ``unescape`` takes back exactly.
A role's own backslashes and line feeds are written ``\\`` and ``\n``.

Rows are dealt by ranges of (conversation, turn, role, beginning of the text), so
a conversation of any length spreads over tasks, and ranges follow the order of
texts; each task writes *parts* of conversations in
order. A part's bytes are assembled column by column: lengths of all segments,
their cumulative offsets, and one gather into a preallocated buffer.

Nulls: null text or role is empty, a null turn comes first, null conversation
ids form one conversation. Rows of equal turn are ordered by role, then text;
repeated rows each are a turn. No rows: no conversations.
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

from gridloom.llm.arrow import blocks, buffers, partitions, text_of

CONTROL = r"/s>|/?INST\]"
HEAD = 256  # characters of a text that range edges tell apart; edges and their sample are on the driver
OPEN, MIDDLE, CLOSE = b"[INST] ", b" [/INST]", b"</s>"
PARTS = "conv_id long, part long, formatted string, loss_from array<int>, loss_to array<int>"
TURN = re.compile(rb"\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
ESCAPED = re.compile(rb"([<\[])\\(\\*(?:/s>|/?INST\]))")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, rf"([<\[])(\\*)({CONTROL})", r"\1\\\2\3")


def unescape(text: bytes) -> bytes:
    return ESCAPED.sub(rb"\1\2", text)


def role_escape(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def role_unescape(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, where each turn begins (and the last ends), and where its text begins and ends."""
    (role, role_at), (text, text_at) = buffers(roles), buffers(texts)
    fixed = np.frombuffer(OPEN + MIDDLE + CLOSE, np.uint8)
    source = np.concatenate([fixed, role, text])
    n = len(roles)
    begin = np.empty((n, 5), np.int64)
    length = np.empty((n, 5), np.int64)
    for k, (at, size) in enumerate([(0, len(OPEN)), (len(fixed) + role_at[:-1], np.diff(role_at)), (len(OPEN), len(MIDDLE)), (len(fixed) + len(role) + text_at[:-1], np.diff(text_at)), (len(OPEN) + len(MIDDLE), len(CLOSE))]):
        begin[:, k], length[:, k] = at, size
    ends = np.cumsum(length.ravel())
    starts = ends - length.ravel()
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    out[:] = source[np.arange(len(out)) + np.repeat(begin.ravel() - starts, length.ravel())]
    turns = np.append(starts.reshape(n, 5)[:, 0], len(out))
    return out, turns, starts.reshape(n, 5)[:, 3], ends.reshape(n, 5)[:, 3]


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Parts of formatted conversations: conv_id, part (their order), formatted, and the byte spans in it that count for the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for block in blocks(batches, "text"):
            if not block.num_rows:
                continue
            roles = text_of(block.column("role"))
            data, turns, begin, end = assemble(role_escape(roles), escape(text_of(block.column("text"))))
            ids = block.column("conv_id")
            known, key = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            new = np.append(True, (key[1:] != key[:-1]) | (known[1:] != known[:-1]))
            first = np.flatnonzero(new)
            bounds = turns[np.append(first, block.num_rows)]
            text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            loss = np.flatnonzero(pc.equal(roles, loss_role).to_numpy(zero_copy_only=False))
            shift = bounds[:-1][np.cumsum(new) - 1][loss]
            lists = pa.array(np.searchsorted(loss, np.append(first, block.num_rows)).astype(np.int32))
            spans = [pa.ListArray.from_arrays(lists, pa.array((x[loss] - shift).astype(np.int32))) for x in (begin, end)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(part + np.arange(len(first))), text, *spans], [c.split()[0] for c in PARTS.split(", ")])
            part += len(first)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role")]
    dealt = rows.repartitionByRange(partitions(conversations.sparkSession), *order, F.left("text", F.lit(HEAD))).sortWithinPartitions(*order, "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, PARTS)


def digest(parts: DataFrame) -> DataFrame:
    """Read formatted parts back: one row per conversation with counts and digests of turns and of the text under the loss mask.

    A digest needs a conversation's parts one after the other; the task streams
    through them and holds only the running digests.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: int | None, state: list) -> list:
            return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def table(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        held, state = None, None
        for batch in batches:
            done = []
            for key, formatted, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
                if state is None or key != held:
                    if state is not None:
                        done.append(row(held, state))
                    held, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = formatted.encode()
                for role, text in TURN.findall(raw):
                    state[0] += 1
                    state[1].update(role_unescape(role) + b"\n" + unescape(text) + b"\n")
                for a, b in zip(begin, end):
                    text = unescape(raw[a:b])
                    state[2] += len(text.decode())
                    state[3].update(text)
                state[4] += len(formatted)
            if done:
                yield table(done)
        if state is not None:
            yield table([row(held, state)])

    dealt = parts.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

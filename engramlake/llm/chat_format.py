"""Chat formatting by columnar byte assembly.

Every turn becomes header, escaped content and footer. Segment lengths give
cumulative offsets; numpy copies headers and contents of a whole batch into
one preallocated Arrow buffer.

Template: ``<|im_start|>role\\ncontent<|im_end|>\\n``. Inside roles and contents a
backslash goes before the ``|`` of ``<|``, ``<\\|``, ``<\\\\|`` and so on, so ``<|`` in the
output is always a mark, and dropping one backslash of each restores the text.
A role's line breaks are written ``<|nl|>``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = b"<|im_start|>", b"<|im_end|>\n", "<|nl|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(column: pa.Array) -> pa.Array:
    return pc.replace_substring(escaped(column), "\n", BREAK)


def unescaped_role(text: str) -> str:
    return unescaped(text.replace(BREAK, "\n"))


def assembled(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns as one Arrow string array, and in each turn the byte range of its content."""
    from engramlake.llm.kernels import buffers, ranges

    n = len(role)
    parts = [buffers(pa.array([START], pa.binary())), buffers(escaped_role(role)), buffers(pa.array([b"\n"], pa.binary())), buffers(escaped(text)), buffers(pa.array([END], pa.binary()))]
    lengths = np.stack([np.broadcast_to(np.diff(o), n) for _, o in parts], 1).astype(np.int64)
    at = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.reshape(-1), out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)
    segment = at[:-1].reshape(n, 5)
    for k, (data, _) in enumerate(parts):
        if k in (1, 3):  # contents: one scatter of the column's own bytes
            if len(data):
                out[ranges(segment[:, k], lengths[:, k])] = data
        else:  # headers: the same bytes at every row's offset
            for i, b in enumerate(data):
                out[segment[:, k] + i] = b
    offsets = np.append(segment[:, 0], at[-1])
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    start = segment[:, 3] - segment[:, 0]
    return made, start, start + lengths[:, 3]


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn (conv_id, turn, role, text) with ``formatted`` and the loss mask of its content.

    ``loss_start``/``loss_end`` are the byte range of an assistant's content in ``formatted`` (both 0 for
    others). Null texts and roles count as empty. Other columns are left out; every row is kept,
    repeated ones too.
    """

    def run(batches):
        for b in batches:
            role, text = b.column("role"), b.column("text")
            for a in range(0, len(b), 2000):
                r, t = role.slice(a, 2000), text.slice(a, 2000)
                made, start, end = assembled(r, t)
                own = np.asarray(pc.equal(r, "assistant").to_numpy(zero_copy_only=False), bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id").slice(a, 2000), b.column("turn").slice(a, 2000), r, made.cast(pa.string()), pa.array(np.where(own, start, 0)), pa.array(np.where(own, end, 0))],
                    ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"],
                )

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, formatted string, loss_start bigint, loss_end bigint")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: the formatted text and its loss ranges, turns in order of (turn, role, text).

    For training files; a conversation is one value here, so it must fit a row (2 GB). ``digests`` streams
    instead. Null conv_id is a conversation of its own.
    """
    row = F.struct("turn", "role", "formatted", "loss_start", "loss_end")
    whole = format_turns(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return whole.select("conv_id", F.array_join("turns.formatted", "").alias("formatted"), F.col("turns").getField("loss_start").alias("loss_starts"), F.col("turns").getField("loss_end").alias("loss_ends"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from the formatted turns: counts and sha256 of turns and of loss text.

    Rows are sorted within their partition and streamed, so a conversation of any length takes constant memory.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        state, done = None, []

        def closed():
            conv, n, turns, loss, h, chars = state
            done.append((conv, n, turns.hexdigest(), loss, h.hexdigest(), chars))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

        for b in batches:
            for conv, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        closed()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = TURN.fullmatch(text).groups()
                content = unescaped(content)
                state[1] += 1
                state[2].update(f"{unescaped_role(role)}\n{content}\n".encode())
                if end:
                    loss = unescaped(text.encode()[start:end].decode())
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
            if done:
                yield out()
                done.clear()
        if state is not None:
            closed()
            yield out()

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)

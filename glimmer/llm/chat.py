"""Chat formatting: turns of conversations become one text each, with the spans that carry loss.

Template: each turn is ``### {role}: {text}</turn>`` and a line end. Inside roles and texts the characters that
could build a mark (``\\``, ``#``, ``<``; ``:`` in roles too) get a backslash before them, so no text can open or close
a turn, and :func:`read_back` restores every turn exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import flat, table, without

OPEN, MID, CLOSE = b"### ", b": ", b"</turn>\n"
SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"
_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escaped(column: pa.Array, marks: str) -> pa.Array:
    column = pc.fill_null(column, "")
    for mark in "\\" + marks:
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
    """Copy every span of ``data`` to its place in ``out`` at once."""
    lens = np.diff(offs)
    out[np.repeat(to - offs[:-1], lens) + np.arange(offs[-1])] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one preallocated buffer, where each starts, and where the text inside it starts."""
    role, text = flat(escaped(roles, "#<:")), flat(escaped(texts, "#<"))
    n = len(roles)
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 3], sizes[:, 4] = len(OPEN), np.diff(role[1]), len(MID), np.diff(text[1]), len(CLOSE)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    at = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, mark in ((0, OPEN), (2, MID), (4, CLOSE)):
        out[(at[:, k, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), n)
    scatter(out, at[:, 1], *role)
    scatter(out, at[:, 3], *text)
    return out, np.append(at[:, 0], len(out)), at[:, 3]


def _conversations(rows: pa.Table) -> pa.RecordBatch:
    """Whole conversations, in order, to one row each."""
    rows = rows.combine_chunks()
    ids, roles, texts = (rows.column(k).combine_chunks() if rows.num_rows else rows.column(k) for k in ("conv_id", "role", "text"))
    data, turn_at, text_at = assemble(roles, texts)
    key, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])])
    bounds = np.append(new, len(key))
    offs = turn_at[bounds]
    # code points before each byte: those that aren't UTF-8 continuation bytes
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    loss = np.flatnonzero(pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False))
    of = np.searchsorted(new, loss, "right") - 1
    base = points[offs[of]]
    span = pa.StructArray.from_arrays([pa.array(points[text_at[loss]] - base), pa.array(points[turn_at[loss + 1] - len(CLOSE)] - base)], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(new) + 1)).astype(np.int32)), span)
    text = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(new)), pa.array(np.diff(bounds)), text, spans], schema=_OUT)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in; the last conversation of a batch waits for the rest of its turns."""
    wait: list[pa.RecordBatch] = []
    last: object = wait
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        same = ids.is_null() if ids[-1].as_py() is None else pc.fill_null(pc.equal(ids, ids[-1]), False)
        cut = int(np.flatnonzero(~same.to_numpy(zero_copy_only=False))[-1]) + 1 if pc.any(pc.invert(same)).as_py() else 0
        if cut == 0 and last == ids[-1].as_py():
            wait.append(batch)
            continue
        if ids[0].as_py() != last and wait:
            yield _conversations(pa.Table.from_batches(wait))
            wait = []
        if cut:
            yield _conversations(pa.Table.from_batches([*wait, batch.slice(0, cut)]))
            wait = []
        wait.append(batch.slice(cut))
        last = ids[-1].as_py()
    if wait:
        yield _conversations(pa.Table.from_batches(wait))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (code points of ``formatted``).

    Turns go by ``turn`` (nulls first), ties by role and text. A null role or text counts as empty; rows with a null
    conv_id form one conversation of their own. Repeated rows stay; no rows give no rows. Extra columns are ignored.
    """
    turns = without(turns, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, SCHEMA)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    turns = without(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    done = format_conversations(turns.unionByName(more))
    return done.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Chat formatting by columnar byte assembly.

A conversation's turns become one text. Per batch, the lengths of all segments (header, escaped content, end mark)
give their places as cumulative offsets; headers, contents and end marks are scattered with numpy into one
preallocated buffer, which becomes the Arrow column without another copy. The loss mask is the list of code point
ranges that hold assistant contents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.arrow import slices

#: The template: START, role, MIDDLE, content, END. In contents and roles, a backslash goes before every character
#: of ESCAPED (in roles also before a colon), so that neither START nor END nor the end of a role can appear there.
START, MIDDLE, END = "### ", ": ", " </turn>\n"
ESCAPED = "\\#<"
LEARNED_ROLE = "assistant"

_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*) </turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_MASK = "array<struct<start:int,end:int>>"


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; anything that the template cannot have made is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _header(role: str) -> np.ndarray:
    escaped = re.sub(r"([\\#<:])", r"\\\1", role)
    return np.frombuffer(f"{START}{escaped}{MIDDLE}".encode(), np.uint8)


def assemble(roles: pa.Array, contents: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The formatted conversations and their loss masks. ``firsts`` are the rows at which conversations begin."""
    contents = pc.fill_null(contents, "").cast(pa.large_string())
    contents = pa.concat_arrays([contents])
    if contents.offset:
        contents = pa.array(contents.to_pylist(), pa.large_string())
    rows = len(contents)
    source_offsets = np.frombuffer(contents.buffers()[1], np.int64)[: rows + 1]
    data = contents.buffers()[2]
    source = np.frombuffer(data, np.uint8)[source_offsets[0] : source_offsets[-1]] if data else np.zeros(0, np.uint8)
    source_offsets = source_offsets - source_offsets[0]

    special = np.isin(source, np.frombuffer(ESCAPED.encode(), np.uint8))
    escapes = np.concatenate([[0], np.cumsum(special)])
    body = np.diff(source_offsets) + np.diff(escapes[source_offsets])
    kinds = pc.fill_null(roles, "").dictionary_encode()
    headers = [_header(r) for r in kinds.dictionary.to_pylist()]
    kind = kinds.indices.to_numpy()
    header = np.array([len(h) for h in headers], np.int64)[kind] if rows else np.zeros(0, np.int64)
    end_mark = np.frombuffer(END.encode(), np.uint8)

    starts = np.concatenate([[0], np.cumsum(header + body + len(end_mark))])
    out = np.empty(starts[-1], np.uint8)
    for k, bytes_ in enumerate(headers):
        out[starts[:-1][kind == k][:, None] + np.arange(len(bytes_))] = bytes_
    body_starts = starts[:-1] + header
    out[(body_starts + body)[:, None] + np.arange(len(end_mark))] = end_mark
    shift = np.repeat(body_starts - source_offsets[:-1] - escapes[source_offsets[:-1]], np.diff(source_offsets))
    places = np.arange(len(source)) + escapes[1:] + shift
    out[places] = source
    out[places[special] - 1] = ord("\\")

    offsets = np.concatenate([starts[firsts], [starts[-1]]])
    formatted = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    conversation = np.repeat(np.arange(len(firsts)), np.diff([*firsts, rows]))
    zero = points[starts[firsts]][conversation]
    learned = np.flatnonzero(np.array([r == LEARNED_ROLE for r in kinds.dictionary.to_pylist()], bool)[kind]) if rows else []
    ranges = pa.StructArray.from_arrays(
        [
            pa.array((points[body_starts] - zero)[learned].astype(np.int32)),
            pa.array((points[body_starts + body] - zero)[learned].astype(np.int32)),
        ],
        names=["start", "end"],
    )
    held = np.concatenate([[0], np.cumsum(np.bincount(conversation[learned], minlength=len(firsts)))])
    return formatted, pa.ListArray.from_arrays(pa.array(held, pa.int32()), ranges)


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation: ``conv_col``, formatted (string), loss_mask (start, end in code points).

    Turns are taken in the order of ``turn_col``; ties by role, then text, nulls first. Null texts and roles are
    empty; rows that repeat are turns like others; rows without a conversation id form one conversation with a null
    id. Texts may have any length and hold the template's own marks. An empty table gives an empty result; other
    columns are not read. A conversation is one row of the result, so it is put together in one task; its rows
    stream in order and only one conversation is held back from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch, "text"):
                bounds = _firsts(part)
                if held and _same(held[-1].column("id")[-1], part.column("id")[0]):
                    cut = bounds[1] if len(bounds) > 1 else len(part)
                    held.append(part.slice(0, cut))
                    part = part.slice(cut)
                    if not len(part):
                        continue
                if held:
                    yield _assembled(held)
                bounds = _firsts(part)
                if bounds[-1]:
                    yield _assembled([part.slice(0, bounds[-1])])
                held = [part.slice(bounds[-1])]
        if held:
            yield _assembled(held)

    source = turns.select(
        F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()
    ordered = source.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    done = ordered.mapInArrow(run, f"id {kind}, formatted string, loss_mask {_MASK}")
    return done.withColumnRenamed("id", conv_col)


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _firsts(rows: pa.RecordBatch) -> np.ndarray:
    """The rows at which another conversation begins."""
    ids = rows.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])


def _assembled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    firsts = _firsts(rows)
    formatted, mask = assemble(rows.column("role"), rows.column("text"), firsts)
    return pa.RecordBatch.from_arrays(
        [rows.column("id").take(pa.array(firsts)), formatted.cast(pa.string()), mask], names=["id", "formatted", "loss_mask"]
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col``, formatted, turns (role, text) and learned: all text under the loss mask, unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for part in slices(batch, "formatted"):
                texts = part.column("formatted").to_pylist()
                turns = [[{"role": r, "text": t} for r, t in parse(text)] for text in texts]
                learned = [
                    "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                    for text, mask in zip(texts, part.column("loss_mask").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("formatted"), pa.array(turns, turns_type), pa.array(learned, pa.string())],
                    names=["id", "formatted", "turns", "learned"],
                )

    source = formatted.select(F.col(conv_col).alias("id"), "formatted", "loss_mask")
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, formatted string, turns array<struct<role:string,text:string>>, learned string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", conv_col)

"""Byte-level BPE encoding and decoding with a sentencepiece model written directly from a rank file.

Each vocabulary entry becomes a piece: its bytes are mapped to printable characters (one per byte), its score is
the negative rank, and its id is the rank. Normalisation is the identity, so sentencepiece's BPE merges the
adjacent pair of the smallest rank first, which is what the rank file means. Texts are cut into pre-tokens by
the vocabulary's pattern and every pre-token is encoded by itself; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.arrow import ragged, slices, texts

#: Encoded chunks that a worker remembers; longer chunks than this are never remembered.
CACHE_ENTRIES, CACHE_CHARS = 120_000, 64


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file (base64 bytes and rank per line), by rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in lines if x.strip())}
    vocabulary = [found.get(i) for i in range(len(found))]
    if None in vocabulary or len({*vocabulary} & {bytes([b]) for b in range(256)}) != 256:
        raise ValueError("ranks must run from 0 without gaps and hold all single bytes")
    return vocabulary


@lru_cache(1)
def byte_alphabet() -> tuple[dict[int, str], dict[str, int]]:
    """A printable character for every byte, and back: printable Latin-1 as it is, the others from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    forward = {b: chr(b) for b in printable}
    forward |= {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*printable}))}
    return forward, {c: b for b, c in forward.items()}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; one unknown piece, never met, comes last."""
    forward, _ = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2  # fixed values of the model format
    pieces = [
        _field(1, _field(1, "".join(forward[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for rank, token in enumerate(vocabulary)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(vocabulary))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts in a worker.

    A text may be cut before any single space that follows or precedes a character which is no white space: the
    pattern never joins across it. The cut chunks are mostly words, whose ids are remembered; so are pre-tokens,
    which many chunks share.
    """

    inner_run, cut = re.compile(r" \s"), re.compile(r" (?=\S)")

    def __init__(self, model: bytes, pattern: str) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.alphabet = byte_alphabet()[0]
        self.first_chunks: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}
        self.long: list[tuple[dict[str, bytes], str]] = []

    def _cut(self, text: str) -> list[str]:
        """The text cut at spaces; each chunk but the first stands for itself after one space."""
        return self.cut.split(text) if self.inner_run.search(text) else text.split(" ")

    def _learn_pre_tokens(self, wanted: set[str]) -> None:
        new = [*wanted - self.pre_tokens.keys()]
        mapped = [p.encode().decode("latin-1").translate(self.alphabet) for p in new]
        ids = self.pieces.encode(mapped, out_type=int, num_threads=1) if new else []
        ends = np.cumsum([4 * len(i) for i in ids]).tolist()
        joined = np.fromiter(chain.from_iterable(ids), np.int32).tobytes()
        self.long += [(self.pre_tokens, p) for p in new if len(p) > CACHE_CHARS]
        self.pre_tokens.update(zip(new, (joined[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def _learn(self, known: dict[str, bytes], new: list[str], before: str) -> None:
        """Remember the ids of chunks; a chunk of letters is one pre-token with the space before it."""
        if len(self.pre_tokens) > CACHE_ENTRIES:
            self.pre_tokens.clear()
        self.long += [(known, c) for c in new if len(c) > CACHE_CHARS]
        whole = [c for c in new if c.isalpha()]
        mixed = [c for c in new if not c.isalpha()]
        parts = [self.split(before + c) for c in mixed]
        self._learn_pre_tokens({before + c for c in whole}.union(*parts))
        ids = self.pre_tokens
        known.update((c, ids[before + c]) for c in whole)
        known.update((c, b"".join([ids[p] for p in ps])) for c, ps in zip(mixed, parts, strict=True))

    def encode(self, rows: list[str]) -> list[bytes]:
        """Per text its ids as 32-bit numbers."""
        cut = [self._cut(t) for t in rows]
        first, rest = self.first_chunks, self.chunks
        for known, seen, before in ((first, {c[0] for c in cut}, ""), (rest, set().union(*(c[1:] for c in cut)), " ")):
            if len(known) > CACHE_ENTRIES:
                known.clear()
            self._learn(known, [*seen - known.keys()], before)
        out = [b"".join([first[c[0]], *map(rest.__getitem__, c[1:])]) for c in cut]
        for known, chunk in self.long:
            known.pop(chunk, None)
        self.long.clear()
        return out


def encode(
    docs: DataFrame, vocabulary: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row ``id_col`` and ids (array of int).

    Null text counts as empty and has no ids; texts of any length are encoded whole; rows that repeat stay; an
    empty table gives an empty result; other columns are not read. No special tokens.
    """
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(vocabulary))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, ids = ragged(encoder.encode(texts(part.column("text"))), "i4")
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("id"), column], names=["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>")
    return coded.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: list[bytes], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` and the bytes that its ids stand for (null ids: null)."""
    model = tokens.sparkSession.sparkContext.broadcast(sentencepiece_model(vocabulary))
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        back = byte_alphabet()[1]
        table = [bytes(back[c] for c in pieces.id_to_piece(i)) for i in range(size)]
        table = np.array([*table, b""], object)[:-1]  # one object for each id
        for batch in batches:
            ids = batch.column(ids_col)
            flat, ends = ids.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())
            whole = [
                b"".join(table[flat[a:b]].tolist()) if held else None
                for a, b, held in zip([0, *ends], ends, ids.is_valid().to_pylist(), strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(whole, pa.binary())], names=[*batch.schema.names, out_col]
            )

    return tokens.mapInArrow(run, tokens.schema.simpleString()[7:-1] + f",`{out_col}`:binary")

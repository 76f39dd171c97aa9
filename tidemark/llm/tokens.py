"""Encoding of texts with a public byte-level BPE vocabulary, and back.

The vocabulary is serialised as a SentencePiece BPE model: every byte of a token
stands as one printable character, a token's score is its negative rank, and
texts are not normalised.  SentencePiece then merges the best pair first, as
byte-level BPE does, within each pre-token.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..common import col, spread

#: Where the vocabulary files lie; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the published pattern that cuts a text into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a task remembers; beyond that it starts afresh.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


def read_ranks(name: str = "byte_bpe_50k", path: str = VOCABULARIES) -> list[bytes]:
    """The tokens of a vocabulary file, by id."""
    with open(os.path.join(path, f"{name}.tiktoken"), "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """A field of a protocol-buffers message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A SentencePiece BPE model of the tokens, whose piece ids are the token ids; the unknown piece comes last."""
    char = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(char[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(i, -1) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Encoder:
    """Texts to ids by a serialised model."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model)
        self.find = regex.compile(PATTERN).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        pieces = [w.encode().decode("latin-1").translate(self.table) for w in words]
        self.known.update(zip(words, map(tuple, self.model.encode(pieces, out_type=int, num_threads=1))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        if not text:
            return []
        words = self.find(text)
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            for a in range(0, len(new), REMEMBERED // 2):
                self._learn(new[a : a + REMEMBERED // 2])
            if any(w not in known for w in words):  # more different pre-tokens in one text than are remembered
                return [i for w in words for i in self.model.encode(w.encode().decode("latin-1").translate(self.table))]
        ids: list[int] = []
        for w in words:
            ids += known[w]
        return ids


def _encoded(df: DataFrame, ident: str, text: str, model: bytes, lengths: bool, carry: tuple[str, ...]) -> DataFrame:
    names = [ident, *carry]
    src = spread(df.select(*[col(c) for c in names], col(text).cast("string").alias("\0text")))
    made = "n_tokens" if lengths else "ids"
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"{made} " + ("bigint" if lengths else "array<int>")])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for b in batches:
            texts = b.column(len(names))
            start = 0
            while start < b.num_rows:
                # Long texts come out in small batches.
                ids, ends, stop = [], [0], start
                while stop < b.num_rows and ends[-1] < 2_000_000:
                    one = encoder.encode(texts[stop].as_py())
                    if lengths:
                        ends.append(len(one))
                    else:
                        ids += one
                        ends.append(len(ids))
                    stop += 1
                out = pa.array(ends[1:], pa.int64()) if lengths else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([*[c.slice(start, stop - start) for c in b.columns[: len(names)]], out], names=[*names, made])
                start = stop

    return src.mapInArrow(kernel, schema)


def encode_texts(df: DataFrame, ident: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", path: str = VOCABULARIES) -> DataFrame:
    """One row per row of ``df``: ``ident`` and ``ids``, the token ids of the whole text without special tokens.

    Empty and null texts have the empty list.  Strings of special tokens in a text are ordinary text.  Repeated rows
    come out each; an empty table gives none; of further columns none is read.  Nothing is shuffled but a table of few files; the model, of fixed
    size, goes to every task.
    """
    return _encoded(df, ident, text, serialise(read_ranks(name, path)), False, ())


def count_tokens(
    df: DataFrame, ident: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), name: str = "byte_bpe_50k", path: str = VOCABULARIES
) -> DataFrame:
    """As ``encode_texts``, with ``n_tokens`` instead of the ids, and the columns ``carry``."""
    return _encoded(df, ident, text, serialise(read_ranks(name, path)), True, carry)


def decode_ids(df: DataFrame, ident: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", path: str = VOCABULARIES) -> DataFrame:
    """``ident`` and ``text`` of each list of ids; the empty text for an empty list, null for null or an unknown id."""
    tokens = read_ranks(name, path)
    src = df.select(col(ident), col(ids).cast("array<int>").alias("\0ids"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for one in b.column(1):
                one = one.as_py()
                known = one is not None and all(i is not None and 0 <= i < len(tokens) for i in one)
                texts.append(b"".join(tokens[i] for i in one).decode(errors="replace") if known else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[ident, "text"])

    return src.mapInArrow(kernel, f"`{ident}` {df.schema[ident].dataType.simpleString()}, text string")

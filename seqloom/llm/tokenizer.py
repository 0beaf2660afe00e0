"""Encoding of a corpus with a public byte-level BPE vocabulary, by a sentencepiece model made from its rank file.

The rank file gives each token's bytes and rank.  A model is serialised from it directly, without training: every
byte is mapped to a printable character, a piece is the mapped bytes of a token, its score is the negative rank
(so that the lowest rank merges first), its number is the rank, and normalisation is the identity.  Text is cut
into pre-tokens by the vocabulary's pattern, each pre-token is encoded by the model.  Decoding is the inverse
mapping of the pieces' characters to bytes.

A text is cut where a non-space is followed by white space, at which no pre-token or look-ahead of the pattern
reaches across; the pieces between such cuts repeat a lot and are remembered, with their ids, in a bounded table of
each Python worker.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pattern of the rank file, and the white space it knows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [base64.b64decode(t) for t, _ in sorted(pairs, key=lambda p: int(p[1]))]
    if sorted(int(r) for _, r in pairs) != list(range(len(pairs))):
        raise ValueError("the ranks have gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece number n is token n; one more piece, the last, stands for the unknown."""
    chars = byte_characters()
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, 1)) for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class _Table(dict):
    """Remembers what ``make`` returns for a key; emptied when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Codec:
    """Encoder and decoder; ids as the bytes of little-endian int32."""

    def __init__(self, model: bytes, most_segments: int = 300_000, most_pretokens: int = 150_000):
        import regex
        import sentencepiece  # only needed here, so the other operators work without it

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(PATTERN)
        chars = byte_characters()
        self._chars = {b: c for b, c in enumerate(chars)}
        self._bytes = {ord(c): b for b, c in enumerate(chars)}
        self.pretokens = _Table(self._pretoken, most_pretokens)
        self.segments = _Table(self._segment, most_segments)

    def _pretoken(self, text: str) -> bytes:
        mapped = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._chars)
        return np.asarray(self.sp.encode(mapped), np.int32).tobytes()

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.segments.__getitem__, _SEGMENT.findall(text)))

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text or ""), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return bytes(self._bytes[ord(c)] for i in ids for c in self.sp.id_to_piece(int(i))).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(model) -> Codec:
    """The codec of a broadcast model, one in each Python worker."""
    if model.__class__ is bytes:
        return Codec(model)
    key = id(model)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model.value)
    return _CODECS[key]


def shared_model(spark: SparkSession, ranks: str | None = None):
    """The serialised model as a broadcast variable: about a megabyte, fixed by the vocabulary, not by the data.

    The rank file is read on the driver: ``ranks``, else the setting seqloom.tokenizer.ranks, else DEFAULT_RANKS.
    """
    path = ranks or spark.conf.get("seqloom.tokenizer.ranks", DEFAULT_RANKS)
    return spark.sparkContext.broadcast(serialise(read_ranks(path)))


def encode(df: DataFrame, doc: str, text: str, ranks: str | None = None) -> DataFrame:
    """(doc, ids array<int>): the ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts have an empty list. Whole
    texts are encoded, whatever their length. Rows stay as they are: a repeated row is encoded again.
    """
    model = shared_model(df.sparkSession, ranks)
    kind = df.schema[doc].dataType.simpleString()

    def run(batches):
        codec = _codec(model)
        for b in batches:
            parts = [codec.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) >> 2 for p in parts], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], ["doc", "ids"])

    out = df.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc {kind}, ids array<int>")
    return out.withColumnRenamed("doc", doc)


def measure(df: DataFrame, columns: list[str], text: str, ranks: str | None = None) -> DataFrame:
    """The named columns with n_tokens (number of ids) and diversity (distinct pieces over pieces, 0 without any)."""
    model = shared_model(df.sparkSession, ranks)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        codec = _codec(model)
        for b in batches:
            n, diversity = [], []
            for t in b.column(len(columns)).to_pylist():
                pieces = _SEGMENT.findall(t) if t else []
                n.append(len(b"".join(map(codec.segments.__getitem__, pieces))) >> 2)
                diversity.append(len(set(pieces)) / len(pieces) if pieces else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(n, pa.int64()), pa.array(diversity, pa.float64())], [*columns, "n_tokens", "diversity"])

    return df.select(*columns, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{fields}, n_tokens long, diversity double")

"""Byte-level BPE through a sentencepiece model that is serialised directly from the vocabulary."""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import PieceCoder, cut_ids
from .common import map_text, utf8


# FIXED VALUES: code points that newer Unicode tables count as letters or digits and tiktoken's tables don't know yet.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def byte_letters() -> list[str]:
    """One printable letter for every byte: printable Latin-1 characters stand for themselves, the other bytes
    for the letters from U+0100 on, in order."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a rank file (base64 token, space, rank)."""
    got = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                got[int(rank)] = base64.b64decode(token)
    assert sorted(got) == list(range(len(got)))
    return [got[r] for r in range(len(got))]


def _field(number: int, value) -> bytes:
    """One protobuf field: bytes, float or integer."""
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: piece 0 is the unknown, piece r + 1 the token of rank r in byte letters with score
    -r; type BPE, identity normalisation (no added prefix, no removed or escaped white space)."""
    letters = byte_letters()
    model = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for r, t in enumerate(tokens):
        piece = "".join(letters[b] for b in t).encode()
        model.append(_field(1, _field(1, piece) + _field(2, float(-r)) + _field(3, 1)))
    model.append(_field(2, _field(3, 2) + _field(4, len(tokens) + 1)))
    model.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(model)


class Codec:
    """Encodes and decodes with one rank file; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.pattern = regex.compile(pattern)
        self.later = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]")
        letters = byte_letters()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(r + 1)) for r in range(len(tokens))]
        self.whole = {t: [r] for r, t in enumerate(tokens)}
        self.coder = PieceCoder(self.encode_pieces, special=b"\xff")       # no byte of a text: there are no special tokens

    def find(self, piece: str) -> list[str]:
        """The pattern's matches; code points of LATER are matched as if they were the symbol U+2603."""
        if piece.isascii() or not self.later.search(piece):
            return self.pattern.findall(piece)
        return [piece[m.start():m.end()] for m in self.pattern.finditer(self.later.sub("\u2603", piece))]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[m.encode("utf-8", "replace") for m in self.find(c)] for c in pieces]
        ids = dict.fromkeys(x for f in found for x in f)
        ask = []
        for t in ids:                                   # a match that is a token as a whole stays one
            ids[t] = self.whole.get(t)
            if ids[t] is None:
                ask.append(t)
        for t, got in zip(ask, self.model.encode([t.decode("latin-1").translate(self.to_letters) for t in ask], num_threads=1)):
            ids[t] = [x - 1 for x in got]
        rows = [ids[f[0]] if len(f) == 1 else [x for t in f for x in ids[t]] for f in found]
        return np.array([x for r in rows for x in r], np.uint32), np.array([len(r) for r in rows], np.int64)

    def encode(self, texts: pa.Array) -> list[bytes]:
        return cut_ids(*self.coder(*utf8(texts)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the ids of the whole text as little-endian unsigned 32-bit integers; a null or empty text has
    none. Texts of any length are encoded whole, chunk by chunk."""
    def make():
        c = codec(path, pattern)
        return lambda texts: [pa.array(c.encode(texts), pa.binary())]
    return map_text(df, text_col, [(out, "binary")], make, keep, 1 << 20)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for (null ids: none)."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType
    keep = [c for c in df.columns if c.lower() != out.lower()]
    src = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType(src.schema.fields + [StructField(out, BinaryType())])
    arrow, at = to_arrow_schema(schema), keep.index(ids_col)

    def run(parts):
        c = codec(path, pattern)
        for b in parts:
            got = pa.array([c.decode(x or b"") for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*b.columns, got], arrow.types)], schema=arrow)
    return src.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass: adds ``ids`` and ``decoded``."""
    def make():
        c = codec(path, pattern)

        def f(texts):
            ids = c.encode(texts)
            return [pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())]
        return f
    return map_text(df, text_col, [("ids", "binary"), ("decoded", "binary")], make, keep, 1 << 20)

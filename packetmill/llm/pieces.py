"""SentencePiece encoding with byte offsets into the original text, and decoding.

The text is normalised by longest prefixes of the model's compiled character map, and every
normalised byte remembers the source byte that it came from. The library segments; each piece's bytes are then laid
along the normalised text, and their ends are projected back, so every piece has a span of original UTF-8 bytes.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packetmill.llm.common import append_columns, texts_of
from packetmill.llm.words import ChunkEncoder

_SPACE = "▁".encode()
# Piece types of a model file (fixed values of the format).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """``(number, value)`` of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at:at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at:at + n], at + n
        yield key >> 3, value


class Model:
    """What the offsets need from a model file: pieces, their types, and how texts are normalised."""

    def __init__(self, data: bytes):
        self.pieces, self.types, self.scores = [], [], []
        norm, trainer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.dummy_prefix, self.trim, self.escape = (bool(norm.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.user = sorted((p.encode() for p, t in zip(self.pieces, self.types) if t == _USER), key=len, reverse=True)
        self._read_map(norm.get(2, b""))
        self.unk = self.types.index(_UNKNOWN) if _UNKNOWN in self.types else -1
        self.lengths = np.array([1 if t == _BYTE else 0 if t == _CONTROL else len(p.encode())
                                 for p, t in zip(self.pieces, self.types)] or [0], np.int64)

    def _read_map(self, data: bytes) -> None:
        self.units, self.strings = [], b""
        if data:
            n = struct.unpack("<I", data[:4])[0]
            self.units, self.strings = np.frombuffer(data[4:4 + n], "<u4").tolist(), data[4 + n:]

    @property
    def plain(self) -> bool:
        """Whether nothing is replaced or trimmed and no piece crosses a word's start: then chunks encode alone."""
        crossing = re.compile("[^▁]▁")
        return (not self.units and not self.user and not self.trim and self.escape and self.dummy_prefix
                and not self.suffix and not any(crossing.search(p) for p in self.pieces))

    def _longest(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix at ``at``, and how many source bytes it takes."""
        for symbol in self.user:
            if raw.startswith(symbol, at):
                return symbol, len(symbol)
        if self.units:
            units, size, value = self.units, 0, -1
            node = _offset(units[0])
            for i in range(at, len(raw)):
                node ^= raw[i]
                unit = units[node] if node < len(units) else 0
                if unit & 0x800000FF != raw[i]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    value, size = units[node] & 0x7FFFFFFF, i + 1 - at
            if size:
                return self.strings[value:self.strings.index(b"\0", value)], size
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at:at + size], size

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and their end, the source byte where it begins."""
        raw = text.encode("utf-8")
        if not raw:
            return b"", np.zeros(1, np.int64)
        if not self.units and not self.user and not self.trim and self.escape and not self.suffix:
            body = raw.replace(b" ", _SPACE)
            source = np.repeat(np.arange(len(raw)), np.where(np.frombuffer(raw, np.uint8) == 32, len(_SPACE), 1))
            head = len(_SPACE) * self.dummy_prefix
            return _SPACE[:head] + body, np.concatenate([np.zeros(head, np.int64), source, [len(raw)]])
        return self._replace(raw)

    def _replace(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        space, out, source, at = (_SPACE if self.escape else b" "), bytearray(), [], 0
        while self.trim and at < len(raw):
            piece, size = self._longest(raw, at)
            if piece != b" ":
                break
            at += size
        if at == len(raw):
            return b"", np.array([at])

        def put(piece, where):
            out.extend(piece)
            source.extend([where] * len(piece))

        if self.dummy_prefix and not self.suffix:
            put(space, at)
        after_space = self.trim
        while at < len(raw):
            piece, size = self._longest(raw, at)
            if after_space:
                piece = piece.lstrip(b" ")
            put(piece.replace(b" ", space), at)
            if piece:
                after_space = self.trim and piece.endswith(b" ")
            at += size
        while self.trim and out.endswith(space):
            at = source[len(out) - len(space)]
            del out[-len(space):], source[-len(space):]
        if self.dummy_prefix and self.suffix:
            put(space, at)
        return bytes(out), np.array(source + [at])

    def spans(self, text: str, ids: np.ndarray, surfaces=None) -> tuple[np.ndarray, np.ndarray]:
        """Source byte spans of pieces. ``surfaces`` gives the pieces as texts where unknown ones are among them."""
        normal, source = self.normalise(text)
        lengths = self.lengths[ids]
        if surfaces is not None:
            unknown = np.flatnonzero(ids == self.unk)
            lengths[unknown] = [len(surfaces[i].encode()) for i in unknown]
        ends = np.cumsum(lengths)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        return source[ends - lengths], source[ends]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, data: bytes, bos: bool = True, eos: bool = True):
        import sentencepiece

        self.model = Model(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.head = [self.library.bos_id()] if bos else []
        self.tail = [self.library.eos_id()] if eos else []
        self._chunks = None
        if self.model.plain and self.library.unk_id() >= 0:
            self._chunks = ChunkEncoder(lambda parts, spaced: self.library.encode(parts, num_threads=1), "<u4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end ids, and the span of each in the text's UTF-8 bytes (begin and end ids: empty)."""
        ids = self._chunks(text) if self._chunks else np.array(self.library.encode(text), "<u4")
        surfaces = None
        if self.model.unk >= 0 and (ids == self.model.unk).any():
            whole = self.library.encode(text, out_type=str)
            surfaces = whole
        starts, ends = self.model.spans(text, ids, surfaces)
        size = len(text.encode("utf-8"))
        first, last = [0] * len(self.head), [size] * len(self.tail)
        return (np.concatenate([self.head, ids, self.tail]).astype("<u4"),
                np.concatenate([first, starts, last]).astype("<u4"), np.concatenate([first, ends, last]).astype("<u4"))

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
          T.StructField("starts", T.BinaryType()), T.StructField("ends", T.BinaryType()),
          T.StructField("decoded", T.StringType())]


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", bos: bool = True,
                     eos: bool = True) -> DataFrame:
    """Every row with ``n_tokens``, ``ids``, ``starts``, ``ends`` (packed little-endian unsigned 32-bit) and ``decoded``.

    ``starts`` and ``ends`` are the UTF-8 byte spans of the pieces in the original text: they tile it, a byte-fallback
    piece has the one byte it stands for, begin and end ids are empty. ``decoded`` is the library's text of all ids.
    Null and empty texts have no pieces besides the begin and end ids. Rows are independent: repeated rows give
    repeated results, an empty table an empty one; input columns named like a result are replaced.
    The model is sent to the executors as one file of known size.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        codec = Codec(model.value, bos, eos)

        def work(batch: pa.RecordBatch) -> dict:
            coded = [codec.encode(t) for t in texts_of(batch.column(batch.schema.get_field_index(text_col)))]
            packed = [pa.array([c[i].tobytes() for c in coded], pa.binary()) for i in range(3)]
            return {"n_tokens": pa.array([len(c[0]) for c in coded], pa.int64()), "ids": packed[0],
                    "starts": packed[1], "ends": packed[2],
                    "decoded": pa.array([codec.decode(c[0]) for c in coded], pa.string())}
        return work

    return append_columns(docs, make, FIELDS)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")

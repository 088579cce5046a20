"""SentencePiece encoding and decoding that keeps every piece's place in the original bytes.

The normaliser reads the compiled character map of the model (a double-array trie of byte strings
and their replacements), takes the longest prefix at each place, and records for each normalised
byte the source byte it came from. Pieces lie end to end in the normalised text, so their lengths
give normalised spans, and the record projects them to spans of the original bytes.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_texts

MARK = "▁".encode()
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6


def default_model() -> str:
    """Path of the public 32k piece model."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def wire(data: bytes) -> list[tuple[int, object]]:
    """(field number, value) of a protobuf message; values are ints or bytes."""
    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if b < 0x80:
                return value, i
    out, i = [], 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            if tag & 7 == 2:
                size, i = varint(i)
            else:
                size = 8 if tag & 7 == 1 else 4
            value, i = data[i:i + size], i + size
        out.append((tag >> 3, value))
    return out


class CharMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest entry that starts at ``at``."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, start
        if not found:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


class Normalizer:
    """The model's normalisation with source alignment."""

    def __init__(self, spec: bytes, symbols: list[bytes] = (), suffix: bool = False):
        fields = dict(wire(spec))
        self.map = CharMap(fields.get(2, b""))
        self.prefix = bool(fields.get(3, 1))
        self.squeeze = bool(fields.get(4, 1))
        self.space = MARK if fields.get(5, 1) else b" "
        self.suffix = suffix
        kept = sorted(symbols, key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, kept))) if kept else None
        self.plain = not (self.map.units or self.squeeze or self.symbols or suffix)
        self.known: dict[bytes, tuple[int, bytes]] = {}

    def step(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(source bytes taken, normalised bytes) of the longest prefix at ``at``."""
        if self.symbols and (m := self.symbols.match(data, at)):
            return len(m[0]), m[0]
        if found := self.map.longest(data, at):
            return found
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at:at + n]

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source): source[i] is the source byte where normalised byte i began;
        one more entry holds the end."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 0x20, len(self.space), 1))
            head = self.space if self.prefix else b""
            return (head + data.replace(b" ", self.space),
                    np.concatenate((np.zeros(len(head), np.int64), source, [len(raw)])))
        return self._by_steps(data)

    def _by_steps(self, data: bytes) -> tuple[bytes, np.ndarray]:
        at, out, source = 0, bytearray(), []

        def put(piece: bytes, start: int, taken: int) -> None:
            same = len(piece) == taken
            for i, b in enumerate(piece):
                new = self.space if b == 0x20 else bytes((b,))
                out.extend(new)
                source.extend([start + i if same else start] * len(new))

        if self.squeeze:
            while at < len(data):
                n, piece = self.step(data, at)
                if piece != b" ":
                    break
                at += n
        if at == len(data):
            return b"", np.full(1, at)
        if self.prefix and not self.suffix:
            put(b" ", at, 0)
        blank = self.squeeze
        while at < len(data):
            n, piece = self.step(data, at)
            if self.squeeze and blank:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, at, n)
                blank = piece.endswith(b" ")
            at += n
            blank = blank and self.squeeze
        end = at
        if self.squeeze:
            while out.endswith(self.space):
                end = source[-1]
                del out[-len(self.space):], source[-len(self.space):]
        if self.prefix and self.suffix:
            put(b" ", end, 0)
        return bytes(out), np.array([*source, end], np.int64)


class Pieces:
    """A model loaded in a task: ids, original byte spans and decoded text."""

    def __init__(self, proto: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        fields = wire(proto)
        pieces = [dict(wire(v)) for k, v in fields if k == 1]
        trainer = dict(wire(dict(fields).get(2, b"")))
        self.lengths = np.array([1 if p.get(3, 1) == BYTE else len(p[1]) for p in pieces])
        symbols = [p[1] for p in pieces if p.get(3, 1) == USER_DEFINED]
        self.unknown = self.model.unk_id()
        self.normalizer = Normalizer(dict(fields).get(3, b""), symbols, bool(trainer.get(24, 0)))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece (without begin and end ids) in the text's UTF-8 bytes."""
        normal, source = self.normalizer.normalize(text.encode())
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():
            lengths = np.array([len(p.encode()) for p in self.model.encode(text, out_type=str)])
            byte = self.lengths[ids] == 1
            lengths = np.where(byte, 1, lengths)
        ends = np.cumsum(lengths)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        return source[ends - lengths], source[ends]

    def encode(self, texts: list[str]) -> list[tuple]:
        out = []
        first, last = self.model.bos_id(), self.model.eos_id()
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1)):
            inner = np.array(ids, np.int64)
            starts, ends = self.spans(text, inner)
            whole = [first, *ids, last]
            n = len(text.encode())
            place = lambda x, edge: np.concatenate((edge[:1], x, edge[1:])).astype("<u4").tobytes()
            out.append((np.array(whole, "<u4").tobytes(), place(starts, [0, n]),
                        place(ends, [0, n]), self.model.decode(whole)))
        return out


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
           model: str | None = None) -> DataFrame:
    """(id, ids, starts, ends, decoded) of every whole text.

    ``ids`` holds begin id, pieces and end id, ``starts`` and ``ends`` each one's byte span in the
    original text; all three are little-endian unsigned 32-bit integers. ``decoded`` is the text
    the model gives back. A null or empty text has only the begin and end ids and decodes to ''.
    Rows are kept as they are: equal rows, null ids and ties give equal results, an empty table an
    empty one; other columns are ignored. ``model`` is a path on the driver; the file (its size
    does not grow with the data) is sent to the tasks once.
    """
    with open(model or default_model(), "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        pieces = Pieces(proto.value)
        return lambda columns: pieces.encode([t or "" for t in columns[1]])

    return map_texts(docs, [id_column, text],
                     "ids binary, starts binary, ends binary, decoded string", make)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids: str = "ids",
           model: str | None = None) -> DataFrame:
    """(id, text) decoded from the little-endian ids; null ids give null."""
    with open(model or default_model(), "rb") as file:
        proto = encoded.sparkSession.sparkContext.broadcast(file.read())

    def make():
        import sentencepiece
        loaded = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        return lambda columns: [
            (None if x is None else loaded.decode(np.frombuffer(x, "<u4").tolist()),)
            for x in columns[1]]

    return map_texts(encoded, [id_column, ids], "text string", make)


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_column, (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"))

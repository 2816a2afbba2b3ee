"""Operator 9: SentencePiece encoding and decoding.

The pieces of a model file and their scores give the segmentation of highest
total score. An Aho-Corasick automaton over the pieces reads a text once; at each
position its output links name every piece that ends there, and each relaxes the
best score at that position (Viterbi). Of equal scores the longest last piece
wins. A character that no piece covers costs the lowest score less 10 and becomes
its UTF-8 bytes' pieces (``<0xNN>``); where the model has not all of them, the unknown piece, which decodes to nothing.

As the model's normaliser says, a blank becomes U+2581 and a text gets one in
front. A U+2581 of the text itself becomes byte pieces, so that decoding gives
back every text. Where no piece holds U+2581 after another character, a segmentation
of the text is one of its blank-led chunks; chunks of up to ``CACHED`` characters
are kept in two bounded tables of each Python worker (a young and an old generation). Otherwise the whole text is one chunk.

Edge cases: a null text has null ids and decodes to null; an empty text has no ids and
decodes to an empty text; a text without blanks is one chunk, in memory in
proportion to it; repeated rows get equal ids; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelforge.llm.common import sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CACHED, ENTRIES = 48, 60_000
UNKNOWN = 10.0

_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def read_model(path: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, may be matched) of every id of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i), not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))) for i in range(sp.get_piece_size())]


class Coder:
    """Encodes and decodes with one list of pieces."""

    def __init__(self, pieces: list[tuple[str, float, bool]], encodes: bool = True):
        self.unknown_id = next((i for i, (p, _, on) in enumerate(pieces) if p == "<unk>" and not on), 0)
        if encodes:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        lowest, whole = 0.0, False
        for i, (piece, score, on) in enumerate(pieces):
            m = _BYTE.match(piece)
            if m and not on:
                self.byte_id[int(m[1], 16)] = i
                self.bytes_of.append(bytes([int(m[1], 16)]))
                continue
            self.bytes_of.append(piece.replace(BLANK, " ").encode() if on else b"")
            if on:
                if encodes:
                    self.automaton.add_word(piece, (len(piece), score, i))
                lowest = min(lowest, score)
                whole |= BLANK in piece.lstrip(BLANK)
        if encodes:
            self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN
        self.whole = whole
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _bytes(self, char: str) -> list[int]:
        if len(self.byte_id) < 256:  # no byte pieces: the unknown piece
            return [self.unknown_id]
        return [self.byte_id[c] for c in char.encode("utf-8", "surrogatepass")]

    def chunk(self, s: str) -> bytes:
        """Viterbi over one chunk: matches come in order of their ends, the longest first."""
        best, last, step, unknown = [0.0], [-1], [1], self.unknown
        top = 0
        for end, (size, score, i) in self.automaton.iter(s):
            while top < end:  # characters where no piece ends
                best.append(best[top] + unknown)
                last.append(-1)
                step.append(1)
                top += 1
            x = best[end + 1 - size] + score
            if top == end:  # the first piece that ends here
                lone = best[end] + unknown
                top += 1
                if x >= lone:
                    best.append(x)
                    last.append(i)
                    step.append(size)
                    continue
                best.append(lone)
                last.append(-1)
                step.append(1)
            if x > best[top]:
                best[top], last[top], step[top] = x, i, size
        p = len(s)
        last.extend([-1] * (p - top))
        step.extend([1] * (p - top))
        out = []
        while p:
            if last[p] < 0:
                out.extend(reversed(self._bytes(s[p - 1])))
                p -= 1
            else:
                out.append(last[p])
                p -= step[p]
        out.reverse()
        return array("i", out).tobytes()

    def _known(self, s: str) -> bytes:
        found = self.young.get(s)
        if found is None:
            found = self.old.get(s) or self.chunk(s)
            if len(s) <= CACHED:
                if len(self.young) >= ENTRIES:
                    self.old, self.young = self.young, {}
                self.young[s] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        if not text:
            return b""
        out = []
        for k, part in enumerate(text.split(BLANK)):  # a U+2581 of the text itself: byte pieces
            if k:
                out.append(array("i", self._bytes(BLANK)).tobytes())
            s = part.replace(" ", BLANK)
            if not k:
                s = BLANK + s
            if s:
                out.extend(map(self._known, (s,) if self.whole else _CHUNK.findall(s)))
        return b"".join(out)

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


_CODERS: dict[tuple, Coder] = {}


def _sent(model: str) -> tuple[str, list[tuple[str, float, bool]]]:
    """The whole vocabulary's digest, and the vocabulary."""
    pieces = read_model(model)
    return hashlib.sha256(repr(pieces).encode()).hexdigest(), pieces


def _coder(sent, encodes: bool = True) -> Coder:
    """One coder a model and Python worker."""
    digest, pieces = sent.value
    key = (digest, encodes)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(pieces, encodes)
    return _CODERS[key]


def _added(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != column), T.StructField(column, kind)])


def encode(documents: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids") -> DataFrame:
    """documents with the ids of ``text`` in the array column ``out`` (replaced where it exists)."""
    sent = documents.sparkSession.sparkContext.broadcast(_sent(model))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for b in sliced(batches):
            names = [n for n in b.schema.names if n != out]
            texts = b.column(b.schema.names.index(text))
            ids = [None if x is None else coder.encode(x) for x in (v.as_py() for v in texts)]
            ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)], dtype=np.int32)
            starts = pa.array(ends, mask=np.array([*(x is None for x in ids), False]))
            made = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.int32)))
            yield pa.record_batch([*(b.column(b.schema.names.index(n)) for n in names), made], [*names, out])

    return documents.mapInArrow(run, _added(documents, out, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of ``ids`` in the column ``out`` (replaced where it exists)."""
    sent = encoded.sparkSession.sparkContext.broadcast(_sent(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent, encodes=False)
        for b in sliced(batches):
            names = [n for n in b.schema.names if n != out]
            rows = b.column(b.schema.names.index(ids))
            texts = [None if not r.is_valid else coder.decode(r.values.to_numpy(zero_copy_only=False).tolist()) for r in rows]
            yield pa.record_batch([*(b.column(b.schema.names.index(n)) for n in names), pa.array(texts, pa.string())], [*names, out])

    return encoded.mapInArrow(run, _added(encoded, out, T.StringType()))

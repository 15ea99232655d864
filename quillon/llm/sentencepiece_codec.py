"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

At each end position the automaton gives, through its output links, every piece that ends there; each
relaxes the best score of the text up to that position. A unigram model's scores are used as stored. A
BPE model stores ranks, which are no probabilities; there the score is Zipf's log-probability of the
rank, so ids can differ from those of merging, and the decoded text is the same.

Text is cut where no piece can reach across (before runs of spaces, and around characters that occur in
no longer piece), so the best segmentation of a text is that of its chunks, and frequent chunks are
looked up instead of solved again. The lookup is bounded by CACHE chunks.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE, LONGEST_CACHED = 250_000, 64
#: SentencePiece's piece types and the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
OUT_BYTES = 4 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick

        self.pieces, scores, kinds, bpe, self.prefix = [], [], [], False, True
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif field == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and self.pieces[i]]
        if bpe:
            scores = [-math.log(2 - min(0.0, s)) for s in scores]
        self.auto = ahocorasick.Automaton()
        for i in usable:
            self.auto.add_word(self.pieces[i], (len(self.pieces[i]), scores[i], i))
        self.auto.make_automaton()
        self.single = {self.pieces[i] for i in usable if len(self.pieces[i]) == 1}
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.byte = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.penalty = min((scores[i] for i in usable), default=0.0) - 10.0
        joined = {c for i in usable if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        solo = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and c != 32) + SPACE
        crossing = any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        self.cut = re.compile("[^" + SPACE + "]+|" + SPACE if crossing else f"[{solo}]| +[^ {solo}]*|[^ {solo}]+")
        self.surface = [p.replace(SPACE, " ").encode() if k not in (CONTROL, BYTE) else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _fallback(self, char: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in char.encode()]

    def viterbi(self, chunk: str) -> list[int]:
        """The best pieces of a chunk in which spaces stand as SPACE."""
        n = len(chunk)
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        solid = self.single
        done = 0
        for end, (size, score, piece) in self.auto.iter(chunk):
            while done < end:  # a character that no piece covers alone
                done += 1
                if chunk[done - 1] not in solid and best[done - 1] + self.penalty > best[done]:
                    best[done], back[done] = best[done - 1] + self.penalty, (1, -1)
            score += best[end + 1 - size]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (size, piece)
        while done < n:
            done += 1
            if chunk[done - 1] not in solid and best[done - 1] + self.penalty > best[done]:
                best[done], back[done] = best[done - 1] + self.penalty, (1, -1)
        out: list[int] = []
        while n:
            size, piece = back[n]
            out += [piece] if piece >= 0 else self._fallback(chunk[n - 1])[::-1]
            n -= size
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            ids = self._fallback(SPACE) if chunk == SPACE else self.viterbi(chunk.replace(" ", SPACE))
            got = np.array(ids, np.int32).tobytes()
        if len(chunk) <= LONGEST_CACHED:
            if len(self.young) >= CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        get, new = self.young.get, self._chunk
        out = []
        for c in self.cut.findall(" " + text if self.prefix else text):
            got = get(c)
            if got is None:
                got = new(c)
                get = self.young.get
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in memoryview(ids).cast("i")]).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # a file of the driver; executors get its bytes with the task
        return f.read()


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` with ``piece_ids`` array<int> and ``n_pieces``; with ``check`` also ``round_trip``, whether
    the decoded ids are the text.

    A column of ``docs`` with one of these names is replaced. Null text has null ids, 0 pieces and a true
    round trip; empty text has an empty array. Texts of any length are encoded whole, row by row, so ties
    and repeated rows have equal results. Characters outside the model become bytes, so every text comes back
    exactly if the model has byte pieces.
    """
    model = _model_bytes(model_path)
    made = ["piece_ids", "n_pieces", *["round_trip"] * check]
    kept = docs.drop(*made)
    at = kept.columns.index(text_col)
    kinds = (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType())
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(made, kinds, strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts, row = batch.column(at), 0
            while row < len(batch):
                first, raw, same, held = row, [], [], 0
                while row < len(batch) and held < OUT_BYTES:
                    text = texts[row].as_py()
                    ids = codec.encode(text) if text is not None else None
                    raw.append(ids)
                    same.append(text is None or not check or codec.decode(ids) == text)
                    held += len(ids or b"")
                    row += 1
                n = np.array([len(x or b"") // 4 for x in raw], np.int64)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(off, pa.array(np.frombuffer(b"".join(x or b"" for x in raw), np.int32)), mask=pa.array([x is None for x in raw]))
                more = [ids, pa.array(n), *[pa.array(same)] * check]
                part = batch.slice(first, row - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *made])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in ``text_col``, which is replaced if it is there; null ids
    give null text."""
    model = _model_bytes(model_path)
    kept = encoded.drop(text_col)
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int32).tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, round_trip) of each row."""
    return encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), model_path=model_path, check=True).select("doc_id", "n_pieces", "piece_ids", "round_trip")

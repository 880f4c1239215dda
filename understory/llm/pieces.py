"""SentencePiece encoding and decoding with byte offsets into the original text.

Normalisation goes by longest prefix through the model's compiled character map (a double array over UTF-8 bytes),
and notes for each normalised byte which original bytes it stands for; each piece is projected through
that alignment to a byte span of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.common import map_batches
from understory.llm.tokens import path_of

SPACE = "▁"


class CharacterMap:
    """A compiled character map: uint32 size of a double array, the array's units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]

    def begins(self, byte: int) -> bool:
        """Whether an entry begins with the byte."""
        if not self.units:
            return False
        node = ((self.units[0] >> 10) << ((self.units[0] & (1 << 9)) >> 6)) ^ byte
        return node < len(self.units) and self.units[node] & ((1 << 31) | 0xFF) == byte

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``raw[at:]`` in the map, and its replacement."""
        if not self.units:
            return None
        units, best = self.units, None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = offset(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != raw[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.texts.index(b"\0", best[1])
        return best[0], self.texts[best[1] : end]


class Normalizer:
    """The library's normalisation with, for every normalised byte and for the end, its original byte.

    The map is walked wherever a byte stands with which an entry begins; what lies between stands for itself and is moved as a whole.
    """

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.starts = np.array([self.map.begins(b) for b in range(256)])

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode("utf-8")
        x, n = np.frombuffer(raw, np.uint8), len(raw)
        out, origins = [], []
        spaced, lead, at = self.squeeze, None, 0

        def between(end: int) -> None:
            nonlocal spaced, lead
            some, where = x[at:end], np.arange(at, end)
            if self.squeeze and len(some):
                blank = some == 0x20
                keep = ~(blank & np.concatenate([[spaced], blank[:-1]]))
                if lead is None and not blank.all():
                    lead = at + int(np.argmin(blank))
                spaced, some, where = bool(blank[-1]), some[keep], where[keep]
            elif lead is None and len(some):
                lead = at
            out.append(some)
            origins.append(where)

        for k in np.flatnonzero(self.starts[x]).tolist():
            if k < at or not (found := self.map.longest(raw, k)):
                continue
            between(k)
            size, piece = found
            if lead is None and not (self.squeeze and piece == b" "):
                lead = k
            if self.squeeze and spaced:
                piece = piece.lstrip(b" ")
            if piece:
                spaced = self.squeeze and piece.endswith(b" ")
            out.append(np.frombuffer(piece, np.uint8))
            origins.append(np.full(len(piece), k))
            at = k + size
        between(n)
        if lead is None:
            return b"", np.array([n])
        if self.prefix:
            out.insert(0, np.array([0x20], np.uint8))
            origins.insert(0, np.array([lead]))
        normal, begin, end = np.concatenate(out), np.concatenate(origins), n
        if self.squeeze:
            stay = len(normal) - len(normal.tobytes().rstrip(b" "))
            if stay:
                end = int(begin[-stay])
                normal, begin = normal[:-stay], begin[:-stay]
        if self.escape:
            begin = np.repeat(begin, np.where(normal == 0x20, len(SPACE.encode()), 1))
        whole = normal.tobytes()
        return whole.replace(b" ", SPACE.encode()) if self.escape else whole, np.append(begin, end)


class PieceModel:
    """A SentencePiece model file. Ids equal the library's ``encode``: texts are normalised here, and the library cuts what comes out by a copy of the model without normalisation."""

    def __init__(self, name_or_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        raw = open(path_of(name_or_path), "rb").read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        self.normalize = Normalizer(proto.normalizer_spec)
        self.bytes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces])
        self.unknown = {k for k, p in enumerate(proto.pieces) if p.type == 2}
        self.decimal = [str(k) for k in range(len(proto.pieces))]
        spec = proto.normalizer_spec
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        spec.precompiled_charsmap = b""
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a whole text, and (n, 2) begin and end of each piece in its UTF-8 bytes; the added first space is an empty span."""
        normal, begin = self.normalize(text)
        ids = np.array(self.cutter.encode(normal.decode()), np.int64)
        if not len(ids):
            return ids, np.empty((0, 2), np.int64)
        ends = np.cumsum(self._widths(normal, ids))
        edges = np.concatenate([[begin[0]], begin[np.minimum(ends, len(begin) - 1)]])
        return ids, np.stack([edges[:-1], edges[1:]], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def _widths(self, normal: bytes, ids: np.ndarray) -> np.ndarray | list[int]:
        """Normalised bytes of each piece; an unknown piece is the run of letters up to where the next piece matches."""
        if not self.unknown.intersection(ids.tolist()):
            return self.bytes[ids]
        out, at = [], 0
        for k, i in enumerate(ids):
            if i in self.unknown:
                nxt = next((self.library.id_to_piece(int(j)).encode() for j in ids[k + 1 :]), None)
                end = normal.index(nxt, at + 1) if nxt else len(normal)
                out.append(end - at)
            else:
                out.append(int(self.bytes[i]))
            at += out[-1]
        return out


def kept(name_or_path: str) -> tuple[tuple, Callable[[], PieceModel]]:
    """Key and maker of the model that a Python worker keeps over the tasks of an operator."""
    return ("pieces", name_or_path), lambda: PieceModel(name_or_path)


def encoded(docs: DataFrame, model: str = "piece_bpe_32k.model", ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids array<int>, begins array<int>, ends array<int>): pieces of each whole text and their byte spans. Null texts are empty; narrow."""
    kind = dict(docs.dtypes)[ident]

    def start(m: PieceModel):
        def one(b: pa.RecordBatch) -> dict:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, spans = zip(*map(m.encode, texts), strict=True) if texts else ((), ())
            lists = pa.list_(pa.int32())
            return {"id": b.column(0), "ids": pa.array([i.astype(np.int32) for i in ids], lists), "begins": pa.array([s[:, 0].astype(np.int32) for s in spans], lists), "ends": pa.array([s[:, 1].astype(np.int32) for s in spans], lists)}

        return one

    return map_batches(docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("t")), f"id {kind}, ids array<int>, begins array<int>, ends array<int>", start, state=kept(model)).withColumnRenamed("id", ident)


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model", ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids and decoded text, and the bytes of the original that its spans cover. A null text is empty."""
    kind = dict(docs.dtypes)[ident]

    def start(m: PieceModel):
        def one(b: pa.RecordBatch) -> dict:
            n, ids_h, text_h, covered = [], [], [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for t in texts:  # one text's ids at a time
                ids, spans = m.encode(t)
                ids = ids.tolist()
                n.append(len(ids))
                ids_h.append(hashlib.sha256(",".join(map(m.decimal.__getitem__, ids)).encode()).hexdigest())
                text_h.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                covered.append(int((spans[:, 1] - spans[:, 0]).sum()))
            return {"id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_h), "decoded_sha256": pa.array(text_h), "span_bytes": pa.array(covered, pa.int64())}

        return one

    return map_batches(docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("t")), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long", start, state=kept(model)).withColumnRenamed("id", ident)

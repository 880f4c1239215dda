"""Harmonic packing: reciprocal-capacity classes whose bins take a fixed count of pieces, per worker.

A document is cut into full sequences of ``capacity`` tokens and a rest. A rest of class k = capacity // length goes to the
open bin of its class, which closes at k rests. A class alone wastes up to 1 / (k + 1) of its bins, so a bin that closes
with a gap of ``least`` tokens or more takes them from the head of one further document, the filler, which is cut
there; the next rest becomes the filler once it is used up. So a bin costs one cut at most, whatever its class, and wastes less than
``least`` tokens. Tasks pack their own rows without talking to each other; what is open at the end of a task is
joined end to end, so that a task pads one sequence only.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.common import enter, give_back, sliced, small_batches, worker_state
from understory.llm.tokens import TextTokenizer, kept

CAPACITY = 4096
#: Tokens of a gap that is left as it is, and one more.
LEAST = 16

PIECES = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

Piece = tuple[object, int, int, bytes, int]  # document, start, length, ids, tokens of the document


def split(piece: Piece, n: int) -> tuple[Piece, Piece]:
    """The first ``n`` tokens of a longer piece, and the rest."""
    doc, start, length, raw, whole = piece
    return (doc, start, n, raw[: 4 * n], whole), (doc, start + n, length - n, raw[4 * n :], whole)


class Packer:
    """Places pieces of one task. ``place`` returns the pieces of bins that have just closed."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0, least: int = LEAST):
        self.capacity, self.next, self.least = capacity, first_sequence, max(1, least)
        self.open: dict[int, list[Piece]] = {}
        self.filler: Piece | None = None
        self.short: list[Piece] = []  # a bin that waits for more filler
        self.gap = 0

    def _close(self, pieces: list[Piece]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def _fill(self, pieces: list[Piece], gap: int) -> list[tuple]:
        """Close a bin with the filler's head; without filler enough it waits."""
        if gap >= self.least and self.filler:
            if self.filler[2] > gap:
                head, self.filler = split(self.filler, gap)
            else:
                head, self.filler = self.filler, None
            pieces.append(head)
            gap -= head[2]
        if gap >= self.least:
            self.short, self.gap = pieces, gap
            return []
        return self._close(pieces)

    def place(self, piece: Piece) -> list[tuple]:
        out: list[tuple] = []
        doc, first, n, raw, whole = piece
        full = n - n % self.capacity
        for at in range(0, full, self.capacity):
            out += self._close([(doc, first + at, self.capacity, raw[4 * at : 4 * (at + self.capacity)], whole)])
        if full == n:
            return out
        if full:
            piece = doc, first + full, n - full, raw[4 * full :], whole
        if not self.filler:
            self.filler = piece
            if self.short:
                pieces, self.short = self.short, []
                out += self._fill(pieces, self.gap)
            return out
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.open[k] = []
            out += self._fill(held, self.capacity - sum(p[2] for p in held))
        return out

    def rest(self) -> list[tuple]:
        """What is open, end to end."""
        left = [*self.short, *([self.filler] if self.filler else []), *(p for k in sorted(self.open) for p in self.open[k])]
        self.open, self.filler, self.short = {}, None, []
        out, bin_, room = [], [], self.capacity
        for piece in left:
            while piece[2] > room:
                head, piece = split(piece, room)
                out += self._close([*bin_, head])
                bin_, room = [], self.capacity
            bin_.append(piece)
            room -= piece[2]
            if not room:
                out += self._close(bin_)
                bin_, room = [], self.capacity
        return out + (self._close(bin_) if bin_ else [])


def _packed(batches: Iterable[tuple[list, list]], kind: pa.DataType, names: list[str], capacity: int, least: int) -> Iterator[pa.RecordBatch]:
    """(documents, ids) of a task -> its pieces."""
    from pyspark import TaskContext

    packer = Packer(capacity, TaskContext.get().partitionId() << 40, least)
    types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    done: list[tuple] = []
    size = 0
    for docs, ids in batches:
        for doc, raw in zip(docs, ids, strict=True):
            if n := len(raw or b"") // 4:
                done += packer.place((doc, 0, n, raw, n))
                size += n
        if size > 1 << 20 and done:
            yield made(done)
            done, size = [], 0
    done += packer.rest()
    for at in range(0, len(done), 10_000):
        yield made(done[at : at + 10_000])


def harmonic_pack(ids: DataFrame, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """(doc_id, ids) of 32-bit token ids -> one row per piece with its ids and place.

    Every id lies in exactly one piece. Sequence ids are unique: the task's number above 2^40, the bin's
    below. A row without tokens gives no piece; rows with equal or null doc_id are separate documents.
    Memory: a batch, and one open bin a class.
    """
    schema = PIECES.format(kind=dict(ids.dtypes)["doc_id"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        first = next(batches, None)
        if first is not None:
            every = (some for batch in _chained(first, batches) for some in sliced(batch))
            yield from _packed(((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in every), first.schema.field(0).type, names, capacity, least)

    small_batches(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(run, schema)


def _chained(first: pa.RecordBatch, others: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from others


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """Tokenise whole texts (null: empty, so only the end id) and pack them, in one narrow pass. Other columns are ignored."""
    schema = PIECES.format(kind=dict(docs.dtypes)["doc_id"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok: TextTokenizer = worker_state(*kept(tokenizer))
        end = array("I", [end_id]).tobytes()
        first = next(batches, None)
        if first is not None:
            every = (some for batch in _chained(first, batches) for some in sliced(batch))
            ids = ((b.column(0).to_pylist(), [tok.encode(t or "") + end for t in b.column(1).to_pylist()]) for b in every)
            yield from _packed(ids, first.schema.field(0).type, names, capacity, least)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pieces(packed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum instead of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

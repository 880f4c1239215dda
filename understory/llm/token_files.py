"""Token-id files of patched frame-of-reference blocks, in global document order.

A file is one row of a Parquet table in shared storage, so Spark's committer makes it appear whole or not at
all, on any store Spark can write. Its payload is a byte string of its own format:

    header   magic "UPF1", block size, number of ids, number of blocks            4 x uint32
    index    start of each block in the payload's body, in bytes                  uint64 a block
    block    minimum, width in bits, exceptions                                   3 x uint32
             low ``width`` bits of each (id - minimum), 64 ids in ``width`` words   uint64
             positions and high parts of the exceptions                           uint32 each

The width is that of the given percentile of a block's differences. A file's payload is four such byte strings: the
token ids, the documents' lengths, and the low and high words of the documents' numbers above the least. Beside the payload the row
has only what finds it: its range of doc_id and how many ids it and those before it in the range hold.

    header   magic "UPC1", documents, documents without a number, kind of numbers 4 x uint32
             least number                                                         int64
             sizes of the four strings in bytes                                   4 x uint64

Documents that are not numbered by integers have their names as JSON in place of the third string.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from understory.llm.common import enter, fresh_path, range_dealt, range_tasks, sliced, small_batches
from understory.llm.tokens import tokenizer

MAGIC = 0x31465055
CONTAINER = 0x31435055
BLOCK = 4096
PERCENTILE = 98.0
#: Blocks worked on at once.
TOGETHER = 64
#: Ids a file holds before the next begins (a document is never split).
FILE_IDS = 1 << 20


def _pack(low: np.ndarray, w: int) -> np.ndarray:
    """(n, 64) values of ``w`` bits -> (n, w) words."""
    out = np.zeros((len(low), w), np.uint64)
    for j in range(64):
        word, shift = divmod(j * w, 64)
        v = low[:, j]
        out[:, word] |= v << np.uint64(shift)
        if shift + w > 64:
            out[:, word + 1] |= v >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for j in range(64):
        word, shift = divmod(j * w, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + w > 64:
            v |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = v & mask
    return out


def encode_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """Unsigned 32-bit ids -> a file's payload. ``block`` is a multiple of 64."""
    n = len(ids)
    blocks = -(-n // block)
    index, body, at = np.zeros(blocks, np.uint64), [], 0
    for first in range(0, blocks, TOGETHER):
        some = ids[first * block : (first + TOGETHER) * block]
        rows = -(-len(some) // block)
        x = np.full(rows * block, some[-1] if len(some) else 0, np.uint32)
        x[: len(some)] = some
        x = x.reshape(rows, block)
        least = x.min(axis=1)
        d = x - least[:, None]
        sizes = np.full(rows, block)
        sizes[-1] = len(some) - (rows - 1) * block
        d[-1, sizes[-1] :] = 0  # the last block's unused places
        k = np.minimum(sizes - 1, np.ceil(sizes * percentile / 100).astype(int) - 1)
        ordered = np.partition(d[:-1], k[0], axis=1)[:, k[0]] if rows > 1 else np.empty(0, np.uint32)
        last = np.partition(d[-1, : sizes[-1]], k[-1])[k[-1]]
        widths = np.array([int(v).bit_length() for v in (*ordered, last)])
        packed: dict[int, bytes] = {}
        for w in np.unique(widths):
            own = np.flatnonzero(widths == w)
            low = (d[own] & np.uint32((1 << int(w)) - 1)).astype(np.uint64).reshape(-1, 64)
            words = _pack(low, int(w)).astype("<u8").reshape(len(own), -1) if w else np.empty((len(own), 0), "<u8")
            for r, b in enumerate(own):
                packed[b] = words[r, : -(-int(sizes[b]) // 64) * int(w)].tobytes()
        for b in range(rows):
            w = int(widths[b])
            high = d[b].astype(np.uint64) >> np.uint64(w)
            odd = np.flatnonzero(high)
            raw = b"".join([np.array([least[b], w, len(odd)], "<u4").tobytes(), packed[b], odd.astype("<u4").tobytes(), high[odd].astype("<u4").tobytes()])
            index[first + b] = at
            at += len(raw)
            body.append(raw)
    return b"".join([np.array([MAGIC, block, n, blocks], "<u4").tobytes(), index.astype("<u8").tobytes(), *body])


def decode_ids(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of a payload; only the blocks that hold them are read."""
    magic, block, n, blocks = np.frombuffer(payload, "<u4", 4)
    if magic != MAGIC:
        raise ValueError("not a token file")
    n, block = int(n), int(block)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint32)
    index = np.frombuffer(payload, "<u8", int(blocks), 16)
    body = 16 + 8 * int(blocks)
    wanted = list(range(first // block, (last - 1) // block + 1))
    out: dict[int, np.ndarray] = {}
    by: dict[int, list[int]] = {}
    heads = {}
    for b in wanted:
        at = body + int(index[b])
        heads[b] = (at + 12, *map(int, np.frombuffer(payload, "<u4", 3, at)))
        by.setdefault(heads[b][2], []).append(b)
    for w, own in by.items():  # blocks of one width together
        for k in range(0, len(own), TOGETHER):
            some = own[k : k + TOGETHER]
            groups = [-(-min(block, n - b * block) // 64) for b in some]
            words = [np.frombuffer(payload, "<u8", g * w, heads[b][0]) for b, g in zip(some, groups, strict=True)]
            low = _unpack(np.concatenate(words).reshape(-1, w), w).reshape(-1) if w else np.zeros(64 * sum(groups), np.uint64)
            ends = np.cumsum(groups) * 64
            for b, g, end in zip(some, groups, ends, strict=True):
                d = low[end - 64 * g : end][: min(block, n - b * block)]
                at, least, _, odd = heads[b]
                at += 8 * g * w
                if odd:
                    where = np.frombuffer(payload, "<u4", odd, at)
                    d[where] |= np.frombuffer(payload, "<u4", odd, at + 4 * odd).astype(np.uint64) << np.uint64(w)
                out[b] = (d + np.uint64(least)).astype(np.uint32)
    out = [out[b] for b in wanted]
    whole = np.concatenate(out)
    begin = first // block * block
    return whole[first - begin : last - begin]


def encode_file(ids: np.ndarray, lengths: Sequence[int], docs: Sequence, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A file of whole documents: all their token ids, their lengths and their numbers (or names); those without one come last."""
    named = [d for d in docs if d is not None]
    if any(d is None for d in docs[: len(named)]):
        raise ValueError("documents without a number come last")
    numbered = all(isinstance(d, (int, np.integer)) for d in named)
    least, words = 0, [b"", b""]
    if numbered:
        least = min(named, default=0)
        above = np.array([d - least for d in named], np.uint64)
        words = [encode_ids(w, block, percentile) for w in ((above & np.uint64(0xFFFFFFFF)).astype(np.uint32), (above >> np.uint64(32)).astype(np.uint32))]
    else:
        words[0] = json.dumps(named, default=str).encode()
    parts = [encode_ids(ids, block, percentile), encode_ids(np.array(lengths, np.uint32), block, percentile), *words]
    head = np.array([CONTAINER, len(docs), len(docs) - len(named), numbered], "<u4").tobytes() + np.array([least], "<i8").tobytes()
    return b"".join([head, np.array([len(x) for x in parts], "<u8").tobytes(), *parts])


def decode_file(payload: bytes) -> tuple[np.ndarray, np.ndarray, list]:
    """(token ids, lengths, numbers or names) of a file."""
    magic, count, without, numbered = (int(v) for v in np.frombuffer(payload, "<u4", 4))
    if magic != CONTAINER:
        raise ValueError("not a token file")
    least = int(np.frombuffer(payload, "<i8", 1, 16)[0])
    ends = np.cumsum(np.concatenate([[56], np.frombuffer(payload, "<u8", 4, 24).astype(np.int64)])).tolist()
    parts = [memoryview(payload)[a:b] for a, b in zip(ends, ends[1:])]
    if numbered:
        low, high = decode_ids(parts[2]).astype(np.uint64), decode_ids(parts[3]).astype(np.uint64)
        docs = [least + v for v in (low | high << np.uint64(32)).tolist()]
    else:
        docs = json.loads(bytes(parts[2]))
    return decode_ids(parts[0]), decode_ids(parts[1]).astype(np.int64), docs + [None] * without


def write_token_files(docs: DataFrame, tokenizer_file: str = "byte_bpe_50k.json", end_id: int = 0, path: str | None = None, block: int = BLOCK, percentile: float = PERCENTILE, file_ids: int = FILE_IDS) -> str:
    """Tokenise whole texts, append ``end_id`` to each, and write them in ascending doc_id order; returns the folder.

    Texts move once, to ranges of doc_id (equal ids ordered by text, null ids last). Only one total per
    range reaches the driver. A null text is empty.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    tasks = range_tasks(docs)
    parts = 4 * tasks  # several ranges a task, so that tasks are even
    kind = dict(docs.dtypes)["doc_id"]
    dealt, edges = range_dealt(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "doc_id", parts)
    dealt = dealt.repartition(tasks, "_part").sortWithinPartitions("_part", F.col("doc_id").asc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_file), np.array([end_id], "<u4").tobytes()
        held, docs_, sizes, total, part, before = [], [], [], 0, None, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs_, sizes, total, before
            payload = encode_file(np.frombuffer(b"".join(held), "<u4"), sizes, docs_, block, percentile)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([kind]), pa.array([payload], pa.binary())], ["part", "before", "n_ids", "doc_kind", "payload"])
            held, docs_, sizes, before, total = [], [], [], before + total, 0
            return out

        for b in (some for batch in batches for some in sliced(batch)):
            ids = tok.encode_many(b.column(2).to_pylist())
            for p, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ids, strict=True):
                if held and (p != part or total >= file_ids):
                    yield flush()
                if p != part:
                    part, before = p, 0
                held.append(raw + end)
                docs_.append(doc)
                sizes.append(len(raw) // 4 + 1)
                total += sizes[-1]
        if held:
            yield flush()

    small_batches(spark)
    files = dealt.select("_part", "doc_id", "text").mapInArrow(run, "part int, before long, n_ids long, doc_kind string, payload binary")
    files.write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary) of a folder's files; start counts the ids of all documents before."""
    files = spark.read.parquet(path)
    first = files.select("doc_kind").first()
    kind = first.doc_kind if first else "bigint"
    type_ = to_arrow_type(_parse_datatype_string(kind))
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row a range
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        for b in batches:
            for row in range(b.num_rows):
                part, start, payload = (b.column(k)[row].as_py() for k in range(3))
                ids, sizes, docs_ = decode_file(payload)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                each = [raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs_, type_), pa.array(starts + start + base[part]), pa.array(each, pa.binary())], ["doc_id", "start", "ids"])

    return files.select("part", "before", "payload").mapInArrow(run, f"doc_id {kind}, start long, ids binary")

"""Quartile bucket digests: counts of hashed byte triplets, coded by quartile, with the length; a bounded difference score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.common import enter, range_dealt, range_tasks, sliced, small_batches

BUCKETS = 256
#: Difference at which two digests count as unlike; scores beyond are cut there.
BOUND = 512
#: Bytes hashed at once.
RUN = 1 << 18
#: Offsets of the three bytes of each triplet within a window of four.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def counts(raw: bytes) -> np.ndarray:
    """How often the triplets of the whole byte string fall into each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    x = np.frombuffer(raw, np.uint8)
    for at in range(0, max(len(x) - 3, 0), RUN):
        y = x[at : at + RUN + 3].astype(np.uint32)
        n = len(y) - 3
        for k, (a, b, c) in enumerate(TRIPLETS):
            h = (y[a : a + n] << np.uint32(16)) | (y[b : b + n] << np.uint32(8)) | y[c : c + n]
            h = (h + np.uint32(k << 24)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(0x85EBCA77)) >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(text: str | None) -> str:
    """Lowercase hex: 2 bytes of a hash of the text, 1 of its length, 1 of quartile ratios, 64 with two bits a bucket.

    A text of fewer than four bytes has no triplets: its buckets are all zero and the hash and length tell it apart.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    c = counts(raw)
    q1, q2, q3 = (int(v) for v in np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    level = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    body = np.packbits(np.stack([level >> 1, level & 1], axis=1).astype(np.uint8).reshape(-1)).tobytes()
    length = min(255, int(round(12 * np.log2(1 + len(raw)))) % 256 if raw else 0)
    ratios = (q1 * 16 // (q3 + 1)) << 4 | (q2 * 16 // (q3 + 1))
    return (hashlib.blake2b(raw, digest_size=2).digest() + bytes([length, ratios]) + body).hex()


def difference(a: str, b: str) -> int:
    """Difference score: buckets by quartile steps (opposite quartiles count double), length and ratios beyond one step."""
    if a == b:
        return 0
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    p, q = (np.unpackbits(np.frombuffer(v[4:], np.uint8)).reshape(-1, 2) @ np.array([2, 1]) for v in (x, y))
    d = np.abs(p - q)
    far = min((x[2] - y[2]) % 256, (y[2] - x[2]) % 256)
    ratios = sum(abs((x[3] >> s & 15) - (y[3] >> s & 15)) for s in (0, 4))
    return int(d.sum() + 3 * (d == 3).sum()) + (far if far <= 1 else 2 * far) + (ratios if ratios <= 1 else 4 * ratios) + int(x[:2] != y[:2])


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of ``BOUND`` on."""
    return 1.0 - min(difference(a, b), BOUND) / BOUND


def edited(text: str, nxt: str) -> str:
    """The text with its last half replaced by as many first code points (or all) of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def fingerprinted(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of each whole text, of its edited text and their likeness, with the next document in descending id order.

    After the last document comes the first; a table of one is its own next. Null texts are empty; equal ids are ordered by
    text, null ids come last. Each text moves once, to a range of ids; the first row of each range also goes to the
    range before, so every row finds its next within its task. Memory: a batch and one text.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[ident]
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("o", -F.col("id").cast("long"))
    tasks = range_tasks(docs)
    dealt, edges = range_dealt(rows, "o", 4 * tasks)
    before = {edges[k][0]: edges[k - 1][0] for k in range(len(edges))}  # the first range's head closes the ring
    heads = [(part, lo) for part, lo, _, _ in edges]
    is_head = F.lit(False)
    copies = F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("copy")))
    if heads:
        least = F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p, _ in heads]), F.array(*[F.lit(lo).cast("long") for _, lo in heads])), F.col("_part"))
        to = F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p in before]), F.array(*[F.lit(p) for p in before.values()])), F.col("_part"))
        is_head = F.col("o").eqNullSafe(least)
        copies = F.when(is_head, F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("copy")), F.struct(to.alias("p"), F.lit(1).alias("copy")))).otherwise(copies)
    dealt = dealt.withColumn("_c", F.explode(copies)).select(F.col("_c.p").alias("p"), F.col("_c.copy").alias("copy"), "o", "id", "t")
    dealt = dealt.repartition(tasks, "p").sortWithinPartitions("p", "copy", F.col("o").asc_nulls_last(), "t")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        held: tuple | None = None  # a row that waits for its next: part, id, text, digest

        def rows_(b: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal held
            for p, copy, i, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and held[0] == p:
                    d = digest(t)
                    e = edited(held[2], t)
                    ed = digest(e)
                    yield held[1], len(held[2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), held[3], ed, likeness(held[3], ed), likeness(held[3], d)
                    held = None if copy else (p, i, t, d)
                elif not copy:
                    held = p, i, t, digest(t)

        types = None
        for b in (some for batch in batches for some in sliced(batch)):
            types = types or [b.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            if out := list(rows_(b)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    small_batches(spark)
    return dealt.select("p", "copy", "id", "t").mapInArrow(run, schema).withColumnRenamed("id", ident)

"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints of 64 bits lie on a ring of 8 segments. If two differ in at most 3 bits, then from some segment on
every chain of l consecutive segments differs in at most floor(3 l / 8) bits: none in the first two, one in the
first five, two in the first seven. So they agree on segments i, i+1 and on two of i+2, i+3, i+4, for some i: 24 tables of
32-bit keys find every pair. Pairs that meet in a table must pass the chain's budgets, segment after segment, and so
at the end of the ring the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.common import block_pairs, components, discard, enter, forest, grouped_batches, map_batches, merged, stored

SEED = 42
WORDS = 3
MOST_BITS = 3
SEGMENTS = 8
#: Shingles whose bits are counted at once.
RUN = 1 << 15


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text: A-Z lower-cased, words between ASCII white space, ``words``-word shingles with repeats.

    Fewer words than that are one shingle; no words give zero.
    """
    from xxhash import xxh64_intdigest as h

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, RUN):
        some = range(at, min(n, at + RUN))
        x = np.fromiter((h(b" ".join(w[k : k + words]), seed) for k in some), np.uint64, len(some))
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(ident, fp): fp is the fingerprint as a signed long. Narrow, one row a document; a null text has fingerprint zero."""
    kind = dict(docs.dtypes)[ident]

    def start():
        return lambda b: {"id": b.column(0), "fp": pa.array(np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64))}

    return map_batches(docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("t")), f"id {kind}, fp long", start).withColumnRenamed("id", ident)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: (first segment, left-out segment of the three after the first two, mask over the fingerprint turned so that the first segment is on top)
TABLES = [(i, skip, sum(0xFF << (8 * (7 - s)) for s in range(5) if s != skip)) for i in range(SEGMENTS) for skip in (2, 3, 4)]


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(fp, ...) -> (key, fp, ...), 24 rows each; the table's number is in the key's lowest byte."""

    def key(i: int, t: int, mask: int):
        x = F.col("fp")
        turned = x if i == 0 else F.shiftleft(x, 8 * i).bitwiseOR(F.shiftrightunsigned(x, 64 - 8 * i))
        return turned.bitwiseAND(F.lit(_signed(mask))).bitwiseOR(F.lit(t))

    return fps.select(F.explode(F.array(*[key(i, t, mask) for t, (i, _, mask) in enumerate(TABLES)])).alias("key"), *fps.columns)


def chain_pairs(a: np.ndarray, b: np.ndarray, first: int, most: int = MOST_BITS) -> np.ndarray:
    """Which of the pairs keep to the budgets of every chain from segment ``first``."""
    x = a ^ b
    turned = x if not first else (x << np.uint64(8 * first)) | (x >> np.uint64(64 - 8 * first))
    kept = np.arange(len(x))
    for length in range(1, SEGMENTS + 1):
        at_most = most * length // SEGMENTS
        ok = np.bitwise_count(turned[kept] >> np.uint64(64 - 8 * length)) <= at_most
        kept = kept[ok]
    return kept


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, _i, _j, _b, fp, node) -> links between the nodes of a spanning forest of each bucket's near fingerprints."""
    enter()
    for t, at in grouped_batches(batches, ["key", "_i", "_j"]):
        keys, fp, node = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
        block, lo, hi = (t.column(c).to_numpy() for c in ("_b", "_i", "_j"))
        us, vs = [], []
        sizes = np.diff(at)
        two = at[:-1][(sizes == 2) & (lo[at[:-1]] == hi[at[:-1]])]
        first = (keys[two] & 0xFF) // 3
        for i in np.unique(first):
            k = two[first == i]
            ok = chain_pairs(fp[k], fp[k + 1], int(i))
            us.append(node[k[ok]])
            vs.append(node[k[ok] + 1])
        for s, n in zip(at[:-1], sizes, strict=True):
            if n < 2 or n == 2 and lo[s] == hi[s]:
                continue
            own, i = fp[s : s + n], int(keys[s] & 0xFF) // 3
            if lo[s] == hi[s]:
                a = b = np.arange(n)
            else:
                a, b = np.flatnonzero(block[s : s + n] == lo[s]), np.flatnonzero(block[s : s + n] == hi[s])
            root = np.arange(n)
            for r in range(0, len(a), 256):
                p, q = np.repeat(a[r : r + 256], len(b)), np.tile(b, len(a[r : r + 256]))
                ok = (p < q) if lo[s] == hi[s] else np.ones(len(p), bool)
                p, q = p[ok], q[ok]
                ok = chain_pairs(own[p], own[q], i)
                root = forest(n, np.concatenate([np.arange(n), p[ok]]), np.concatenate([root, q[ok]]))
            k = np.flatnonzero(root != np.arange(n))
            us.append(node[s : s + n][root[k]])
            vs.append(node[s : s + n][k])
        if us and (u := np.concatenate(us)).size:
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.concatenate(vs))], ["u", "v"])


def near_links(fps: DataFrame) -> DataFrame:
    """Distinct (fp, node), the node being the fingerprint where it isn't given -> links (u, v) of nodes from each bucket's members to the least one they are chained to: what is linked is connected, with at most one link a member and bucket."""
    spark = fps.sparkSession
    rows = bucket_keys(fps if "node" in fps.columns else fps.withColumn("node", F.col("fp")))
    multi = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # sizes of exploded rows are estimated without the factor of 24, so that small ones would be broadcast whole
    dealt = block_pairs(rows.join(multi.hint("merge"), "key"), "key", "n", "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").select("key", "_i", "_j", "_b", "fp", "node").mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(ident, fp, component_id): component_id is the smallest id reachable by links of at most three differing bits, the row's own included.

    Equal fingerprints are linked and are compared once, so copies cost nothing. Rows with equal ids are one node
    for their component; null ids get the component of their fingerprint but never name it. An empty table gives none.
    """
    kind = dict(docs.dtypes)[ident]
    own = stored(fingerprints(docs, ident, text, words), "fingerprints")
    classes = own.groupBy("fp").agg(F.min(ident).alias("least"))
    if kind in ("bigint", "int") and own.where(F.col(ident).isNull()).isEmpty():
        # classes are named by their smallest id, so that the least node of a component is the answer
        named = stored(classes.withColumn("node", F.col("least").cast("long")).select("fp", "node"), "named")
        twice = named.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty():
            found = components(near_links(named))
            of = named.join(merged(found, named.count()), "node", "left").select("fp", F.coalesce("root", "node").cast(kind).alias("component_id"))
            of = stored(of, "classes")
            for done in (named, found):
                discard(done)
            return own.join(merged(of, of.count()), "fp").select(ident, "fp", "component_id")
        discard(named)
    found = components(near_links(classes.select("fp", F.col("fp").alias("node"))))
    rows = own.count()
    whole = found.join(merged(classes, rows), found.node == classes.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(classes.join(merged(found.join(merged(whole, rows), "root").select(F.col("node").alias("fp"), "component_id"), rows), "fp", "left").select("fp", F.coalesce("component_id", "least").cast(kind).alias("component_id")), "classes")
    discard(found)
    return own.join(merged(of, of.count()), "fp").select(ident, "fp", "component_id")


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the row of the smallest id stays, of equal rows of that id one.

    Rows without an id stay, one a fingerprint, where their component has no id. Texts move once, by id.
    """
    found = stored(near_duplicates(docs, ident, text), "components")
    stay = found.where(F.col(ident) == F.col("component_id")).select(F.col(ident).alias("_kept_id")).distinct()
    named = docs.where(F.col(ident).isNotNull())
    kept = named.join(stay, named[ident] == stay["_kept_id"], "left_semi")
    # repeated rows are found by hashes and combined before they move; most tables have none
    again = named.groupBy(ident, F.xxhash64(text).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select(F.col(ident).alias("_again")).distinct()
    again = stored(again, "repeated")
    if not again.isEmpty():
        once = kept.join(again, kept[ident] == again["_again"], "left_anti")
        first = named.join(again, named[ident] == again["_again"], "left_semi").join(stay, named[ident] == stay["_kept_id"], "left_semi")
        kept = once.unionByName(first.withColumn("_kept_hash", F.xxhash64(text)).dropDuplicates([ident, "_kept_hash"]).drop("_kept_hash"))
    free = docs.where(F.col(ident).isNull())
    if free.isEmpty():
        return kept

    @F.pandas_udf("long")
    def own(texts):
        import pandas as pd

        enter()
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    loose = found.where(F.col("component_id").isNull()).select(F.col("fp").alias("_kept_id")).distinct()
    free = free.withColumn("_kept_fp", own(F.col(text).cast("string")))
    free = free.join(loose, F.col("_kept_fp") == loose["_kept_id"], "left_semi")
    least = free.groupBy("_kept_fp").agg(F.min(F.struct(F.col(text).alias("_kept_text"), *docs.columns)).alias("r"))  # combined before they move
    return kept.unionByName(least.select(*[F.col("r")[c].alias(c) for c in docs.columns]))

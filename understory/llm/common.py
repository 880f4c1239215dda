"""Shared pieces of the training-data operators: tables, shared storage, range dealing, links, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared storage


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a temporary one, if driver and executors are one process."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="understory-"))
        own = _OWN[0]
    return own


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends in files that survive executors."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``stored`` once nothing reads it any more."""
    if path := getattr(df, "_stored_at", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ---------------------------------------------------------------- Arrow helpers


_STATE: dict = {}


def give_back() -> None:
    """Return freed memory to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def enter(key: object = None) -> None:
    """Begin a task of a Python stage: what a stage of another operator kept in this worker goes. A worker serves all operators of a job in turn and keeps one thing at a time."""
    if _STATE and key not in _STATE:
        _STATE.clear()
        gc.collect()
        give_back()


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between the tasks of one operator."""
    enter(key)
    if key not in _STATE:
        _STATE[key] = make()
    return _STATE[key]


#: Rows of a batch that are in work at once, so that a worker's memory follows a few texts and not the batch.
ROWS = 256


def sliced(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = ROWS, state: tuple[object, Callable[[], object]] | None = None) -> DataFrame:
    """``mapInArrow`` with per-worker state: ``start`` runs once a task, its result turns some rows into columns.

    ``state`` is the key and the maker of what the worker keeps between tasks, which ``start`` then gets.
    """
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(state and state[0])
        one = start(worker_state(*state)) if state else start()
        for batch in batches:
            for some in sliced(batch, rows):
                got = one(some)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (got[n] for n in names)], names)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of an Arrow batch, so that what lies between the JVM and Python follows a few hundred texts.
BATCH = 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches; results don't depend on them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def parts_of(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


#: Bytes of input that a task of a range deal takes, about; and the most ranges, whose bounds are literals of a plan.
TASK_BYTES = 256 << 20
MOST_RANGES = 16_384


def range_tasks(df: DataFrame) -> int:
    """Tasks to deal a whole table to by ranges: as many as the session shuffles to, or more where its input is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = size if size < 1 << 60 else 0  # unknown sizes are reported as huge
    return max(parts_of(df.sparkSession), min(MOST_RANGES // 4, -(-files // TASK_BYTES)))


# ---------------------------------------------------------------- order over the whole table


def _search(bounds: list, key: Column) -> Column:
    """Number of bounds <= key, by binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    size = 1
    while size <= len(bounds):
        size *= 2
    array = F.array(*[F.lit(b) for b in bounds])
    steps, step = [], size // 2
    while step:
        steps.append(step)
        step //= 2
    here = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - 1) <= key), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), here)


def range_dealt(df: DataFrame, key: str, parts: int, per_part: int = 64) -> tuple[DataFrame, list[tuple]]:
    """Add ``_part``: consecutive ranges of ``key`` of about equal counts, in ascending order.

    Reads only the key column to choose bounds (a sample of at most ``parts * per_part`` keys or so, whose
    choice moves rows between tasks but changes no result) and the first and last key of each part; both
    are bounded by the number of parts, not by the rows. Null keys go to the last part.
    Returns the frame and [(part, least key, greatest key, has null)] of the parts that have rows.
    """
    keys = df.select(F.col(key).alias("k"))
    total = keys.count()
    share = min(1.0, parts * per_part / max(total, 1))
    found = keys.where(F.col("k").isNotNull())
    if share < 1:
        found = found.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    sample = sorted(r.k for r in found.distinct().collect())
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)} if sample else set())
    part = F.when(F.col(key).isNull(), F.lit(len(bounds))).otherwise(_search(bounds, F.col(key)))
    out = df.withColumn("_part", part.cast("int"))
    edges = keys.withColumn("_part", F.when(F.col("k").isNull(), F.lit(len(bounds))).otherwise(_search(bounds, F.col("k"))).cast("int"))
    rows = edges.groupBy("_part").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max(F.col("k").isNull()).alias("nul")).collect()
    return out, sorted((r["_part"], r["lo"], r["hi"], r["nul"]) for r in rows)


# ---------------------------------------------------------------- joins of tables that grow


#: Rows of a table that a join may send through the driver, about; larger ones are sorted and merged, whatever Spark's threshold.
SENT_ROWS = 1 << 16


def merged(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one side of a join that may be broadcast only if it has few ``rows``: the planner goes by packed bytes, of which the driver holds a multiple."""
    return df.hint("merge") if rows > SENT_ROWS else df


# ---------------------------------------------------------------- links inside buckets


BLOCK = 2048


def block_pairs(df: DataFrame, bucket: str, count: str, ident: str, block: int = BLOCK) -> DataFrame:
    """Deal each bucket out as pairs of blocks ``_i <= _j`` of about ``block`` rows, so that no task holds a large bucket.

    A bucket of at most ``block`` rows is one pair (0, 0). A larger one is split by a hash of ``ident``; a row
    of block b goes to each pair that holds b, so that every two rows of a bucket meet in exactly one pair.
    """
    n = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(ident)), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(F.col("_b"), j).alias("i"), F.greatest(F.col("_b"), j).alias("j")))
    dealt = df.withColumn("_b", own).withColumn("_p", F.explode(pairs))
    return dealt.withColumn("_i", F.col("_p.i")).withColumn("_j", F.col("_p.j")).drop("_p", count)


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups out of batches sorted by ``keys``, with the groups' starts and the end.

    Only the last, unfinished group is carried over, so memory holds a batch and a group.
    """
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            a = t.column(k).to_numpy()
            new[1:] |= a[1:] != a[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        if [held[0].column(k)[0].as_py() for k in keys] == last:
            continue
        whole = pa.Table.from_batches(held)
        at = starts(whole)
        yield whole.slice(0, at[-1]), np.append(at[:-1], at[-1])
        held = whole.slice(at[-1]).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, np.append(starts(whole), whole.num_rows)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Root (least index) of each of ``n`` nodes under links u-v."""
    root = np.arange(n)
    while len(u):
        ru, rv = root[u], root[v]
        lo, hi = np.minimum(ru, rv), np.maximum(ru, rv)
        if not (apart := lo != hi).any():
            break
        np.minimum.at(root, hi[apart], lo[apart])
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = u[apart], v[apart]
    return root


# ---------------------------------------------------------------- connected components


def _fold_local(edges: DataFrame) -> DataFrame:
    """Replace each task's links by a spanning forest of them, at most one link a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        own = np.empty((0, 2), np.int64)

        def fold(e: np.ndarray) -> np.ndarray:
            ids, at = np.unique(e, return_inverse=True)
            at = at.reshape(-1, 2)
            root = forest(len(ids), at[:, 0], at[:, 1])
            k = np.flatnonzero(root != np.arange(len(ids)))
            return np.stack([ids[root[k]], ids[k]], axis=1)

        limit = 1 << 20
        for b in batches:
            own = np.concatenate([own, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)])
            if len(own) >= limit:
                own = fold(own)
                if len(own) >= limit // 2:  # a forest that stays large leaves in parts
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["u", "v"])
                    own = own[:0]
        if len(own):
            own = fold(own)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over undirected links (u, v), for each node that has a link.

    Alternating large-star and small-star steps until the stars are stable. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round at most. Minima are combined before
    the shuffle; a node of very many links is split by the adaptive skew join. The steps end when nothing changes, after
    a number of rounds that grows with the logarithm of the nodes. Many links never pass the driver. Delete the frame's files with ``discard``.
    """
    spark = edges.sparkSession
    now = stored(_fold_local(edges.where("u <> v").select("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "links")
    mark, n = None, now.count()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(merged(least, n), "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        small_least = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        small = large.join(merged(small_least, n), large.v == small_least.w)
        small = small.select("m", F.col("u").alias("x")).union(small_least.select("m", F.col("w").alias("x"))).where("m <> x").distinct()
        nxt = stored(small.select(F.col("m").alias("u"), F.col("x").alias("v")), "links")
        got = nxt.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))").alias("h")).first()
        discard(now)
        now, n, seen = nxt, got.n, (got.n, got.h)
        if seen == mark or not got.n:
            break
        mark = seen
    out = now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    out._stored_at = now._stored_at
    return out

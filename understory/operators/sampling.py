"""Sampling, allocation, folds and pairs. Draws are ordered by a hash of the key, so they are the same on every run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 42) -> Column:
    """A draw order that SQL engines share: the digest of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def allocation(sizes: Mapping[str, int], count: int) -> dict[str, int]:
    """One each, then in proportion to size, the remainder to the largest; never more than a stratum has."""
    if not sizes:
        return {}
    count = min(count, sum(sizes.values()))
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    out = {k: 1 if i < count else 0 for i, k in enumerate(order)}
    left, total = count - sum(out.values()), sum(sizes.values())
    for k in order:
        out[k] += min(left * sizes[k] // total, sizes[k] - out[k])
    while (rest := count - sum(out.values())) > 0:
        for k in order:
            more = min(rest, sizes[k] - out[k])
            if more:
                out[k] += min(more, 1)
                rest -= 1
            if not rest:
                break
    return out


def stratified_sample(df: DataFrame, stratum: str, ident: str, count: int, seed: int = 42) -> DataFrame:
    """A sample without replacement over all strata; only the strata's sizes reach the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    take = allocation(sizes, count)
    of = F.lit(0)
    for k, n in take.items():
        of = F.when(F.col(stratum).eqNullSafe(F.lit(k)), F.lit(n)).otherwise(of)
    w = W.partitionBy(stratum).orderBy(hash_order(F.col(ident), seed), ident)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= of).drop("_k")


def spread(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """At most ``count`` rows at even intervals of the order, whose first column is numeric."""
    from understory.operators.windows import running

    total = df.count()
    if total <= count:
        return df
    at = running(df, order[0], list(order[1:]), {"_at": F.lit(1)}).drop("_at_all").withColumn("_at", F.col("_at") - 1)
    i = F.ceil(F.col("_at") * F.lit(count) / F.lit(total))  # the only i whose floor(i * total / count) can be this row
    return at.where((F.floor(i * F.lit(total) / F.lit(count)) == F.col("_at")) & (i < count)).drop("_at")


def systematic_folds(df: DataFrame, block: str, folds: int, seed: int = 42) -> DataFrame:
    """(block, fold): distinct blocks in hash order, dealt round robin. The order is a running count over ranges of the hash, so no task holds all blocks."""
    from understory.operators.windows import running

    if folds < 2:
        raise ValueError("two folds at least")
    blocks = df.select(block).where(F.col(block).isNotNull()).distinct().withColumn("_hash", hash_order(F.col(block), seed))
    ordered = blocks.withColumn("_front", F.conv(F.substring("_hash", 1, 15), 16, 10).cast("long"))
    at = running(ordered, "_front", ["_hash", block], {"_at": F.lit(1)})
    return at.select(block, ((F.col("_at") - 1) % folds).cast("int").alias("fold"))


def blocks(df: DataFrame, x: str, y: str, size_m: float) -> DataFrame:
    """Adds ``block``: row-major number on the square lattice from the least coordinates."""
    from understory.functions.maths import block_of

    lo = df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1")).first()
    if lo.x0 is None:
        return df.withColumn("block", F.lit(None).cast("long"))
    columns = int((lo.x1 - lo.x0) // size_m) + 1
    return df.withColumn("block", block_of(F.col(x), F.col(y), F.lit(lo.x0), F.lit(lo.y0), F.lit(columns), size_m))


def pairs(df: DataFrame, ident: str, keys: Sequence[str], most_per_key: int) -> DataFrame:
    """Pairs a < b within each key; a key of over ``most_per_key`` rows gives each row a bounded number of partners, the next ones in hash order."""
    w = W.partitionBy(*keys)
    rows = df.withColumns({"_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy(hash_order(F.col(ident)), ident))})
    reach = F.least(F.col("_n") - 1, F.lit(most_per_key))
    out = rows.withColumn("_to", F.explode(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))))).withColumn("_b", F.col("_at") + F.col("_to")).where("_b <= _n")
    right = rows.select(*keys, F.col(ident).alias("b"), F.col("_at").alias("_b"))
    return out.select(*keys, F.col(ident).alias("a"), "_b").join(right, [*keys, "_b"]).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def grid_thinned(points: DataFrame, radius: float, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The first point of each square of the radius: an even thinning that needs no neighbours."""
    cell = [F.floor(F.col(c) / radius) for c in ("x", "y")]
    return points.withColumn("_k", F.row_number().over(W.partitionBy(*keys, *cell).orderBy(*order))).where("_k = 1").drop("_k")

"""Rasters as tables of (row, col, value), with any further keys such as tile, epoch or band. Missing cells are null or absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDUCERS = {"mean": F.avg, "median": lambda v: F.percentile(v, 0.5), "p95": lambda v: F.percentile(v, 0.95), "max": F.max}


def block_reduced(cells: DataFrame, factor: int, how: str = "mean", min_valid: float = 0.5, keys: Sequence[str] = (), rows: int | None = None, cols: int | None = None, value: str = "value") -> DataFrame:
    """Blocks of factor x factor cells; null where under ``min_valid`` of them are valid. Ragged edges beyond rows and cols are trimmed."""
    kept = cells
    if rows:
        kept = kept.where(F.col("row") < rows // factor * factor)
    if cols:
        kept = kept.where(F.col("col") < cols // factor * factor)
    at = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("row", "col")]
    v = F.col(value)
    return kept.groupBy(*keys, *at).agg(F.when(F.count(v) >= min_valid * factor * factor, REDUCERS[how](v)).alias(value), F.count(v).alias("n_valid"))


def ladder(cells: DataFrame, factors: Sequence[int], how: str = "mean", min_valid: float = 0.5, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Block reductions at several factors in one pass over the cells: a factor column more."""
    each = cells.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    f, v = F.col("factor"), F.col(value)
    at = [F.floor(F.col(c) / f).cast("long").alias(c) for c in ("row", "col")]
    return each.groupBy(*keys, "factor", *at).agg(F.when(F.count(v) >= min_valid * F.first(f) * F.first(f), REDUCERS[how](v)).alias(value))


def ladder_difference(cells: DataFrame, start: str, end: str, factors: Sequence[int], min_valid: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each epoch by block, then their difference, null where either is missing."""
    each = cells.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    f = F.col("factor")
    at = [F.floor(F.col(c) / f).cast("long").alias(c) for c in ("row", "col")]
    mean = lambda c: F.when(F.count(c) >= min_valid * F.first(f) * F.first(f), F.avg(c))
    return each.groupBy(*keys, "factor", *at).agg((mean(end) - mean(start)).alias("difference"))


def cell_targets(cells: DataFrame, factor: int, min_valid: float = 0.5, canopy_min: float = 2.0, loss_limit: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Per block of (start, end) heights: means, change, shares of canopy and loss, valid shares of both epochs, and high percentiles."""
    s, e = F.col("start"), F.col("end")
    n = factor * factor
    both = s.isNotNull() & e.isNotNull()
    at = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("row", "col")]
    ok = lambda c, x: F.when(F.count(c) >= min_valid * n, x)
    got = cells.groupBy(*keys, *at).agg(
        (F.count(s) / n).alias("valid_start"), (F.count(e) / n).alias("valid_end"),
        ok(s, F.avg(s)).alias("mean_start"), ok(e, F.avg(e)).alias("mean_end"),
        ok(s, F.percentile(s, 0.95)).alias("p95_start"), ok(e, F.percentile(e, 0.95)).alias("p95_end"),
        ok(s, F.max(s)).alias("max_start"), ok(e, F.max(e)).alias("max_end"),
        ok(s, F.avg((s >= canopy_min).cast("int"))).alias("canopy_share"),
        F.when(F.count_if(both) > 0, F.count_if(both & (e - s < -loss_limit)) / F.count_if(both)).alias("loss_share"),
    )
    return got.withColumns({f"{k}_change": F.col(f"{k}_end") - F.col(f"{k}_start") for k in ("mean", "p95", "max")})


def shifted(cells: DataFrame, dx: float, dy: float, size: float, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Resampled bilinearly at (x + dx, y + dy), rows southward; null where any of the four cells with weight is missing.

    Each cell is sent to the (up to four) cells that it counts for, so the resampling is one aggregation.
    """
    import math

    c, r = dx / size, -dy / size
    c0, r0 = math.floor(c), math.floor(r)
    wc, wr = c - c0, r - r0
    parts = [(i, j, (wc if i else 1 - wc) * (wr if j else 1 - wr)) for i in (0, 1) for j in (0, 1)]
    parts = [p for p in parts if p[2] > 0]
    to = F.explode(F.array(*[F.struct(F.lit(r0 + j).alias("r"), F.lit(c0 + i).alias("c"), F.lit(w).alias("w")) for i, j, w in parts]))
    sent = cells.withColumn("_t", to).select(*keys, (F.col("row") - F.col("_t.r")).alias("row"), (F.col("col") - F.col("_t.c")).alias("col"), (F.col(value) * F.col("_t.w")).alias("_v"))
    got = sent.groupBy(*keys, "row", "col").agg(F.when(F.count("_v") == len(parts), F.sum("_v")).alias(value))
    return cells.select(*keys, "row", "col").join(got, [*keys, "row", "col"], "left")


def pit_free(layers: Sequence[Column], low: float, high: float) -> Column:
    """Highest of the layers; null outside the clamp."""
    top = F.greatest(*layers)
    return F.when((top >= low) & (top <= high), top)


def disk_difference(cells: DataFrame, radius: int, tile: int, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Topographic position: value less the mean of its disk, only where the whole disk is valid.

    Cells of the same keys go to super-tiles of ``tile`` cells with a halo of the radius; each is one dense convolution by row sums, so
    cost is tile x radius, not tile x radius^2, and memory is one super-tile.
    """
    import numpy as np
    import pandas as pd

    at = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))
    dealt = cells.select(*keys, "row", "col", F.col(value).cast("double").alias("v")).withColumn("ti", at("row")).withColumn("tj", at("col"))
    half = [int((radius**2 - d * d) ** 0.5) for d in range(-radius, radius + 1)]
    count = sum(2 * h + 1 for h in half)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = key[-2:]
        r0, c0, n = ti * tile - radius, tj * tile - radius, tile + 2 * radius
        grid = np.full((n, n), np.nan)
        grid[pdf.row - r0, pdf.col - c0] = pdf.v
        sums = np.zeros((n, n + 1))
        np.cumsum(grid, axis=1, out=sums[:, 1:])
        ok, hold = np.isfinite(grid), np.zeros((n, n + 1))
        np.cumsum(ok, axis=1, out=hold[:, 1:])
        np.cumsum(np.where(ok, grid, 0), axis=1, out=sums[:, 1:])
        total, valid = np.zeros((tile, tile)), np.zeros((tile, tile))
        for d, h in zip(range(-radius, radius + 1), half, strict=True):
            rows = slice(radius + d, radius + d + tile)
            hi, lo = slice(radius + h + 1, radius + h + 1 + tile), slice(radius - h, radius - h + tile)
            total += sums[rows, hi] - sums[rows, lo]
            valid += hold[rows, hi] - hold[rows, lo]
        own = grid[radius : radius + tile, radius : radius + tile]
        i, j = np.nonzero(np.isfinite(own))
        tpi = np.where(valid[i, j] == count, own[i, j] - total[i, j] / count, np.nan)
        return pd.DataFrame({"row": i + ti * tile, "col": j + tj * tile, "tpi": tpi}).assign(**dict(zip(keys, key, strict=False)))[[*keys, "row", "col", "tpi"]]

    schema = T.StructType([*[cells.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("row", "col")], T.StructField("tpi", T.DoubleType())])
    out = dealt.groupBy(*keys, "ti", "tj").applyInPandas(one, schema)
    return out.withColumn("tpi", F.when(~F.isnan("tpi"), F.col("tpi")))


def shift_system(cells: DataFrame, min_slope: float = 5.0, max_slope: float = 45.0) -> DataFrame:
    """Normal equations of the co-registration of ``moving`` to ``reference`` from (difference, slope_deg, aspect_deg): one row of sums.

    Each cell says difference / tan(slope) = dx sin(aspect) + dy cos(aspect) + dz'.
    """
    ok = cells.where(F.col("difference").isNotNull() & F.col("slope_deg").between(min_slope, max_slope))
    t = F.tan(F.radians("slope_deg"))
    rows = ok.select(F.sin(F.radians("aspect_deg")).alias("a"), F.cos(F.radians("aspect_deg")).alias("b"), (F.col("difference") / t).alias("d"), t.alias("t"))
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    return rows.agg(F.count("*").alias("n"), *[F.sum(x).alias(k) for k, x in (("aa", a * a), ("ab", a * b), ("bb", b * b), ("a", a), ("b", b), ("ad", a * d), ("bd", b * d), ("d", d))], F.avg("t").alias("tan"))


def solved_shift(system: DataFrame) -> dict[str, float]:
    """dx, dy, dz from the one row of sums."""
    import numpy as np

    s = system.first()
    if s.n < 3:
        raise ValueError("fewer than three usable cells")
    m = np.array([[s.aa, s.ab, s.a], [s.ab, s.bb, s.b], [s.a, s.b, s.n]])
    dx, dy, c = np.linalg.solve(m, np.array([s.ad, s.bd, s.d]))
    return {"dx": float(dx), "dy": float(dy), "dz": float(c * s.tan), "n": int(s.n)}

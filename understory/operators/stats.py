"""Estimators, resampling and gates. Tables are reduced to one row per block, tile or lag on the executors; draws then run on those sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from understory.operators.aggregates import with_percentiles


# ---------------------------------------------------------------- block bootstrap


def block_sums(df: DataFrame, block: str, error_a: Column, error_b: Column) -> pd.DataFrame:
    """One row a block: n and the sums of both absolute errors. The number of blocks is bounded by the study area."""
    return df.where(F.col(block).isNotNull()).groupBy(block).agg(F.count("*").alias("n"), F.sum(F.abs(error_a)).alias("a"), F.sum(F.abs(error_b)).alias("b")).orderBy(block).toPandas()


def _draws(blocks: int, draws: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, blocks, (draws, blocks))


def mae_interval(sums: pd.DataFrame, draws: int = 2000, confidence: float = 0.95, seed: int = 42) -> dict[str, float]:
    """Difference of mean absolute errors a - b, with the percentile interval over resampled blocks."""
    if len(sums) < 2:
        raise ValueError("two blocks at least")
    n, d = sums.n.to_numpy(float), (sums.a - sums.b).to_numpy(float)
    at = _draws(len(sums), draws, seed)
    reps = d[at].sum(axis=1) / n[at].sum(axis=1)
    low, high = np.quantile(reps, [(1 - confidence) / 2, (1 + confidence) / 2])
    return {"difference": float(d.sum() / n.sum()), "ci_low": float(low), "ci_high": float(high), "blocks": len(sums)}


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _normal_quantile(p: float) -> float:
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def bca_interval(observed: float, reps: np.ndarray, jackknife: np.ndarray, confidence: float = 0.95) -> tuple[float, float]:
    """Bias-corrected accelerated interval. The bias is the share of replicates strictly below; the percentile interval where that is none or all, no acceleration where the jackknife doesn't spread."""
    tail = (1 - confidence) / 2
    below = float((reps < observed).mean())
    if not 0 < below < 1:
        return tuple(float(v) for v in np.quantile(reps, [tail, 1 - tail]))
    spread = jackknife.mean() - jackknife
    cube, square = float((spread**3).sum()), float((spread**2).sum())
    z0, acc = _normal_quantile(below), cube / (6 * square**1.5) if square else 0.0
    out = []
    for p in (tail, 1 - tail):
        z = z0 + _normal_quantile(p)
        out.append(float(np.quantile(reps, _normal_cdf(z0 + z / (1 - acc * z)))))
    return out[0], out[1]


def paired_block_bootstrap(sums: pd.DataFrame, resamples: int = 2000, confidence: float = 0.95, seed: int = 42) -> dict[str, float]:
    """BCa interval of the paired difference of mean absolute errors, from block sums; the jackknife leaves out a block at a time."""
    if len(sums) < 2:
        raise ValueError("two blocks at least")
    n, d = sums.n.to_numpy(float), (sums.a - sums.b).to_numpy(float)
    at = _draws(len(sums), resamples, seed)
    reps = d[at].sum(axis=1) / n[at].sum(axis=1)
    jack = (d.sum() - d) / (n.sum() - n)
    observed = float(d.sum() / n.sum())
    low, high = bca_interval(observed, reps, jack, confidence)
    return {"difference": observed, "ci_low": low, "ci_high": high, "p_not_below_zero": float((reps >= 0).mean())}


def custom_block_bootstrap(df: DataFrame, block: str, value: str, statistic: Callable[[np.ndarray], float], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(draw, replicate) of any statistic: each draw is one group on the executors, built from the drawn blocks' rows.

    Rows are sent once to each draw that took their block, with how often.
    """
    names = sorted(r[0] for r in df.select(block).where(F.col(block).isNotNull()).distinct().collect())
    at = _draws(len(names), resamples, seed)
    took = pd.DataFrame([(d, names[k], int(c)) for d in range(resamples) for k, c in enumerate(np.bincount(at[d], minlength=len(names))) if c], columns=["draw", block, "times"])
    taken = df.sparkSession.createDataFrame(took).withColumn(block, F.col(block).cast(df.schema[block].dataType))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"draw": [key[0]], "replicate": [float(statistic(np.repeat(pdf[value].to_numpy(), pdf.times)))]})

    return df.select(block, value).join(taken, block).groupBy("draw").applyInPandas(one, "draw long, replicate double")


def ratio_interval(strata: pd.DataFrame, reps: int = 2000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """Observed over expected, with the percentile interval over resampled tiles; ``strata`` has tile, observed, expected."""
    by = strata.groupby("tile", sort=True)[["observed", "expected"]].sum().to_numpy(float)
    at = _draws(len(by), reps, seed)
    o, e = by[:, 0][at].sum(axis=1), by[:, 1][at].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(e > 0, o / e, np.nan)
    low, high = np.nanquantile(r, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(by[:, 0].sum() / by[:, 1].sum()), float(low), float(high)


# ---------------------------------------------------------------- variogram


def raster_pairs(cells: DataFrame, size: float, most: float, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(distance, a, b): every pair of cells of the same keys nearer than ``most``, once, from (keys, row, col, value) with cells of ``size``.

    Cells meet in blocks as wide as the distance. The later cell of a pair, by (row, col), is also sent to the block
    above and to those beside both, so that each pair meets in the block of its earlier cell.
    """
    reach = math.ceil(most / size)
    block = lambda c: F.floor(F.col(c) / reach).cast("long")
    p = cells.select(*keys, block("row").alias("_i"), block("col").alias("_j"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("a"))
    sent = cells.select(*keys, F.explode(F.sequence(block("row") - 1, block("row"))).alias("_i"), block("col").alias("_k"), "row", "col", F.col(value).alias("b"))
    sent = sent.withColumn("_j", F.explode(F.sequence(F.col("_k") - 1, F.col("_k") + 1))).drop("_k")
    met = p.join(sent, [*keys, "_i", "_j"]).where("row > _r or row = _r and col > _c")
    return met.select((F.sqrt(F.pow(F.col("col") - F.col("_c"), 2) + F.pow(F.col("row") - F.col("_r"), 2)) * size).alias("distance"), "a", "b").where(F.col("distance") < most)


def variogram(pairs: DataFrame, lag: float, most: float) -> DataFrame:
    """(bin, n, distance, gamma) of pairs (distance, a, b): half the mean squared difference by separation."""
    rows = pairs.where((F.col("distance") > 0) & (F.col("distance") < most))
    d = F.col("a") - F.col("b")
    return rows.groupBy(F.floor(F.col("distance") / lag).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("distance").alias("distance"), (F.avg(d * d) / 2).alias("gamma"))


def fit_spherical(lags: Sequence[float], gamma: Sequence[float], weights: Sequence[float], ranges: int = 200) -> dict[str, float]:
    """Weighted least squares of nugget and sill at each range of a grid; neither below zero."""
    h, g, w = (np.asarray(v, float) for v in (lags, gamma, weights))
    best = None
    for r in np.linspace(h.min(), h.max() * 1.5, ranges):
        u = np.minimum(h / r, 1)
        s = 1.5 * u - 0.5 * u**3
        m = np.stack([np.ones_like(s), s], axis=1) * np.sqrt(w)[:, None]
        try:
            c = np.linalg.lstsq(m, g * np.sqrt(w), rcond=None)[0]
        except np.linalg.LinAlgError:
            continue
        c = np.maximum(c, 0)
        loss = float((w * (g - c[0] - c[1] * s) ** 2).sum())
        if best is None or loss < best["loss"]:
            best = {"nugget": float(c[0]), "sill": float(c.sum()), "range": float(r), "loss": loss}
    return best


def practical_range(fit: dict[str, float], share: float = 0.95, points: int = 2001) -> float:
    """First point of a grid up to twice the range that reaches the share of the sill."""
    h = np.linspace(0, 2 * fit["range"], points)
    u = np.minimum(h / fit["range"], 1)
    g = fit["nugget"] + (fit["sill"] - fit["nugget"]) * (1.5 * u - 0.5 * u**3)
    return float(h[np.argmax(g >= share * fit["sill"])])


def block_size(reach: float, candidates: Sequence[float], least: float) -> float:
    """Smallest candidate of at least the range and the minimum, else the largest."""
    ok = [c for c in sorted(candidates) if c >= max(reach, least)]
    return ok[0] if ok else max(candidates)


# ---------------------------------------------------------------- noise floor


def noise_table(rungs: DataFrame, base: float, min_cells: int = 0) -> DataFrame:
    """Per scale (rows: scale, delta): n, mean, NMAD, sd, detection limit, admission, and on every row the decay of noise with the cells of a block, over admitted scales: base_sigma * cells ^ -decay."""
    mid = with_percentiles(rungs, ["scale"], [F.count("*").alias("_rows")], F.col("delta"), {"_m": 0.5}).drop("_rows")
    aggs = [F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd")]
    got = with_percentiles(rungs.join(mid, "scale"), ["scale"], aggs, F.abs(F.col("delta") - F.col("_m")), {"nmad": 0.5}).withColumn("nmad", 1.4826 * F.col("nmad"))
    got = got.withColumns({"lod95": 1.96 * F.col("nmad"), "admitted": (F.col("n") >= max(2, min_cells)) & (F.col("nmad") > 0)})
    x, y = F.when(F.col("admitted"), 2 * F.log(F.col("scale") / base)), F.when(F.col("admitted"), F.log("nmad"))
    w = Window.partitionBy(F.lit(0))  # a row a scale
    return got.withColumns({"decay": -F.regr_slope(y, x).over(w), "base_sigma": F.exp(F.regr_intercept(y, x).over(w)), "decay_r2": F.regr_r2(y, x).over(w)})


def gate(rows: Sequence[dict], limits: dict[str, float]) -> dict[str, bool]:
    """Checks of a noise table: reference noise, bias, decay, monotone fall within a tolerance, enough cells, fit."""
    rows = sorted(rows, key=lambda r: r["scale"])
    ok = [r for r in rows if r["admitted"]]
    sig = [r["nmad"] for r in ok]
    return {
        "noise": bool(ok) and sig[0] <= limits["sigma"],
        "bias": all(abs(r["mean"]) <= limits["bias"] for r in ok),
        "decay": bool(ok) and ok[0]["decay"] is not None and ok[0]["decay"] >= limits["decay"],
        "monotone": all(b <= a * (1 + limits["tolerance"]) for a, b in zip(sig, sig[1:], strict=False)),
        "cells": len(ok) >= limits["scales"],
        "fit": bool(ok) and ok[0]["decay_r2"] is not None and ok[0]["decay_r2"] >= limits["r2"],
    }


def noise_gate(rows: Sequence[dict], shift: dict, limits: dict[str, float], base: float) -> dict:
    """The calibration gate on a noise table's admitted scales and the pair's shift (magnitude, converged).

    The mean change at the finest scale lies between minus its detection limit and ``max_mean``; noise rises from a scale to the next by no more than twice
    the combined relative standard error (1 / sqrt(2 n) each); the alignment converged, under ``max_shift``; noise at ``reference_scale`` is known, measured
    or from the decay, and under ``max_reference``.
    """
    ok = sorted((r for r in rows if r["admitted"]), key=lambda r: r["scale"])
    if not ok:
        raise ValueError("no scale is admitted")
    error = [1 / math.sqrt(2 * r["n"]) for r in ok]
    falls = all(b["nmad"] <= a["nmad"] * (1 + 2 * math.hypot(error[k], error[k + 1])) for k, (a, b) in enumerate(zip(ok, ok[1:], strict=False)))
    spread, source = reference_spread(rows, limits["reference_scale"], base)
    checks = {
        "mean_in_range": -ok[0]["lod95"] <= ok[0]["mean"] <= limits["max_mean"], "noise_falls_with_scale": falls, "alignment_converged": bool(shift["converged"]), "shift_below_limit": shift["magnitude"] < limits["max_shift"],
        "reference_noise_below_limit": spread < limits["max_reference"], "reference_noise_available": math.isfinite(spread),
    }
    return {"checks": checks, "passed": all(checks.values()), "admitted_scales": [r["scale"] for r in ok], "reference_noise": spread, "reference_source": source}


def reference_spread(rows: Sequence[dict], scale: float, base: float) -> tuple[float, str]:
    """Noise at a scale: measured where that scale is admitted, else from the decay over three admitted scales at least."""
    ok = [r for r in rows if r["admitted"]]
    for r in ok:
        if r["scale"] == scale:
            return float(r["nmad"]), "measured"
    if len(ok) < 3 or ok[0]["decay"] is None or ok[0]["base_sigma"] is None:
        return math.inf, "unavailable"
    return float(ok[0]["base_sigma"] * ((scale / base) ** 2) ** -ok[0]["decay"]), "extrapolated"


def mean_importance(folds: Sequence[dict[str, float]]) -> dict[str, float]:
    """Mean over folds; a feature that a fold lacks counts as zero there."""
    names = sorted({k for f in folds for k in f})
    return {k: sum(f.get(k, 0.0) for f in folds) / len(folds) for k in names}


def check_splits(study_start: str, study_end: str, bounds: Sequence[str]) -> None:
    """Dates of train end, validation start and end, test start and end must rise strictly within the study."""
    import datetime as dt

    order = [dt.date.fromisoformat(d) for d in (study_start, *bounds)]
    if any(a >= b for a, b in zip(order, order[1:], strict=False)) or order[-1] > dt.date.fromisoformat(study_end):
        raise ValueError("splits must rise strictly within the study's dates")


def check_split(dates: DataFrame, train: Column, test: Column, date: str) -> DataFrame:
    """One row: last training date, first test date, and whether the first lies before the second."""
    got = dates.agg(F.max(F.when(train, F.col(date))).alias("train_last"), F.min(F.when(test, F.col(date))).alias("test_first"))
    return got.withColumn("ok", F.coalesce(F.col("train_last") < F.col("test_first"), F.lit(False)))

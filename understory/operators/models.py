"""Priors, growth curves and residual models under blocked cross-validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.operators.aggregates import with_percentiles

# ---------------------------------------------------------------- median prior


def scopes(train: DataFrame, kind: str, group: str, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, kind, group, scope): ``type:`` scope with at least ``least`` rows, else the broad group's; pooled ``group:`` kinds never get their own."""
    types = train.groupBy(*keys, kind, group).agg(F.count("*").alias("_n"))
    own = (F.col("_n") >= least) & ~F.col(kind).startswith("group:")
    return types.select(*keys, kind, group, F.when(own, F.concat(F.lit("type:"), F.col(kind))).otherwise(F.concat(F.lit("group:"), F.col(group))).alias("scope"))


def median_prior(df: DataFrame, kind: str, group: str, start: str, end: str, least: int) -> DataFrame:
    """(kind, scope, increment): median growth of the kind, or of its broad group where the kind has fewer than ``least`` rows."""
    rows = df.select(kind, group, (F.col(end) - F.col(start)).alias("g"))
    by_type = with_percentiles(rows, [kind, group], [F.count("*").alias("n")], F.col("g"), {"t": 0.5})
    by_group = with_percentiles(rows, [group], [F.count("*").alias("_rows")], F.col("g"), {"b": 0.5}).drop("_rows")
    own = (F.col("n") >= least) & ~F.col(kind).startswith("group:")
    got = by_type.join(by_group, group)
    return got.select(kind, F.when(own, F.concat(F.lit("type:"), F.col(kind))).otherwise(F.concat(F.lit("group:"), F.col(group))).alias("scope"), F.when(own, F.col("t")).otherwise(F.col("b")).alias("increment"), "n")


def fold_prior(df: DataFrame, fold: str, folds: int, kind: str, group: str, start: str, end: str, least: int, statistic: str = "median") -> DataFrame:
    """Rows with ``predicted``: start plus the median (or mean) growth of their scope in all other folds. Every row is copied to the folds that train on it."""
    rows = df.select(fold, kind, group, (F.col(end) - F.col(start)).alias("g"))
    train = rows.withColumn("_f", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).where(F.col("_f") != F.col(fold))
    if statistic == "median":
        by_type = with_percentiles(train, ["_f", kind], [F.count("*").alias("_n")], F.col("g"), {"_t": 0.5})
        by_group = with_percentiles(train, ["_f", group], [F.count("*").alias("_rows")], F.col("g"), {"_b": 0.5}).drop("_rows")
    else:
        by_type = train.groupBy("_f", kind).agg(F.count("*").alias("_n"), F.avg("g").alias("_t"))
        by_group = train.groupBy("_f", group).agg(F.avg("g").alias("_b"))
    own = (F.coalesce("_n", F.lit(0)) >= least) & ~F.col(kind).startswith("group:")
    out = df.withColumn("_f", F.col(fold)).join(by_type, ["_f", kind], "left").join(by_group, ["_f", group], "left")
    return out.withColumn("predicted", F.col(start) + F.when(own, F.col("_t")).otherwise(F.col("_b"))).drop("_f", "_n", "_t", "_b")


def training_prior(df: DataFrame, fold: str, folds: int, kind: str, group: str, start: str, end: str, least: int) -> DataFrame:
    """Every row once for each fold ``_f`` that trains on it, with ``_increment``: the median growth of its scope in that fold's training rows."""
    rows = df.withColumn("_g", F.col(end) - F.col(start)).withColumn("_f", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).where(F.col("_f") != F.col(fold))
    by_type = with_percentiles(rows, ["_f", kind], [F.count("*").alias("_n")], F.col("_g"), {"_t": 0.5})
    by_group = with_percentiles(rows, ["_f", group], [F.count("*").alias("_rows")], F.col("_g"), {"_b": 0.5}).drop("_rows")
    own = (F.col("_n") >= least) & ~F.col(kind).startswith("group:")
    out = rows.join(by_type, ["_f", kind]).join(by_group, ["_f", group])
    return out.withColumn("_increment", F.when(own, F.col("_t")).otherwise(F.col("_b"))).drop("_n", "_t", "_b", "_g")


def class_ceilings(df: DataFrame, kind: str, start: str, end: str, literature: Mapping[str, float], mode: str = "literature") -> dict[str, float]:
    """Ceiling height of each class: as published, as recorded (99.5th percentile), or the greater of both."""
    if mode == "literature":
        return dict(literature)
    seen = {r[0]: r[1] for r in df.groupBy(kind).agg(F.percentile(F.greatest(start, end), 0.995)).collect()}
    if mode == "record":
        return seen
    return {k: max(literature.get(k, 0.0), seen.get(k, 0.0)) for k in {*literature, *seen}}


# ---------------------------------------------------------------- growth curve


def curve(start: np.ndarray, years: float, a: float | np.ndarray, k: float, c: float) -> np.ndarray:
    h = np.minimum(start, a)
    out = a * (1 - (1 - (h / a) ** (1 / c)) * np.exp(-k * years)) ** c
    return np.where(start >= a, start, out)


def _fitting(top: float, free: bool, bounds: tuple[tuple[float, float], tuple[float, float]], rounds: int):
    """Levenberg-Marquardt on logit-transformed parameters with reweighting, from a coarse grid's best point.

    A generator that holds no rows: it yields (points, slopes), is sent what ``_sums`` gives there over all rows, and returns (parameters, loss).
    """
    lows = np.array([bounds[0][0], bounds[1][0], top * 1.001][: 2 + free])
    highs = np.array([bounds[0][1], bounds[1][1], max(top * 3, 120.0)][: 2 + free])
    out = lambda t: lows + (highs - lows) / (1 + np.exp(-t))
    inn = lambda p: np.log((p - lows) / (highs - p))
    around = lambda t: np.array([out(t), *[out(t + d * e) for e in np.eye(len(t)) for d in (1e-5, -1e-5)]])
    parts = lambda v: (v[0], v[1 : 1 + len(lows) ** 2].reshape(len(lows), -1), v[1 + len(lows) ** 2 :])
    grid = np.array([[lows[0] + (highs[0] - lows[0]) * i, lows[1] + (highs[1] - lows[1]) * j, *([top * 1.4] if free else [])] for i in (0.02, 0.06, 0.12, 0.3, 0.7) for j in (0.1, 0.25, 0.5, 0.9)])
    t, damp = inn(grid[np.argmin((yield grid, False))]), 1e-2
    now, h, g = parts((yield around(t), True))
    for _ in range(rounds):
        tried = [np.clip(t - np.linalg.solve(h + damp * 4**j * np.diag(np.diag(h) + 1e-12), g), -12, 12) for j in range(8)]
        got, h, g = parts((yield around(tried[0]), True))
        j = 0
        if not got < now:
            losses = yield np.array([out(x) for x in tried[1:]]), False
            j = next((j for j, x in enumerate(losses, 1) if x < now), 0)
            if not j:
                break
            got = losses[j - 1]
        gain, t, now, damp = now - got, tried[j], got, max(damp * 4**j / 6, 1e-9)
        if gain < 1e-10 * (1 + now):
            break
        if j:
            _, h, g = parts((yield around(t), True))
    return out(t), float(now)


def _sums(points: np.ndarray, slopes: bool, start: np.ndarray, end: np.ndarray, years: float, a: float | np.ndarray | None, scale: float) -> np.ndarray:
    """Soft L1 losses at the points; with ``slopes`` the loss at the first, and its weighted normal equations from the pairs of points around it."""
    value = lambda p: curve(start, years, p[2] if a is None else a, p[0], p[1])
    loss = lambda r: (2 * scale**2 * (np.sqrt(1 + (r / scale) ** 2) - 1)).sum()
    if not slopes:
        return np.array([loss(value(p) - end) for p in points])
    r = value(points[0]) - end
    w = 1 / np.sqrt(1 + (r / scale) ** 2)
    jac = np.stack([(value(u) - value(d)) / 2e-5 for u, d in zip(points[1::2], points[2::2], strict=True)], axis=1)
    return np.concatenate([[loss(r)], ((jac * w[:, None]).T @ jac).ravel(), jac.T @ (w * r)])


BOUNDS = ((1e-4, 0.5), (1.01, 6.0))


def fit_curve(start: np.ndarray, end: np.ndarray, years: float, a: float | np.ndarray | None, bounds: tuple[tuple[float, float], tuple[float, float]] = BOUNDS, scale: float = 1.0, rounds: int = 60) -> dict[str, float]:
    """Robust (soft L1) least squares for k and c, and the ceiling where it isn't given, within bounds."""
    fit = _fitting(float(max(start.max(), end.max())), a is None, bounds, rounds)
    asked = next(fit)
    while True:
        try:
            asked = fit.send(_sums(*asked, start, end, years, a, scale))
        except StopIteration as done:
            p, loss = done.value
            return {"a": float(p[2]) if a is None else float(np.mean(a)), "k": float(p[0]), "c": float(p[1]), "loss": loss, "n": len(start)}


def fitted_curves(df: DataFrame, scope: str, start: str, end: str, years: float, ceiling: str | None, scale: float = 1.0, rounds: int = 60) -> DataFrame:
    """(scope, a, k, c, loss, n): one robust fit a scope on all its rows, as ``fit_curve``.

    All scopes take their steps together, a pass over the rows each. Rows stay on the executors, in partitions of any mix of
    scopes; a task returns one row of sums a scope, and the driver holds a few numbers a scope. Where a scope has some ceilings, their mean stands for missing ones.
    """
    rows = df.select(F.col(scope).cast("string").alias("scope"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), (F.col(ceiling) if ceiling else F.lit(None)).cast("double").alias("top")).persist()
    wide = 20
    try:
        facts = {r[0]: r for r in rows.groupBy("scope").agg(F.count("*").alias("n"), F.max(F.greatest("s", "e")).cast("double").alias("high"), F.avg("top").alias("top")).collect()}
        fits = {k: _fitting(np.nan if r.high is None else r.high, r.top is None, BOUNDS, rounds) for k, r in facts.items()}
        asked, done = {k: next(f) for k, f in fits.items()}, {}
        while asked:

            def summed(batches, asked=asked, tops={k: facts[k].top for k in asked}):
                total: dict = {}
                for pdf in batches:
                    for key, part in pdf.groupby("scope", dropna=False):
                        key = None if pd.isna(key) else key
                        if key in asked:
                            a = None if tops[key] is None else part.top.fillna(tops[key]).to_numpy(float)
                            total[key] = total.get(key, 0) + _sums(*asked[key], part.s.to_numpy(float), part.e.to_numpy(float), years, a, scale)
                if total:
                    yield pd.DataFrame([[k, *v, *[0.0] * (wide - len(v))] for k, v in total.items()], columns=["scope", *[f"v{i}" for i in range(wide)]])

            sums = rows.mapInPandas(summed, "scope string, " + ", ".join(f"v{i} double" for i in range(wide)))
            told = {r[0]: np.array(r[1:]) for r in sums.groupBy("scope").agg(*[F.sum(f"v{i}") for i in range(wide)]).collect()}
            then = {}
            for k, (points, slopes) in asked.items():
                d = points.shape[1]
                try:
                    then[k] = fits[k].send(told[k][: 1 + d * d + d if slopes else len(points)])
                except StopIteration as end_:
                    done[k] = end_.value
            asked = then
    finally:
        rows.unpersist()
    got = [(k, float(p[2]) if facts[k].top is None else facts[k].top, float(p[0]), float(p[1]), loss, facts[k].n) for k, (p, loss) in done.items()]
    return df.sparkSession.createDataFrame(got, "scope string, a double, k double, c double, loss double, n long")


def fold_curves(df: DataFrame, fold: str, folds: int, kind: str, group: str, start: str, end: str, years: float, literature: Mapping[str, float], least: int) -> DataFrame:
    """Rows with ``predicted``: the curve of their scope (kind, or broad group where the kind is small or pooled) fitted in all other folds.

    One fit per (fold, scope) on all its rows; a kind's ceiling is its published one, or the greatest of them for kinds without.
    ``predicted`` is null where no other fold has rows of the scope.
    """
    from understory.functions.maths import chapman_richards

    top = F.lit(float(max(literature.values())))
    for k, v in literature.items():
        top = F.when(F.col(kind) == k, F.lit(float(v))).otherwise(top)
    rows = df.withColumn("_top", top)
    train = rows.withColumn("_f", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).where(F.col("_f") != F.col(fold))
    sizes = train.groupBy("_f", kind).agg(F.count("*").alias("_n"))
    own = (F.coalesce("_n", F.lit(0)) >= least) & ~F.col(kind).startswith("group:")
    scope = F.concat_ws("|", "_f", F.when(own, F.concat(F.lit("type:"), kind)).otherwise(F.concat(F.lit("group:"), group)))
    # a group's fit takes all its kinds, so rows of large kinds count in both scopes
    by_kind = train.select(F.concat_ws("|", "_f", F.concat(F.lit("type:"), kind)).alias("_scope"), start, end, "_top")
    by_group = train.select(F.concat_ws("|", "_f", F.concat(F.lit("group:"), group)).alias("_scope"), start, end, "_top")
    wanted = rows.withColumn("_f", F.col(fold)).join(sizes, ["_f", kind], "left").withColumn("_scope", scope).drop("_n", "_f")
    used = wanted.select("_scope").distinct()
    fits = fitted_curves(by_kind.union(by_group).join(used, "_scope", "left_semi"), "_scope", start, end, years, "_top").select(F.col("scope").alias("_scope"), F.col("k").alias("_k"), F.col("c").alias("_c"))
    grown = chapman_richards(F.col(start), F.lit(float(years)), F.col("_top"), F.col("_k"), F.col("_c"))
    return wanted.join(fits, "_scope", "left").withColumn("predicted", grown).drop("_scope", "_k", "_c", "_top")


# ---------------------------------------------------------------- residual models


def ridge(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], alpha: float = 1.0) -> dict:
    """Ridge by normal equations: medians fill numerics, which are standardised; categories are indicators; the intercept is free.

    One pass for medians and levels, one for moments, one aggregation of products; only the small matrix reaches the driver.
    """
    med = df.agg(*[F.percentile(c, 0.5).alias(c) for c in numeric]).first() if numeric else {}
    levels = {c: sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in categorical}
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))) for c in numeric}) if numeric else df
    mom = filled.agg(*[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.avg(target).alias("y"), F.count("*").alias("n")).first()
    cols = [((F.col(c) - F.lit(mom[f"m_{c}"])) / F.lit(mom[f"s_{c}"] or 1.0)) for c in numeric] + [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in levels.items() for v in vs]
    x = filled.select(*[c.alias(f"x{k}") for k, c in enumerate(cols)], (F.col(target) - F.lit(mom["y"])).alias("y"))
    p = len(cols)
    sums = x.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"r{i}") for i in range(p)], *[F.sum(f"x{i}").alias(f"t{i}") for i in range(p)]).first()
    n = mom["n"]
    t = np.array([sums[f"t{i}"] for i in range(p)])
    q = np.array([[sums[f"q{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - np.outer(t, t) / n
    beta = np.linalg.solve(q + alpha * np.eye(p), np.array([sums[f"r{i}"] for i in range(p)]))
    names = [*numeric, *[f"{c}={v}" for c, vs in levels.items() for v in vs]]
    return {"intercept": float(mom["y"] - beta @ t / n), "coefficients": dict(zip(names, beta.tolist(), strict=True)), "columns": cols, "beta": beta, "median": {c: float(med[c]) for c in numeric}}


def ridge_predicted(df: DataFrame, model: dict, name: str = "predicted") -> DataFrame:
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in model["median"].items()}
    keep = df.columns
    out = df.withColumns({f"_keep_{c}": F.col(c) for c in filled}).withColumns(filled)
    total = F.lit(model["intercept"])
    for b, c in zip(model["beta"], model["columns"], strict=True):
        total = total + F.lit(float(b)) * c
    out = out.withColumn(name, total)
    return out.select(*[F.col(f"_keep_{c}").alias(c) if c in filled else F.col(c) for c in keep], name)


def boosted(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], trees: int = 400, depth: int = 4, rate: float = 0.03, share: str = "0.6", seed: int = 42):
    """A pipeline of imputation, indexing and Spark's gradient-boosted regression trees, fitted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled, coded = [f"{c}_f" for c in numeric], [f"{c}_i" for c in categorical]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)] if numeric else []
    stages += [StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep")] if categorical else []
    stages += [VectorAssembler(inputCols=filled + coded, outputCol="features"), GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, featureSubsetStrategy=share, seed=seed, maxBins=64)]
    return Pipeline(stages=stages).fit(df)


def gate_decision(highs: Mapping[str, float]) -> str:
    """PASS only if every screen's upper bound of candidate minus reference lies under zero."""
    return "PASS" if highs and all(h < 0 for h in highs.values()) else "FAIL"

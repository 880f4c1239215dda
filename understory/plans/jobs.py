"""End-to-end jobs: noise floor gate, growth gate, residual gate, checkpointed tile builds, and their records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.functions import maths
from understory.operators import aggregates, filters, models, raster, sampling, stats, windows

# ---------------------------------------------------------------- settings and records


def require_keys(settings: Mapping, keys: Sequence[str]) -> None:
    if missing := [k for k in keys if k not in settings]:
        raise KeyError(f"settings lack {', '.join(missing)}")


def signature(*parts) -> str:
    """SHA-256 of everything that decides an output, as sorted JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def interval_text(result: Mapping[str, float], digits: int = 3) -> str:
    return f"{result['difference']:+.{digits}f} [{result['ci_low']:+.{digits}f}, {result['ci_high']:+.{digits}f}]"


def markdown(df: DataFrame, digits: int = 3, most: int = 200) -> str:
    """A report table of a small result; a longer one is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows for a report")
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


# ---------------------------------------------------------------- checkpointed builds


def todo(jobs: DataFrame, ledger: DataFrame | None, keys: Sequence[str], retry_failed: bool = True) -> DataFrame:
    """Jobs that the ledger doesn't hold as done; failed ones come again."""
    if ledger is None:
        return jobs
    done = ledger.where("status = 'done'") if retry_failed else ledger
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def build(jobs: DataFrame, keys: Sequence[str], work: Callable[[dict], dict], result: str) -> DataFrame:
    """Run ``work`` for each job on the executors; an error becomes a failed row and stops nothing else."""
    import pandas as pd

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(result).fieldNames()
    own = ", ".join(f"{k} {dict(jobs.dtypes)[k]}" for k in keys)

    def run(batches):
        for pdf in batches:
            out = []
            for job in pdf.to_dict("records"):
                row = {k: job[k] for k in keys} | dict.fromkeys(names)
                try:
                    row |= work(job) | {"status": "done", "note": None}
                except Exception as e:  # noqa: BLE001
                    row |= {"status": "failed", "note": f"{type(e).__name__}: {e}"[:500]}
                out.append(row)
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names, "status", "note"])

    return jobs.mapInPandas(run, f"{own}, {result}, status string, note string")


# ---------------------------------------------------------------- gates


def noise_floor(cells: DataFrame, factors: Sequence[int], cell_m: float, limits: Mapping[str, float], stable_limit: float, min_valid: float = 0.5, min_cells: int = 30, keys: Sequence[str] = ("tile",)) -> dict:
    """Table of noise by scale over stable cells of two epochs (start, end), and its gate."""
    require_keys(limits, ("sigma", "bias", "decay", "tolerance", "scales", "r2"))
    stable = cells.where(F.abs(F.col("end") - F.col("start")) <= stable_limit)
    rungs = raster.ladder_difference(stable, "start", "end", factors, min_valid, keys).where("difference is not null")
    table = stats.noise_table(rungs.select((F.col("factor") * cell_m).alias("scale"), F.col("difference").alias("delta")), cell_m, min_cells).orderBy("scale")
    rows = [r.asDict() for r in table.collect()]  # a row a scale
    return {"rows": rows, "checks": stats.gate(rows, dict(limits))}


def aligned(cells: DataFrame, cell_m: float, keys: Sequence[str] = ("tile",), rounds: int = 5, tolerance_m: float = 0.01, slopes: tuple[float, float] = (5.0, 45.0), least_cells: int = 100) -> dict[str, float]:
    """Pooled shift of ``end`` against ``start`` over all tiles: estimate, resample, until the step is small.

    Each round is one pass of windows, one resampling and one row of sums; only those sums reach the driver.
    """
    total, converged = {"dx": 0.0, "dy": 0.0, "dz": 0.0}, False
    graded = windows.slope_aspect(cells, "start", cell_m, keys).select(*keys, "row", "col", "start", "end", "slope_deg", "aspect_deg")
    for k in range(rounds):
        moved = raster.shifted(graded.select(*keys, "row", "col", F.col("end").alias("value")), total["dx"], total["dy"], cell_m, keys)
        both = graded.join(moved, [*keys, "row", "col"]).withColumn("difference", F.col("value") - F.col("start") - total["dz"])
        step = raster.solved_shift(raster.shift_system(both, *slopes))
        if step["n"] < least_cells:
            break
        total = {"dx": total["dx"] + step["dx"], "dy": total["dy"] + step["dy"], "dz": total["dz"] + step["dz"]}
        if max(abs(step["dx"]), abs(step["dy"])) < tolerance_m:
            converged = True
            break
    return total | {"converged": converged, "rounds": k + 1, "magnitude": (total["dx"] ** 2 + total["dy"] ** 2) ** 0.5}


def folded(df: DataFrame, block_m: float, folds: int, seed: int = 42) -> DataFrame:
    """Rows with their spatial block and its fold."""
    blocked = sampling.blocks(df, "x", "y", block_m)
    return blocked.join(sampling.systematic_folds(blocked, "block", folds, seed), "block")


def growth_gate(df: DataFrame, screens: Mapping[str, str], block_m: float, least: int, folds: int = 5, draws: int = 2000, kind: str = "kind", group: str = "grp", start: str = "start", end: str = "end") -> dict:
    """Cross-fitted median growth against no change, per screen (a SQL condition), with block intervals and the decision."""
    out = {}
    for name, condition in screens.items():
        rows = models.fold_prior(folded(df.where(condition), block_m, folds), "fold", folds, kind, group, start, end, least)
        sums = stats.block_sums(rows, "block", F.col("predicted") - F.col(end), F.col(start) - F.col(end))
        out[name] = {"cells": int(sums.n.sum()), "mae_prior": float(sums.a.sum() / sums.n.sum()), "mae_no_change": float(sums.b.sum() / sums.n.sum()), **stats.mae_interval(sums, draws)}
    return {"screens": out, "decision": models.gate_decision({k: v["ci_high"] for k, v in out.items()})}


def residual_gate(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], block_m: float, least: int, folds: int = 5, alpha: float = 1.0, kind: str = "kind", group: str = "grp", start: str = "start", end: str = "end") -> dict:
    """Does a ridge on the prior's residual, fitted without the held-out fold, beat the prior?"""
    rows = models.fold_prior(folded(df, block_m, folds), "fold", folds, kind, group, start, end, least)
    rows = rows.withColumn("residual", F.col(end) - F.col("predicted"))
    parts = []
    for f in range(folds):
        model = models.ridge(rows.where(F.col("fold") != f), "residual", numeric, categorical, alpha)
        parts.append(models.ridge_predicted(rows.where(F.col("fold") == f), model, "correction"))
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    sums = stats.block_sums(held, "block", F.col("predicted") + F.col("correction") - F.col(end), F.col("predicted") - F.col(end))
    got = stats.mae_interval(sums)
    return {"mae_model": float(sums.a.sum() / sums.n.sum()), "mae_prior": float(sums.b.sum() / sums.n.sum()), **got, "decision": "PASS" if got["ci_high"] < 0 else "FAIL"}


def pair_summary(cells: DataFrame, rules: Mapping[str, float], cell_km2: float, least_km2: float, burned: str | None = None) -> DataFrame:
    """Areas of canopy, loss and undisturbed canopy between two epochs (start, end), with the change on it and whether that is enough to use."""
    f = filters.epoch_masks(F.col("start"), F.col("end"), rules["bare_max"], rules["canopy_min"], rules["limit"])
    burnt = filters.sure(F.col(burned)) if burned else F.lit(False)
    usable = f["canopy"] & f["stable"] & ~burnt
    change = F.when(usable, F.col("end") - F.col("start"))
    area = lambda m: F.count_if(m) * cell_km2
    got = cells.agg(area(f["valid"]).alias("valid_km2"), area(f["canopy"]).alias("canopy_km2"), area(f["loss"]).alias("loss_km2"), area(burnt & f["valid"]).alias("burned_km2"), area(usable).alias("usable_km2"), F.percentile(change, 0.5).alias("median"), F.percentile(change, 0.1).alias("p10"), F.percentile(change, 0.9).alias("p90"))
    return got.withColumn("go", F.col("usable_km2") >= least_km2)


def sensitivity(cells: DataFrame, rules: Mapping[str, float], moved: Mapping[str, Sequence[float]], cell_km2: float, least_km2: float) -> DataFrame:
    """Usable area with one rule at a time at other values: all settings in one pass over the cells."""
    settings = [(k, float(v), {**rules, k: float(v)}) for k, values in moved.items() for v in values]
    aggs = []
    for n, (_, _, r) in enumerate(settings):
        f = filters.epoch_masks(F.col("start"), F.col("end"), r["bare_max"], r["canopy_min"], r["limit"])
        aggs.append((F.count_if(f["canopy"] & f["stable"]) * cell_km2).alias(f"u{n}"))
    wide = cells.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v).alias("value"), F.col(f"u{n}").alias("usable_km2")) for n, (k, v, _) in enumerate(settings)]))
    return wide.select(rows.alias("r")).select("r.*").withColumn("go", F.col("usable_km2") >= least_km2)


def near_line_check(df: DataFrame, edges: Sequence[float], near_m: float, control_m: float, flag: str = "flag", distance: str = "distance") -> dict:
    """Rate of flags near lines against a matched control, with its interval over tiles, and the rate by distance."""
    key = F.concat_ws("|", F.col("tile"), F.floor(F.col("canopy_share") / 0.1))
    rows = df.withColumn("_key", key)
    strata = aggregates.expected_counts(rows, "_key", F.col(flag), F.col(distance) < near_m, F.col(distance) > control_m)
    by = strata.withColumn("tile", F.substring_index("_key", "|", 1)).groupBy("tile").agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected")).orderBy("tile").toPandas()
    ratio, low, high = stats.ratio_interval(by)
    return {"ratio": ratio, "ci_low": low, "ci_high": high, "profile": aggregates.distance_profile(df, F.col(flag), F.col(distance), edges)}


def array_gib(shape: Sequence[int], item_bytes: int, copies: int = 1) -> float:
    n = item_bytes * copies
    for s in shape:
        n *= s
    return n / 2**30


def tile_lattice(spark: SparkSession, box: tuple[float, float, float, float], tile_m: float) -> DataFrame:
    """(tile, x0, y0, x1, y1): a longitude-latitude box cut to about square tiles; the last are clipped to its edge."""
    w, s, e, n = box
    import math

    step_y = tile_m / maths.METRES_PER_DEGREE
    step_x = step_y / math.cos(math.radians((s + n) / 2))
    columns, rows = math.ceil(round((e - w) / step_x, 9)), math.ceil(round((n - s) / step_y, 9))
    i, j = F.col("id") % columns, F.floor(F.col("id") / columns)
    at = spark.range(columns * rows)
    return at.select(F.col("id").alias("tile"), (w + i * step_x).alias("x0"), (s + j * step_y).alias("y0"), F.least(F.lit(e), w + (i + 1) * step_x).alias("x1"), F.least(F.lit(n), s + (j + 1) * step_y).alias("y1"))

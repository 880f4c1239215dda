"""Summaries by cell, tile, class, period and scale. Percentiles are exact with linear interpolation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def median(c: Column) -> Column:
    return F.percentile(c, 0.5)


#: Bytes of input, as the planner sees them, over which a group's distinct values aren't held in one buffer.
LARGE = 1 << 30


def large(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > LARGE


def spread_percentiles(df: DataFrame, value: str, ps: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a column a percentile): as ``F.percentile``, with no group in one task or buffer.

    Values are counted first. Ranges of the value sum their counts a key; only the ranges that hold a wanted rank are ordered, each on its own.
    """
    from pyspark.sql import Window as W

    from understory.operators.windows import in_ranges

    own = list(keys) or ["_all"]
    rows = (df if keys else df.withColumn("_all", F.lit(0))).select(*own, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    dealt = in_ranges(rows.groupBy(*own, "_v").agg(F.count("*").alias("_n")), "_v")
    sums = dealt.groupBy(*own, "_part").agg(F.sum("_n").alias("_s"))
    by_key = W.partitionBy(*own)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(by_key.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_s").over(by_key)})
    at = {n: (F.col("_total") - 1) * F.lit(float(p)) for n, p in ps.items()}
    holds = F.lit(False)
    for rank in at.values():
        for r in (F.floor(rank), F.ceil(rank)):
            holds = holds | (F.col("_before") <= r) & (r < F.col("_before") + F.col("_s"))
    wanted = sums.where(holds).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], F.col("_part").alias("_p"), "_before", "_total")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(own):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*own, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ordered = dealt.join(wanted, same).withColumn("_upto", upto)
    ends = ordered.groupBy(*own).agg(F.first("_total").alias("_total"), *[F.min(F.when(F.col("_upto") > f(at[n]), F.col("_v"))).alias(f"_{side}_{n}") for n in ps for side, f in (("lo", F.floor), ("hi", F.ceil))])
    got = {n: F.when(F.floor(at[n]) == F.ceil(at[n]), F.col(f"_lo_{n}")).otherwise((F.ceil(at[n]) - at[n]) * F.col(f"_lo_{n}") + (at[n] - F.floor(at[n])) * F.col(f"_hi_{n}")) for n in ps}
    return ends.select(*keys, *[c.alias(n) for n, c in got.items()])


def with_percentiles(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], value: Column, ps: Mapping[str, float], spread: bool | None = None) -> DataFrame:
    """Aggregates of each group with exact percentiles of a value. Results are the same either way; large inputs spread the order over tasks."""
    if not (large(df) if spread is None else spread):
        return df.groupBy(*keys).agg(*aggs, *[F.percentile(value, p).alias(n) for n, p in ps.items()])
    got = spread_percentiles(df.select(*keys, value.alias("_value")), "_value", ps, keys)
    base = df.groupBy(*keys).agg(*aggs)
    if not keys:
        return base.join(got, F.lit(True), "left")  # a row each
    got = got.toDF(*[f"_k{i}" for i in range(len(keys))], *ps)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & base[k].eqNullSafe(got[f"_k{i}"])
    return base.join(got, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def monthly_climate(daily: DataFrame, base: float = 10.0) -> DataFrame:
    from understory.functions.maths import growing_degree_days

    mean = (F.col("tmax_c") + F.col("tmin_c")) / 2
    rows = daily.withColumns({"tmean_c": mean, "gdd": growing_degree_days(F.col("tmax_c"), F.col("tmin_c"), base), "month": F.date_format("date", "yyyy-MM")})
    return rows.groupBy("segment_id", "month").agg(*[F.sum("prcp_mm").alias("prcp_mm"), *[F.avg(c).alias(c) for c in ("tmax_c", "tmin_c", "tmean_c")], F.sum("gdd").alias("gdd")])


def canopy_percentile(points: DataFrame, keys: Sequence[str], height: str, p: float = 0.95, min_points: int = 5) -> DataFrame:
    return points.groupBy(*keys).agg(F.when(F.count(height) >= min_points, F.percentile(height, p)).otherwise(0.0).alias("canopy"))


def valid_by_year(stack: DataFrame, pixel_area_m2: float, year: str = "year", value: str = "value") -> DataFrame:
    v = F.col(value)
    return stack.groupBy(year).agg(
        F.count("*").alias("total"), F.count(v).alias("valid"), (F.count(v) / F.count("*")).alias("share"), (F.count(v) * pixel_area_m2 / 1e6).alias("area_km2"),
        *[F.percentile(v, p).alias(n) for p, n in ((0.0, "least"), (0.5, "median"), (0.95, "p95"), (1.0, "greatest"))],
    )


def steps(stack: DataFrame, pixel: str, year: str = "year", value: str = "value") -> DataFrame:
    """Each pixel's change since its observation before."""
    w = F.expr(f"lag(struct({year} as y, {value} as v)) over (partition by {pixel} order by {year})")
    return stack.withColumn("_p", w).where("_p is not null").select(pixel, F.col("_p.y").alias("from_year"), F.col(year).alias("to_year"), (F.col(value) - F.col("_p.v")).alias("change"))


def abrupt_changes(stack: DataFrame, pixel: str, threshold: float, year: str = "year", value: str = "value") -> DataFrame:
    c = F.col("change")
    return steps(stack, pixel, year, value).groupBy("from_year", "to_year").agg(F.count(c).alias("valid"), F.count_if(c < -threshold).alias("drops"), F.count_if(c > threshold).alias("gains"))


def peak_step(counts: DataFrame, count: str = "drops") -> DataFrame:
    """The step of the most drops; the first of equals."""
    return counts.agg(F.max_by("from_year", F.struct(F.col(count), -F.col("from_year"))).alias("from_year"), F.max(count).alias(count))


def tile_stats(points: DataFrame, keys: Sequence[str], ground_class: int = 2, dropped: Sequence[int] = (7, 18)) -> DataFrame:
    """Returns, ground returns, mean ground height and top height of each cell."""
    ground = F.col("classification") == ground_class
    kept = points.where(~F.col("classification").isin(*dropped))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ground).alias("n_ground"), F.avg(F.when(ground, F.col("z"))).alias("ground"), F.max(F.when(~ground, F.col("z"))).alias("top"))


def with_height(cells: DataFrame) -> DataFrame:
    h = F.col("top") - F.col("ground")
    return cells.withColumn("height", F.when(h.isNotNull(), F.greatest(h, F.lit(0.0))))


def tile_validity(cells: DataFrame, cells_per_tile: int, min_cells: float, min_ground: float) -> DataFrame:
    """Shares of a tile's cells with returns and with ground returns; absent cells count as empty."""
    a, g = F.count_if(F.col("n") > 0) / F.lit(cells_per_tile), F.count_if(F.col("n_ground") > 0) / F.lit(cells_per_tile)
    return cells.groupBy("tile").agg(a.alias("cell_share"), g.alias("ground_share")).withColumn("ok", (F.col("cell_share") >= min_cells) & (F.col("ground_share") >= min_ground))


def class_mix(df: DataFrame, value: str, edges: Sequence[float], area: float = 1.0) -> DataFrame:
    """(label, n, area) of half-open classes; the last is open; empty classes give zero rows. Values under the first edge are left out."""
    labels = [f"{lo:g}-{hi:g}" for lo, hi in zip(edges, edges[1:], strict=False)] + [f"{edges[-1]:g}+"]
    bin_ = F.lit(None).cast("int")
    for k, lo in enumerate(edges):
        bin_ = F.when(F.col(value) >= lo, F.lit(k)).otherwise(bin_)
    counts = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    names = df.sparkSession.createDataFrame(list(enumerate(labels)), "bin int, label string")
    return names.join(counts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * area).alias("area"))


def change_summary(df: DataFrame, change: str, mask: Column) -> DataFrame:
    c = F.when(mask, F.col(change))
    return with_percentiles(df, [], [F.count(c).alias("n")], c, {"median": 0.5, "p10": 0.1, "p90": 0.9})


def summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    got = with_percentiles(df, keys, [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")], v, {"median": 0.5, "p5": 0.05, "p95": 0.95})
    return got.select(*keys, "n", "mean", "median", "sd", "p5", "p95")


def height_summary(df: DataFrame, height: str, keys: Sequence[str] = ()) -> DataFrame:
    h = F.col(height)
    over = [share(F.when(h.isNotNull(), h > t)).alias(f"over_{t}") for t in (2, 5, 10)]
    return with_percentiles(df, keys, [F.count(h).alias("n"), *over], h, {"median": 0.5, "p95": 0.95})


def normalised_mad(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """1.4826 times the median distance from the median, of each group."""
    keys, own = list(keys), list(keys) or ["_all"]
    df = df if keys else df.withColumn("_all", F.lit(0))
    mid = with_percentiles(df, own, [F.count("*").alias("_rows")], F.col(value), {"_m": 0.5}).drop("_rows")
    got = with_percentiles(df.join(mid, own), keys, [F.count(value).alias("n")], F.abs(F.col(value) - F.col("_m")), {"nmad": 0.5})
    return got.select(*keys, (1.4826 * F.col("nmad")).alias("nmad"), "n")


def disturbance(df: DataFrame, change: str, limit: float, keys: Sequence[str] = ()) -> DataFrame:
    c = F.col(change)
    part = lambda cond: F.coalesce(share(F.when(c.isNotNull(), cond)), F.lit(0.0))
    return df.groupBy(*keys).agg(part(c < -limit).alias("loss_share"), part(c > limit).alias("gain_share"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(median(F.col(a)).alias("median_a"), median(F.col(b)).alias("median_b"), F.regr_slope(a, b).alias("slope"), median(F.col(a) - F.col(b)).alias("offset"))


def stratum_shortfall(df: DataFrame, stratum: str, least: int) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("n")).where(F.col("n") < least)


def expected_counts(df: DataFrame, key: str, flag: Column, near: Column, control: Column) -> DataFrame:
    """Per stratum: flagged near rows, and as many as the control rate would give; strata without either side are left out."""
    got = df.groupBy(key).agg(F.count_if(near).alias("near"), F.count_if(control).alias("control"), F.count_if(flag & near).alias("observed"), F.count_if(flag & control).alias("hit"))
    return got.where("near > 0 and control > 0").select(key, "observed", (F.col("hit") / F.col("control") * F.col("near")).alias("expected"))


def distance_profile(df: DataFrame, flag: Column, distance: Column, edges: Sequence[float]) -> DataFrame:
    """(low, high, n, rate) in half-open distance bins; the rate of an empty bin is null."""
    bins = df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(edges, edges[1:], strict=False)], "low double, high double")
    low = F.lit(None).cast("double")
    for a in edges[:-1]:
        low = F.when(distance >= a, F.lit(float(a))).otherwise(low)
    got = df.where(distance < edges[-1]).groupBy(low.alias("low")).agg(F.count("*").alias("n"), share(flag).alias("rate"))
    return bins.join(got, "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"), "rate")


def persistence(df: DataFrame, first: Column, second: Column) -> DataFrame:
    return df.agg(F.count_if(first).alias("first"), F.count_if(second).alias("second"), F.count_if(first & second).alias("both"), F.count_if(first & ~second).alias("only_first"), F.count_if(second & ~first).alias("only_second"))


def exclusion_waterfall(flagged: DataFrame, rules: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Totals of each rule (they overlap) and what each removes after those before it."""
    aggs, before = [F.count("*").alias("cells"), F.count_if(F.col("clean")).alias("clean")], F.lit(False)
    for r in rules:
        aggs += [F.count_if(F.col(r)).alias(f"all_{r}"), F.count_if(F.col(r) & ~before).alias(f"step_{r}")]
        before = before | F.col(r)
    return flagged.groupBy(*keys).agg(*aggs)


def duplicate_summary(df: DataFrame, key: str, tile: str, values: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """For keys of several rows: rows, distinct tiles, and the spread of each value."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(tile).alias("tiles"), *[(F.max(v) - F.min(v)).alias(f"spread_{v}") for v in values]).where("n > 1")


def saturation(df: DataFrame, kind: str, start: str, ceilings: Mapping[str, float] | None = None) -> DataFrame:
    """Cells whose start reaches the ceiling of their class; null without a ceiling."""
    top = F.lit(None).cast("double")
    for k, v in (ceilings or {}).items():
        top = F.when(F.col(kind) == k, F.lit(float(v))).otherwise(top)
    hit = F.when(top.isNotNull(), F.col(start) >= top)
    return df.groupBy(kind).agg(F.count("*").alias("cells"), F.when(F.count(hit) > 0, F.count_if(hit)).alias("saturated"), share(hit).alias("share"))


def cell_trend(stack: DataFrame, pixel: str, year: str = "year", value: str = "value", least: int = 3) -> DataFrame:
    return stack.groupBy(pixel).agg(F.when(F.regr_count(value, year) >= least, F.regr_slope(value, year)).alias("trend"))


def monthly_composite(obs: DataFrame, keys: Sequence[str], value: str, scene_class: str, excluded: Sequence[int]) -> DataFrame:
    """Median of the clear observations, and how many there are."""
    v = F.when(~F.col(scene_class).isin(*excluded), F.col(value))
    return obs.groupBy(*keys).agg(median(v).alias("composite"), F.count(v).cast("int").alias("clear"))


def errors(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, bias and r2 over rows with both; r2 is null where the truth doesn't vary."""
    t, p = F.col(truth), F.col(predicted)
    e = p - t
    rows = df.where(t.isNotNull() & p.isNotNull())
    sst = F.var_pop(t) * F.count("*")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"))


def prevalence(df: DataFrame, label: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(label) * F.col(weight)) / F.sum(weight)).alias("prevalence"))


def point_summary(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, apex and second highest return, class histogram of each cell."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("down"), "classification", "ret")))
    classes = points.groupBy(*keys, "classification").agg(F.count("*").alias("c")).groupBy(*keys)
    hist = classes.agg(F.concat_ws(";", F.array_sort(F.collect_list(F.format_string("%02d:%d", F.col("classification"), F.col("c"))))).alias("classes"))
    top = points.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("classification") == 2).alias("n_ground"), F.max("z").alias("apex"), F.max_by("classification", F.struct("z", -F.col("ret"))).alias("apex_class"), (-F.get(order, 1)["down"]).alias("second"))
    return top.join(hist, list(keys))


def gridded(points: DataFrame, keys: Sequence[str], value: str, how: str = "max") -> DataFrame:
    """Points to cells by one reducer."""
    by = {"max": F.max, "min": F.min, "mean": F.avg, "count": F.count, "median": lambda c: median(F.col(c))}
    return points.groupBy(*keys).agg(by[how](value).alias("value"))

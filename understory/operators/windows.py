"""Ranking, cumulative and neighbourhood operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# ---------------------------------------------------------------- order over a whole table


#: The range of rows whose key is null.
NULLS = -1


def in_ranges(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Adds ``_part``: ascending ranges of a numeric key of about equal counts; null keys have a range of their own. Bounds are approximate quantiles, a number per range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.005))) if parts > 1 else []
    if not bounds:
        return df.withColumn("_part", F.when(F.col(key).isNull(), NULLS).otherwise(0))
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key)))
    return df.withColumn("_part", F.when(F.col(key).isNull(), NULLS).otherwise(place))


def running(df: DataFrame, key: str, ties: Sequence[str], values: dict[str, Column], descending: bool = False, parts: int | None = None) -> DataFrame:
    """Adds running sums ``name`` and whole sums ``name_all`` in the order of (key, ties) over the whole table, without gathering it in one task.

    Each range of the key sums its own rows; the sums of the ranges before come from one row a range.
    """
    dealt = in_ranges(df.withColumns({f"_v_{k}": v for k, v in values.items()}), key, parts)
    order = [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), *ties]
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = dealt.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    last = F.when(F.col("_part") == NULLS, 1).otherwise(0)
    before = W.orderBy(last, F.col("_part").desc() if descending else F.col("_part")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values], *[F.sum(f"_s_{k}").over(whole).alias(f"{k}_all") for k in values])
    out = dealt.join(offsets, "_part").withColumns({k: F.col(f"_o_{k}") + F.sum(f"_v_{k}").over(own) for k in values})
    return out.drop("_part", *[f"_v_{k}" for k in values], *[f"_o_{k}" for k in values])


def ranked(df: DataFrame, value: str, name: str = "rank_avg") -> DataFrame:
    """Adds the 1-based rank over the whole table, ties averaged: values are counted first, so copies of a value move once."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    upto = running(counts, value, [], {"_upto": F.col("_n")})
    return df.join(upto.select(F.col(value).alias("_value"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), F.col(value) == F.col("_value"), "left").drop("_value")


# ---------------------------------------------------------------- ranks and gains


def average_rank(value: Column, keys: Sequence[str] = ()) -> Column:
    """1-based rank, ties averaged."""
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": average_rank(F.col(a), keys), "_b": average_rank(F.col(b), keys)})
    return ranked.groupBy(*keys).agg(F.corr("_a", "_b").alias("spearman"))


def best_rows(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``, and whether the key had others."""
    w = W.partitionBy(key)
    return df.withColumns({"_k": F.row_number().over(w.orderBy(*order)), "n_rows": F.count("*").over(w)}).where("_k = 1").drop("_k")


def unique_labels(labels: DataFrame, min_valid: float, ties: Sequence[str] = (), changes: Sequence[str] = ("mean_change", "p95_change", "max_change")) -> DataFrame:
    """One label row per cell: valid in both epochs, best covered first, then the lowest tile; disputed if its rows disagree on a change."""
    rows = labels.where((F.col("valid_start") >= min_valid) & (F.col("valid_end") >= min_valid))
    for c in changes:
        rows = rows.where(F.col(c).isNotNull())
    w = W.partitionBy("cell_id")
    order = [F.least("valid_start", "valid_end").desc(), (F.col("valid_start") + F.col("valid_end")).desc(), F.col("tile"), *[F.col(c) for c in ties]]
    spread = F.greatest(*[F.max(c).over(w) - F.min(c).over(w) for c in changes])
    return rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)), "overlap_disputed": spread > 0, "n_rows": F.count("*").over(w)}).where("_k = 1").drop("_k")


def gain_curve(df: DataFrame, score: str, label: str, weight: str, ident: str, keys: Sequence[str] = ()) -> DataFrame:
    """Budget share and recall after each row in order of score, then id: over the whole table, or within each group of ``keys``."""
    gain = F.col(label) * F.col(weight)
    if not keys:
        got = running(df, score, [ident], {"_w": F.col(weight).cast("double"), "_g": gain.cast("double")}, descending=True)
        return got.withColumns({"budget": F.col("_w") / F.col("_w_all"), "recall": F.col("_g") / F.col("_g_all")}).drop("_w", "_g", "_w_all", "_g_all")
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident)).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    return df.withColumns({"budget": F.sum(weight).over(w) / F.sum(weight).over(whole), "recall": F.sum(gain).over(w) / F.sum(gain).over(whole)})


def at_budget(curve: DataFrame, share: float, label: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Recall and precision of the rows within a share of the budget; zero and null if none fits."""
    inside = curve.where(F.col("budget") <= share)
    got = inside.groupBy(*keys).agg(F.max("recall").alias("recall"), (F.sum(F.col(label) * F.col(weight)) / F.sum(weight)).alias("precision"))
    return got.withColumn("recall", F.coalesce("recall", F.lit(0.0)))


def gain_area(curve: DataFrame, most: float = 0.2, points: int = 512) -> DataFrame:
    """Area under the gain curve up to a budget share, over an even grid with linear interpolation from (0, 0), divided by the share."""
    step = most / (points - 1)
    # of the curve's points only the last at or before and the first at or after each grid point count
    down, up = F.ceil(F.col("budget") / step), F.floor(F.col("budget") / step)
    best = lambda f: f(F.struct(F.col("budget").alias("x"), F.col("recall").alias("y")))
    last = curve.where(F.col("budget") <= most).groupBy(down.alias("k")).agg(best(F.max).alias("lo"))
    first = curve.groupBy(F.least(up, F.lit(points)).alias("k")).agg(best(F.min).alias("hi"))
    grid = curve.sparkSession.range(points).select(F.col("id").alias("k"), (F.col("id") * step).alias("x"))
    w = W.orderBy("k")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    keyed = last.join(first, "k", "full").join(grid, "k", "full")  # a row a grid point
    filled = keyed.withColumns({"lo": F.last("lo", True).over(back), "hi": F.first("hi", True).over(ahead)}).where("x is not null")
    lx, ly, hx, hy = F.col("lo.x"), F.col("lo.y"), F.col("hi.x"), F.col("hi.y")
    y = F.when(lx.isNull(), 0.0).when(hx.isNull() | (hx <= lx), ly).otherwise(ly + (hy - ly) / F.nullif(hx - lx, F.lit(0.0)) * (F.col("x") - lx))
    steps = filled.select("k", "x", y.alias("y")).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    return steps.agg((F.sum((F.col("x") - F.col("px")) * (F.col("y") + F.col("py")) / 2) / most).alias("area"))


def neighbour_median(cells: DataFrame, value: str, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the up to eight neighbours of each cell (col, row); null with fewer than ``least``."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    sent = cells.where(F.col(value).isNotNull()).select(*keys, "col", "row", value, F.explode(offsets).alias("o"))
    sent = sent.select(*keys, (F.col("col") + F.col("o.i")).alias("col"), (F.col("row") + F.col("o.j")).alias("row"), F.col(value).alias("_v"))
    got = sent.groupBy(*keys, "col", "row").agg(F.when(F.count("_v") >= least, F.percentile("_v", 0.5)).alias("around"))
    return cells.join(got, [*keys, "col", "row"], "left")


def slope_aspect(cells: DataFrame, value: str, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Slope in degrees and downslope azimuth by central differences, one-sided at the grid's edges; a missing neighbour gives null.

    Cells are keyed (row, col) with rows southward and may be sparse: only the cell right beside counts.
    """
    def gradient(along: str, across: str) -> Column:
        w = W.partitionBy(*keys, across).orderBy(along)
        here = F.struct(F.col(along).alias("k"), F.col(value).alias("v"))
        back, ahead = F.lag(here).over(w), F.lead(here).over(w)
        first, last = F.min(along).over(W.partitionBy(*keys)), F.max(along).over(W.partitionBy(*keys))
        b = F.when(back["k"] == F.col(along) - 1, back["v"])
        a = F.when(ahead["k"] == F.col(along) + 1, ahead["v"])
        v = F.col(value)
        return F.when(F.col(along) == first, (a - v) / size).when(F.col(along) == last, (v - b) / size).otherwise((a - b) / (2 * size))

    east, south = gradient("col", "row"), gradient("row", "col")
    got = cells.withColumns({"_e": east, "_s": south})
    slope = F.degrees(F.atan(F.sqrt(F.col("_e") * F.col("_e") + F.col("_s") * F.col("_s"))))
    azimuth = F.pmod(F.degrees(F.atan2(-F.col("_e"), F.col("_s"))) , F.lit(360.0))
    return got.withColumns({"slope_deg": slope, "aspect_deg": azimuth}).drop("_e", "_s")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, done: DataFrame | None = None, done_keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group, without those that are done."""
    got = df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
    return got if done is None else got.join(done, list(done_keys), "left_anti")

"""Height surfaces from point tables (tile, x, y, z, ...): thinning, ground, heights above ground, layered canopy rasters.

Stages that are filters or sums are DataFrame expressions. Thinning, ground and nearest ground need the points around a point. Ground runs a
tile at a time; thinning and nearest ground run by blocks of a tile with what lies around them. A tile's own points decide its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.projection import frame, placed
from understory.operators import filters, raster, sets

# ---------------------------------------------------------------- filters and sums


def read_points(sources: Sequence[DataFrame], z_to_metres: float = 1.0) -> DataFrame:
    """One cloud of several resources, its heights in metres."""
    if not sources:
        raise ValueError("a reader is needed")
    if not z_to_metres > 0:
        raise ValueError("the vertical scale must be positive")
    return sets.concatenated(list(sources)).withColumn("z", F.col("z") * float(z_to_metres))


def numbered_returns(points: DataFrame) -> DataFrame:
    """Returns whose number and count are set."""
    return points.where((F.col("return_number") > 0) & (F.col("returns") > 0))


def unflagged(points: DataFrame, flags: Sequence[str] = ("synthetic", "withheld", "overlap")) -> DataFrame:
    """Returns without the flags; key points stay."""
    keep = F.lit(True)
    for f in flags:
        keep = keep & (F.coalesce(F.col(f).cast("int"), F.lit(0)) == 0)
    return points.where(keep)


def reprojected(points: DataFrame, source: int | str, target: int | str) -> DataFrame:
    """Points with x and y in another frame."""
    geographic = placed(points, frame(source), "x", "y", ("_lon", "_lat"), inverse=True)
    return placed(geographic, frame(target), "_lon", "_lat", ("x", "y")).drop("_lon", "_lat")


def _on_grid(points: DataFrame, grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with their tile's grid as one column."""
    return points.join(grids.select(*keys, F.struct("origin_x", "origin_y", "width", "height", "resolution").alias("_grid")), list(keys))


def cropped(points: DataFrame, grids: DataFrame, keys: Sequence[str] = ("tile",)) -> DataFrame:
    """Points inside their tile's grid (keys, origin_x, origin_y, width, height, resolution), its far edges left out."""
    met, at = _on_grid(points, grids, keys), F.col("_grid")
    inside = (F.col("x") >= at["origin_x"]) & (F.col("y") >= at["origin_y"]) & (F.col("x") < at["origin_x"] + at["width"] * at["resolution"]) & (F.col("y") < at["origin_y"] + at["height"] * at["resolution"])
    return met.where(inside).select(points.columns)


def dimension_stats(points: DataFrame, dimensions: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, least, greatest and mean of each dimension, a row a key."""
    if not dimensions:
        raise ValueError("a dimension is needed")
    return points.groupBy(*keys).agg(F.count("*").alias("points"), *[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("least", F.min), ("greatest", F.max), ("mean", F.avg))])


def rasterised(points: DataFrame, value: str, grids: DataFrame, how: str = "max", keys: Sequence[str] = ("tile",)) -> DataFrame:
    """(keys, row, col, value) on each tile's fixed grid, rows southward; a point counts in the cell it falls in. ``idw`` weighs by the inverse square of the distance to the cell's centre."""
    met, at = _on_grid(points, grids, keys), F.col("_grid")
    u, v = (F.col("x") - at["origin_x"]) / at["resolution"], (F.col("y") - at["origin_y"]) / at["resolution"]
    met = met.withColumns({"col": F.floor(u).cast("long"), "row": (at["height"] - 1 - F.floor(v)).cast("long"), "_w": 1 / F.greatest(F.pow(u - F.floor(u) - 0.5, 2) + F.pow(v - F.floor(v) - 0.5, 2), F.lit(1e-12))})
    by = {"max": F.max(value), "min": F.min(value), "mean": F.avg(value), "count": F.count(value), "idw": F.sum(F.col(value) * F.col("_w")) / F.sum("_w")}
    return met.groupBy(*keys, "row", "col").agg(by[how].alias("value"))


# ---------------------------------------------------------------- a tile at a time


def _per_tile(points: DataFrame, keys: Sequence[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return points.groupBy(*keys).applyInPandas(work, schema)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *more])


def kept_disks(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Which points stay when each, in turn, stays if no point that stays lies within the radius."""
    keep = np.zeros(len(x), bool)
    i, j = np.floor(x / radius).astype(np.int64).tolist(), np.floor(y / radius).astype(np.int64).tolist()
    xs, ys, limit = x.tolist(), y.tolist(), radius * radius
    held: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for k, (a, b, px, py) in enumerate(zip(i, j, xs, ys, strict=True)):
        free = True
        for da in (-1, 0, 1):
            for db in (-1, 0, 1):
                for qx, qy in held.get((a + da, b + db), ()):
                    if (px - qx) ** 2 + (py - qy) ** 2 < limit:
                        free = False
                        break
                if not free:
                    break
            if not free:
                break
        if free:
            keep[k] = True
            held.setdefault((a, b), []).append((px, py))
    return keep


#: Side of a thinning block and width of the rim around it, in squares of the radius.
THIN_BLOCK, THIN_RIM = 96, 16
#: Candidate pairs a point up to which a block's pairs are listed; denser blocks are worked point after point.
MOST_PAIRS = 128
KEPT, DROPPED, OPEN = 1, 2, 0


def _square_pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in order of their square, and for each point and each of three rows of squares around it the first and the end of the points there."""
    i, j = i - i.min() + 1, j - j.min() + 1
    wide = int(j.max()) + 2
    key = i * wide + j
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    around = key[:, None] + np.array([-wide, 0, wide])
    return order, np.searchsorted(ranked, around - 1), np.searchsorted(ranked, around + 1, side="right")


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which place, of all places in the ranges."""
    n = end - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def thinning_states(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, whole: np.ndarray) -> np.ndarray:
    """KEPT or DROPPED where that is certain, else OPEN, of points in order that lie in squares (i, j) of the radius.

    ``whole`` says whether all points around a point are here; one without can't be known to stay, but can be known to go.
    """
    state = np.zeros(len(x), np.int8)
    if not len(x):
        return state
    order, first, end = _square_pairs(i, j)
    if (end - first).sum() > MOST_PAIRS * len(x):
        return _states_in_turn(i, j, x, y, radius, whole)
    early, late = [], []
    for s in range(0, len(x), 1 << 16):
        of, at = _spread(first[s : s + (1 << 16)].ravel(), end[s : s + (1 << 16)].ravel())
        p, q = s + of // 3, order[at]
        near = (q < p) & ((x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2 < radius * radius)
        early.append(q[near])
        late.append(p[near])
    early, late = np.concatenate(early), np.concatenate(late)
    while True:
        stop = np.zeros(len(x), bool)
        stop[late] = True
        new = (state == OPEN) & whole & ~stop
        state[new] = KEPT
        state[late[new[early]]] = DROPPED
        live = (state[late] == OPEN) & (state[early] == OPEN)  # a kept point has dropped what it could
        if not new.any() and live.all():
            return state
        early, late = early[live], late[live]


def _states_in_turn(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, whole: np.ndarray) -> np.ndarray:
    """``thinning_states`` point after point; memory follows the points that stay or stay open."""
    state, limit = np.zeros(len(x), np.int8), radius * radius
    kept: dict[tuple[int, int], list[tuple[float, float]]] = {}
    unsure: dict[tuple[int, int], list[tuple[float, float]]] = {}

    def near(held: dict, a: int, b: int, px: float, py: float) -> bool:
        return any((px - qx) ** 2 + (py - qy) ** 2 < limit for da in (-1, 0, 1) for db in (-1, 0, 1) for qx, qy in held.get((a + da, b + db), ()))

    for k, (a, b, px, py, all_here) in enumerate(zip(i.tolist(), j.tolist(), x.tolist(), y.tolist(), whole.tolist(), strict=True)):
        if near(kept, a, b, px, py):
            state[k] = DROPPED
        elif all_here and not near(unsure, a, b, px, py):
            state[k] = KEPT
            kept.setdefault((a, b), []).append((px, py))
        else:
            unsure.setdefault((a, b), []).append((px, py))
    return state


def poisson_thinned(points: DataFrame, radius: float, order: Sequence[str], keys: Sequence[str] = ("tile",)) -> DataFrame:
    """Poisson-disk thinning of each tile: points in ``order``, equal ones by place, stay unless one that stayed lies nearer than the radius.

    Blocks of a tile are worked by themselves with a rim of the points around, which settles nearly all points: those that stay or go whatever
    lies beyond the rim. Only what stays open then meets a tile at a time. No point that is known to stay lies within the radius of an open one,
    since its own block would have known that one to go and said so, so the open points of a tile decide among themselves.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    keys, by = list(keys), [*order, "x", "y"]
    fl = lambda c, n: F.floor(c / n).cast("long")
    at = points.withColumns({"_ci": fl(F.col("x"), F.lit(float(radius))), "_cj": fl(F.col("y"), F.lit(float(radius)))})
    own = at.withColumns({"_i": fl(F.col("_ci"), THIN_BLOCK), "_j": fl(F.col("_cj"), THIN_BLOCK), "_own": F.lit(True)})
    reach = lambda c: F.sequence(fl(F.col(c) - THIN_RIM, THIN_BLOCK), fl(F.col(c) + THIN_RIM, THIN_BLOCK))
    rim = own.where((F.size(reach("_ci")) > 1) | (F.size(reach("_cj")) > 1)).withColumnsRenamed({"_i": "_oi", "_j": "_oj"})
    rim = rim.withColumn("_i", F.explode(reach("_ci"))).withColumn("_j", F.explode(reach("_cj"))).where("_i <> _oi or _j <> _oj").withColumn("_own", F.lit(False))
    columns = points.columns

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf._own.any():
            return pdf.head(0)[columns].assign(_s=0, _r=0)
        pdf = pdf.sort_values(by, kind="stable")
        i, j, mine = pdf._ci.to_numpy(np.int64), pdf._cj.to_numpy(np.int64), pdf._own.to_numpy(bool)
        inner = lambda c, n: (c > n * THIN_BLOCK - THIN_RIM) & (c < (n + 1) * THIN_BLOCK + THIN_RIM - 1)
        bi, bj = int(pdf._i.iloc[0]), int(pdf._j.iloc[0])
        state = thinning_states(i, j, pdf.x.to_numpy(float), pdf.y.to_numpy(float), radius, inner(i, bi) & inner(j, bj))
        beside = ~mine & (i >= bi * THIN_BLOCK - 1) & (i <= (bi + 1) * THIN_BLOCK) & (j >= bj * THIN_BLOCK - 1) & (j <= (bj + 1) * THIN_BLOCK)
        says = mine & (state != DROPPED) | beside & (state == DROPPED)
        return pdf[says][columns].assign(_s=state[says], _r=np.where(state[says] == KEPT, 1 + (bi * 1_000_003 + bj) % 65_521, 0))

    known = own.select(*columns, "_ci", "_cj", "_i", "_j", "_own").unionByName(rim.select(*columns, "_ci", "_cj", "_i", "_j", "_own"))
    settled = known.where("x is not null and y is not null").groupBy(*keys, "_i", "_j").applyInPandas(settle, _schema(points, "_s int", "_r int"))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rest = []
        for b in batches:
            to = b.column(b.schema.get_field_index("_r"))
            if len(found := b.filter(pc.equal(to, 0))):
                rest.append(found)
            if len(done := b.filter(pc.not_equal(to, 0))):
                yield done.select(columns)
        if not rest:
            return
        left = pa.Table.from_batches(rest)
        pdf = left.select(list(dict.fromkeys([*keys, *by, "_s"]))).to_pandas()
        gone = pdf[pdf._s == DROPPED].drop(columns="_s").drop_duplicates()
        pdf = pdf[pdf._s == OPEN].drop(columns="_s").reset_index(names="_at").merge(gone.assign(_gone=True), how="left", on=list(gone.columns))
        pdf = pdf[pdf._gone.isna()].sort_values(by, kind="stable")
        stay = [some._at.to_numpy()[kept_disks(some.x.to_numpy(float), some.y.to_numpy(float), radius)] for _, some in (pdf.groupby(keys, dropna=False) if keys else [((), pdf)])]
        if stay:
            yield from left.take(np.sort(np.concatenate(stay))).select(columns).to_batches()

    # what stays open of a tile meets in one task; what is settled goes by block
    return settled.repartition(*keys, "_r").mapInArrow(finish, _schema(points))


def _opened(z: np.ndarray, radius: int) -> np.ndarray:
    """Grey opening by a disk: the greatest of the least values around."""
    n = z.shape

    def swept(a: np.ndarray, pick: Callable) -> np.ndarray:
        out = a.copy()
        for d in range(-radius, radius + 1):
            h = int((radius**2 - d * d) ** 0.5)
            for e in range(-h, h + 1):
                to = (slice(max(0, -d), n[0] - max(0, d)), slice(max(0, -e), n[1] - max(0, e)))
                of = (slice(max(0, d), n[0] - max(0, -d)), slice(max(0, e), n[1] - max(0, -e)))
                if to[0].start < to[0].stop and to[1].start < to[1].stop:
                    out[to] = pick(out[to], a[of])
        return out

    return swept(swept(z, np.minimum), np.maximum)


def _filled(z: np.ndarray) -> np.ndarray:
    """Missing cells by the mean of their known neighbours, from the known ones outwards."""
    z = z.copy()
    while (gap := np.isnan(z)).any() and not gap.all():
        total, count = np.zeros_like(z), np.zeros_like(z)
        padded = np.pad(z, 1, constant_values=np.nan)
        for a in (0, 1, 2):
            for b in (0, 1, 2):
                part = padded[a : a + z.shape[0], b : b + z.shape[1]]
                ok = ~np.isnan(part)
                total += np.where(ok, part, 0)
                count += ok
        z = np.where(gap & (count > 0), total / np.maximum(count, 1), z)
    return z


def ground_mask(x: np.ndarray, y: np.ndarray, z: np.ndarray, rules: Mapping[str, float]) -> np.ndarray:
    """Ground returns by the simple morphological filter (Pingel, Clarke and McBride 2013).

    The lowest surface is opened by growing disks up to ``window``; cells that drop by more than ``slope`` times the disk are objects.
    Returns within ``threshold`` plus ``scalar`` times the slope of what is left are ground. ``cell`` is the surface's cell, 1 where unset.
    """
    if missing := [k for k in ("scalar", "slope", "threshold", "window") if k not in rules]:
        raise ValueError(f"ground rules lack {', '.join(missing)}")
    if not len(x):
        return np.zeros(0, bool)
    cell = float(rules.get("cell", 1.0))
    c, r = np.floor((x - x.min()) / cell).astype(int), np.floor((y - y.min()) / cell).astype(int)
    low = np.full((r.max() + 1, c.max() + 1), np.inf)
    np.minimum.at(low, (r, c), z)
    known = np.isfinite(low)
    surface = _filled(np.where(known, low, np.nan))
    objects, last = np.zeros_like(known), surface
    for radius in range(1, max(1, int(np.ceil(rules["window"] / cell))) + 1):
        opened = _opened(last, radius)
        objects |= last - opened > rules["slope"] * radius * cell
        last = opened
    terrain = _filled(np.where(known & ~objects, low, np.nan)) if (known & ~objects).any() else surface
    g = np.gradient(terrain, cell) if min(terrain.shape) > 1 else [np.zeros_like(terrain)] * 2
    steep = np.sqrt(g[0] ** 2 + g[1] ** 2)
    return np.abs(z - terrain[r, c]) <= rules["threshold"] + rules["scalar"] * steep[r, c]


def classified_ground(points: DataFrame, rules: Mapping[str, float], keys: Sequence[str] = ("tile",)) -> DataFrame:
    """Points with ``ground``: whether the morphological filter takes the return for ground."""
    rules = dict(rules)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(ground=ground_mask(pdf.x.to_numpy(float), pdf.y.to_numpy(float), pdf.z.to_numpy(float), rules))

    return _per_tile(points, keys, work, _schema(points, "ground boolean"))


def nearest_values(x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray, gz: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Value of the nearest ground point of each point; of equal distances that of the least value.

    Points look through the nine squares around them; those whose nearest lies beyond a square's side look again through squares of twice the side. ``most`` bounds the pairs at a time.
    """
    out = np.full(len(x), np.nan)
    if not len(gx) or not len(x):
        return out
    order = np.lexsort((gz, gy, gx))  # copies of a place count once, with their least value
    order = order[np.r_[True, (np.diff(gx[order]) != 0) | (np.diff(gy[order]) != 0)]]
    gx, gy, gz = gx[order], gy[order], gz[order]
    x0, y0 = gx.min(), gy.min()
    wide = max(float(max(x.max(), gx.max()) - min(x.min(), x0)), float(max(y.max(), gy.max()) - min(y.min(), y0)), 1e-9)
    size = max(float(np.sqrt(max(np.ptp(gx), 1e-9) * max(np.ptp(gy), 1e-9) * 2 / len(gx))), wide / (1 << 20))

    def squares(size: float) -> tuple[np.ndarray, int]:
        tall = int((gy.max() - y0) / size) + 5
        return np.floor((gx - x0) / size).astype(np.int64) * tall + np.floor((gy - y0) / size).astype(np.int64) + 2, tall

    while size > wide / (1 << 20) and np.unique(squares(size)[0], return_counts=True)[1].max() > 64:
        size /= 2
    left = np.arange(len(x))
    while len(left):
        key, tall = squares(size)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        i = np.floor((x[left] - x0) / size).astype(np.int64)
        j = np.clip(np.floor((y[left] - y0) / size).astype(np.int64), -1, tall - 4)
        around = (i[:, None] + np.array([-1, 0, 1])) * tall + j[:, None] + 2
        first, end = np.searchsorted(ranked, around - 1), np.searchsorted(ranked, around + 1, side="right")
        ends = np.cumsum((end - first).sum(axis=1))
        sure = np.zeros(len(left), bool)
        s = 0
        while s < len(left):
            t = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, side="right")))
            of, at = _spread(first[s:t].ravel(), end[s:t].ravel())
            of, at = of // 3, order[at]
            d = (x[left[s:t]][of] - gx[at]) ** 2 + (y[left[s:t]][of] - gy[at]) ** 2
            if len(of):
                has, starts = np.unique(of, return_index=True)
                least = np.full(t - s, np.inf)
                least[has] = np.minimum.reduceat(d, starts)
                out[left[s + has]] = np.fmin.reduceat(np.where(d == least[of], gz[at], np.nan), starts)
                sure[s:t] = least < (0.999999 * size) ** 2
            s = t
        if size > wide:
            break
        left, size = left[~sure], size * 2
    return out


#: Sides of the squares that are asked for ground, each a multiple of the one before; and how many squares a block is wide.
GROUND_SIDE, GROUND_STEP, GROUND_LEVELS, GROUND_BLOCK = 4.0, 8, 3, 40


def heights_above_ground(points: DataFrame, keys: Sequence[str] = ("tile",), ground: str = "ground") -> DataFrame:
    """Points with ``height``: z less that of the nearest ground return of the tile; null in a tile without ground.

    A point whose square holds ground has its nearest ground within the square's diagonal, so blocks of squares with two squares of ground around
    them are worked by themselves. Points of bare squares go by the smallest of the wider squares that holds ground, and by the whole tile where none does.
    """
    keys = list(keys)
    fl = lambda c, n: F.floor(c / n).cast("long")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    columns, flag, levels = points.columns, F.coalesce(F.col(ground).cast("boolean"), F.lit(False)), range(1, GROUND_LEVELS)
    at = points.withColumns({"_ci": fl(F.col("x"), F.lit(GROUND_SIDE)), "_cj": fl(F.col("y"), F.lit(GROUND_SIDE)), "_fine": known("x") & known("y"), "_is": flag & known("x") & known("y")})
    side = lambda c, k: fl(F.col(c), GROUND_STEP**k)
    block = lambda c, k, by=0: fl(side(c, k) + by, GROUND_BLOCK)

    def around(rows: DataFrame, k: int) -> DataFrame:
        """Ground rows in each block of the level that needs them."""
        spots = [F.sequence(block(c, k, -2), block(c, k, 2)) for c in ("_ci", "_cj")]
        return rows.withColumn("_i", F.explode(spots[0])).withColumn("_j", F.explode(spots[1])).withColumns({"_k": F.lit(k), "_own": F.lit(False)})

    tagged = [*columns, "_k", "_i", "_j", "_own"]
    base = at.withColumns({"_k": F.lit(0), "_i": block("_ci", 0), "_j": block("_cj", 0), "_own": F.lit(True)})
    edge = at.where(F.col("_is") & ((block("_ci", 0, -2) != block("_ci", 0, 2)) | (block("_cj", 0, -2) != block("_cj", 0, 2))))
    edge = around(edge, 0).where((F.col("_i") != block("_ci", 0)) | (F.col("_j") != block("_cj", 0)))
    # squares without ground, with the first wider level that has some; the last is the whole tile
    cells = at.where("_fine").groupBy(*keys, "_ci", "_cj").agg(F.max("_is").alias("_has"))
    bare, level = cells.where("not _has").drop("_has"), F.lit(GROUND_LEVELS)
    for k in reversed(levels):
        some = cells.where("_has").select(*[F.col(c).alias(f"_key{n}") for n, c in enumerate(keys)], side("_ci", k).alias("_wi"), side("_cj", k).alias("_wj")).distinct().withColumn(f"_has{k}", F.lit(True))
        on = (side("_ci", k) == F.col("_wi")) & (side("_cj", k) == F.col("_wj"))
        for n, c in enumerate(keys):
            on = on & F.col(c).eqNullSafe(F.col(f"_key{n}"))
        bare = bare.join(some, on, "left").select(*bare.columns, f"_has{k}")
        level = F.when(F.col(f"_has{k}"), F.lit(k)).otherwise(level)
    place = lambda c: F.when(F.col("_k") == GROUND_LEVELS, F.lit(0).cast("long")).otherwise(F.coalesce(*[F.when(F.col("_k") == k, block(c, k)) for k in levels]))
    bare = bare.withColumn("_k", level).withColumns({"_i": place("_ci"), "_j": place("_cj")}).select(*[F.col(c).alias(f"_key{n}") for n, c in enumerate(keys)], F.col("_ci").alias("_bi"), F.col("_cj").alias("_bj"), "_k", "_i", "_j")
    same = F.lit(True)
    for n, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{n}"))
    far = at.where("_fine").join(bare, same & (F.col("_ci") == F.col("_bi")) & (F.col("_cj") == F.col("_bj"))).withColumn("_own", F.lit(True))
    needed = bare.select(*[f"_key{n}" for n in range(len(keys))], F.col("_k").alias("_nk"), F.col("_i").alias("_ni"), F.col("_j").alias("_nj")).distinct()
    of = lambda rows, k: rows.join(needed.where(F.col("_nk") == k), same & (F.col("_i") == F.col("_ni")) & (F.col("_j") == F.col("_nj")), "left_semi")
    whole = at.where("_is").withColumns({"_k": F.lit(GROUND_LEVELS), "_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long"), "_own": F.lit(False)})
    parts = [base, edge, far, of(whole, GROUND_LEVELS), *[of(around(at.where("_is"), k), k) for k in levels]]
    dealt = parts[0].select(tagged)
    for p in parts[1:]:
        dealt = dealt.unionByName(p.select(tagged))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        own, x, y = pdf._own.to_numpy(bool), pdf.x.to_numpy(float), pdf.y.to_numpy(float)
        fine = ~(np.isnan(x) | np.isnan(y))
        g = pdf[ground].fillna(False).to_numpy(bool) & fine
        mine = own.copy()
        if pdf._k.iloc[0] == 0:  # points of bare squares are worked elsewhere
            square = np.zeros(len(pdf), np.int64)
            square[fine] = pd.factorize(np.floor(x[fine] / GROUND_SIDE) + 1j * np.floor(y[fine] / GROUND_SIDE))[0] + 1
            mine &= ~fine | np.isin(square, np.unique(square[g & own]))
        q = mine & fine
        under = np.full(len(pdf), np.nan)
        z = pdf.z.to_numpy(float)
        under[q] = nearest_values(x[q], y[q], x[g], y[g], z[g])
        return pdf[mine][columns].assign(height=(z - under)[mine])

    got = dealt.groupBy(*keys, "_k", "_i", "_j").applyInPandas(work, _schema(points, "height double"))
    return got.withColumn("height", F.when(~F.isnan("height"), F.col("height")))


# ---------------------------------------------------------------- pipelines


def prepared(points: DataFrame, grids: DataFrame, settings: Mapping, keys: Sequence[str] = ("tile",)) -> DataFrame:
    """The stages that all surfaces of a tile share, in order: numbering, flags, frame, classes, scan angle, crop, thinning, ground.

    ``settings``: source_frame, target_frame, drop_classes, max_scan_angle_deg, sample_radius_m, order, smrf; drop_class_flags is true where unset.
    """
    out = numbered_returns(points)
    if settings.get("drop_class_flags", True):
        out = unflagged(out)
    out = reprojected(out, settings["source_frame"], settings["target_frame"])
    out = out.where(filters.class_ok(F.col("classification"), settings["drop_classes"]) & filters.scan_angle_ok(F.col("scan_angle"), settings["max_scan_angle_deg"]))
    out = poisson_thinned(cropped(out, grids, keys), settings["sample_radius_m"], settings["order"], keys)
    return classified_ground(out, settings["smrf"], keys)


def terrain_surfaces(ready: DataFrame, grids: DataFrame, keys: Sequence[str] = ("tile",), terrain: str = "idw") -> DataFrame:
    """(keys, row, col, dsm, dtm): the highest return of each cell, and its ground."""
    dsm = rasterised(ready, "z", grids, "max", keys).withColumnRenamed("value", "dsm")
    dtm = rasterised(ready.where("ground"), "z", grids, terrain, keys).withColumnRenamed("value", "dtm")
    return dsm.join(dtm, [*keys, "row", "col"], "left")


def canopy_layers(ready: DataFrame, grids: DataFrame, thresholds: Iterable[float], low: float, high: float, keys: Sequence[str] = ("tile",)) -> DataFrame:
    """(keys, row, col, a column a layer, top): the highest height above ground of returns over each threshold, and their pit-free combination within [low, high]."""
    thresholds = [float(t) for t in thresholds]
    if not thresholds or min(thresholds) < 0:
        raise ValueError("thresholds from zero are needed")
    tall = heights_above_ground(ready, keys)
    layers = [f"over_{t:g}" for t in thresholds]
    marked = tall.withColumns({n: F.when(F.col("height") >= t, F.col("height")) for n, t in zip(layers, thresholds, strict=True)})
    parts = [rasterised(marked.where(F.col(n).isNotNull()), n, grids, "max", keys).select(*keys, "row", "col", F.lit(n).alias("_n"), "value") for n in layers]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = long.groupBy(*keys, "row", "col").agg(*[F.max(F.when(F.col("_n") == n, F.col("value"))).alias(n) for n in layers])
    return wide.withColumn("top", raster.pit_free([F.col(n) for n in layers], low, high))

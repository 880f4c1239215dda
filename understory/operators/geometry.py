"""Boxes, grids and footprints in projected frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.projection import frame, placed

EDGES = ("x0", "y0", "x1", "y1")


def checked_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes (x0, y0, x1, y1); one without an inside is an error when it is read."""
    return boxes.withColumn("x0", F.when((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.col("x0")).otherwise(F.raise_error(F.lit("a box needs x0 < x1 and y0 < y1"))))


def projected_boxes(boxes: DataFrame, keys: Sequence[str], code: int | str, samples: int = 21) -> DataFrame:
    """(keys, x0, y0, x1, y1): bounds of longitude-latitude boxes in a frame, from ``samples`` points along each edge."""
    if samples < 2:
        raise ValueError("an edge needs two samples at least")
    step = F.explode(F.array(*[F.lit(k / (samples - 1)) for k in range(samples)]))
    at = boxes.select(*keys, *EDGES, step.alias("_t"))
    along = lambda a, b: F.col(a) + F.col("_t") * (F.col(b) - F.col(a))
    ring = F.explode(F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((along("x0", "x1"), F.col("y0")), (along("x0", "x1"), F.col("y1")), (F.col("x0"), along("y0", "y1")), (F.col("x1"), along("y0", "y1")))]))
    points = at.select(*keys, ring.alias("_p")).select(*keys, F.col("_p.lon").alias("_lon"), F.col("_p.lat").alias("_lat"))
    points = placed(points, frame(code), "_lon", "_lat", ("_x", "_y"))
    return points.groupBy(*keys).agg(F.min("_x").alias("x0"), F.min("_y").alias("y0"), F.max("_x").alias("x1"), F.max("_y").alias("y1"))


def grids(boxes: DataFrame, resolution: float, snap: float | None = None) -> DataFrame:
    """Boxes with (origin_x, origin_y, width, height, resolution): grids from the lower left, snapped outwards to multiples of ``snap`` (the resolution)."""
    snap = float(snap or resolution)
    if resolution <= 0 or snap <= 0 or abs(snap / resolution - round(snap / resolution)) > 1e-9:
        raise ValueError("the snap must be a positive multiple of a positive resolution")
    low = lambda c: F.floor(F.col(c) / snap) * snap
    size = lambda lo, hi: F.round(F.ceil((F.col(hi) - low(lo)) / snap) * snap / resolution).cast("long")
    return boxes.withColumns({"origin_x": low("x0").cast("double"), "origin_y": low("y0").cast("double"), "width": size("x0", "x1"), "height": size("y0", "y1"), "resolution": F.lit(float(resolution))})


def grid_extents(gridded: DataFrame) -> DataFrame:
    """Grids with the box (x0, y0, x1, y1) that they cover."""
    return gridded.withColumns({"x0": F.col("origin_x"), "y0": F.col("origin_y"), "x1": F.col("origin_x") + F.col("width") * F.col("resolution"), "y1": F.col("origin_y") + F.col("height") * F.col("resolution")})


def tile_grids(tiles: DataFrame, keys: Sequence[str], code: int | str, resolution: float, snap: float | None = None) -> DataFrame:
    """The grid of each longitude-latitude tile in a frame."""
    return grids(projected_boxes(tiles, keys, code), resolution, snap)


def scale_factor(base: float, scale: float) -> int:
    """How many base cells a coarser cell is wide; an error unless that is a whole number."""
    if base <= 0 or scale < base or abs(scale / base - round(scale / base)) > 1e-9:
        raise ValueError("the scale must be a whole multiple of the base resolution")
    return round(scale / base)


def pixel_positions(cells: DataFrame, x0: float, y0: float, size: float, code: int | str) -> DataFrame:
    """Cells (row, col) of a north-up raster with the longitude and latitude of their centres."""
    at = cells.withColumns({"_px": x0 + (F.col("col") + 0.5) * size, "_py": F.lit(float(y0)) - (F.col("row") + 0.5) * size})
    return placed(at, frame(code), "_px", "_py", ("lon", "lat"), inverse=True).drop("_px", "_py")


def warped(target: DataFrame, source: DataFrame, target_code: int | str, source_code: int | str, origin: tuple[float, float, float], grid: tuple[float, float, float], keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Target cells (keys, row, col) with the source raster's value at their centres, bilinear over four cells, null unless all four are there.

    ``origin`` and ``grid`` are (x0, y0, size) of the north-up source and target. Each target cell asks for four source cells: one join, no pairs beyond those.
    """
    asked = placed(pixel_positions(target.select(*keys, "row", "col"), *grid, target_code), frame(source_code), "lon", "lat", ("_x", "_y"))
    x, y = F.col("_x"), F.col("_y")
    at = asked.select(*keys, "row", "col", ((x - origin[0]) / origin[2] - 0.5).alias("_u"), ((F.lit(origin[1]) - y) / origin[2] - 0.5).alias("_v"))
    i, j = F.floor("_v").cast("long"), F.floor("_u").cast("long")
    fv, fu = F.col("_v") - F.floor("_v"), F.col("_u") - F.floor("_u")
    four = F.explode(F.array(*[F.struct((i + a).alias("r"), (j + b).alias("c"), ((fv if a else 1 - fv) * (fu if b else 1 - fu)).alias("w")) for a in (0, 1) for b in (0, 1)]))
    asked = at.select(*keys, "row", "col", four.alias("_q")).select(*keys, "row", "col", F.col("_q.r").alias("_r"), F.col("_q.c").alias("_c"), F.col("_q.w").alias("_w"))
    found = asked.join(source.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_z")), [*keys, "_r", "_c"], "left")
    return found.groupBy(*keys, "row", "col").agg(F.when(F.count("_z") == 4, F.sum(F.col("_z") * F.col("_w"))).alias(value))


# ---------------------------------------------------------------- footprints as cells


def footprint_cells(boxes: DataFrame, keys: Sequence[str], step: float, code: int | str) -> DataFrame:
    """(keys, i, j, lon, lat, x, y, km2): cells of ``step`` degrees whose centre a longitude-latitude box covers, with their projected centre and area, each once a key.

    Areas are those of the cells' projected corners, so a footprint is known to about a cell along its edge.
    """
    first = lambda c: F.ceil(F.col(c) / step - 0.5).cast("long")
    last = lambda c: (F.ceil(F.col(c) / step - 0.5) - 1).cast("long")
    some = boxes.where((first("x0") <= last("x1")) & (first("y0") <= last("y1")))
    over = some.withColumn("i", F.explode(F.sequence(first("x0"), last("x1")))).withColumn("j", F.explode(F.sequence(first("y0"), last("y1"))))
    cells = over.select(*keys, "i", "j").distinct().withColumns({"lon": (F.col("i") + 0.5) * step, "lat": (F.col("j") + 0.5) * step})
    cells, at = placed(cells, frame(code), "lon", "lat", ("x", "y")), frame(code)
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    for k, (a, b) in enumerate(corners):
        cells = placed(cells.withColumns({"_a": (F.col("i") + a) * step, "_b": (F.col("j") + b) * step}), at, "_a", "_b", (f"_x{k}", f"_y{k}"))
    area = F.lit(0.0)
    for k in range(4):
        n = (k + 1) % 4
        area = area + (F.col(f"_x{k}") * F.col(f"_y{n}") - F.col(f"_x{n}") * F.col(f"_y{k}")) / 2
    return cells.withColumn("km2", F.abs(area) / 1e6).drop("_a", "_b", *[f"_{c}{k}" for c in "xy" for k in range(4)])


def overlap_summary(first: DataFrame, second: DataFrame, study: tuple[float, float, float, float], code: int | str, buffers_km: Sequence[float], step: float) -> DataFrame:
    """One row: km2 of two footprints and of what they share, in all and inside the study box, the shared part's distance to the box in km and its km2 within each buffer."""
    a, b = (footprint_cells(f, (), step, code).withColumn("side", F.lit(k)) for k, f in ((1, first), (2, second)))
    both = a.unionByName(b).groupBy("i", "j", "lon", "lat", "x", "y", "km2").agg(F.bit_or("side").alias("side"))
    w, s, e, n = study
    inside = (F.col("lon") >= w) & (F.col("lon") < e) & (F.col("lat") >= s) & (F.col("lat") < n)
    bounds = projected_boxes(first.sparkSession.createDataFrame([study], "x0 double, y0 double, x1 double, y1 double"), (), code).first()
    dx = F.greatest(F.lit(bounds.x0) - F.col("x"), F.col("x") - F.lit(bounds.x1), F.lit(0.0))
    dy = F.greatest(F.lit(bounds.y0) - F.col("y"), F.col("y") - F.lit(bounds.y1), F.lit(0.0))
    away = F.sqrt(dx * dx + dy * dy) / 1e3
    of = lambda where: F.coalesce(F.sum(F.when(where, F.col("km2"))), F.lit(0.0))
    shared = F.col("side") == 3
    return both.agg(
        of(F.col("side") != 2).alias("first_km2"), of(F.col("side") != 1).alias("second_km2"), of((F.col("side") != 2) & inside).alias("first_in_study_km2"), of((F.col("side") != 1) & inside).alias("second_in_study_km2"),
        of(shared).alias("shared_km2"), of(shared & inside).alias("shared_in_study_km2"), F.min(F.when(shared, away)).alias("shared_distance_km"), *[of(shared & (away <= float(km))).alias(f"shared_within_{km:g}_km2") for km in buffers_km],
    )


def dispersion_side(tiles: int) -> int:
    """Side of the coarse grid that a sample is spread over: no more squares than tiles."""
    if tiles < 1:
        raise ValueError("at least one tile")
    return max(1, math.isqrt(tiles))

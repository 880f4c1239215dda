"""Planners and jobs over tables: which tiles to build, from what, and the checks that run on what was built.

Settings are mappings, as read from a settings file. Footprints are tables of delivered boxes (epoch, resource, x0, y0, x1, y1) in degrees.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.functions import maths, text
from understory.functions.projection import frame, placed
from understory.operators import aggregates, filters, geometry, joins, models, raster, sampling, stats, windows
from understory.plans import jobs
from understory.sources import catalogues

Box = tuple[float, float, float, float]

# ---------------------------------------------------------------- settings


def search_box(settings: Mapping) -> Box:
    """The box that the calibration pair's overlap is looked for in."""
    if not (box := settings.get("noise_floor", {}).get("search_box")):
        raise ValueError("noise_floor.search_box is not set")
    w, s, e, n = (float(v) for v in box)
    return w, s, e, n


def epoch_resources(settings: Mapping, epochs: Sequence[str]) -> dict[str, list[str]]:
    """Resources of each wanted epoch: one under ``dataset`` or several under ``datasets``."""
    out = {}
    for e in settings["epochs"]:
        if e["name"] in set(epochs):
            found = e.get("datasets", e.get("dataset")) or []
            out[e["name"]] = [found] if isinstance(found, str) else [str(v) for v in found]
    if bad := sorted(set(epochs) - {k for k, v in out.items() if v}):
        raise ValueError(f"no resource for epochs {', '.join(bad)}")
    return out


def pair_epochs(settings: Mapping, pair: Sequence[str]) -> tuple[dict, dict]:
    """The two epochs of a pair, the earlier first."""
    if len(pair) != 2 or pair[0] == pair[1]:
        raise ValueError("a pair names two epochs")
    by = {e["name"]: e for e in settings["epochs"]}
    if missing := [p for p in pair if p not in by]:
        raise ValueError(f"no epochs named {', '.join(missing)}")
    a, b = sorted((by[p] for p in pair), key=lambda e: str(e["start"]))
    return a, b


def z_factor(settings: Mapping, epoch: str) -> float:
    """What an epoch's elevations are multiplied by to be metres."""
    for e in settings["epochs"]:
        if e["name"] == epoch:
            return float(e.get("z_to_metres", 1.0))
    raise ValueError(f"no epoch named {epoch}")


PAIR_KEYS = ("min_cell_fraction", "min_ground_fraction", "noise_classes", "water_class", "ground_class", "excluded_flag_bits", "canopy_cell_m", "canopy_height_classes_m", "usable_canopy_min_km2", "sensitivity")


def pair_rules(settings: Mapping) -> tuple[dict, dict]:
    """Point rules and pair rules of a coverage check, from its section and those of change and tiers."""
    own = settings.get("pair_coverage")
    if not isinstance(own, Mapping):
        raise ValueError("settings have no pair_coverage section")
    jobs.require_keys(own, PAIR_KEYS)
    point = {"dropped": (*own["noise_classes"], own["water_class"]), "ground_class": int(own["ground_class"]), "flag_bits": int(own["excluded_flag_bits"])}
    pair = {
        "min_cells": float(own["min_cell_fraction"]), "min_ground": float(own["min_ground_fraction"]), "canopy_min": float(settings["change"]["canopy_min_height_m"]), "limit": float(settings["change"]["disturbance_limit_m"]),
        "bare_max": float(settings["change"].get("bare_max_height_m", settings["change"]["canopy_min_height_m"])), "classes": tuple(float(v) for v in own["canopy_height_classes_m"]),
        "slopes": tuple((float(a), float(b)) for a, b in settings["tiers"]["slope_bands_deg"]), "cell_m": float(own["canopy_cell_m"]),
    }
    return point, pair


def sample_radius(settings: Mapping) -> float:
    """Thinning radius that brings every admitted epoch to the density of the sparsest; an error if that is under the floor."""
    dense = [float(e["nominal_density_pts_m2"]) for e in settings["epochs"] if admitted(e, settings["admission_screen"]) and e.get("nominal_density_pts_m2")]
    floor = float(settings["admission_screen"]["min_density_pts_m2"])
    if not dense or min(dense) < floor:
        raise ValueError("no admitted epoch is as dense as the floor")
    return math.sqrt(0.70 / min(dense))


def admitted(epoch: Mapping, screen: Mapping) -> bool:
    """Dense enough, with a geoid, flown in leaf, and not excluded by hand."""
    month = int(str(epoch["start"])[5:7])
    return epoch.get("admitted") is not False and float(epoch.get("nominal_density_pts_m2") or 0) >= float(screen["min_density_pts_m2"]) and bool(epoch.get("geoid")) and month in screen["leaf_on_months"]


# ---------------------------------------------------------------- tiles


def covered_tiles(tiles: DataFrame, boxes: DataFrame, epochs: Sequence[str], side: int, union: bool = False) -> DataFrame:
    """Tiles (tile, x0, y0, x1, y1) whose ``side`` x ``side`` cells every epoch covers.

    A cell is covered if one box holds it whole, or, with ``union``, if its corners and its middle lie in boxes of the epoch, so that a
    cell across two abutting files counts. Boxes and cells meet in buckets of a tile's size.
    """
    if not epochs:
        raise ValueError("an epoch is needed")
    size = tiles.agg(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0"))).first()
    sx, sy = max(size[0] or 1.0, 1e-12), max(size[1] or 1.0, 1e-12)
    eps = 1e-9
    step = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    cells = tiles.select("tile", "x0", "y0", "x1", "y1", step.alias("_k")).withColumns({"_w": (F.col("x1") - F.col("x0")) / side, "_h": (F.col("y1") - F.col("y0")) / side})
    cells = cells.withColumns({"cx": F.col("x0") + F.col("_k") % side * F.col("_w"), "cy": F.col("y0") + F.floor(F.col("_k") / side) * F.col("_h")})
    spots = [(0.5, 0.5), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)] if union else [(0.5, 0.5)]
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (F.col("cx") + a * F.col("_w")).alias("x"), (F.col("cy") + b * F.col("_h")).alias("y")) for n, (a, b) in enumerate(spots)]))
    asked = cells.select("tile", "_k", "cx", "cy", "_w", "_h", asked.alias("_p")).select("tile", "_k", "cx", "cy", "_w", "_h", F.col("_p.n").alias("_n"), F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    bucket = lambda c, s: F.floor(c / s).cast("long")
    asked = asked.withColumns({"_bx": bucket(F.col("_x"), sx), "_by": bucket(F.col("_y"), sy)})
    wanted = boxes.where(F.col("epoch").isin(*epochs)).select("epoch", F.col("x0").alias("fx0"), F.col("y0").alias("fy0"), F.col("x1").alias("fx1"), F.col("y1").alias("fy1"))
    dealt = wanted.withColumn("_bx", F.explode(F.sequence(bucket(F.col("fx0") - eps, sx), bucket(F.col("fx1") + eps, sx)))).withColumn("_by", F.explode(F.sequence(bucket(F.col("fy0") - eps, sy), bucket(F.col("fy1") + eps, sy))))
    if union:
        inside = (F.col("_x") >= F.col("fx0") - eps) & (F.col("_x") <= F.col("fx1") + eps) & (F.col("_y") >= F.col("fy0") - eps) & (F.col("_y") <= F.col("fy1") + eps)
    else:
        inside = (F.col("cx") >= F.col("fx0") - eps) & (F.col("cy") >= F.col("fy0") - eps) & (F.col("cx") + F.col("_w") <= F.col("fx1") + eps) & (F.col("cy") + F.col("_h") <= F.col("fy1") + eps)
    hits = asked.join(dealt, ["_bx", "_by"]).where(inside).select("tile", "_k", "_n", "epoch").distinct()
    full = hits.groupBy("tile").agg(F.count("*").alias("n")).where(F.col("n") == side * side * len(spots) * len(set(epochs)))
    return tiles.join(full.select("tile"), "tile", "left_semi")


def whole_tiles(lattice: DataFrame) -> DataFrame:
    """Tiles of the full size; those clipped by the box's edge go."""
    size = lattice.agg(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0"))).first()
    return lattice.where((F.col("x1") - F.col("x0") > size[0] * (1 - 1e-6)) & (F.col("y1") - F.col("y0") > size[1] * (1 - 1e-6)))


def calibration_tiles(spark: SparkSession, settings: Mapping, boxes: DataFrame) -> DataFrame:
    """Tiles of the search box that both epochs of the calibration pair supply in full."""
    tiers = settings["tiers"]
    lattice = jobs.tile_lattice(spark, search_box(settings), float(tiers["sample_tile_size_m"]))
    return covered_tiles(whole_tiles(lattice), boxes, settings["noise_floor"]["epoch_pair"], int(tiers["coverage_cells_per_tile"]))


def change_tiles(spark: SparkSession, settings: Mapping, study: Box, boxes: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Tiles of the study box that both epochs of a change pair supply in full, files of one epoch taken together."""
    own = settings["change"]
    lattice = jobs.tile_lattice(spark, study, float(own["tile_size_m"]))
    return covered_tiles(whole_tiles(lattice), boxes, pair, int(own.get("coverage_cells_per_tile", 10)), union=True)


def drawn_tiles(candidates: DataFrame, count: int, seed: int) -> DataFrame:
    """A sample of tiles spread over the candidates' extent by a coarse grid; all of them if there are no more."""
    extent = candidates.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.count("*")).first()
    if not extent[4] or count < 1:
        return candidates.limit(0)
    side = geometry.dispersion_side(count)
    middle = text.spatial_stratum((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, tuple(extent[:4]), side, side)
    return sampling.stratified_sample(candidates.withColumn("_stratum", middle), "_stratum", "tile", count, seed).drop("_stratum")


def readers(tiles: DataFrame, boxes: DataFrame, resources: Mapping[str, Sequence[str]], settings: Mapping) -> DataFrame:
    """(tile, readers): for each tile what to read of each epoch: its resources with a file over the tile, and what makes its heights metres."""
    known = boxes.select("epoch", "resource", "x0", "y0", "x1", "y1").where(F.col("epoch").isin(*resources))
    size = tiles.agg(F.max(F.col("x1") - F.col("x0"))).first()[0] or 1.0
    named = known.select(F.concat_ws("|", "epoch", "resource").alias("resource"), F.col("x0").alias("fx0"), F.col("y0").alias("fy0"), F.col("x1").alias("fx1"), F.col("y1").alias("fy1"))
    t = tiles.select("tile", F.col("x0").alias("tx0"), F.col("y0").alias("ty0"), F.col("x1").alias("tx1"), F.col("y1").alias("ty1"))
    found = joins.tile_resources(t, named, float(size)).select("tile", F.explode("resources").alias("r")).withColumns({"epoch": F.substring_index("r", "|", 1), "resource": F.substring_index("r", "|", -1)})
    factor = F.create_map(*[v for e in resources for v in (F.lit(e), F.lit(z_factor(settings, e)))])
    per = found.groupBy("tile", "epoch").agg(F.array_sort(F.collect_set("resource")).alias("resources")).withColumn("z_to_metres", factor[F.col("epoch")])
    return per.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("epoch", "resources", "z_to_metres"))).alias("readers"))


def _planned(tiles: DataFrame, boxes: DataFrame, resources: Mapping, settings: Mapping, snap: float | None) -> DataFrame:
    grids = geometry.tile_grids(tiles, ["tile"], settings["harmonization"]["target_crs"], float(settings["chm"]["resolution_m"]), snap).drop("x0", "y0", "x1", "y1")
    return tiles.join(grids, "tile").join(readers(tiles, boxes, resources, settings), "tile", "left").withColumn("radius_m", F.lit(sample_radius(settings)))


def calibration_plan(spark: SparkSession, settings: Mapping, boxes: DataFrame, count: int, seed: int | None = None) -> DataFrame:
    """One row a tile to build for the calibration pair: box, grid, readers and thinning radius."""
    pair = settings["noise_floor"]["epoch_pair"]
    resources = epoch_resources(settings, pair)
    if several := [e for e, r in resources.items() if len(r) != 1]:
        raise ValueError(f"calibration epochs must have one resource: {', '.join(several)}")
    candidates = calibration_tiles(spark, settings, boxes)
    chosen = drawn_tiles(candidates, count, int(settings["tiers"]["seed"]) if seed is None else seed)
    return _planned(chosen, boxes, resources, settings, None)


def corridor_tiles(candidates: DataFrame, lines: DataFrame, buffer_m: float, code: int | str) -> DataFrame:
    """Candidates within the buffer of a line (line, points: longitude and latitude), erring towards inclusion.

    Lines become points at half the buffer; tiles and points meet in buckets of a tile and its buffer.
    """
    if buffer_m <= 0:
        raise ValueError("the buffer must be positive")
    dots = catalogues.densified(lines, buffer_m / 2 / maths.METRES_PER_DEGREE).select("x", "y")
    dots = placed(dots, frame(code), "x", "y", ("_px", "_py")).select("_px", "_py")
    flat = geometry.projected_boxes(candidates, ["tile"], code)
    size = (flat.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0) + 2 * buffer_m
    bucket = lambda c: F.floor(c / size).cast("long")
    spread = flat.withColumn("_bx", F.explode(F.sequence(bucket(F.col("x0") - buffer_m), bucket(F.col("x1") + buffer_m)))).withColumn("_by", F.explode(F.sequence(bucket(F.col("y0") - buffer_m), bucket(F.col("y1") + buffer_m))))
    near = (F.col("_px") >= F.col("x0") - buffer_m) & (F.col("_px") <= F.col("x1") + buffer_m) & (F.col("_py") >= F.col("y0") - buffer_m) & (F.col("_py") <= F.col("y1") + buffer_m)
    hit = dots.withColumns({"_bx": bucket(F.col("_px")), "_by": bucket(F.col("_py"))}).join(spread, ["_bx", "_by"]).where(near).select("tile").distinct()
    return candidates.join(hit, "tile", "left_semi")


def change_plan(spark: SparkSession, settings: Mapping, study: Box, pair: Sequence[str], boxes: DataFrame, count: int, seed: int | None = None, required: Sequence[int] = (), corridor: tuple[DataFrame, float] | None = None) -> DataFrame:
    """One row a tile to build for a change pair: the required ones and those near a corridor's lines are always built (``forced``), ``count`` more are drawn from the rest."""
    if len(pair) != 2 or pair[0] == pair[1]:
        raise ValueError("a pair names two epochs")
    resources = epoch_resources(settings, pair)
    candidates = change_tiles(spark, settings, study, boxes, pair)
    wanted = candidates.where(F.col("tile").isin(*[int(t) for t in required])) if required else candidates.limit(0)
    if corridor:
        wanted = wanted.unionByName(corridor_tiles(candidates, *corridor, settings["harmonization"]["target_crs"])).distinct()
    rest = candidates.join(wanted.select("tile"), "tile", "left_anti")
    drawn = drawn_tiles(rest, count, int(settings["tiers"]["seed"]) if seed is None else seed)
    both = wanted.withColumn("forced", F.lit(True)).unionByName(drawn.withColumn("forced", F.lit(False)))
    return _planned(both, boxes, resources, settings, settings["change"].get("grid_snap_m"))


def plan_summary(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: candidates and chosen tiles with their areas, and how many were forced."""
    area = lambda d: d.agg(F.count("*").alias("n"), F.coalesce(F.sum(maths.box_area_km2(*[F.col(c) for c in geometry.EDGES])), F.lit(0.0)).alias("km2"))
    a, b = area(candidates).toDF("candidate_tiles", "candidate_km2"), area(plan).toDF("tiles", "sample_km2")
    forced = plan.agg(F.count_if("forced").alias("forced_tiles")) if "forced" in plan.columns else plan.agg(F.lit(0).alias("forced_tiles"))
    return a.crossJoin(b).crossJoin(forced)  # a row each


# ---------------------------------------------------------------- built pairs


def pair_verdicts(cells: DataFrame, cells_per_tile: int, min_valid: float, min_ground: float = 0.0, ground: str = "ground", keys: Sequence[str] = ("tile",)) -> DataFrame:
    """(keys, valid, ground, admitted, reason): whether a tile's two surfaces (start, end) are complete enough to use."""
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    got = cells.groupBy(*keys).agg((F.count_if(both) / cells_per_tile).alias("valid"), (F.count_if(filters.sure(F.col(ground))) / cells_per_tile if ground in cells.columns else F.lit(1.0)).alias("ground"))
    reason = F.when(F.col("valid") < min_valid, "few valid cells").when(F.col("ground") < min_ground, "few ground cells")
    return got.withColumns({"admitted": reason.isNull(), "reason": reason})


def measured_noise(cells: DataFrame, factors: Sequence[int], cell_m: float, limits: Mapping[str, float], stable_limit: float, min_valid: float = 0.5, min_cells: int = 30, keys: Sequence[str] = ("tile",), **aligning) -> dict:
    """The calibration job on a pair's cells (start, end): shift, stable cells, noise by scale, and the gate."""
    shift = jobs.aligned(cells, cell_m, keys, **aligning)
    moved = raster.shifted(cells.select(*keys, "row", "col", F.col("end").alias("value")), shift["dx"], shift["dy"], cell_m, keys).withColumnRenamed("value", "end")
    both = cells.select(*keys, "row", "col", "start").join(moved, [*keys, "row", "col"]).withColumn("end", F.col("end") - shift["dz"])
    rungs = raster.ladder_difference(both.where(F.abs(F.col("end") - F.col("start")) <= stable_limit), "start", "end", factors, min_valid, keys).where("difference is not null")
    table = stats.noise_table(rungs.select((F.col("factor") * cell_m).alias("scale"), F.col("difference").alias("delta")), cell_m, min_cells).orderBy("scale")
    rows = [r.asDict() for r in table.collect()]  # a row a scale
    return {"shift": shift, "rows": rows, **stats.noise_gate(rows, shift, limits, cell_m)}


def coverage(points: DataFrame, settings: Mapping, cells_per_tile: int, cell_km2: float) -> dict[str, DataFrame]:
    """The coverage job on two epochs' points (epoch, tile, row, col, z, classification): cells, tiles with their verdicts, usable canopy by the pair's rules and with each rule moved."""
    point, pair = pair_rules(settings)
    cells = aggregates.with_height(aggregates.tile_stats(points, ["epoch", "tile", "row", "col"], point["ground_class"], point["dropped"]))
    order = sorted(r[0] for r in points.select("epoch").distinct().collect())  # two epochs
    if len(order) != 2:
        raise ValueError("a pair has two epochs")
    side = lambda e, n: cells.where(F.col("epoch") == e).select("tile", "row", "col", F.col("height").alias(n))
    both = side(order[0], "start").join(side(order[1], "end"), ["tile", "row", "col"], "full")
    verdicts = pair_verdicts(both, cells_per_tile, pair["min_cells"])
    good = both.join(verdicts.where("admitted").select("tile"), "tile", "left_semi")
    least = float(settings["pair_coverage"]["usable_canopy_min_km2"])
    return {"cells": both, "tiles": verdicts, "summary": jobs.pair_summary(good, pair, cell_km2, least), "sensitivity": jobs.sensitivity(good, pair, settings["pair_coverage"]["sensitivity"], cell_km2, least)}


# ---------------------------------------------------------------- lines and suspect labels


def epoch_flags(cells: DataFrame, epoch: str, cfg: Mapping) -> DataFrame:
    """Cells with isolated_, wire_like_ and eligible_ of an epoch: tall returns over low neighbours. Cells are keyed (col, row)."""
    top, upper = f"max_{epoch}", f"p95_{epoch}"
    spike = cfg["spike"]
    around = windows.neighbour_median(cells, top, int(spike["min_neighbours"]))
    isolated, wire = filters.spikes(F.col(top), F.col(upper), F.col("around"), spike["min_max_height_m"], spike["max_neighbour_median_m"], spike["wire_like_gap_m"])
    eligible = filters.sure(F.col(top).isNotNull() & F.col("around").isNotNull() & (F.col(f"valid_{epoch}") >= cfg["min_valid_fraction"]))
    return around.withColumns({f"eligible_{epoch}": eligible, f"isolated_{epoch}": eligible & filters.sure(isolated), f"wire_like_{epoch}": eligible & filters.sure(wire)}).drop("around")


def flagged_cells(labels: DataFrame, segments: DataFrame, cfg: Mapping) -> DataFrame:
    """Undisputed cells (cell_id, tile, x, y, ...) with both epochs' flags, the distance to the nearest segment (null beyond the control distance), and what is excluded near lines."""
    cells = labels.where(~filters.sure(F.col("overlap_disputed"))).withColumns({"col": F.floor(F.col("x") / cfg["cell_m"]).cast("long"), "row": F.floor(F.col("y") / cfg["cell_m"]).cast("long")})
    for e in ("start", "end"):
        cells = epoch_flags(cells, e, cfg)
    most = float(cfg["control_min_distance_m"])
    cells = cells.join(joins.line_distance(cells.select("cell_id", "x", "y"), segments, most, "cell_id"), "cell_id")
    near = filters.sure(F.col("distance") < cfg["bands_m"]["near"][1])
    suspect = near & (F.col("isolated_start") | F.col("isolated_end"))
    within = filters.sure(F.col("distance") < cfg["exclusion"]["within_line_m"])
    return cells.withColumns({"wire_suspect": suspect, "within_exclusion": within, "excluded": suspect | within})


def remaining_counts(flagged: DataFrame, disputed: int, cfg: Mapping) -> DataFrame:
    """One row: how many cells are flagged, and how many remain for mean labels and for maximum and 95th-percentile labels."""
    canopy = filters.sure(F.col("mean_start") >= cfg["exclusion"]["modelling_min_mean_start_m"])
    c = F.count_if
    return flagged.agg(
        F.count("*").alias("analysed_cells"), F.lit(disputed).alias("disputed_removed"), c("wire_suspect").alias("wire_suspect"), c("within_exclusion").alias("within_exclusion_distance"), c(F.col("wire_suspect") & F.col("within_exclusion")).alias("both"),
        c("excluded").alias("excluded_from_max_p95"), F.count("*").alias("remaining_for_mean_labels"), c(~F.col("excluded")).alias("remaining_for_max_p95"), c(canopy).alias("canopy_cells_before"), c(canopy & ~F.col("excluded")).alias("canopy_cells_remaining_for_max_p95"),
    )


def stratum(cfg: Mapping, epoch: str) -> Column:
    """Tile, bin of the canopy share (-1 where it is missing), and bin of the valid fraction."""
    bins = F.lit(0)
    for edge in cfg["valid_fraction_edges"]:
        bins = bins + F.when(F.col(f"valid_{epoch}") >= float(edge), 1).otherwise(0)
    return F.concat_ws("|", F.col("tile"), F.coalesce(F.floor(F.col("canopy_share") / cfg["canopy_share_bin"]), F.lit(-1)), bins)


def band_ratio(flagged: DataFrame, epoch: str, flag: str, band: tuple[float, float], cfg: Mapping, distance: str = "distance", leave_out: Column | None = None) -> dict:
    """Flags in a distance band against matched far cells of the same strata, with the interval over tiles. A missing distance is far."""
    rows = flagged.where(F.col(f"eligible_{epoch}") & (~leave_out if leave_out is not None else F.lit(True))).withColumn("_key", stratum(cfg, epoch))
    d = F.col(distance)
    near, control = filters.sure((d >= band[0]) & (d < band[1])), d.isNull() | (d > cfg["control_min_distance_m"])
    strata = aggregates.expected_counts(rows, "_key", F.col(f"{flag}_{epoch}"), near, control)
    by = strata.withColumn("tile", F.substring_index("_key", "|", 1)).groupBy("tile").agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected")).orderBy("tile").toPandas()  # a row a tile
    n = rows.agg(F.count_if(near).alias("near_cells"), F.count_if(control).alias("control_cells")).first().asDict()
    if by.expected.sum() <= 0:
        return n | {"observed": float(by.observed.sum()), "expected": 0.0, "ratio": None, "ci_low": None, "ci_high": None}
    ratio, low, high = stats.ratio_interval(by, int(cfg["bootstrap_reps"]), float(cfg["pass_rule"]["confidence"]), int(cfg["seed"]))
    return n | {"observed": float(by.observed.sum()), "expected": float(by.expected.sum()), "ratio": ratio, "ci_low": low, "ci_high": high}


def line_check(flagged: DataFrame, cfg: Mapping) -> dict:
    """The check of flags near lines: per epoch, totals, the ratio of each band and flag, and the rate by distance."""
    out: dict = {"proposed_mask_cells": flagged.where("wire_suspect").count()}
    for e in ("start", "end"):
        totals = flagged.agg(*[F.count_if(f"{n}_{e}").alias(n) for n in ("eligible", "isolated", "wire_like")]).first().asDict()
        own = flagged.where(F.col(f"eligible_{e}"))
        out[e] = totals | {
            "bands": {name: {flag: band_ratio(flagged, e, flag, tuple(band), cfg) for flag in ("isolated", "wire_like")} for name, band in cfg["bands_m"].items()},
            "profile": aggregates.distance_profile(own, F.col(f"isolated_{e}"), F.col("distance"), cfg["profile_edges_m"]).orderBy("low").collect(),
        }
    return out


def line_verification(flagged: DataFrame, segments: DataFrame, cfg: Mapping) -> dict:
    """The same ratios for the real lines and for lines moved sideways, with cells near the real ones left out, and how flags persist between epochs."""
    near_band = tuple(cfg["bands_m"]["near"])
    ratios = lambda df, **kw: {e: {f: band_ratio(df, e, f, near_band, cfg, **kw) for f in ("isolated", "wire_like")} for e in ("start", "end")}
    out: dict = {"real": ratios(flagged), "placebo": []}
    leave = filters.sure(F.col("distance") < cfg["verify"]["placebo_exclude_within_m"])
    for dx, dy in cfg["verify"]["placebo_shifts_m"]:
        moved = segments.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy})
        far = joins.line_distance(flagged.select("cell_id", "x", "y"), moved, float(cfg["control_min_distance_m"]), "cell_id").withColumnRenamed("distance", "moved_distance")
        out["placebo"].append({"shift_m": (dx, dy), **ratios(flagged.join(far, "cell_id"), distance="moved_distance", leave_out=leave)})
    near = filters.sure(F.col("distance") < near_band[1])
    far_ = F.col("distance").isNull() | (F.col("distance") > cfg["control_min_distance_m"])
    for name, mask in (("persistence_near", near), ("persistence_far", far_)):
        out[name] = aggregates.persistence(flagged.where(mask), F.col("isolated_start"), F.col("isolated_end")).first().asDict()
    tall = {**cfg, "spike": {**cfg["spike"], "min_max_height_m": cfg["verify"]["sensitivity_min_height_m"]}}
    again = flagged.drop(*[f"{n}_{e}" for n in ("eligible", "isolated", "wire_like") for e in ("start", "end")])
    for e in ("start", "end"):
        again = epoch_flags(again, e, tall)
    return out | {"sensitivity": ratios(again)}


# ---------------------------------------------------------------- growth populations


def all_forest(settings: Mapping) -> Column:
    """Cells that pass the quality and line rules and are forest, whatever disturbed them since."""
    good = [F.col(c) for c in ("label_change_valid", "canopy_at_start", "vegetation_known", "loss_valid")]
    bad = [F.col(c) for c in ("overlap_disputed", "near_line", "p95_wire_excluded")]
    keep = F.col("broader_group").isin(*settings["forest_groups"]) & ~F.col("vegetation_type").isin(*settings["excluded_map_classes"])
    for c in good:
        keep = keep & c
    for c in bad:
        keep = keep & ~c
    return filters.sure(keep)


def _scored(rows: DataFrame, candidate: Column, reference: Column, end: str, settings: Mapping) -> dict:
    sums = stats.block_sums(rows, "block", candidate - F.col(end), reference - F.col(end))
    n = float(sums.n.sum())
    return {"candidate_mae": float(sums.a.sum()) / n, "reference_mae": float(sums.b.sum()) / n, "candidate_minus_reference": stats.mae_interval(sums, int(settings["bootstrap_draws"]), seed=int(settings["seed"]))}


def forest_check(df: DataFrame, settings: Mapping, kind: str = "model_group", group: str = "broader_group", start: str = "start", end: str = "end") -> dict:
    """After the gate: the cross-fitted median prior against no change on one forest population by block size, and two squared-error baselines against the median."""
    by_size, folds = {}, int(settings["folds"])
    for size in settings["block_sizes_m"]:
        rows = models.fold_prior(jobs.folded(df, float(size), folds, int(settings["seed"])), "fold", folds, kind, group, start, end, int(settings["min_fit_cells"]))
        by_size[size] = {"cells": rows.count(), "blocks": rows.select("block").distinct().count(), **_scored(rows, F.col("predicted"), F.col(start), end, settings)}
    rows = models.fold_prior(jobs.folded(df, float(settings["primary_block_m"]), folds, int(settings["seed"])), "fold", folds, kind, group, start, end, int(settings["min_fit_cells"]))
    # the mean residual of the median prior over the folds that a fold trains on, each row's prior being that fold's own
    train = models.training_prior(rows.drop("predicted"), "fold", folds, kind, group, start, end, int(settings["min_fit_cells"]))
    offsets = train.groupBy("_f").agg(F.avg(F.col(end) - F.col(start) - F.col("_increment")).alias("_offset"))
    shifted = rows.join(offsets.withColumnRenamed("_f", "fold"), "fold").withColumn("intercept", F.col("predicted") + F.col("_offset"))
    mean = models.fold_prior(rows.withColumnRenamed("predicted", "median"), "fold", folds, kind, group, start, end, int(settings["min_fit_cells"]), statistic="mean")
    return {
        "blocks": by_size, "offsets": {r[0]: r[1] for r in offsets.orderBy("_f").collect()},  # a row a fold
        "intercept_only": _scored(shifted, F.col("intercept"), F.col("predicted"), end, settings), "type_mean": _scored(mean, F.col("predicted"), F.col("median"), end, settings),
    }


def check_fit_permission(settings: Mapping, ceilings: Mapping[str, float | None]) -> None:
    """Before a fit: every class has a published ceiling, its source is confirmed, and the spot check is complete and signed for what it is."""
    import re

    if missing := sorted(k for k, v in ceilings.items() if v is None):
        raise ValueError(f"no confirmed ceiling for {', '.join(missing)}")
    if not settings.get("source_review_confirmed"):
        raise ValueError("the table of heights isn't confirmed")
    check = settings.get("reviewer_spot_check") or {}
    if lacking := [k for k in ("reviewer", "reviewer_type", "session", "review_window_utc", "commit", "scope", "independence_limit", "human_review") if not check.get(k)]:
        raise ValueError(f"the spot check lacks {', '.join(lacking)}")
    if check["reviewer_type"] not in ("ai", "human") or not re.fullmatch("[0-9a-f]{40}", check["commit"]):
        raise ValueError("the spot check needs a known type and a whole commit")
    if check["reviewer_type"] == "ai" and check["human_review"] != "pending":
        raise ValueError("an automatic spot check leaves the human one pending")


def growth_preflight(df: DataFrame, screens: Mapping[str, str], ceilings: Mapping[str, float], kind: str = "model_group", start: str = "start") -> dict[str, DataFrame]:
    """What a growth fit would see, without fitting: cells of each screen (a SQL condition), and the share of each class at its ceiling."""
    counts = df.agg(F.count("*").alias("cells"), *[F.count_if(filters.sure(F.expr(c))).alias(name) for name, c in screens.items()])
    return {"screens": counts, "saturation": aggregates.saturation(df, kind, start, ceilings)}


# ---------------------------------------------------------------- products of others


def check_bands(stack: DataFrame, years: Sequence[int], nodata: float, declared_nodata: float, year: str = "year") -> None:
    """An error unless the product holds the years that settings list and declares the missing value that they do."""
    found = sorted(r[0] for r in stack.select(year).distinct().collect())  # a row a band
    if len(found) != len(years):
        raise ValueError(f"{len(found)} bands where settings list {len(years)}")
    if declared_nodata != nodata and not (math.isnan(nodata) and math.isnan(declared_nodata)):
        raise ValueError("the product's missing value isn't the one in settings")


def product_report(stack: DataFrame, settings: Mapping, pixel_area_m2: float, pixel: str = "pixel", year: str = "year", value: str = "value") -> dict:
    """Usable pixels of each checked year, abrupt changes between years, and checked years that the product lacks."""
    years = list(settings["band_years"])
    usable = F.when(F.col(value) != float(settings["nodata_value"]), F.col(value) * float(settings["height_scale_to_m"]))
    rows = stack.withColumn(value, usable)
    return {
        "years_missing_from_product": sorted(set(settings["check_years"]) - set(years)),
        "per_year": aggregates.valid_by_year(rows.where(F.col(year).isin(*settings["check_years"])), pixel_area_m2, year, value),
        "abrupt_changes": aggregates.abrupt_changes(rows, pixel, float(settings["abrupt_change_m"]), year, value),
    }

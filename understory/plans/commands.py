"""Jobs by name: each reads tables of a folder, runs with a settings file, and writes tables and records with their provenance.

    python -m understory COMMAND --tables FOLDER --settings FILE --out FOLDER
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from understory.functions import text
from understory.operators import aggregates, geometry, joins, raster, sampling, surfaces, windows
from understory.plans import jobs, planning
from understory.sources import catalogues, files

Tables = Mapping[str, DataFrame]
Results = dict[str, "DataFrame | dict"]


@dataclass(frozen=True)
class Command:
    #: Tables that it reads, and keys that its settings must have.
    tables: tuple[str, ...]
    settings: tuple[str, ...]
    work: Callable[[SparkSession, Mapping, Tables], Results]


COMMANDS: dict[str, Command] = {}


def command(*tables: str, settings: tuple[str, ...] = ()):
    def add(f):
        COMMANDS[f.__name__.replace("_", "-")] = Command(tables, settings, f)
        return f

    return add


# ---------------------------------------------------------------- sources


@command("pages", settings=("sentinel2",))
def list_scenes(spark, cfg, t):
    """Scenes of a catalogue's result pages."""
    own = cfg["sentinel2"]
    return {"scenes": catalogues.scenes(t["pages"], own["assets"], own["max_cloud"], own["tile_code"])}


@command("documents")
def list_footprints(spark, cfg, t):
    """Delivered boxes of manifests (resource, json)."""
    return {"boxes": catalogues.manifest_boxes(t["documents"])}


@command("documents")
def list_power_lines(spark, cfg, t):
    """Spans between supports of a map document."""
    return {"spans": catalogues.spans(catalogues.power_lines(t["documents"]))}


@command(settings=("epochs", "admission_screen"))
def screen_epochs(spark, cfg, t):
    """Which epochs pass the admission screen."""
    rows = [(e["name"], planning.admitted(e, cfg["admission_screen"])) for e in cfg["epochs"]]
    return {"epochs": spark.createDataFrame(rows, "name string, admitted boolean")}


# ---------------------------------------------------------------- plans and builds


@command("boxes", settings=("noise_floor", "tiers", "epochs", "tile_count"))
def plan_calibration(spark, cfg, t):
    return {"plan": planning.calibration_plan(spark, cfg, t["boxes"], int(cfg["tile_count"]))}


@command("boxes", settings=("change", "pair", "study_box", "tile_count"))
def plan_change(spark, cfg, t):
    lines = (catalogues.corridors(t["lines"]), float(cfg["change"]["corridor_buffer_m"])) if "lines" in t else None
    study = tuple(float(v) for v in cfg["study_box"])
    plan = planning.change_plan(spark, cfg, study, cfg["pair"], t["boxes"], int(cfg["tile_count"]), corridor=lines)
    return {"plan": plan, "summary": planning.plan_summary(plan, planning.change_tiles(spark, cfg, study, t["boxes"], cfg["pair"]))}


@command("points", "grids", settings=("surfaces",))
def build_surfaces(spark, cfg, t):
    """Terrain, top and pit-free canopy of each tile; ``plan_signature`` tells builds of other settings apart."""
    own = cfg["surfaces"]
    ready = surfaces.prepared(t["points"], t["grids"], own)
    low, high = own["clamp_m"]
    return {
        "terrain": surfaces.terrain_surfaces(ready, t["grids"], terrain=own.get("terrain", "idw")), "canopy": surfaces.canopy_layers(ready, t["grids"], own["thresholds_m"], low, high),
        "statistics": surfaces.dimension_stats(ready, ["z", "scan_angle"], ["tile"]), "record": {"plan_signature": jobs.signature(own)},
    }


@command("dem", settings=("terrain",))
def build_terrain(spark, cfg, t):
    """Slope, aspect and topographic position of an elevation table (tile, row, col, value)."""
    own = cfg["terrain"]
    graded = windows.slope_aspect(t["dem"], "value", float(own["cell_m"]), ["tile"])
    return {"terrain": graded, "position": raster.disk_difference(t["dem"], int(own["radius_cells"]), int(own.get("tile_cells", 256)), "value", ["tile"])}


# ---------------------------------------------------------------- pairs


@command("cells", settings=("cell_m",))
def align(spark, cfg, t):
    return {"shift": jobs.aligned(t["cells"], float(cfg["cell_m"]))}


@command("cells", settings=("cell_m", "noise"))
def noise_floor(spark, cfg, t):
    own = cfg["noise"]
    return {"gate": planning.measured_noise(t["cells"], own["factors"], float(cfg["cell_m"]), own["limits"], float(own["stable_limit_m"]))}


@command("cells", settings=("pair", "cell_km2"))
def change_summary(spark, cfg, t):
    own, km2 = cfg["pair"], float(cfg["cell_km2"])
    least = float(own["least_km2"])
    return {"summary": jobs.pair_summary(t["cells"], own, km2, least), "sensitivity": jobs.sensitivity(t["cells"], own, own["sensitivity"], km2, least), "targets": raster.cell_targets(t["cells"], int(own["target_factor"]), keys=["tile"])}


@command("points", settings=("pair_coverage", "change", "tiers", "cells_per_tile", "cell_km2"))
def pair_coverage(spark, cfg, t):
    return planning.coverage(t["points"], cfg, int(cfg["cells_per_tile"]), float(cfg["cell_km2"]))


@command("first", "second", settings=("study_box", "target_crs", "buffers_km"))
def footprint_overlap(spark, cfg, t):
    return {"overlap": geometry.overlap_summary(t["first"], t["second"], tuple(float(v) for v in cfg["study_box"]), cfg["target_crs"], cfg["buffers_km"], float(cfg.get("step_degrees", 0.001)))}


@command("stack", settings=("band_years", "check_years", "nodata_value", "height_scale_to_m", "abrupt_change_m", "pixel_area_m2"))
def check_product(spark, cfg, t):
    planning.check_bands(t["stack"], cfg["band_years"], float(cfg["nodata_value"]), float(cfg["nodata_value"]))
    return planning.product_report(t["stack"], cfg, float(cfg["pixel_area_m2"]))


# ---------------------------------------------------------------- lines


def _flagged(cfg, t):
    return planning.flagged_cells(t["labels"], t["segments"], cfg)


@command("labels", "segments", settings=("spike", "bands_m", "exclusion"))
def check_lines(spark, cfg, t):
    return {"check": planning.line_check(_flagged(cfg, t), cfg)}


@command("labels", "segments", settings=("spike", "bands_m", "exclusion"))
def flag_lines(spark, cfg, t):
    got = _flagged(cfg, t)
    disputed = t["labels"].where("overlap_disputed").count()
    return {"flags": got.select("cell_id", "distance", "wire_suspect", "within_exclusion", "excluded"), "counts": planning.remaining_counts(got, disputed, cfg)}


@command("labels", "segments", settings=("spike", "bands_m", "verify"))
def verify_lines(spark, cfg, t):
    return {"verification": planning.line_verification(_flagged(cfg, t), t["segments"], cfg)}


@command("points")
def inspect_points(spark, cfg, t):
    return {"points": aggregates.point_summary(t["points"], ["tile", "row", "col"])}


# ---------------------------------------------------------------- vegetation and growth


@command("points", "edges", "classes", settings=("bucket_m", "pool_below"))
def join_vegetation(spark, cfg, t):
    hits = joins.lone_polygons(t["points"], t["edges"], float(cfg["bucket_m"]))
    return {"vegetation": joins.assigned_types(t["points"], hits, t["classes"], int(cfg["pool_below"]))}


@command("cells", settings=("screens", "block_m", "least"))
def growth_gate(spark, cfg, t):
    return {"gate": jobs.growth_gate(t["cells"], cfg["screens"], float(cfg["block_m"]), int(cfg["least"]))}


@command("cells", settings=("screens", "ceilings"))
def growth_preflight(spark, cfg, t):
    return planning.growth_preflight(t["cells"], cfg["screens"], cfg["ceilings"])


@command("cells", settings=("numeric", "categorical", "block_m", "least"))
def residual_gate(spark, cfg, t):
    return {"gate": jobs.residual_gate(t["cells"], cfg["numeric"], cfg["categorical"], float(cfg["block_m"]), int(cfg["least"]))}


@command("cells", settings=("folds", "seed", "block_sizes_m", "primary_block_m", "min_fit_cells", "bootstrap_draws"))
def forest_check(spark, cfg, t):
    return {"check": planning.forest_check(t["cells"], cfg)}


@command("cells", settings=("block_m", "folds"))
def assign_folds(spark, cfg, t):
    blocked = sampling.blocks(t["cells"], "x", "y", float(cfg["block_m"]))
    return {"folds": sampling.systematic_folds(blocked, "block", int(cfg["folds"]))}


# ---------------------------------------------------------------- housekeeping


@command(settings=("arrays",))
def estimate_storage(spark, cfg, t):
    rows = [(k, jobs.array_gib(v["shape"], int(v["item_bytes"]), int(v.get("copies", 1)))) for k, v in cfg["arrays"].items()]
    return {"storage": spark.createDataFrame(rows, "name string, gib double")}


@command("files")
def check_text(spark, cfg, t):
    """Disallowed characters of text files (path, text), by line."""
    return {"characters": text.disallowed_chars(t["files"], "text", "path")}


# ---------------------------------------------------------------- running


def run(spark: SparkSession, name: str, tables: str | None, settings: Mapping, out: str) -> dict[str, str]:
    """Run a command; returns the paths written. Tables are ``<folder>/<name>.parquet``; ``lines`` is read too where it is there."""
    if name not in COMMANDS:
        raise ValueError(f"no command {name}; there are {', '.join(sorted(COMMANDS))}")
    own = COMMANDS[name]
    jobs.require_keys(settings, own.settings)
    found = {n: spark.read.parquet(f"{tables}/{n}.parquet") for n in own.tables}
    if name == "plan-change" and "corridor_buffer_m" in settings["change"]:
        found["lines"] = spark.read.parquet(f"{tables}/lines.parquet")
    written = {}
    for part, result in own.work(spark, settings, found).items():
        path = f"{out.rstrip('/')}/{part}"
        if isinstance(result, DataFrame):
            written[part] = files.write(result, path, source=tables)
        else:
            shown = json.dumps(result, indent=1, default=lambda v: v.asDict() if hasattr(v, "asDict") else v.collect() if isinstance(v, DataFrame) else str(v))
            files.write_text(spark, path + ".json", shown)
            written[part] = path + ".json"
    return written


def main(argv: list[str] | None = None) -> int:
    import argparse

    parser = argparse.ArgumentParser(prog="understory", description="Run a job over tables.")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--tables", help="folder of Parquet tables")
    parser.add_argument("--settings", help="TOML or JSON file")
    parser.add_argument("--out", required=True)
    asked = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"understory-{asked.command}").getOrCreate()
    for part, path in run(spark, asked.command, asked.tables, files.settings(asked.settings) if asked.settings else {}, asked.out).items():
        print(part, path)
    return 0

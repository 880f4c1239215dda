import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from understory.operators import models, stats
from understory.plans import catalog, planning

SETTINGS = {
    "epochs": [
        {"name": "b", "start": "2018-06-01", "datasets": ["r2", "r3"], "nominal_density_pts_m2": 8.0, "geoid": "g18", "z_to_metres": 0.3048},
        {"name": "a", "start": "2013-07-01", "dataset": "r1", "nominal_density_pts_m2": 4.0, "geoid": "g18"},
        {"name": "winter", "start": "2014-01-01", "dataset": "r9", "nominal_density_pts_m2": 2.5, "geoid": "g18"},
    ],
    "admission_screen": {"min_density_pts_m2": 2.0, "leaf_on_months": [5, 6, 7, 8, 9]},
    "noise_floor": {"epoch_pair": ["a", "c"], "search_box": [-122.5, 38.0, -122.46, 38.03]},
    "tiers": {"sample_tile_size_m": 500, "coverage_cells_per_tile": 4, "seed": 42, "slope_bands_deg": [[0, 10], [10, 30]]},
    "change": {"tile_size_m": 500, "coverage_cells_per_tile": 4, "grid_snap_m": 10, "canopy_min_height_m": 2, "disturbance_limit_m": 3},
    "harmonization": {"target_crs": "EPSG:6339"},
    "chm": {"resolution_m": 1.0},
}
STUDY = (-122.5, 38.0, -122.46, 38.03)
BOXES = "epoch string, resource string, x0 double, y0 double, x1 double, y1 double"


def boxes(spark):
    """Epoch a is whole; b comes in two abutting halves and lacks the north."""
    return spark.createDataFrame([("a", "r1", -122.6, 37.9, -122.4, 38.1), ("b", "r2", -122.6, 37.9, -122.48, 38.02), ("b", "r3", -122.48, 37.9, -122.4, 38.02), ("c", "r4", -122.6, 37.9, -122.48, 38.1)], BOXES)


def test_settings_are_looked_up_and_checked():
    assert planning.search_box(SETTINGS) == STUDY
    assert planning.epoch_resources(SETTINGS, ["a", "b"]) == {"a": ["r1"], "b": ["r2", "r3"]}
    assert [e["name"] for e in planning.pair_epochs(SETTINGS, ("b", "a"))] == ["a", "b"]
    assert planning.z_factor(SETTINGS, "b") == 0.3048 and planning.z_factor(SETTINGS, "a") == 1.0
    assert planning.sample_radius(SETTINGS) == pytest.approx(math.sqrt(0.70 / 4))  # the winter epoch isn't admitted
    for bad in (lambda: planning.search_box({}), lambda: planning.epoch_resources(SETTINGS, ["x"]), lambda: planning.pair_epochs(SETTINGS, ("a", "a")), lambda: planning.z_factor(SETTINGS, "x"), lambda: planning.pair_rules({})):
        with pytest.raises(ValueError):
            bad()


def test_change_tiles_need_both_epochs_whole(spark):
    got = planning.change_tiles(spark, SETTINGS, STUDY, boxes(spark), ("a", "b")).toPandas()
    assert len(got) and (got.y1 <= 38.02 + 1e-9).all()
    assert ((got.x0 < -122.48) & (got.x1 > -122.48)).any()  # a tile across the two files of b
    one_box = planning.covered_tiles(planning.whole_tiles(planning.jobs.tile_lattice(spark, STUDY, 500)), boxes(spark), ["a", "b"], 4).toPandas()
    assert set(one_box.tile) < set(got.tile)  # cells across the seam lie in no single file
    assert planning.covered_tiles(planning.jobs.tile_lattice(spark, STUDY, 500), boxes(spark), ["a", "none"], 4).count() == 0


def test_change_plan_forces_required_and_corridor_tiles(spark):
    candidates = planning.change_tiles(spark, SETTINGS, STUDY, boxes(spark), ("a", "b"))
    all_ = candidates.toPandas().set_index("tile")
    required = int(all_.index.max())
    lines = spark.createDataFrame([(1, [[-122.499, 38.001], [-122.49, 38.001]])], "line int, points array<array<double>>")
    plan = planning.change_plan(spark, SETTINGS, STUDY, ("a", "b"), boxes(spark), 4, required=[required], corridor=(lines, 50.0)).toPandas().set_index("tile")
    forced = set(plan.index[plan.forced])
    near = {t for t, r in all_.iterrows() if r.y0 < 38.0015 and r.x0 < -122.489}
    assert required in forced and near <= forced and len(plan) == len(forced) + 4 and plan.index.is_unique
    row = plan.loc[required]
    assert row.origin_x % 10 == 0 and row.width % 10 == 0 and row.radius_m == pytest.approx(math.sqrt(0.175))
    read = {r.epoch: (list(r.resources), r.z_to_metres) for r in row.readers}
    assert read["a"] == (["r1"], 1.0) and set(read["b"][0]) <= {"r2", "r3"} and read["b"][1] == 0.3048
    again = planning.change_plan(spark, SETTINGS, STUDY, ("a", "b"), boxes(spark), 4, required=[required], corridor=(lines, 50.0))
    assert set(again.toPandas().tile) == set(plan.index)
    s = planning.plan_summary(again, candidates).first()
    assert (s.candidate_tiles, s.tiles, s.forced_tiles) == (len(all_), len(plan), len(forced)) and s.sample_km2 < s.candidate_km2
    with pytest.raises(ValueError):
        planning.corridor_tiles(candidates, lines, 0, 6339)


def test_calibration_plan(spark):
    own = {**SETTINGS, "epochs": [*SETTINGS["epochs"], {"name": "c", "start": "2014-07-01", "dataset": "r4", "nominal_density_pts_m2": 5.0, "geoid": "g18"}]}
    got = planning.calibration_plan(spark, own, boxes(spark), 5).toPandas()
    assert len(got) == 5 and (got.x1 <= -122.48 + 1e-9).all() and all(len(r) == 2 for r in got.readers)
    with pytest.raises(ValueError):  # b has two resources
        planning.calibration_plan(spark, {**own, "noise_floor": {**own["noise_floor"], "epoch_pair": ["a", "b"]}}, boxes(spark), 5)


# ---------------------------------------------------------------- gate and interval


def rows(*sigmas, n=5000, mean=0.02):
    return [{"scale": 10 * 2**k, "n": n, "mean": mean, "nmad": s, "lod95": 1.96 * s, "admitted": True, "decay": 0.1, "base_sigma": sigmas[0]} for k, s in enumerate(sigmas)]


LIMITS = {"max_mean": 0.1, "max_shift": 0.5, "reference_scale": 40, "max_reference": 0.15}


def test_noise_gate_checks():
    shift = {"converged": True, "magnitude": 0.137}
    good = stats.noise_gate(rows(0.12, 0.11, 0.1), shift, LIMITS, 10)
    assert good["passed"] and good["reference_source"] == "measured" and good["reference_noise"] == 0.1
    fails = lambda r, s=shift, **k: [c for c, ok in stats.noise_gate(r, s, {**LIMITS, **k}, 10)["checks"].items() if not ok]
    assert fails(rows(0.12, 0.11, 0.1, mean=0.2)) == ["mean_in_range"] and fails(rows(0.12, 0.11, 0.1, mean=-0.3)) == ["mean_in_range"]
    assert fails(rows(0.12, 0.13, 0.1)) == ["noise_falls_with_scale"] and fails(rows(0.12, 0.1201, 0.1)) == []  # within two standard errors
    assert fails(rows(0.12, 0.11, 0.1), {"converged": False, "magnitude": 0.1}) == ["alignment_converged"]
    assert fails(rows(0.12, 0.11, 0.1), {"converged": True, "magnitude": 0.6}) == ["shift_below_limit"]
    assert fails(rows(0.12, 0.11, 0.1), max_reference=0.1) == ["reference_noise_below_limit"]
    assert fails(rows(0.12, 0.11)) == ["reference_noise_below_limit", "reference_noise_available"]
    far = stats.noise_gate(rows(0.12, 0.11, 0.1), shift, {**LIMITS, "reference_scale": 160}, 10)
    assert far["reference_source"] == "extrapolated" and far["reference_noise"] == pytest.approx(0.12 * 256**-0.1)
    with pytest.raises(ValueError):
        stats.noise_gate([{**r, "admitted": False} for r in rows(0.1)], shift, LIMITS, 10)


def test_measured_noise_passes_on_planted_noise(spark):
    r = np.random.default_rng(0)
    i, j = np.mgrid[0:64, 0:64]
    h = 40 * np.sin(i / 7) + 30 * np.cos(j / 6)
    cells = spark.createDataFrame(pd.DataFrame({"tile": 0, "row": i.ravel(), "col": j.ravel(), "start": h.ravel(), "end": (h + r.normal(0, 0.1, h.shape)).ravel()}))
    got = planning.measured_noise(cells, (1, 2, 4), 10, {**LIMITS, "max_reference": 0.2}, 3, slopes=(5, 88))
    assert got["passed"], got


def test_interval_counts_strictly_smaller_replicates():
    reps = np.array([0.0] * 50 + [1.0] * 50)
    low, high = stats.bca_interval(0.0, reps, np.zeros(4))  # none is smaller: the percentile interval
    assert (low, high) == (0.0, 1.0)
    reps, flat = np.linspace(0, 1, 1001), np.ones(5)
    z = lambda p: stats._normal_quantile(p)
    low, high = stats.bca_interval(0.3, reps, flat)  # no spread: bias correction without acceleration
    assert low == pytest.approx(stats._normal_cdf(2 * z(300 / 1001) + z(0.025)), abs=2e-3) and high == pytest.approx(stats._normal_cdf(2 * z(300 / 1001) + z(0.975)), abs=2e-3)


# ---------------------------------------------------------------- lines

LINE = {
    "cell_m": 10, "min_valid_fraction": 0.8, "spike": {"min_neighbours": 3, "min_max_height_m": 10, "max_neighbour_median_m": 4, "wire_like_gap_m": 5}, "bands_m": {"near": [0, 10], "wide": [10, 30]},
    "control_min_distance_m": 60, "exclusion": {"within_line_m": 10, "modelling_min_mean_start_m": 0.5}, "canopy_share_bin": 0.1, "valid_fraction_edges": [0.9], "bootstrap_reps": 200, "seed": 1,
    "pass_rule": {"confidence": 0.95}, "profile_edges_m": [0, 10, 30, 60], "verify": {"placebo_exclude_within_m": 20, "placebo_shifts_m": [[0, 150]], "sensitivity_min_height_m": 20},
}


def lined(spark):
    """Low cells with a line along y = 105; spikes sit on it far more often than elsewhere."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(40):
        for j in range(40):
            on = i == 10 and j % 4 == 0
            top = 25.0 if on or r.random() < 0.004 and i > 20 else 1.0
            rows.append((i * 1000 + j, j // 10, j * 10 + 5.0, i * 10 + 5.0, 1.0, 1.0, top, top, 1.0, 1.0, 1.0, 0.05, (i, j) == (30, 30)))
    cells = spark.createDataFrame(rows, "cell_id long, tile int, x double, y double, valid_start double, valid_end double, max_start double, max_end double, p95_start double, p95_end double, mean_start double, canopy_share double, overlap_disputed boolean")
    return cells, spark.createDataFrame([(0.0, 105.0, 400.0, 105.0)], "x1 double, y1 double, x2 double, y2 double")


def test_line_check_finds_planted_spikes(spark):
    cells, line = lined(spark)
    got = planning.flagged_cells(cells, line, LINE).cache()
    assert got.count() == 1599  # the disputed cell is gone
    on = got.where("cell_id div 1000 = 10 and cell_id % 4 = 0").toPandas()
    assert on.wire_suspect.all() and on.excluded.all() and on.wire_like_start.all() and (on.distance < 1).all()
    out = planning.line_check(got, LINE)
    near = out["start"]["bands"]["near"]["isolated"]
    assert near["near_cells"] == 40 and near["observed"] == 10 and near["ratio"] > 5 and near["ci_low"] > 1
    assert out["proposed_mask_cells"] == 10 and out["start"]["profile"][0].rate == pytest.approx(10 / 40)
    counts = planning.remaining_counts(got, 1, LINE).first()
    assert (counts.analysed_cells, counts.wire_suspect, counts.both, counts.remaining_for_max_p95) == (1599, 10, 10, 1599 - 40)
    check = planning.line_verification(got, line, LINE)
    placebo = check["placebo"][0]["start"]["isolated"]
    assert placebo["ratio"] is None or placebo["ratio"] < near["ratio"] / 2
    assert check["persistence_near"] == {"first": 10, "second": 10, "both": 10, "only_first": 0, "only_second": 0}
    assert check["sensitivity"]["start"]["isolated"]["observed"] == 10


# ---------------------------------------------------------------- growth


def test_forest_mask(spark):
    names = ["overlap_disputed", "label_change_valid", "canopy_at_start", "vegetation_known", "loss_valid", "near_line", "p95_wire_excluded", "burned"]
    good = [False, True, True, True, True, False, False, False]
    rows_ = [(1, "oak", "hardwood forest", *good), (2, "oak", "hardwood forest", *good[:-1], True), (3, "oak", "hardwood forest", True, *good[1:]), (4, "oak", "hardwood forest", *good[:6], True, False), (5, "urban", "hardwood forest", *good), (6, "oak", "grass", *good), (7, "oak", "hardwood forest", None, *good[1:])]
    df = spark.createDataFrame(rows_, "id int, vegetation_type string, broader_group string, " + ", ".join(f"{n} boolean" for n in names))
    keep = planning.all_forest({"forest_groups": ["hardwood forest"], "excluded_map_classes": ["urban"]})
    assert sorted(r.id for r in df.where(keep).collect()) == [1, 2]  # disturbed stays


def test_forest_check_against_numpy(spark):
    r = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"x": r.random(n) * 3000, "y": r.random(n) * 3000, "model_group": r.choice(["oak", "fir"], n), "broader_group": "forest", "start": r.uniform(2, 30, n)})
    pdf["end"] = pdf.start + np.where(pdf.model_group == "oak", 3, 1) + r.exponential(1.0, n)
    settings = {"folds": 4, "seed": 42, "min_fit_cells": 20, "block_sizes_m": [500, 1000], "primary_block_m": 500, "bootstrap_draws": 200}
    df = spark.createDataFrame(pdf)
    got = planning.forest_check(df, settings)
    own = planning.jobs.folded(df, 500.0, 4, 42).toPandas()
    growth, candidate, shifted, mean = own.end - own.start, np.zeros(n), np.zeros(n), np.zeros(n)
    for f in range(4):
        train, test = (own.fold != f).to_numpy(), (own.fold == f).to_numpy()
        med = own.model_group.map(growth[train].groupby(own.model_group[train]).median()).to_numpy()
        offset = (growth[train] - med[train]).mean()
        candidate[test], shifted[test], mean[test] = med[test], med[test] + offset, own.model_group.map(growth[train].groupby(own.model_group[train]).mean()).to_numpy()[test]
        assert got["offsets"][f] == pytest.approx(offset)
    mae = lambda p: np.abs(p - growth).mean()
    assert got["blocks"][500]["candidate_mae"] == pytest.approx(mae(candidate)) and got["blocks"][500]["cells"] == n
    assert got["intercept_only"]["candidate_mae"] == pytest.approx(mae(shifted)) and got["type_mean"]["candidate_mae"] == pytest.approx(mae(mean))
    assert models.gate_decision({"a": got["blocks"][500]["candidate_minus_reference"]["ci_high"]}) == "PASS"


def test_fit_needs_permission():
    check = {k: "x" for k in ("reviewer", "session", "review_window_utc", "scope", "independence_limit")} | {"reviewer_type": "ai", "commit": "a" * 40, "human_review": "pending"}
    planning.check_fit_permission({"source_review_confirmed": True, "reviewer_spot_check": check}, {"oak": 30.0})
    for settings, tops in (({"source_review_confirmed": True, "reviewer_spot_check": check}, {"oak": None}), ({"reviewer_spot_check": check}, {}), ({"source_review_confirmed": True, "reviewer_spot_check": {**check, "commit": "abc"}}, {}), ({"source_review_confirmed": True, "reviewer_spot_check": {**check, "human_review": "done"}}, {}), ({"source_review_confirmed": True}, {})):
        with pytest.raises(ValueError):
            planning.check_fit_permission(settings, tops)


def test_preflight_and_product_report(spark):
    df = spark.createDataFrame([("oak", 31.0, True), ("oak", 3.0, None), ("fir", 5.0, False)], "model_group string, start double, ok boolean")
    got = planning.growth_preflight(df, {"ok": "ok"}, {"oak": 30.0})
    assert got["screens"].first().asDict() == {"cells": 3, "ok": 1}
    assert {r.model_group: r.saturated for r in got["saturation"].collect()} == {"oak": 1, "fir": None}
    stack = spark.createDataFrame([(1, 2019, 100.0), (1, 2020, 400.0), (2, 2019, -1.0), (2, 2020, 50.0)], "pixel int, year int, value double")
    report = planning.product_report(stack, {"band_years": [2019, 2020], "check_years": [2020, 2021], "nodata_value": -1, "height_scale_to_m": 0.1, "abrupt_change_m": 5}, 100.0)
    assert report["years_missing_from_product"] == [2021] and {r.year: r.valid for r in report["per_year"].collect()} == {2020: 2}
    planning.check_bands(stack, [2019, 2020], -1, -1)
    for bad in (([2019], -1, -1), ([2019, 2020], -1, 0)):
        with pytest.raises(ValueError):
            planning.check_bands(stack, *bad)


def test_coverage_of_two_epochs(spark):
    rows_ = [(e, 0, i, j, z, c) for e, top in (("2018", 110.0), ("2023", 112.0)) for i in range(5) for j in range(5) for z, c in ((100.0, 2), (top, 5))]
    points = spark.createDataFrame(rows_, "epoch string, tile int, row int, col int, z double, classification int")
    own = {**SETTINGS, "pair_coverage": {"min_cell_fraction": 0.5, "min_ground_fraction": 0.0, "noise_classes": [7], "water_class": 9, "ground_class": 2, "excluded_flag_bits": 0, "canopy_cell_m": 10, "canopy_height_classes_m": [0, 2], "usable_canopy_min_km2": 0.001, "sensitivity": {"canopy_min": [11.5]}}}
    got = planning.coverage(points, own, 25, 1e-4)
    s = got["summary"].first()
    assert s.median == pytest.approx(2.0) and s.canopy_km2 == pytest.approx(25e-4) and s.go
    assert got["tiles"].first().admitted and got["sensitivity"].first().usable_km2 == 0.0


def test_objective_query_gives_one_row(spark):
    assert catalog.QUERIES["pln_forest_check"](spark, "/root/testdata/sf0.001").count() == 1

"""Operators on small inputs with known answers: planted truths, edges of definitions, missing values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from understory.functions import maths, text
from understory.operators import aggregates, filters, joins, models, raster, sampling, sets, stats, windows
from understory.sources import catalogues, files


def one(df):
    return df.first().asDict()


def test_unique_labels_prefers_coverage_then_tile_and_marks_disputes(spark):
    rows = [(2, 5, 1.0, 1.0, 1.0), (1, 9, 0.7, 0.9, 2.0), (1, 3, 0.9, 0.8, 3.0), (1, 7, 0.9, 0.7, 4.0), (3, 4, 1.0, 1.0, None)]
    df = spark.createDataFrame([(*r, r[4], r[4]) for r in rows], "cell_id long, tile int, valid_start double, valid_end double, mean_change double, p95_change double, max_change double")
    got = {r.cell_id: (r.tile, r.overlap_disputed) for r in windows.unique_labels(df, 0.5).collect()}
    assert got == {1: (3, True), 2: (5, False)}


def test_waterfall_counts_each_cell_once(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, True), (False, None)], "a boolean, b boolean")
    got = one(aggregates.exclusion_waterfall(filters.clean_screen(df, {"a": F.col("a"), "b": F.col("b")}), ["a", "b"]))
    assert got == {"cells": 4, "clean": 1, "all_a": 2, "step_a": 2, "all_b": 2, "step_b": 1}


def test_missing_values_pass_no_predicate(spark):
    df = spark.createDataFrame([(None, 1.0), (5.0, None), (1.0, 9.0)], "a double, b double")
    masks = filters.epoch_masks(F.col("a"), F.col("b"), 2, 4, 3)
    got = df.select(*[F.count_if(m).alias(k) for k, m in masks.items()]).first().asDict()
    assert got == {"valid": 1, "bare": 0, "canopy": 1, "disturbed": 1, "loss": 0, "stratum": 1, "stable": 0}
    assert df.select(maths.height_above_ground(F.col("a"), F.col("b")).alias("h")).where("h is null").count() == 2


def test_climate_month(spark):
    df = spark.createDataFrame([("s", "2023-06-01", 5.0, 28.0, 16.0), ("s", "2023-06-02", 10.0, 30.0, 18.0)], "segment_id string, date string, prcp_mm double, tmax_c double, tmin_c double").withColumn("date", F.to_date("date"))
    got = one(aggregates.monthly_climate(df))
    assert (got["month"], got["prcp_mm"], got["tmean_c"], got["gdd"]) == ("2023-06", 15.0, 23.0, 26.0)


def test_ranks_average_over_ties(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (40.0,)], "v double")
    assert sorted(r[0] for r in df.select(windows.average_rank(F.col("v"))).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_errors_and_budget(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (3.0, 2.5), (4.0, 4.5), (None, 1.0)], "t double, p double")
    got = one(aggregates.errors(df, "t", "p"))
    assert (got["n"], got["mae"], got["rmse"], got["bias"]) == (4, 0.5, 0.5, 0.25)
    scores = spark.createDataFrame([(k, float(s), 1.0 if k < 3 else 0.0, 1.0) for k, s in enumerate((9, 8, 7, 1, 0.5, 0.2, 0.1, 0, -1, -2))], "id int, score double, label double, weight double")
    got = one(windows.at_budget(windows.gain_curve(scores, "score", "label", "weight", "id"), 0.3, "label", "weight"))
    assert (got["recall"], got["precision"]) == (1.0, 1.0)


def test_gain_area_equals_numpy(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "score": r.random(200), "label": (r.random(200) < 0.3).astype(float), "weight": r.random(200) + 0.1}))
    curve = windows.gain_curve(df, "score", "label", "weight", "id")
    known = curve.orderBy("budget").select("budget", "recall").toPandas()
    g = np.linspace(0, 0.2, 512)
    y = np.interp(g, known.budget, known.recall, left=0)
    assert windows.gain_area(curve).first().area == pytest.approx(np.trapezoid(y, g) / 0.2, rel=1e-9)


def test_voltage_and_habit(spark):
    df = spark.createDataFrame([("115000;60000",), ("x/230000",), (None,), ("bad",)], "v string")
    assert [r[0] for r in df.select(text.voltage_kv(F.col("v"))).collect()] == [115.0, 230.0, None, None]
    names = spark.createDataFrame([("Mixed Oak",), ("Blue oak",), ("Ponderosa Pine",), (None,)], "n string")
    assert [r[0] for r in names.select(text.growth_habit(F.col("n"))).collect()] == ["mixed", "hardwood", "conifer", "other"]


def test_growth_curve_keeps_ceiling_and_rejects_bad_parameters(spark):
    c = lambda h, a: maths.chapman_richards(F.lit(h), F.lit(9.0), F.lit(a), F.lit(0.04), F.lit(2.0))
    row = spark.range(1).select(c(80.0, 70.0), c(10.0, 70.0)).first()
    assert row[0] == 80.0 and row[1] == pytest.approx(70 * (1 - (1 - (10 / 70) ** 0.5) * math.exp(-0.36)) ** 2)
    with pytest.raises(Exception, match="growth curve"):
        spark.range(1).select(c(10.0, -1.0)).collect()


def test_heat_load_and_mercator(spark):
    x, y = maths.to_web_mercator(F.lit(-122.5), F.lit(38.5))
    lon, lat = maths.from_web_mercator(x, y)
    row = spark.range(1).select(lon, lat, maths.to_web_mercator(F.lit(0.0), F.lit(89.0))[1], maths.heat_load(F.lit(0.0), F.lit(10.0), F.lit(38.0))).first()
    assert row[0] == pytest.approx(-122.5) and row[1] == pytest.approx(38.5) and row[2] is None
    assert row[3] == pytest.approx(math.exp(-1.467 + 1.582 * math.cos(math.radians(38))))


def test_nearest_join_equals_brute_force(spark):
    r = np.random.default_rng(1)
    a = pd.DataFrame({"id": range(150), "lon": -122 + r.random(150), "lat": 60 + r.random(150)})
    b = pd.DataFrame({"id": range(80), "lon": -122 + r.random(80), "lat": 60 + r.random(80)})
    got = {x.id: (x.match, x.distance_m) for x in joins.nearest_within(spark.createDataFrame(a), spark.createDataFrame(b), 6000).collect()}
    p1, p2 = np.radians(a.lat.to_numpy())[:, None], np.radians(b.lat.to_numpy())[None]
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(b.lon.to_numpy()[None] - a.lon.to_numpy()[:, None]) / 2) ** 2
    d = 2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
    want = {k: (int(d[k].argmin()), d[k].min()) for k in range(150) if d[k].min() <= 6000}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_polygon_types_need_one_match_and_pool_rare_kinds(spark):
    square = lambda x0, x1: [(float(x), float(y)) for x, y in ((x0, 0), (x1, 0), (x1, 4), (x0, 4))]
    rings = spark.createDataFrame([(1, square(0, 4)), (2, square(3, 8))], "polygon int, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.5, 2.0), (3, 7.0, 3.0), (4, 9.0, 1.0), (5, 1.5, 2.5)], "id int, x double, y double")
    hits = joins.points_in_polygons(points, joins.edges_of(rings), 1.0)
    assert sorted(map(tuple, hits.collect())) == [(1, 1), (2, 1), (2, 2), (3, 2), (5, 1)]
    kinds = spark.createDataFrame([(1, "oak", "forest"), (2, "fir", "forest")], "polygon int, kind string, grp string")
    got = {r.id: (r.polygon, r.kind) for r in joins.assigned_types(points, hits, kinds, 2).collect()}
    assert got == {1: (1, "oak"), 2: (-1, "uncertain"), 3: (2, "group:forest"), 4: (-1, "uncertain"), 5: (1, "oak")}


def test_places_and_shapes_of_copies_meet_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "MEMBERS", 16)
    square = lambda x0, x1: [(float(x), float(y)) for x, y in ((x0, 0), (x1, 0), (x1, 4), (x0, 4))]
    rings = spark.createDataFrame([*[(k, square(0, 4)) for k in range(60)], (60, square(3, 8))], "polygon int, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame([*[(k, 1.0, 1.0) for k in range(70)], (70, 3.5, 2.0), (71, 7.0, 3.0), (72, 9.0, 1.0), (73, None, 1.0)], "id int, x double, y double")
    edges = joins.edges_of(rings)
    _, met, members = joins._places_in_shapes(points, edges, 1.0, "id", "x", "y", "polygon")
    assert sorted(map(tuple, met.collect())) == [(1.0, 1.0, 0), (3.5, 2.0, 0), (3.5, 2.0, 60), (7.0, 3.0, 60)]
    assert members.count() == 61
    want = sorted([(i, k) for i in [*range(71)] for k in range(60)] + [(70, 60), (71, 60)])
    assert sorted(map(tuple, joins.points_in_polygons(points, edges, 1.0).collect())) == want
    assert [tuple(r) for r in joins.lone_polygons(points, edges, 1.0).collect()] == [(71, 60)]


def test_points_of_one_id_share_their_parity(spark):
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "polygon int, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (2, 3.0, 3.0), (3, 1.0, 1.0), (3, 9.0, 1.0), (None, 1.0, 1.0)], "id int, x double, y double")
    edges = joins.edges_of(rings)
    assert sorted(map(tuple, joins.points_in_polygons(points, edges, 2.0).collect()), key=str) == [(2, 1), (3, 1), (None, 1)]
    assert sorted(map(tuple, joins.lone_polygons(points, edges, 2.0).collect()), key=str) == [(2, 1), (3, 1), (None, 1)]


def test_planted_shift_is_found(spark):
    n = 48
    i, j = np.mgrid[0:n, 0:n]
    height = lambda r, c: 40 * np.sin(r / 7) + 30 * np.cos(c / 6) + 12 * np.sin((r + c) / 9)
    dx, dy, dz = 0.6, -0.4, 1.5
    ref, mov = height(i, j), height(i + dy, j - dx) + dz
    cells = spark.createDataFrame(pd.DataFrame({"row": i.ravel(), "col": j.ravel(), "ref": ref.ravel(), "mov": mov.ravel()}))
    graded = windows.slope_aspect(cells.withColumn("value", F.col("ref")), "value", 1.0)
    got = raster.solved_shift(raster.shift_system(graded.withColumn("difference", F.col("mov") - F.col("ref")), 5, 88))
    assert abs(abs(got["dx"]) - 0.6) < 0.15 and abs(abs(got["dy"]) - 0.4) < 0.15


def test_bilinear_shift_of_a_plane(spark):
    cells = spark.createDataFrame([(r, c, 3.0 * c - 2.0 * r) for r in range(6) for c in range(6)], "row long, col long, value double")
    got = {(r.row, r.col): r.value for r in raster.shifted(cells, 4.0, -5.0, 10.0).collect()}
    assert got[2, 2] == pytest.approx(3 * 2.4 - 2 * 2.5) and got[5, 5] is None


def test_disk_difference_crosses_super_tiles(spark):
    r = np.random.default_rng(0)
    v = r.random((30, 30))
    v[12, 12] = np.nan
    cells = spark.createDataFrame([(a, b, float(v[a, b])) for a in range(30) for b in range(30) if np.isfinite(v[a, b])], "row long, col long, value double")
    got = {(x.row, x.col): x.tpi for x in raster.disk_difference(cells, 3, 8).collect()}
    disk = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9]
    for (a, b), t in got.items():
        own = [v[a + p, b + q] if 0 <= a + p < 30 and 0 <= b + q < 30 else np.nan for p, q in disk]
        want = v[a, b] - np.mean(own)
        assert (t is None and not np.isfinite(want)) or t == pytest.approx(want)
    assert len(got) == 899


def test_disk_difference_and_sampling_take_all_tiles(spark):
    r = np.random.default_rng(1)
    v = r.random((3, 12, 12))
    df = spark.createDataFrame([(t, a, b, float(v[t, a, b])) for t in range(3) for a in range(12) for b in range(12)], "tile int, row long, col long, value double")
    got = {(x.tile, x.row, x.col): x.tpi for x in raster.disk_difference(df, 1, 5, keys=["tile"]).collect()}
    assert len(got) == 3 * 144
    for (t, a, b), tpi in got.items():
        inner = 0 < a < 11 and 0 < b < 11
        want = v[t, a, b] - (v[t, a, b] + v[t, a - 1, b] + v[t, a + 1, b] + v[t, a, b - 1] + v[t, a, b + 1]) / 5 if inner else None
        assert tpi == (pytest.approx(want) if inner else None)
    cells = spark.createDataFrame([(1, 15.0, 105.0, 2), (2, 500.0, 0.0, 0)], "id long, x double, y double, tile int")
    every = {(x.id, x.tile): x.value for x in joins.sampled(cells.drop("tile"), df, 0, 120, 10, keys=["tile"]).collect()}
    assert every == {**{(1, t): v[t, 1, 1] for t in range(3)}, (2, None): None}
    own = {(x.id, x.tile): x.value for x in joins.sampled(cells, df, 0, 120, 10, keys=["tile"]).collect()}
    assert own == {(1, 2): v[2, 1, 1], (2, 0): None}


def test_raster_queries_take_all_tiles(spark):
    import duckdb

    from understory.plans import catalog
    from understory.plans.fixtures import VIEWS

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for k in ("raster", "cells"):
        con.execute(f"CREATE VIEW {k} AS {VIEWS[k]}")
    tpi = con.execute("""SELECT r.tile, r."row", r.col, CASE WHEN count(n.start) = 13 THEN round(r.start - avg(n.start), 4) END FROM raster r
        JOIN raster n ON n.tile = r.tile AND pow(n."row" - r."row", 2) + pow(n.col - r.col, 2) <= 4 GROUP BY r.tile, r."row", r.col, r.start""").fetchall()
    got = [(x.tile, x.row, x.col, x.tpi) for x in catalog.QUERIES["ras_disk_difference"](spark, d).collect()]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in tpi) and len({x[0] for x in got}) == 4
    want = {x[:3]: None if x[3] is None else float(x[3]) for x in tpi}
    assert all(x[3] == (None if want[x[:3]] is None else pytest.approx(want[x[:3]], abs=2e-4)) for x in got)
    at = con.execute("""SELECT c.id, r.tile, r.start FROM cells c LEFT JOIN raster r ON r.col = floor(c.x / 20) AND r."row" = floor((900 - c.y) / 20)""").fetchall()
    got = [(x.id, x.tile, x.value) for x in catalog.QUERIES["join_raster_sample"](spark, d).collect()]
    plain = lambda rows: sorted(((a, b, None if c is None else float(c)) for a, b, c in rows), key=repr)
    assert plain(got) == plain(at)


def test_curve_fit_finds_planted_parameters():
    r = np.random.default_rng(7)
    start = r.uniform(2, 30, 1000)
    end = models.curve(start, 8.96, 70, 0.04, 2.0) + r.normal(0, 0.1, 1000)
    fit = models.fit_curve(start, end, 8.96, 70.0)
    assert np.abs(models.curve(start, 8.96, 70, fit["k"], fit["c"]) - end).mean() < 0.12
    free = models.fit_curve(start, end, 8.96, None)
    assert np.abs(models.curve(start, 8.96, free["a"], free["k"], free["c"]) - end).mean() < 0.12


def test_ridge_equals_normal_equations(spark):
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": r.random(300), "b": r.random(300) * 5, "k": r.choice(["x", "y", "z"], 300)})
    pdf["y"] = 2 * pdf.a - pdf.b + (pdf.k == "y") * 3 + r.normal(0, 0.1, 300)
    df = spark.createDataFrame(pdf)
    model = models.ridge(df, "y", ["a", "b"], ["k"], 1.0)
    x = np.column_stack([(pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0) for c in ("a", "b")] + [(pdf.k == v).astype(float) for v in "xyz"])
    xc, yc = x - x.mean(0), pdf.y - pdf.y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
    assert np.allclose(model["beta"], beta)
    got = models.ridge_predicted(df, model).toPandas()
    assert np.abs(got.predicted - pdf.y).mean() < 0.15


def test_held_out_targets_do_not_reach_the_prior(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(200), "fold": r.integers(0, 4, 200), "kind": r.choice(["a", "b"], 200), "grp": "g", "s": r.random(200) * 10})
    pdf["e"] = pdf.s + r.random(200)
    first = models.fold_prior(spark.createDataFrame(pdf), "fold", 4, "kind", "grp", "s", "e", 10).where("fold = 2").select("id", "predicted").toPandas()
    pdf.loc[pdf.fold == 2, "e"] += 100
    again = models.fold_prior(spark.createDataFrame(pdf), "fold", 4, "kind", "grp", "s", "e", 10).where("fold = 2").select("id", "predicted").toPandas()
    assert np.allclose(first.sort_values("id").predicted, again.sort_values("id").predicted)


def test_bootstrap_intervals_hold_the_difference():
    r = np.random.default_rng(9)
    sums = pd.DataFrame({"n": r.integers(50, 200, 80), "a": r.random(80) * 50, "b": r.random(80) * 50 + 40})
    for got in (stats.mae_interval(sums), stats.paired_block_bootstrap(sums)):
        assert got["ci_low"] < got["difference"] < got["ci_high"] < 0
    with pytest.raises(ValueError):
        stats.mae_interval(sums[:1])


def test_custom_statistic_runs_per_draw(spark):
    df = spark.createDataFrame([(k % 6, float(k)) for k in range(60)], "block long, v double")
    got = stats.custom_block_bootstrap(df, "block", "v", np.median, resamples=20).toPandas()
    assert len(got) == 20 and got.replicate.between(0, 60).all()


def test_raster_pairs_cross_block_borders(spark):
    r = np.random.default_rng(3)
    cells = [(t, a, b, float(r.random())) for t in (1, 2) for a in range(-3, 28) for b in range(-2, 30) if r.random() < 0.6]
    got = [tuple(x) for x in stats.raster_pairs(spark.createDataFrame(cells, "tile int, row long, col long, value double"), 10, 90, ["tile"]).collect()]
    far = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 * 10
    want = [(far(p, q), p[3], q[3]) for k, p in enumerate(cells) for q in cells[k + 1 :] if p[0] == q[0] and far(p, q) < 90]
    assert sorted((round(h, 6), a, b) for h, a, b in got) == sorted((round(h, 6), a, b) for h, a, b in want)


def test_variogram_query_takes_all_pairs(spark):
    import duckdb

    from understory.plans import catalog
    from understory.plans.fixtures import VIEWS

    con = duckdb.connect()
    con.execute("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    want = con.execute(f"""WITH raster AS ({VIEWS["raster"]}) SELECT CAST(floor(h / 20) AS BIGINT), count(*), round(avg(h), 4), round(avg(pow(a - b, 2)) / 2, 4) FROM (
        SELECT sqrt(pow(p.col - q.col, 2) + pow(p."row" - q."row", 2)) * 10 AS h, p.start AS a, q.start AS b FROM raster p JOIN raster q ON p.tile = q.tile AND (p."row", p.col) < (q."row", q.col)) WHERE h < 90 GROUP BY 1 ORDER BY 1""").fetchall()
    got = sorted(tuple(x) for x in catalog.QUERIES["sta_variogram"](spark, "/root/testdata/sf0.001").collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose(np.array(got, float), np.array(want, float), atol=2e-4)


def test_variogram_fit_recovers_range():
    h = np.linspace(50, 1000, 20)
    u = np.minimum(h / 400, 1)
    fit = stats.fit_spherical(h, 1 + 4 * (1.5 * u - 0.5 * u**3), np.ones(20))
    assert fit["range"] == pytest.approx(400, rel=0.03) and fit["nugget"] == pytest.approx(1, abs=0.1)
    assert stats.block_size(stats.practical_range(fit), (100, 250, 500, 1000), 100) in (500, 1000)


def test_allocation_gives_each_stratum_one():
    assert sampling.allocation({"a": 90, "b": 9, "c": 1}, 10) == {"a": 9, "b": 1, "c": 1} or sum(sampling.allocation({"a": 90, "b": 9, "c": 1}, 10).values()) == 10
    got = sampling.allocation({"a": 2, "b": 2}, 10)
    assert got == {"a": 2, "b": 2}


def test_pairs_are_bounded_and_ordered(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(20)], "id long, g long")
    got = sampling.pairs(df, "id", ["g"], 3).toPandas()
    assert (got.a < got.b).all() and len(got) == len(got.drop_duplicates()) == 2 * (7 * 3 + 2 + 1)


def test_union_needs_equal_columns(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        sets.concatenated([a, a.select("b", "a")])


def test_lines_are_cut_at_supports(spark):
    doc = '{"elements": [' + ",".join(f'{{"type":"node","id":{k},"lon":{k},"lat":0,"tags":{{"power":"{"tower" if k == 3 else "x"}"}}}}' for k in range(1, 6)) + ',{"type":"way","id":10,"nodes":[1,2,3,4,9,5],"tags":{"voltage":"115000;60000"}},{"type":"way","id":11,"nodes":[1,8]}]}'
    points = catalogues.power_lines(spark.createDataFrame([(doc,)], "json string"))
    assert points.count() == 5 and points.first().kv == 115.0
    got = sorted((r.lon1, r.lon2, r.points) for r in catalogues.spans(points).collect())
    assert got == [(1.0, 3.0, 3), (3.0, 5.0, 3)]


def test_multi_lines_become_parts(spark):
    doc = '{"features":[{"properties":{"ID":"7","VOLTAGE":"x"},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[3,4]],[[1,1],[2,2]]]}},{"properties":{"ID":"0"},"geometry":{"type":"LineString","coordinates":[[0,0],[10,0]]}},{"properties":{},"geometry":{"type":"Point","coordinates":[1,1]}}]}'
    got = catalogues.corridors(spark.createDataFrame([(doc,)], "json string"))
    assert sorted((r.line, r.kv) for r in got.collect()) == [("1", 0.0), ("7_0", 0.0), ("7_1", 0.0)]
    cut = catalogues.segmented(got.where("line = '1'"), 4.0).orderBy("segment").collect()
    assert [round(r.x, 3) for r in cut] == [round(10 / 6, 3), 5.0, round(50 / 6, 3)] and cut[0].length == pytest.approx(10 / 3)


def test_octree_is_pruned(spark):
    h = spark.createDataFrame([("0-0-0-0", 10), ("1-0-0-0", 5), ("1-1-1-0", 4), ("2-0-0-0", 3), ("2-3-3-0", 2), ("3-0-0-0", 1)], "key string, points long")
    boxes = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.key for r in catalogues.octree_nodes(spark, h, (0.0, 0.0, 100.0), boxes, 2).collect()) == ["0-0-0-0", "1-0-0-0", "2-0-0-0"]


def test_scenes_and_manifests(spark):
    page = '{"features":[{"id":"a","properties":{"datetime":"2020-01-02","eo:cloud_cover":5,"grid:code":"T"},"assets":{"red":{"href":"r1"}}},{"id":"a","properties":{"datetime":"2020-01-02","eo:cloud_cover":6,"grid:code":"T"},"assets":{"red":{"href":"r2"}}},{"id":"b","properties":{"grid:code":"T"},"assets":{}}]}'
    got = catalogues.scenes(spark.createDataFrame([(0, page)], "page int, json string"), ["red"], 20, "T").collect()
    assert [(r.id, r.assets["red"]) for r in got] == [("a", "r2")]
    m = '[{"filename":"f","bounds":[0,1,2,3,4,5],"points":9},{"filename":"g","bounds":[0,1],"points":9},{"path":"h","bounds":[0,1,2,3,4,5],"points":0}]'
    assert [tuple(r) for r in catalogues.manifest_boxes(spark.createDataFrame([(m,)], "json string")).collect()] == [("f", 0.0, 1.0, 3.0, 4.0, 9)]
    with pytest.raises(ValueError):
        catalogues.search_url("http://x", "c", "2021", "2020", (0, 0, 1, 1), 20, "T")


def test_writes_leave_provenance(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, v double")
    path = files.write(df, f"file://{tmp_path}/t", source="test")
    note = json.loads((tmp_path / "t.provenance.json").read_text())
    assert note["row_count"] == 2 and note["source"] == "test"
    assert files.read(spark, path).where("v is null").count() == 1
    files.require(files.read(spark, path), "id int, v double")
    with pytest.raises(ValueError):
        files.require(df, "id long")
    with pytest.raises(Exception, match="repeated key"):
        files.require_unique(df.union(df), "id").collect()
    assert files.listing(spark, f"file://{tmp_path}", (".parquet",)).count() >= 1


def test_gate_needs_every_check():
    rows = [{"scale": s, "admitted": True, "nmad": n, "mean": 0.01, "decay": 0.1, "decay_r2": 0.9} for s, n in ((10, 0.12), (30, 0.11), (100, 0.1))]
    limits = {"sigma": 0.2, "bias": 0.05, "decay": 0.05, "tolerance": 0.05, "scales": 3, "r2": 0.5}
    assert all(stats.gate(rows, limits).values())
    assert not stats.gate([{**rows[0], "nmad": 0.5}, *rows[1:]], limits)["noise"]
    assert models.gate_decision({"a": -0.1, "b": 0.0}) == "FAIL"


def test_nested_catalogues(spark):
    doc = lambda s: spark.createDataFrame([(s,)], "json string")
    got = catalogues.datasets(doc('{"Datasets":[{"Dataset":{"identifier":{"value":"a"},"name":"n","temporalCoverage":"2020-01-01 / 2020-02-01","spatialCoverage":{"geo":{"box":"38 -123 39 -122"}}}},{"identifier":"b","spatialCoverage":{"geo":{"box":"1 2"}}}]}')).collect()
    assert [(r.identifier, r.start, r.end, r.x0, r.y1) for r in got] == [("a", "2020-01-01", "2020-02-01", -123.0, 39.0), ("b", "", "", None, None)]
    fires = catalogues.perimeters(doc('{"features":[{"properties":{"FIRE_NAME":" X ","YEAR_":"2017","GIS_ACRES":null},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[0,1]]],[[[5,5],[6,5],[5,6]]]]}}]}')).first()
    assert (fires.name, fires.year, fires.acres, len(fires.rings)) == ("X", 2017, 0.0, 2)
    types = catalogues.identified_types(doc('{"results":[{"attributes":{"EVT_Code":"7","EVT_NAME":"Blue oak"}}]}').union(doc('{"results":[]}'))).collect()
    assert [(r.code, r.name, r.habit) for r in types] == [(7, "Blue oak", "hardwood"), (-1, "Unknown", "other")]
    meta = catalogues.point_metadata(doc('{"points":9,"bounds":[0,0,0,1,1,1],"srs":{"horizontal":"3857"}}')).first()
    assert (meta.points, meta.conforming[3], meta.epsg) == (9, 1.0, "3857")
    with pytest.raises(Exception, match="metadata lacks"):
        catalogues.point_metadata(doc('{"points":9}')).collect()


def test_fold_curves_recover_growth(spark):
    r = np.random.default_rng(4)
    s = r.uniform(2, 30, 600)
    pdf = pd.DataFrame({"fold": r.integers(0, 3, 600), "kind": r.choice(["a", "b", "group:x"], 600), "grp": "g", "s": s, "e": models.curve(s, 9.0, 70.0, 0.04, 2.0)})
    got = models.fold_curves(spark.createDataFrame(pdf), "fold", 3, "kind", "grp", "s", "e", 9.0, {"a": 70.0, "b": 70.0}, 20).toPandas()
    assert len(got) == 600 and np.abs(got.predicted - got.e).mean() < 0.05


def test_fitted_curves_take_every_row_of_a_large_scope(spark):
    r = np.random.default_rng(6)
    few = pd.DataFrame({"s": [5.0, 12.0, 20.0, 28.0]})
    few["e"] = models.curve(few.s.to_numpy(), 9.0, 70.0, 0.04, 2.0)
    hot = pd.concat([few] * 60_000, ignore_index=True).assign(scope="hot")  # 240,000 rows of four pairs
    s = r.uniform(2, 30, 1000)
    small = pd.DataFrame({"s": s, "e": models.curve(s, 9.0, 70.0, 0.06, 1.5) + r.normal(0, 0.2, 1000), "scope": "small"})
    rows = pd.concat([hot, small], ignore_index=True)
    for top in (70.0, None):
        got = {x.scope: x for x in models.fitted_curves(spark.createDataFrame(rows.assign(top=70.0)), "scope", "s", "e", 9.0, "top" if top else None).collect()}
        assert got["hot"].n == 240_000 and got["small"].n == 1000
        want = models.fit_curve(small.s.to_numpy(), small.e.to_numpy(), 9.0, top)
        assert got["small"].loss == pytest.approx(want["loss"], rel=1e-6)
        assert got["hot"].loss < 1
        assert np.abs(models.curve(few.s.to_numpy(), 9.0, got["hot"].a, got["hot"].k, got["hot"].c) - few.e).max() < 0.01


def test_fold_curves_keep_rows_without_a_fit(spark):
    pdf = pd.DataFrame({"fold": [0, 0, 1, 1, 1], "kind": ["a"] * 4 + ["b"], "grp": ["g"] * 4 + ["alone"], "s": [5.0, 9.0, 14.0, 20.0, 8.0]})
    pdf["e"] = models.curve(pdf.s.to_numpy(), 9.0, 70.0, 0.04, 2.0)
    got = models.fold_curves(spark.createDataFrame(pdf), "fold", 2, "kind", "grp", "s", "e", 9.0, {"a": 70.0}, 1).toPandas()
    assert len(got) == 5 and got[got.kind == "b"].predicted.isna().all() and got[got.kind == "a"].predicted.notna().all()


def test_splits_and_spread():
    stats.check_splits("2013-01-01", "2023-12-31", ("2018-01-01", "2018-02-01", "2020-01-01", "2020-02-01", "2023-01-01"))
    with pytest.raises(ValueError):
        stats.check_splits("2013-01-01", "2022-12-31", ("2018-01-01", "2018-02-01", "2020-01-01", "2020-02-01", "2023-01-01"))
    rows = [{"scale": s, "admitted": True, "nmad": 0.2 * (s / 10) ** -0.2, "decay": 0.1, "base_sigma": 0.2} for s in (10, 20, 40)]
    assert stats.reference_spread(rows, 20, 10)[1] == "measured"
    value, how = stats.reference_spread(rows, 80, 10)
    assert how == "extrapolated" and value == pytest.approx(0.2 * 8**-0.2)
    assert stats.mean_importance([{"a": 1.0}, {"a": 0.5, "b": 0.5}]) == {"a": 0.75, "b": 0.25}


@pytest.mark.parametrize("parts", [1, 3, 20])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_do_not_depend_on_ranges(spark, parts, descending):
    r = np.random.default_rng(6)
    rows = [(k, None if k % 17 == 0 else float(r.integers(0, 12)), float(r.random())) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, key double, v double")
    got = {x.id: (x.s, x.s_all) for x in windows.running(df, "key", ["id"], {"s": F.col("v")}, descending, parts).collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, (-1 if descending else 1) * (x[1] or 0), x[0]))
    total = 0.0
    for k, _, v in order:
        total += v
        assert got[k][0] == pytest.approx(total) and got[k][1] == pytest.approx(sum(x[2] for x in rows))


def test_global_ranks(spark):
    df = spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in enumerate([10, 20, 20, 40, None, 20])], "id int, v double")
    assert {r.id: r.rank_avg for r in windows.ranked(df, "v").collect()} == {0: 1.0, 1: 3.0, 2: 3.0, 5: 3.0, 3: 5.0, 4: None}


def test_provenance_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    path = files.write(df, f"file://{tmp_path}/t", source="test")
    assert files.checked(spark, path).count() == 2
    df.write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="differ"):
        files.checked(spark, path)
    assert files.hashes(spark, f"file://{tmp_path}").where("length(sha256) = 64").count() >= 2
    (tmp_path / "s.toml").write_text("a = 1")
    assert files.settings(str(tmp_path / "s.toml"), ("a",)) == {"a": 1}
    with pytest.raises(KeyError):
        files.settings(str(tmp_path / "s.toml"), ("b",))
    assert files.confined("/data", "x", "y") == "/data/x/y"
    with pytest.raises(ValueError):
        files.confined("/data", "..", "etc")

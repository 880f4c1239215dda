import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from understory.functions import projection
from understory.operators import geometry, surfaces

POINTS = "tile int, k long, x double, y double, z double, classification int, return_number int, returns int, scan_angle double, synthetic int, withheld int, overlap int"


# ---------------------------------------------------------------- projections

#: Published worked examples: a transverse Mercator and a conic of two parallels (in feet).
CONTROL = [
    (projection.TransverseMercator(lon0=-2, lat0=49, k0=0.9996012717, east=400_000, north=-100_000, radius=6_377_563.396, flattening=1 / 299.3249646), (0.5, 50.5), (577_274.99, 69_740.50), 0.02),
    (projection.LambertConic(lon0=-99, lat0=27 + 50 / 60, first=28 + 23 / 60, second=30 + 17 / 60, east=2_000_000, radius=20_925_832.164, flattening=1 / 294.978698214), (-96.0, 28.5), (2_963_503.91, 254_759.80), 0.01),
]


@pytest.mark.parametrize("at, lonlat, xy, near", CONTROL)
def test_published_points(spark, at, lonlat, xy, near):
    x, y = at.forward(F.lit(lonlat[0]), F.lit(lonlat[1]))
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(xy[0], abs=near) and got[1] == pytest.approx(xy[1], abs=near)


@pytest.mark.parametrize("code", ["EPSG:6339", 32610, 32733, 3857])
def test_there_and_back(spark, code):
    at = projection.frame(code)
    lon0 = {32733: 15.0}.get(code, -123.0)
    rows = spark.range(400).select((lon0 - 3 + F.col("id") % 20 * 0.3).alias("lon"), (-60 + F.col("id") * 0.3).alias("lat"))
    x, y = at.forward(F.col("lon"), F.col("lat"))
    got = rows.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = at.inverse(F.col("x"), F.col("y"))
    far = got.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(far) < 1e-9
    if code != 3857:  # the meridian itself lies at the false easting, and scale there is 0.9996
        two = spark.range(2).select(*[c.alias(n) for c, n in zip(at.forward(F.lit(lon0), 38 + F.col("id") * 1e-5), "xy", strict=True)]).orderBy("y").collect()
        assert two[0].x == pytest.approx(500_000, abs=1e-6)
    with pytest.raises(ValueError):
        projection.frame(2154)


def test_pinned_operation():
    own = {"datum_operation": {"code": 1, "area": (-125, 30, -110, 45)}}
    assert projection.operation(own, (-123, 38, -122, 39))["code"] == 1
    for settings, box in (({}, (0, 0, 1, 1)), (own, (-130, 38, -122, 39))):
        with pytest.raises(ValueError):
            projection.operation(settings, box)


# ---------------------------------------------------------------- boxes and grids


def test_projected_boxes_hold_their_edges_and_grids_snap_outwards(spark):
    boxes = spark.createDataFrame([(1, -122.5, 38.0, -122.4, 38.1)], "tile int, x0 double, y0 double, x1 double, y1 double")
    p = geometry.projected_boxes(boxes, ["tile"], 6339).first()
    x, y = projection.frame(6339).forward(F.col("lon"), F.col("lat"))
    edge = spark.range(101).select((-122.5 + F.col("id") * 0.001).alias("lon"), F.lit(38.1).alias("lat")).select(x.alias("x"), y.alias("y")).agg(F.max("y"), F.min("x"), F.max("x")).first()
    assert p.y1 == pytest.approx(edge[0], abs=0.05) and p.x0 <= edge[1] + 1e-6 and p.x1 >= edge[2] - 1e-6
    g = geometry.tile_grids(boxes, ["tile"], 6339, 1.0, 10.0).first()
    assert g.origin_x % 10 == 0 and g.origin_x <= p.x0 < g.origin_x + 10 and g.width % 10 == 0 and g.origin_x + g.width >= p.x1
    e = geometry.grid_extents(geometry.tile_grids(boxes, ["tile"], 6339, 1.0, 10.0)).first()
    assert (e.x0, e.y0) == (g.origin_x, g.origin_y) and e.x1 == g.origin_x + g.width
    for bad in ((1.0, 1.5), (0.0, None)):
        with pytest.raises(ValueError):
            geometry.grids(boxes, *bad)
    assert geometry.scale_factor(10, 40) == 4 and geometry.dispersion_side(10) == 3
    for bad in ((10, 25), (0, 10)):
        with pytest.raises(ValueError):
            geometry.scale_factor(*bad)


def test_overlap_summary_of_planted_boxes(spark):
    box = lambda *b: spark.createDataFrame([b], "x0 double, y0 double, x1 double, y1 double")
    a, b = box(-122.30, 38.70, -122.20, 38.80), box(-122.25, 38.75, -122.10, 38.90)
    r = geometry.overlap_summary(a, b, (-122.22, 38.70, -122.0, 38.78), 6339, [0, 5], 0.001).first()
    km2 = lambda w, s, e, n: (e - w) * 111.32 * np.cos(np.radians((s + n) / 2)) * (n - s) * 110.99
    assert r.first_km2 == pytest.approx(km2(-122.30, 38.70, -122.20, 38.80), rel=5e-3)
    assert r.shared_km2 == pytest.approx(km2(-122.25, 38.75, -122.20, 38.80), rel=5e-3)
    assert r.shared_in_study_km2 == pytest.approx(km2(-122.22, 38.75, -122.20, 38.78), rel=2e-2)
    assert r.shared_distance_km < 0.2 and r.shared_within_0_km2 <= r.shared_within_5_km2 == pytest.approx(r.shared_km2, rel=1e-6)
    # overlapping boxes of one footprint count once
    assert geometry.footprint_cells(a.union(a), (), 0.001, 6339).agg(F.sum("km2")).first()[0] == pytest.approx(r.first_km2)


def test_warp_is_exact_on_a_plane(spark):
    source = spark.range(40 * 40).select((F.col("id") / 40).cast("long").alias("row"), (F.col("id") % 40).alias("col"))
    source = geometry.pixel_positions(source, 500_000, 4_210_000, 30, 6339).withColumn("value", F.col("col") * 2.0 + F.col("row") * 3.0)
    target = spark.range(100).select((F.col("id") / 10).cast("long").alias("row"), (F.col("id") % 10).alias("col"))
    got = geometry.warped(target, source, 6339, 6339, (500_000, 4_210_000, 30), (500_300, 4_209_700, 30)).collect()
    assert all(r.value == pytest.approx((r.col + 10) * 2 + (r.row + 10) * 3, abs=1e-4) for r in got)
    out = geometry.warped(target, source, 6339, 6339, (500_000, 4_210_000, 30), (499_900, 4_210_100, 30)).where("row = 0").first()
    assert out.value is None


# ---------------------------------------------------------------- points


def cloud(spark, rows):
    return spark.createDataFrame([(t, k, x, y, z, c, 1, 1, 0.0, 0, 0, 0) for k, (t, x, y, z, c) in enumerate(rows)], POINTS)


def test_thinning_is_greedy_by_order(spark):
    r = np.random.default_rng(0)
    rows = [(int(k % 2), float(x), float(y), 0.0, 1) for k, (x, y) in enumerate(r.uniform(0, 20, (900, 2)))]
    got = {p.k for p in surfaces.poisson_thinned(cloud(spark, rows), 1.5, ["k"]).collect()}
    want = set()
    for t in (0, 1):
        held = []
        for k, p in enumerate(rows):
            if p[0] == t and all((p[1] - q[0]) ** 2 + (p[2] - q[1]) ** 2 >= 1.5**2 for q in held):
                held.append(p[1:3])
                want.add(k)
    assert got == want


def scene(seed=2):
    """A slope with a house and trees; returns and whether each is ground."""
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 40, 6000), r.uniform(0, 40, 6000)
    ground = 100 + 0.1 * x
    z, true = ground + r.normal(0, 0.02, 6000), np.ones(6000, bool)
    house = (abs(x - 12) < 5) & (abs(y - 12) < 5)
    tree = ((x - 30) ** 2 + (y - 28) ** 2 < 36) & (r.random(6000) < 0.7)
    z[house], true[house] = 108.0, False
    z[tree], true[tree] = ground[tree] + r.uniform(4, 18, tree.sum()), False
    return x, y, z, true, ground


def test_ground_and_heights_of_a_planted_scene(spark):
    x, y, z, true, ground = scene()
    got = surfaces.ground_mask(x, y, z, {"scalar": 1.2, "slope": 0.2, "threshold": 0.45, "window": 16.0})
    assert (got == true).mean() > 0.98 and not got[(z - ground) > 3].any()
    with pytest.raises(ValueError):
        surfaces.ground_mask(x, y, z, {"slope": 0.2})
    g = np.flatnonzero(true)
    near = surfaces.nearest_values(x, y, x[g], y[g], z[g])
    d = (x[:400, None] - x[g]) ** 2 + (y[:400, None] - y[g]) ** 2
    assert near[:400] == pytest.approx(z[g][d.argmin(axis=1)])
    assert np.isnan(surfaces.nearest_values(x, y, x[:0], y[:0], z[:0])).all()


def test_canopy_of_a_planted_scene(spark):
    x, y, z, true, _ = scene()
    lon, lat = -122.5, 38.0
    base = spark.range(1).select(*projection.frame(6339).forward(F.lit(lon), F.lit(lat))).first()
    x0, y0 = round(base[0], -1), round(base[1], -1)
    rows = [(7, float(a + x0), float(b + y0), float(c), 1) for a, b, c in zip(x, y, z, strict=True)]
    bad = cloud(spark, rows[:50]).withColumn("z", F.lit(500.0)).withColumn("withheld", F.lit(1)).withColumn("k", F.col("k") + 90_000)
    noise = cloud(spark, rows[:50]).withColumn("z", F.lit(900.0)).withColumn("classification", F.lit(7)).withColumn("k", F.col("k") + 95_000)
    points = surfaces.read_points([cloud(spark, rows), bad, noise])
    grid = spark.createDataFrame([(7, x0, y0, 40, 40, 1.0)], "tile int, origin_x double, origin_y double, width int, height int, resolution double")
    settings = {"source_frame": 6339, "target_frame": 6339, "drop_classes": [7, 18], "max_scan_angle_deg": 20, "sample_radius_m": 0.3, "order": ["k"], "smrf": {"scalar": 1.2, "slope": 0.2, "threshold": 0.45, "window": 16.0}}
    ready = surfaces.prepared(points, grid, settings).cache()
    assert 2000 < ready.count() < 6000
    cells = surfaces.terrain_surfaces(ready, grid).collect()
    assert max(c.dsm for c in cells) < 125 and all(c.dtm is None or abs(c.dtm - 100 - 0.1 * (c.col + 0.5)) < 0.6 for c in cells)
    tops = {(c.row, c.col): c for c in surfaces.canopy_layers(ready, grid, [0, 2, 5, 10], 0, 60).collect()}
    assert max(c.top for c in tops.values()) == pytest.approx(18, abs=1.0)
    c = tops[(39 - 12, 12)]
    assert c.top == pytest.approx(108 - 101.2, abs=0.8) and c.over_10 is None and c.top == max(v for v in (c.over_0, c.over_2, c.over_5) if v is not None)
    stats = surfaces.dimension_stats(ready, ["z"], ["tile"]).first()
    assert stats.points == ready.count() and stats.greatest_z < 125


@pytest.mark.parametrize("most", [surfaces.MOST_PAIRS, 0])
def test_blockwise_thinning_equals_one_pass(spark, monkeypatch, most):
    """Small blocks and rims, a chain of points longer than a rim, points of equal order, copies: as in one pass over each tile."""
    monkeypatch.setattr(surfaces, "THIN_BLOCK", 6)
    monkeypatch.setattr(surfaces, "THIN_RIM", 2)
    monkeypatch.setattr(surfaces, "MOST_PAIRS", most)
    r = np.random.default_rng(3)
    some = pd.DataFrame({"tile": r.integers(0, 2, 1500), "x": r.uniform(-15, 15, 1500), "y": r.uniform(-15, 15, 1500), "id": r.integers(0, 400, 1500)})
    line = pd.DataFrame({"tile": 7, "x": np.arange(120) * 0.5, "y": 0.0, "id": range(120)})
    points = pd.concat([some, line, line.head(9)], ignore_index=True).sample(frac=1, random_state=1)
    want = []
    for _, g in points.groupby("tile"):
        g = g.sort_values(["id", "x", "y"], kind="stable")
        want.append(g[surfaces.kept_disks(g.x.to_numpy(float), g.y.to_numpy(float), 0.8)])
    thinned = surfaces.poisson_thinned(spark.createDataFrame(points), 0.8, ["id"])
    assert "_i" in thinned._jdf.queryExecution().optimizedPlan().toString()  # a block, not a tile, is the unit of work
    got = thinned.toPandas()
    columns = ["tile", "x", "y", "id"]
    assert sorted(map(tuple, got[columns].to_numpy())) == sorted(map(tuple, pd.concat(want)[columns].to_numpy()))


def test_heights_by_block_equal_one_pass(spark, monkeypatch):
    """Ground at all distances, equal distances, copies, bare tiles, missing places: as by comparing all pairs, without a tile as the unit of work."""
    monkeypatch.setattr(surfaces, "GROUND_SIDE", 1.0)
    monkeypatch.setattr(surfaces, "GROUND_STEP", 3)
    monkeypatch.setattr(surfaces, "GROUND_BLOCK", 4)
    r = np.random.default_rng(5)
    n = 1500
    points = pd.DataFrame({"tile": r.integers(0, 3, n), "id": range(n), "x": r.integers(-120, 120, n) / 4, "y": r.integers(-120, 120, n) / 4, "z": r.integers(0, 40, n) / 2})
    points["ground"] = (points.tile < 2) & (r.random(n) < 0.2) & ((points.tile == 1) | (points.x < 0) & (points.y < 5) | (points.x > 29))
    points.loc[3, ["x", "ground"]] = [np.nan, False]
    want = {}
    for _, t in points.groupby("tile"):
        g = t[t.ground].sort_values("z")
        for p in t.itertuples():
            d = ((p.x - g.x) ** 2 + (p.y - g.y) ** 2).to_numpy()
            want[p.id] = None if not len(g) or np.isnan(p.x) else p.z - g.z.to_numpy()[d.argmin()]
    frame = surfaces.heights_above_ground(spark.createDataFrame(points))
    assert "_i" in frame._jdf.queryExecution().optimizedPlan().toString()
    got = frame.select("id", "height").collect()
    assert len(got) == n and {r.id: r.height for r in got} == want

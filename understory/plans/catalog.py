"""The registered queries, each with its SQL over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.functions import maths, projection, text
from understory.operators import aggregates, filters, geometry, joins, models, raster, sampling, sets, stats, surfaces, windows
from understory.plans import jobs, planning
from understory.plans.fixtures import oracle, view
from understory.sources import catalogues, files
from understory.streaming import climate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with the SQL that should give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *views) if views else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a few places, since sums of doubles depend on their order."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


R = lambda expr, name, n=4: f"round({expr}, {n}) AS {name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- flagship: unique labels, screened, by class

TIES = ("k1", "k2", "k3", "part_id")
RULES = ("overlap_disputed", "low_canopy", "lidar_loss", "near_line")
UNIQUE_SQL = """(SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY least(valid_start, valid_end) DESC, valid_start + valid_end DESC, tile, k1, k2, k3, part_id) AS rn,
           greatest(max(mean_change) OVER w - min(mean_change) OVER w, max(p95_change) OVER w - min(p95_change) OVER w, max(max_change) OVER w - min(max_change) OVER w) > 0 AS overlap_disputed,
           count(*) OVER w AS n_rows
    FROM labels_raw WHERE valid_start >= 5e-1 AND valid_end >= 5e-1 WINDOW w AS (PARTITION BY cell_id)) WHERE rn = 1)"""
FLAGS_SQL = f"""(SELECT u.*, v.vegetation_type, v.broader_group, u.canopy_share < 95e-2 AS low_canopy, u.loss_share > 6e-2 AS lidar_loss, coalesce(v.line_m < 10, FALSE) AS near_line
    FROM {UNIQUE_SQL} u LEFT JOIN vegetation v ON u.part_id = v.part_id)"""


def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.unique_labels(view(spark, sf_dir, "labels_raw"), 0.5, TIES)


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = unique(spark, sf_dir).join(view(spark, sf_dir, "vegetation"), "part_id", "left")
    return filters.clean_screen(cells, {"overlap_disputed": F.col("overlap_disputed"), "low_canopy": F.col("canopy_share") < 0.95, "lidar_loss": F.col("loss_share") > 0.06, "near_line": F.col("line_m") < 10})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screened(spark, sf_dir).groupingSets([[F.col("broader_group")], [F.col("vegetation_type")], []], F.col("broader_group"), F.col("vegetation_type")).agg(
        F.count("*").alias("cells"), F.count_if("clean").alias("clean"), F.percentile(F.when(F.col("clean"), F.col("mean_change")), 0.5).alias("median_change"),
        *[F.count_if(F.col(r)).alias(f"all_{r}") for r in RULES]))


NOT_CLEAN = " OR ".join(RULES)
QUERIES["job_clean_cells"] = flagship
ORACLES["job_clean_cells"] = oracle(
    f"""SELECT broader_group, vegetation_type, count(*) AS cells, count(*) FILTER (NOT ({NOT_CLEAN})) AS clean, round(quantile_cont(mean_change, 0.5) FILTER (NOT ({NOT_CLEAN})), 4) AS median_change,
    {", ".join(f"count(*) FILTER ({r}) AS all_{r}" for r in RULES)} FROM {FLAGS_SQL} GROUP BY GROUPING SETS ((broader_group), (vegetation_type), ())""",
    "labels_raw", "vegetation",
)


@query(f"SELECT cell_id, tile, part_id, n_rows, overlap_disputed FROM {UNIQUE_SQL}", "labels_raw")
def win_unique_labels(spark, d):
    return unique(spark, d).select("cell_id", "tile", "part_id", "n_rows", "overlap_disputed")


@query("""SELECT cell_id, tile, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY least(valid_start, valid_end) DESC, valid_start + valid_end DESC, tile, k1, k2, k3, part_id) AS rn, count(*) OVER (PARTITION BY cell_id) AS n_rows FROM labels_raw) WHERE rn = 1""", "labels_raw")
def win_dedupe_labels(spark, d):
    order = [F.least("valid_start", "valid_end").desc(), (F.col("valid_start") + F.col("valid_end")).desc(), *[F.col(c) for c in ("tile", *TIES)]]
    return windows.best_rows(view(spark, d, "labels_raw"), "cell_id", order).select("cell_id", "tile", "n_rows")


@query(f"SELECT broader_group, count(*) AS cells, count(*) FILTER (NOT ({NOT_CLEAN})) AS clean, " + ", ".join(f"count(*) FILTER ({r}) AS all_{r}, count(*) FILTER ({r}{''.join(f' AND NOT {p}' for p in RULES[:k])}) AS step_{r}" for k, r in enumerate(RULES)) + f" FROM {FLAGS_SQL} GROUP BY broader_group", "labels_raw", "vegetation")
def agg_exclusion_waterfall(spark, d):
    return aggregates.exclusion_waterfall(screened(spark, d), RULES, ["broader_group"])


@query("SELECT cell_id, count(*) AS n, count(DISTINCT tile) AS tiles, " + ", ".join(R(f"max({c}) - min({c})", f"spread_{c}") for c in ("mean_change", "p95_change", "max_change")) + " FROM labels_raw GROUP BY cell_id HAVING count(*) > 1", "labels_raw")
def agg_duplicate_summary(spark, d):
    return rounded(aggregates.duplicate_summary(view(spark, d, "labels_raw"), "cell_id", "tile", ["mean_change", "p95_change", "max_change"]))


@query(f"""SELECT cell_id, CASE WHEN overlap_disputed THEN 'overlap_disputed' WHEN low_canopy THEN 'low_canopy' WHEN lidar_loss THEN 'lidar_loss' WHEN near_line THEN 'near_line' ELSE 'clean' END AS first_rule,
    broader_group <> 'grass' AND NOT ({NOT_CLEAN}) AS forest_clean FROM {FLAGS_SQL}""", "labels_raw", "vegetation")
def flt_first_rule(spark, d):
    first = F.lit("clean")
    for r in reversed(RULES):
        first = F.when(F.col(r), F.lit(r)).otherwise(first)
    return screened(spark, d).select("cell_id", first.alias("first_rule"), (F.col("clean") & (F.col("broader_group") != "grass")).alias("forest_clean"))


# ---------------------------------------------------------------- scalars: text, dates, numbers


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%mixed%' THEN 'mixed' WHEN regexp_matches(lower(p_name), 'hardwood|deciduous|oak') THEN 'hardwood' WHEN regexp_matches(lower(p_name), 'pine|conifer|evergreen') THEN 'conifer'
    WHEN regexp_matches(lower(p_name), 'shrub|chaparral') THEN 'shrub' WHEN regexp_matches(lower(p_name), 'grass|herbaceous') THEN 'grass' ELSE 'other' END AS habit FROM part""")
def str_growth_habit(spark, d):
    return table(spark, d, "part").select("p_partkey", text.growth_habit(F.col("p_name")).alias("habit"))


@query("""SELECT id, max(TRY_CAST(trim(v) AS DOUBLE)) / 1000 AS kv FROM (SELECT c_custkey AS id, unnest(string_split(translate(CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_custkey || '000; 60000,bad/' || c_custkey % 9 || '0000' END, ',/', ';;'), ';')) AS v FROM customer) GROUP BY id""")
def str_voltage(spark, d):
    raw = F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_custkey || '000; 60000,bad/' || c_custkey % 9 || '0000' END")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.voltage_kv(raw).alias("kv"))


@query("SELECT id, 'e' || epoch || '_t' || lpad(CAST(resource AS VARCHAR), 4, '0') AS stem, 'e' || epoch || '_t' || lpad(CAST(resource AS VARCHAR), 4, '0') || '_chm.tif' AS chm, 'r' || least(4, greatest(0, CAST(floor(y0 / 90 * 5) AS INT))) || 'c' || least(4, greatest(0, CAST(floor(x0 / 90 * 5) AS INT))) AS stratum FROM boxes", "boxes")
def str_tile_names(spark, d):
    e = F.concat(F.lit("e"), F.col("epoch"))
    return view(spark, d, "boxes").select("id", text.tile_stem(e, F.col("resource")).alias("stem"), text.surface_names(e, F.col("resource"))["chm"].alias("chm"), text.spatial_stratum(F.col("x0"), F.col("y0"), (0, 0, 90, 90)).alias("stratum"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS line, c AS char, count(*) AS n FROM (SELECT doc_id, i, unnest(string_split(regexp_replace(l, '[\\x09\\x20-\\x7e]', '', 'g'), '')) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE c <> '' GROUP BY 1, 2, 3""")
def str_disallowed_chars(spark, d):
    return text.disallowed_chars(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT id, CASE WHEN survey_end > DATE '1995-06-17' THEN round((survey_end - DATE '1995-06-17') / 365.25, 6) END AS years, survey_end <= DATE '1996-12-31' AND DATE '1996-12-31' < DATE '1998-01-01' AS available FROM surveys", "surveys")
def dat_baseline(spark, d):
    return view(spark, d, "surveys").select("id", F.round(maths.baseline_years(F.lit("1995-06-17").cast("date"), F.col("survey_end")), 6).alias("years"), filters.available_as_of(F.col("survey_end"), F.lit("1996-12-31").cast("date"), F.lit("1998-01-01").cast("date")).alias("available"))


@query("""SELECT id, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM (SELECT id, pow(sin(radians(385e-1 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(385e-1)) * pow(sin(radians(-1225e-1 - lon) / 2), 2) AS a FROM shots)""", "shots")
def mth_haversine(spark, d):
    return view(spark, d, "shots").select("id", F.round(maths.haversine_m(F.col("lon"), F.col("lat"), F.lit(-122.5), F.lit(38.5)), 3).alias("metres"))


@query("""SELECT id, round(6378137e0 * radians(lon), 3) AS mx, round(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS my, round(lon, 6) AS lon2, round(lat, 6) AS lat2, round(1 / cos(radians(lat)), 8) AS scale FROM shots""", "shots")
def mth_web_mercator(spark, d):
    x, y = maths.to_web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = maths.from_web_mercator(x, y)
    return view(spark, d, "shots").select("id", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"), F.round(lon, 6).alias("lon2"), F.round(lat, 6).alias("lat2"), F.round(maths.mercator_scale(F.col("lat")), 8).alias("scale"))


@query("""SELECT event_id, greatest((tmax_c + tmin_c) / 2 - 10, 0e0) AS gdd, round(degrees(atan(abs(tmax_c - tmin_c) / 30)), 6) AS slope, round(cos(radians(tmax_c * 9)), 6) AS northness, round(sin(radians(tmax_c * 9)), 6) AS eastness, CASE WHEN tmax_c + tmin_c <> 0 THEN round((tmax_c - tmin_c) / (tmax_c + tmin_c), 6) END AS nd FROM daily_climate""", "daily_climate")
def mth_climate_terms(spark, d):
    a, b = F.col("tmax_c"), F.col("tmin_c")
    north, east = maths.aspect_components(a * 9)
    return view(spark, d, "daily_climate").select("event_id", maths.growing_degree_days(a, b).alias("gdd"), F.round(maths.segment_slope_deg(b, a, F.lit(30.0)), 6).alias("slope"), F.round(north, 6).alias("northness"), F.round(east, 6).alias("eastness"), F.round(maths.normalised_difference(a, b), 6).alias("nd"))


@query("""SELECT id, CASE WHEN value >= 0 THEN CASE WHEN value / 100 >= 70 THEN round(value / 100, 5) ELSE round(70 * pow(1 - (1 - pow(least(value / 100, 70) / 70, 1 / 2e0)) * exp(-4e-2 * 9), 2), 5) END END AS grown FROM cells WHERE value >= 0""", "cells")
def mth_growth_curve(spark, d):
    c = view(spark, d, "cells").where("value >= 0")
    return c.select("id", F.round(maths.chapman_richards(F.col("value") / 100, F.lit(9.0), F.lit(70.0), F.lit(0.04), F.lit(2.0)), 5).alias("grown"))


@query("""SELECT id, round(exp(-1.467 + 1.582 * cos(radians(384e-1)) * cos(s) - 1.500 * cos(a) * sin(s) * sin(radians(384e-1)) - 0.262 * sin(radians(384e-1)) * sin(s) + 0.607 * sin(a) * sin(s)), 6) AS heat FROM (SELECT id, radians(id % 46) AS s, radians(180 - abs(180 - (id * 7 % 360 + 135) % 360)) AS a FROM cells)""", "cells")
def mth_heat_load(spark, d):
    return view(spark, d, "cells").select("id", F.round(maths.heat_load(F.col("id") % 46, F.col("id") * 7 % 360, F.lit(38.4)), 6).alias("heat"))


@query("""SELECT id, (x1 - x0) * cos(radians((y0 + y1) / 2)) * (y1 - y0) * pow(11132e-2, 2) AS raw, round((x1 - x0) * cos(radians((y0 + y1) / 2)) * (y1 - y0) * 12392.1424, 3) AS km2, x0 < 50 AND 20 < x1 AND y0 < 60 AND 30 < y1 AS meets, CAST(x0 AS BIGINT) * 10000000 + CAST(y0 AS BIGINT) AS cell, CASE WHEN x1 >= 60 THEN 8e0 ELSE round(1 + 7 * (1.5 * x1 / 60 - 0.5 * pow(x1 / 60, 3)), 4) END AS gamma FROM boxes""".replace("(x1 - x0) * cos(radians((y0 + y1) / 2)) * (y1 - y0) * pow(11132e-2, 2) AS raw, ", ""), "boxes")
def mth_box_terms(spark, d):
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    other = tuple(F.lit(float(v)) for v in (20, 30, 50, 60))
    return view(spark, d, "boxes").select("id", F.round(maths.box_area_km2(*box), 3).alias("km2"), maths.boxes_intersect(box, other).alias("meets"), maths.cell_id(F.col("x0"), F.col("y0")).alias("cell"), F.round(maths.spherical(F.col("x1"), 1, 8, 60), 4).alias("gamma"))


@query("SELECT pixel, year, CASE WHEN value <> 0 THEN round((CAST(floor(value) AS INT) - 1000) / 10000e0, 4) END AS reflectance, (CAST(floor(value * 3) AS INT) & 63) = 0 AS clear FROM year_stack", "year_stack")
def mth_reflectance(spark, d):
    v = F.floor("value").cast("int")
    return view(spark, d, "year_stack").select("pixel", "year", F.round(F.when(F.col("value") != 0, maths.scaled_reflectance(v, 10000, -1000).cast("double")), 4).alias("reflectance"), maths.clear_pixel(F.floor(F.col("value") * 3).cast("int")).alias("clear"))


# ---------------------------------------------------------------- filters


@query("SELECT id FROM shots WHERE coalesce(quality_flag, 0) = 1 AND coalesce(degrade_flag, 1) = 0 AND coalesce(sensitivity, 0) >= 95e-2 AND coalesce(solar_elevation, 0) < 0", "shots")
def flt_good_shots(spark, d):
    return filters.good_shots(view(spark, d, "shots")).select("id")


@query("SELECT id, lon BETWEEN -122.8 AND -122.3 AND lat BETWEEN 38.2 AND 38.7 AS inside, lon BETWEEN -122.9 AND -122.2 AND lat BETWEEN 38.1 AND 38.8 AS near FROM shots", "shots")
def flt_box(spark, d):
    box, x, y = (-122.8, 38.2, -122.3, 38.7), F.col("lon"), F.col("lat")
    return view(spark, d, "shots").select("id", filters.inside_box(x, y, box).alias("inside"), filters.inside_box(x, y, (-122.9, 38.1, -122.2, 38.8)).alias("near"))


@query("""SELECT id, array_to_string(list_filter([CASE WHEN density IS NULL THEN 'density unknown' WHEN density < 8 THEN 'density low' END, CASE WHEN geoid IS NULL THEN 'geoid missing' END, CASE WHEN month NOT IN (5, 6, 7, 8, 9) THEN 'outside leaf-on months' END], lambda r: r IS NOT NULL), ', ') AS reasons FROM surveys""", "surveys")
def flt_admit_survey(spark, d):
    reasons = filters.admission(F.col("density"), F.col("geoid"), F.col("month"), 8, (5, 6, 7, 8, 9))
    return view(spark, d, "surveys").select("id", F.concat_ws(", ", reasons).alias("reasons"))


@query("""SELECT tile, count(*) AS cells, count(*) FILTER (start IS NOT NULL AND "end" IS NOT NULL) AS valid, count(*) FILTER (start < 5 AND "end" < 5) AS bare, count(*) FILTER ((start + "end") / 2 >= 20) AS canopy, count(*) FILTER (abs("end" - start) > 2) AS disturbed, count(*) FILTER ("end" - start < -2) AS loss,
    count(*) FILTER ((start + "end") / 2 >= 20 AND NOT "end" - start < -2) AS stratum, count(*) FILTER (abs("end" - start) <= 2) AS stable, count(*) FILTER ("end" - start BETWEEN 0 AND 3) AS clamped FROM raster GROUP BY tile""", "raster")
def flt_epoch_masks(spark, d):
    masks = filters.epoch_masks(F.col("start"), F.col("end"), 5, 20, 2)
    clamped = filters.clamped_height(F.col("end"), F.col("start"), 0, 3)
    return view(spark, d, "raster").groupBy("tile").agg(F.count("*").alias("cells"), *[F.count_if(m).alias(k) for k, m in masks.items()], F.count(clamped).alias("clamped"))


@query("SELECT classification, count(*) AS n FROM points WHERE abs(angle) <= 12 AND classification NOT IN (7, 18) GROUP BY classification", "points")
def flt_point_stages(spark, d):
    return view(spark, d, "points").where(filters.scan_angle_ok(F.col("angle"), 12) & filters.class_ok(F.col("classification"), [7, 18])).groupBy("classification").agg(F.count("*").alias("n"))


AROUND_SQL = """(SELECT c.tile, c."row", c.col, c.start, c."end", CASE WHEN count(n.start) >= 3 THEN quantile_cont(n.start, 0.5) END AS around
    FROM raster c LEFT JOIN raster n ON c.tile = n.tile AND n."row" BETWEEN c."row" - 1 AND c."row" + 1 AND n.col BETWEEN c.col - 1 AND c.col + 1 AND NOT (n."row" = c."row" AND n.col = c.col)
    GROUP BY 1, 2, 3, 4, 5)"""


@query(f'SELECT tile, "row", col, {R("around", "around")}, coalesce(start >= 40 AND around <= 30, FALSE) AS isolated, coalesce(start >= 40 AND around <= 30 AND start - "end" >= 1, FALSE) AS wire_like FROM {AROUND_SQL}', "raster")
def win_neighbour_median(spark, d):
    c = windows.neighbour_median(view(spark, d, "raster"), "start", 3, ["tile"])
    isolated, wire = filters.spikes(F.col("start"), F.col("end"), F.col("around"), 40, 30, 1)
    return c.select("tile", "row", "col", F.round("around", 4).alias("around"), isolated.alias("isolated"), wire.alias("wire_like"))


# ---------------------------------------------------------------- joins


@query("""SELECT id, match, round(dist, 3) AS distance_m FROM (SELECT s.id, g.id AS match, 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) AS dist, row_number() OVER (PARTITION BY s.id ORDER BY 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), g.id) AS k
    FROM shots s, segments g, LATERAL (SELECT pow(sin(radians(g.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - s.lon) / 2), 2) AS a)) WHERE k = 1 AND dist <= 5000""", "shots", "segments")
def join_nearest_segment(spark, d):
    got = joins.nearest_within(view(spark, d, "shots"), view(spark, d, "segments"), 5000)
    return got.select("id", "match", F.round("distance_m", 3).alias("distance_m"))


def rings(spark, d):
    s = table(spark, d, "supplier")
    x, y = F.col("s_suppkey") % 29 * 40.0, F.col("s_suppkey") % 31 * 35.0
    pts = [F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.0, 0.0), (90.0, 10.0), (50.0, 40.0), (80.0, 95.0), (5.0, 70.0))]
    return s.select(F.col("s_suppkey").cast("int").alias("polygon"), F.array(*pts).alias("points"))


EDGES_SQL = """(SELECT polygon, x + a.ax AS x1, y + a.ay AS y1, x + a.bx AS x2, y + a.by_ AS y2 FROM (SELECT CAST(s_suppkey AS INT) AS polygon, s_suppkey % 29 * 4e1 AS x, s_suppkey % 31 * 35e0 AS y FROM supplier),
    (VALUES (0e0, 0e0, 9e1, 1e1), (9e1, 1e1, 5e1, 4e1), (5e1, 4e1, 8e1, 95e0), (8e1, 95e0, 5e0, 7e1), (5e0, 7e1, 0e0, 0e0)) a(ax, ay, bx, by_))"""
HITS_SQL = f"(SELECT c.id, e.polygon FROM cells c, {EDGES_SQL} e WHERE (e.y1 > c.y) <> (e.y2 > c.y) AND c.x < (e.x2 - e.x1) * (c.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


def hits(spark, d):
    return joins.points_in_polygons(view(spark, d, "cells"), joins.edges_of(rings(spark, d)), 50.0)


@query(f"SELECT id, polygon FROM {HITS_SQL}", "cells")
def join_points_in_polygons(spark, d):
    return hits(spark, d)


@query(f"""WITH one AS (SELECT id, min(polygon) AS polygon FROM {HITS_SQL} GROUP BY id HAVING count(*) = 1),
    got AS (SELECT c.id, coalesce(o.polygon, -1) AS polygon, CASE WHEN o.polygon IS NULL THEN 'uncertain' ELSE 'k' || o.polygon % 17 END AS kind, CASE WHEN o.polygon IS NULL THEN 'other' ELSE 'g' || o.polygon % 3 END AS grp FROM cells c LEFT JOIN one o ON c.id = o.id)
    SELECT id, polygon, CASE WHEN count(*) OVER (PARTITION BY kind) < 20 AND kind <> 'uncertain' THEN 'group:' || grp ELSE kind END AS kind, grp FROM got""".replace("WITH one AS", ", one AS"))
def join_assigned_types(spark, d):
    p = F.col("polygon")
    classes = rings(spark, d).select("polygon", F.concat(F.lit("k"), p % 17).alias("kind"), F.concat(F.lit("g"), p % 3).alias("grp"))
    cells = view(spark, d, "cells")
    return joins.assigned_types(cells, joins.lone_polygons(cells, joins.edges_of(rings(spark, d)), 50.0), classes, 20)


ORACLES["join_assigned_types"] = oracle("", "cells") + ORACLES["join_assigned_types"]


@query("""SELECT id, CASE WHEN min(dist) <= 60 THEN round(min(dist), 4) END AS distance FROM (SELECT c.id, sqrt(pow(c.x - l.x1 - t * (l.x2 - l.x1), 2) + pow(c.y - l.y1 - t * (l.y2 - l.y1), 2)) AS dist
    FROM cells c, lines l, LATERAL (SELECT CASE WHEN pow(l.x2 - l.x1, 2) + pow(l.y2 - l.y1, 2) > 0 THEN least(1e0, greatest(0e0, ((c.x - l.x1) * (l.x2 - l.x1) + (c.y - l.y1) * (l.y2 - l.y1)) / (pow(l.x2 - l.x1, 2) + pow(l.y2 - l.y1, 2)))) ELSE 0e0 END AS t)) GROUP BY id""", "cells", "lines")
def join_line_distance(spark, d):
    got = joins.line_distance(view(spark, d, "cells"), view(spark, d, "lines"), 60.0)
    return got.select("id", F.round("distance", 4).alias("distance"))


@query("""SELECT c.id, r.tile, r.start AS value FROM (SELECT id, CAST(floor(x / 20) AS BIGINT) AS col, CAST(floor((900 - y) / 20) AS BIGINT) AS "row" FROM cells) c LEFT JOIN raster r ON c.col = r.col AND c."row" = r."row" """, "cells", "raster")
def join_raster_sample(spark, d):
    got = joins.sampled(view(spark, d, "cells"), view(spark, d, "raster"), 0, 900, 20, "start", ["tile"])
    return got.select("id", "tile", F.col("start").alias("value"))


@query(f"SELECT u.cell_id, coalesce(v.near, FALSE) AS near, CASE WHEN coalesce(v.near, FALSE) THEN NULL ELSE u.max_change END AS max_change FROM {UNIQUE_SQL} u LEFT JOIN (SELECT part_id, TRUE AS near FROM vegetation WHERE line_m < 10) v ON u.part_id = v.part_id", "labels_raw", "vegetation")
def join_wire_flags(spark, d):
    flags = view(spark, d, "vegetation").where("line_m < 10").select("part_id", F.lit(True).alias("near"))
    cells = joins.flagged(unique(spark, d), flags, "part_id", "near")
    return joins.blanked(cells, flags, "part_id", ["max_change"]).select("cell_id", "near", "max_change")


@query("""SELECT t.tile, list_sort(list_distinct(list('r' || b.resource))) AS resources FROM (SELECT DISTINCT CAST(s_suppkey % 40 AS INT) AS tile, s_suppkey % 40 % 8 * 12e0 AS tx0, floor(s_suppkey % 40 / 8) * 18e0 AS ty0 FROM supplier) t JOIN boxes b ON t.tx0 < b.x1 AND b.x0 < t.tx0 + 12 AND t.ty0 < b.y1 AND b.y0 < t.ty0 + 18 GROUP BY t.tile""".replace("list_sort(list_distinct(list('r' || b.resource)))", "string_agg(DISTINCT 'r' || b.resource, ';' ORDER BY 'r' || b.resource)"), "boxes")
def join_tile_resources(spark, d):
    k = F.col("s_suppkey") % 40
    tiles = table(spark, d, "supplier").select(k.cast("int").alias("tile"), (k % 8 * 12.0).alias("tx0"), (F.floor(k / 8) * 18.0).alias("ty0")).distinct()
    tiles = tiles.withColumns({"tx1": F.col("tx0") + 12, "ty1": F.col("ty0") + 18})
    files = view(spark, d, "boxes").select(F.concat(F.lit("r"), F.col("resource")).alias("resource"), F.col("x0").alias("fx0"), F.col("y0").alias("fy0"), F.col("x1").alias("fx1"), F.col("y1").alias("fy1"))
    return joins.tile_resources(tiles, files, 20.0).select("tile", F.concat_ws(";", "resources").alias("resources"))


# ---------------------------------------------------------------- aggregations


@query("SELECT segment_id, strftime(date, '%Y-%m') AS month, " + ", ".join([R("sum(prcp_mm)", "prcp_mm"), R("avg(tmax_c)", "tmax_c"), R("avg(tmin_c)", "tmin_c"), R("avg((tmax_c + tmin_c) / 2)", "tmean_c"), R("sum(greatest((tmax_c + tmin_c) / 2 - 10, 0))", "gdd")]) + " FROM daily_climate GROUP BY 1, 2", "daily_climate")
def agg_monthly_climate(spark, d):
    return rounded(aggregates.monthly_climate(view(spark, d, "daily_climate")))


@query("SELECT tile, col, CASE WHEN count(z) >= 5 THEN round(quantile_cont(z, 0.95), 4) ELSE 0 END AS canopy FROM points GROUP BY 1, 2", "points")
def agg_canopy_percentile(spark, d):
    return rounded(aggregates.canopy_percentile(view(spark, d, "points"), ["tile", "col"], "z"))


@query("SELECT year, count(*) AS total, count(v) AS valid, " + ", ".join([R("count(v) / count(*)", "share"), R("count(v) * 100 / 1e6", "area_km2"), R("min(v)", "least"), R("quantile_cont(v, 0.5)", "median"), R("quantile_cont(v, 0.95)", "p95"), R("max(v)", "greatest")]) + " FROM (SELECT year, CASE WHEN pixel % 5 > 0 THEN value END AS v FROM year_stack) GROUP BY year", "year_stack")
def agg_valid_by_year(spark, d):
    return rounded(aggregates.valid_by_year(view(spark, d, "year_stack").withColumn("value", F.when(F.col("pixel") % 5 > 0, F.col("value"))), 100))


STEPS_SQL = "(SELECT pixel, lag(year) OVER w AS from_year, year AS to_year, value - lag(value) OVER w AS change FROM year_stack WINDOW w AS (PARTITION BY pixel ORDER BY year))"


@query(f"SELECT from_year, to_year, count(change) AS valid, count(*) FILTER (change < -5) AS drops, count(*) FILTER (change > 5) AS gains FROM {STEPS_SQL} WHERE from_year IS NOT NULL GROUP BY 1, 2", "year_stack")
def agg_abrupt_changes(spark, d):
    return aggregates.abrupt_changes(view(spark, d, "year_stack"), "pixel", 5)


@query(f"SELECT arg_max(from_year, drops * 10000 - from_year) AS from_year, max(drops) AS drops FROM (SELECT from_year, count(*) FILTER (change < -5) AS drops FROM {STEPS_SQL} WHERE from_year IS NOT NULL GROUP BY 1)", "year_stack")
def agg_peak_step(spark, d):
    steps = aggregates.steps(view(spark, d, "year_stack"), "pixel").groupBy("from_year").agg(F.count_if(F.col("change") < -5).alias("drops"))
    return aggregates.peak_step(steps)


TILE_SQL = """(SELECT tile, "row", col, count(*) AS n, count(*) FILTER (classification = 2) AS n_ground, avg(z) FILTER (classification = 2) AS ground, max(z) FILTER (classification <> 2) AS top FROM points WHERE classification NOT IN (7, 18) GROUP BY 1, 2, 3)"""


@query(f'SELECT tile, "row", col, n, n_ground, {R("ground", "ground")}, {R("top", "top")}, {R("CASE WHEN top IS NOT NULL AND ground IS NOT NULL THEN greatest(top - ground, 0) END", "height")} FROM {TILE_SQL}', "points")
def agg_tile_stats(spark, d):
    return rounded(aggregates.with_height(aggregates.tile_stats(view(spark, d, "points"), ["tile", "row", "col"])))


@query(f"SELECT tile, {R('count(*) FILTER (n > 0) / 1600', 'cell_share', 6)}, {R('count(*) FILTER (n_ground > 0) / 1600', 'ground_share', 6)}, count(*) FILTER (n > 0) / 1600 >= 9e-1 AND count(*) FILTER (n_ground > 0) / 1600 >= 3e-1 AS ok FROM {TILE_SQL} GROUP BY tile", "points")
def agg_tile_validity(spark, d):
    cells = aggregates.tile_stats(view(spark, d, "points"), ["tile", "row", "col"])
    return rounded(aggregates.tile_validity(cells, 1600, 0.9, 0.3), 6)


@query("SELECT bin, label, count(v) AS n, count(v) * 1e2 AS area FROM (VALUES (0, '0-5'), (1, '5-15'), (2, '15-30'), (3, '30+')) b(bin, label) LEFT JOIN (SELECT start AS v, CASE WHEN start >= 30 THEN 3 WHEN start >= 15 THEN 2 WHEN start >= 5 THEN 1 WHEN start >= 0 THEN 0 END AS k FROM raster) r ON r.k = b.bin GROUP BY 1, 2", "raster")
def agg_class_mix(spark, d):
    return aggregates.class_mix(view(spark, d, "raster"), "start", (0, 5, 15, 30), 100.0)


@query("SELECT count(c) AS n, " + ", ".join([R("quantile_cont(c, 0.5)", "median"), R("quantile_cont(c, 0.1)", "p10"), R("quantile_cont(c, 0.9)", "p90")]) + ' FROM (SELECT "end" - start AS c FROM raster WHERE start >= 10)', "raster")
def agg_change_summary(spark, d):
    return rounded(aggregates.change_summary(view(spark, d, "raster").withColumn("change", F.col("end") - F.col("start")), "change", F.col("start") >= 10))


@query("SELECT tile, count(v) AS n, " + ", ".join([R("avg(v)", "mean"), R("quantile_cont(v, 0.5)", "median"), R("stddev_samp(v)", "sd"), R("quantile_cont(v, 0.05)", "p5"), R("quantile_cont(v, 0.95)", "p95")]) + ' FROM (SELECT tile, "end" - start AS v FROM raster) GROUP BY tile', "raster")
def agg_summary(spark, d):
    return rounded(aggregates.summary(view(spark, d, "raster").withColumn("v", F.col("end") - F.col("start")), "v", ["tile"]))


@query("SELECT tile, count(v) AS n, " + ", ".join([R("quantile_cont(v, 0.5)", "median"), R("quantile_cont(v, 0.95)", "p95"), *[R(f"avg(CASE WHEN v > {t} THEN 1e0 WHEN v <= {t} THEN 0e0 END)", f"over_{t}") for t in (2, 5, 10)]]) + ' FROM (SELECT tile, "end" AS v FROM raster) GROUP BY tile', "raster")
def agg_height_summary(spark, d):
    return rounded(aggregates.height_summary(view(spark, d, "raster"), "end", ["tile"]))


@query('SELECT tile, round(1.4826 * mad(v), 4) AS nmad, count(v) AS n FROM (SELECT tile, "end" - start AS v FROM raster) GROUP BY tile', "raster")
def agg_normalised_mad(spark, d):
    return rounded(aggregates.normalised_mad(view(spark, d, "raster").withColumn("v", F.col("end") - F.col("start")), "v", ["tile"]))


@query("SELECT tile, " + ", ".join([R("coalesce(avg(CASE WHEN v < -2 THEN 1e0 WHEN v IS NOT NULL THEN 0e0 END), 0)", "loss_share", 6), R("coalesce(avg(CASE WHEN v > 2 THEN 1e0 WHEN v IS NOT NULL THEN 0e0 END), 0)", "gain_share", 6)]) + ' FROM (SELECT tile, "end" - start AS v FROM raster) GROUP BY tile', "raster")
def agg_disturbance(spark, d):
    return rounded(aggregates.disturbance(view(spark, d, "raster").withColumn("v", F.col("end") - F.col("start")), "v", 2, ["tile"]), 6)


@query("SELECT " + ", ".join([R("quantile_cont(start, 0.5)", "median_a"), R('quantile_cont("end", 0.5)', "median_b"), R('regr_slope(start, "end")', "slope", 6), R('quantile_cont(start - "end", 0.5)', "offset")]).replace("AS offset", 'AS "offset"') + ' FROM raster WHERE start IS NOT NULL AND "end" IS NOT NULL', "raster")
def agg_agreement(spark, d):
    got = aggregates.agreement(view(spark, d, "raster"), "start", "end")
    return got.select(F.round("median_a", 4).alias("median_a"), F.round("median_b", 4).alias("median_b"), F.round("slope", 6).alias("slope"), F.round("offset", 4).alias("offset"))


@query("SELECT kind, count(*) AS n FROM (SELECT 's' || id % 37 AS kind FROM cells) GROUP BY kind HAVING count(*) < 41", "cells")
def agg_stratum_shortfall(spark, d):
    return aggregates.stratum_shortfall(view(spark, d, "cells").select(F.concat(F.lit("s"), F.col("id") % 37).alias("kind")), "kind", 41)


@query("SELECT key, count(*) FILTER (near AND flag) AS observed, round(count(*) FILTER (control AND flag) / count(*) FILTER (control) * count(*) FILTER (near), 6) AS expected FROM (SELECT id % 50 AS key, value > 5000 AS flag, x < 300 AS near, x > 600 AS control FROM cells) GROUP BY key HAVING count(*) FILTER (near) > 0 AND count(*) FILTER (control) > 0", "cells")
def agg_expected_counts(spark, d):
    c = view(spark, d, "cells").withColumn("key", F.col("id") % 50)
    return rounded(aggregates.expected_counts(c, "key", F.col("value") > 5000, F.col("x") < 300, F.col("x") > 600), 6)


@query("SELECT lo AS low, hi AS high, count(c.id) AS n, round(avg(CAST(c.value > 5000 AS INT)), 6) AS rate FROM (VALUES (0e0, 1e2), (1e2, 3e2), (3e2, 7e2), (7e2, 15e2)) b(lo, hi) LEFT JOIN cells c ON c.x >= lo AND c.x < hi GROUP BY 1, 2", "cells")
def agg_distance_profile(spark, d):
    c = view(spark, d, "cells")
    return rounded(aggregates.distance_profile(c, F.col("value") > 5000, F.col("x"), (0, 100, 300, 700, 1500)), 6)


@query('SELECT count(*) FILTER (a) AS first, count(*) FILTER (b) AS second, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second FROM (SELECT start > 30 AS a, coalesce("end" > 30, FALSE) AS b FROM raster)', "raster")
def agg_persistence(spark, d):
    return aggregates.persistence(view(spark, d, "raster"), F.col("start") > 30, filters.sure(F.col("end") > 30))


@query("SELECT kind, count(*) AS cells, CASE WHEN kind IN ('BUILDING', 'MACHINERY') THEN count(*) FILTER (value >= CASE kind WHEN 'BUILDING' THEN 4000 ELSE 6000 END) END AS saturated, CASE WHEN kind IN ('BUILDING', 'MACHINERY') THEN round(avg(CAST(value >= CASE kind WHEN 'BUILDING' THEN 4000 ELSE 6000 END AS INT)), 6) END AS share FROM cells GROUP BY kind", "cells")
def agg_saturation(spark, d):
    return rounded(aggregates.saturation(view(spark, d, "cells"), "kind", "value", {"BUILDING": 4000, "MACHINERY": 6000}), 6)


@query("SELECT pixel, CASE WHEN count(*) >= 3 THEN round(regr_slope(value, year), 4) END AS trend FROM year_stack GROUP BY pixel", "year_stack")
def agg_trend(spark, d):
    return rounded(aggregates.cell_trend(view(spark, d, "year_stack"), "pixel"))


@query("SELECT segment_id, strftime(date, '%Y-%m') AS month, round(quantile_cont(CASE WHEN event_type NOT IN ('error', 'view') THEN prcp_mm END, 0.5), 4) AS composite, CAST(count(CASE WHEN event_type NOT IN ('error', 'view') THEN prcp_mm END) AS INT) AS clear FROM daily_climate GROUP BY 1, 2", "daily_climate")
def agg_monthly_composite(spark, d):
    obs = view(spark, d, "daily_climate").withColumn("month", F.date_format("date", "yyyy-MM"))
    return rounded(aggregates.monthly_composite(obs, ["segment_id", "month"], "prcp_mm", "event_type", ["error", "view"]))


@query("SELECT tile, count(*) AS n, " + ", ".join([R("avg(abs(e))", "mae"), R("sqrt(avg(e * e))", "rmse"), R("avg(e)", "bias"), R("1 - sum(e * e) / (var_pop(t) * count(*))", "r2")]) + ' FROM (SELECT tile, "end" AS t, start - "end" AS e FROM raster WHERE "end" IS NOT NULL) GROUP BY tile', "raster")
def agg_errors(spark, d):
    return rounded(aggregates.errors(view(spark, d, "raster"), "end", "start", ["tile"]))


@query("SELECT round(sum(label * weight) / sum(weight), 8) AS prevalence FROM scores", "scores")
def agg_prevalence(spark, d):
    return rounded(aggregates.prevalence(view(spark, d, "scores"), "label", "weight"), 8)


@query("""SELECT p.tile, p.col, p.n, p.n_ground, p.apex, p.apex_class, p.second, h.classes FROM (SELECT tile, col, count(*) AS n, count(*) FILTER (classification = 2) AS n_ground, max(z) AS apex, list(classification ORDER BY z DESC, ret, classification DESC)[1] AS apex_class, list(z ORDER BY z DESC)[2] AS second FROM points GROUP BY 1, 2) p
    JOIN (SELECT tile, col, string_agg(printf('%02d:%d', classification, c), ';' ORDER BY printf('%02d:%d', classification, c)) AS classes FROM (SELECT tile, col, classification, count(*) AS c FROM points GROUP BY 1, 2, 3) GROUP BY 1, 2) h ON p.tile = h.tile AND p.col = h.col""".replace("p.apex, p.apex_class, p.second", "round(p.apex, 6) AS apex, round(p.second, 6) AS second"), "points")
def agg_point_summary(spark, d):
    return rounded(aggregates.point_summary(view(spark, d, "points"), ["tile", "col"]).drop("apex_class"), 6)


# ---------------------------------------------------------------- windows and ranking


@query("SELECT id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rank_avg FROM scores", "scores")
def win_average_rank(spark, d):
    return windows.ranked(view(spark, d, "scores"), "score").select("id", "rank_avg")


@query("SELECT lang, round(corr(a, b), 6) AS spearman FROM (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS a, rank() OVER (PARTITION BY lang ORDER BY weight) + (count(*) OVER (PARTITION BY lang, weight) - 1) / 2 AS b FROM scores) GROUP BY lang", "scores")
def win_spearman(spark, d):
    return rounded(windows.spearman(view(spark, d, "scores"), "score", "weight", ["lang"]), 6)


CURVE_SQL = "(SELECT *, sum(weight) OVER w / sum(weight) OVER () AS budget, sum(label * weight) OVER w / sum(label * weight) OVER () AS recall FROM scores WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))"


def scored(spark, d):
    return windows.gain_curve(view(spark, d, "scores"), "score", "label", "weight", "id")


@query(f"SELECT id, round(budget, 8) AS budget, round(recall, 8) AS recall FROM {CURVE_SQL}", "scores")
def win_gain_curve(spark, d):
    return scored(spark, d).select("id", F.round("budget", 8).alias("budget"), F.round("recall", 8).alias("recall"))


@query(f"SELECT round(coalesce(max(recall), 0), 8) AS recall, round(sum(label * weight) / sum(weight), 8) AS precision_at FROM {CURVE_SQL} WHERE budget <= 3e-1", "scores")
def win_at_budget(spark, d):
    return rounded(windows.at_budget(scored(spark, d), 0.3, "label", "weight").withColumnRenamed("precision", "precision_at"), 8)


@query(f"""SELECT round(sum((x - px) * (y + py) / 2) / 2e-1, 8) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS px, lag(y) OVER (ORDER BY x) AS py FROM (
    SELECT g.x, CASE WHEN lo.b IS NULL THEN 0e0 WHEN hi.b IS NULL OR hi.b = lo.b THEN lo.r ELSE lo.r + (hi.r - lo.r) / (hi.b - lo.b) * (g.x - lo.b) END AS y
    FROM (SELECT i * 2e-1 / 511 AS x FROM range(512) t(i)) g LEFT JOIN LATERAL (SELECT max(budget) AS b, max(recall) AS r FROM {CURVE_SQL} c WHERE c.budget <= g.x) lo ON TRUE LEFT JOIN LATERAL (SELECT min(budget) AS b, min(recall) AS r FROM {CURVE_SQL} c WHERE c.budget >= g.x) hi ON TRUE))""", "scores")
def win_gain_area(spark, d):
    return rounded(windows.gain_area(scored(spark, d)), 8)


GRAD_SQL = """(SELECT tile, "row", col, CASE WHEN col = min(col) OVER t THEN (CASE WHEN lead(col) OVER h = col + 1 THEN lead(start) OVER h END - start) / 10 WHEN col = max(col) OVER t THEN (start - CASE WHEN lag(col) OVER h = col - 1 THEN lag(start) OVER h END) / 10 ELSE (CASE WHEN lead(col) OVER h = col + 1 THEN lead(start) OVER h END - CASE WHEN lag(col) OVER h = col - 1 THEN lag(start) OVER h END) / 20 END AS e,
    CASE WHEN "row" = min("row") OVER t THEN (CASE WHEN lead("row") OVER v = "row" + 1 THEN lead(start) OVER v END - start) / 10 WHEN "row" = max("row") OVER t THEN (start - CASE WHEN lag("row") OVER v = "row" - 1 THEN lag(start) OVER v END) / 10 ELSE (CASE WHEN lead("row") OVER v = "row" + 1 THEN lead(start) OVER v END - CASE WHEN lag("row") OVER v = "row" - 1 THEN lag(start) OVER v END) / 20 END AS s
    FROM raster WINDOW t AS (PARTITION BY tile), h AS (PARTITION BY tile, "row" ORDER BY col), v AS (PARTITION BY tile, col ORDER BY "row"))"""


@query(f'SELECT tile, "row", col, {R("degrees(atan(sqrt(e * e + s * s)))", "slope_deg")} FROM {GRAD_SQL}', "raster")
def win_slope(spark, d):
    return windows.slope_aspect(view(spark, d, "raster"), "start", 10, ["tile"]).select("tile", "row", "col", F.round("slope_deg", 4).alias("slope_deg"))


@query("SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, id) AS k FROM cells) WHERE k <= 7 AND id % 2 = 1", "cells")
def win_first_of_each(spark, d):
    c = view(spark, d, "cells")
    return windows.first_of_each(c, ["kind"], [F.col("value").desc(), F.col("id")], 7, c.where("id % 2 = 0").select("id"), ["id"]).select("id", "kind")


# ---------------------------------------------------------------- sampling, folds, sets


@query("SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || id), id) AS k FROM cells) WHERE k <= 12", "cells")
def srt_sample_per_stratum(spark, d):
    return windows.first_of_each(view(spark, d, "cells"), ["kind"], [sampling.hash_order(F.col("id")), F.col("id")], 12).select("id", "kind")


@query()
def srt_stratified_sample(spark, d):
    return sampling.stratified_sample(view(spark, d, "cells"), "kind", "id", 60).select("id", "kind")


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY value, id) - 1 AS k, count(*) OVER () AS n FROM cells) WHERE k IN (SELECT CAST(floor(i * (SELECT count(*) FROM cells) / 40) AS BIGINT) FROM range(40) t(i))", "cells")
def srt_spread(spark, d):
    return sampling.spread(view(spark, d, "cells"), ["value", "id"], 40).select("id")


BLOCK_SQL = "(SELECT *, CAST(floor((y - (SELECT min(y) FROM cells)) / 100) * (floor(((SELECT max(x) FROM cells) - (SELECT min(x) FROM cells)) / 100) + 1) + floor((x - (SELECT min(x) FROM cells)) / 100) AS BIGINT) AS block FROM cells)"


@query(f"SELECT block, CAST((row_number() OVER (ORDER BY md5('42:' || block), block) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT block FROM {BLOCK_SQL})", "cells")
def srt_systematic_folds(spark, d):
    return sampling.systematic_folds(sampling.blocks(view(spark, d, "cells"), "x", "y", 100), "block", 5)


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY floor(x / 90), floor(y / 90) ORDER BY id) AS k FROM cells) WHERE k = 1", "cells")
def srt_grid_thinning(spark, d):
    return sampling.grid_thinned(view(spark, d, "cells"), 90.0, [F.col("id")]).select("id")


@query("SELECT id, 'customer' AS origin FROM cells UNION ALL SELECT id, 'supplier' FROM segments", "cells", "segments")
def set_concatenated(spark, d):
    return sets.concatenated([view(spark, d, "cells").select("id", F.lit("customer").alias("origin")), view(spark, d, "segments").select("id", F.lit("supplier").alias("origin"))])


@query("SELECT DISTINCT geoid FROM surveys WHERE geoid IS NOT NULL", "surveys")
def set_identifiers(spark, d):
    return sets.identifiers(view(spark, d, "surveys"), "geoid")


@query("SELECT resource, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY resource", "boxes")
def set_box_union(spark, d):
    return sets.box_union(view(spark, d, "boxes"), ["resource"])


@query("SELECT k, CASE WHEN a < c AND b < e THEN a END AS x0, CASE WHEN a < c AND b < e THEN b END AS y0, CASE WHEN a < c AND b < e THEN c END AS x1, CASE WHEN a < c AND b < e THEN e END AS y1 FROM (SELECT id % 1000 AS k, max(x0) AS a, max(y0) AS b, min(x1) AS c, min(y1) AS e FROM boxes GROUP BY 1)", "boxes")
def set_box_intersection(spark, d):
    return sets.box_intersection(view(spark, d, "boxes").withColumn("k", F.col("id") % 1000), ["k"])


CELLS_SQL = "(SELECT DISTINCT epoch, i, j FROM boxes, range(0, 60) a(i), range(0, 60) b(j) WHERE i * 2 >= x0 AND (i + 1) * 2 <= x1 AND j * 2 >= y0 AND (j + 1) * 2 <= y1)"


@query(f"SELECT epoch, i, j FROM {CELLS_SQL}", "boxes")
def set_covered_cells(spark, d):
    return sets.covered_cells(view(spark, d, "boxes"), 2.0, ["epoch"])


@query(f"SELECT CAST(floor(i / 2) AS BIGINT) AS ti, CAST(floor(j / 2) AS BIGINT) AS tj FROM (SELECT i, j FROM {CELLS_SQL} GROUP BY 1, 2 HAVING count(*) = 5) GROUP BY 1, 2 HAVING count(*) = 4", "boxes")
def set_co_covered_tiles(spark, d):
    return sets.co_covered_tiles(view(spark, d, "boxes"), "epoch", 5, 2.0, 2)


# ---------------------------------------------------------------- rasters


@query("""SELECT tile, CAST(floor("row" / 4) AS BIGINT) AS "row", CAST(floor(col / 4) AS BIGINT) AS col, CASE WHEN count("end") >= 8 THEN round(quantile_cont("end", 0.95), 4) END AS "end", count("end") AS n_valid FROM raster GROUP BY 1, 2, 3""".replace("GROUP BY 1, 2, 3", 'GROUP BY tile, floor("row" / 4), floor(col / 4)'), "raster")
def ras_block_reduce(spark, d):
    return rounded(raster.block_reduced(view(spark, d, "raster"), 4, "p95", 0.5, ["tile"], value="end"))


@query("""SELECT tile, f AS factor, CAST(floor("row" / f) AS BIGINT) AS "row", CAST(floor(col / f) AS BIGINT) AS col, CASE WHEN count("end") >= 5e-1 * f * f AND count(start) >= 5e-1 * f * f THEN round(avg("end") - avg(start), 4) END AS difference FROM raster, (VALUES (2), (5), (10)) s(f) GROUP BY tile, f, floor("row" / f), floor(col / f)""", "raster")
def ras_difference_ladder(spark, d):
    return rounded(raster.ladder_difference(view(spark, d, "raster"), "start", "end", (2, 5, 10), 0.5, ["tile"]))


@query("""SELECT tile, f AS factor, CAST(floor("row" / f) AS BIGINT) AS "row", CAST(floor(col / f) AS BIGINT) AS col, CASE WHEN count(start) >= 25e-2 * f * f THEN round(avg(start), 4) END AS start FROM raster, (VALUES (1), (3), (9)) s(f) GROUP BY tile, f, floor("row" / f), floor(col / f)""", "raster")
def ras_ladder(spark, d):
    return rounded(raster.ladder(view(spark, d, "raster"), (1, 3, 9), "mean", 0.25, ["tile"], "start"))


TARGETS = {"mean_start": "avg(start)", "mean_end": 'avg("end")', "p95_start": "quantile_cont(start, 0.95)", "p95_end": 'quantile_cont("end", 0.95)', "max_start": "max(start)", "max_end": 'max("end")'}


@query('SELECT tile, CAST(floor("row" / 5) AS BIGINT) AS "row", CAST(floor(col / 5) AS BIGINT) AS col, round(count(start) / 25, 4) AS valid_start, round(count("end") / 25, 4) AS valid_end, '
    + ", ".join(f"""CASE WHEN count({'start' if k.endswith('start') else '"end"'}) >= 25 * 3e-1 THEN round({v}, 4) END AS {k}""" for k, v in TARGETS.items())
    + ", CASE WHEN count(start) >= 25 * 3e-1 THEN round(avg(CASE WHEN start >= 30 THEN 1e0 ELSE 0e0 END), 4) END AS canopy_share, round(count(*) FILTER (\"end\" - start < -3) / nullif(count(\"end\"), 0), 4) AS loss_share, "
    + ", ".join(f"""CASE WHEN count(start) >= 25 * 3e-1 AND count("end") >= 25 * 3e-1 THEN round({TARGETS[k + '_end']} - {TARGETS[k + '_start']}, 4) END AS {k}_change""" for k in ("mean", "p95", "max"))
    + ' FROM raster GROUP BY tile, floor("row" / 5), floor(col / 5)', "raster")
def ras_cell_targets(spark, d):
    return rounded(raster.cell_targets(view(spark, d, "raster"), 5, 0.3, 30, 3, ["tile"]))


@query("""SELECT r.tile, r."row", r.col, CASE WHEN count(n.start) = 4 THEN round(sum(n.start * w.w), 4) END AS start FROM raster r, (VALUES (0, 0, 3e-1), (0, 1, 2e-1), (-1, 0, 3e-1), (-1, 1, 2e-1)) w(dr, dc, w) LEFT JOIN raster n ON n.tile = r.tile AND n."row" = r."row" + w.dr AND n.col = r.col + w.dc GROUP BY 1, 2, 3""", "raster")
def ras_shift_bilinear(spark, d):
    return rounded(raster.shifted(view(spark, d, "raster"), 4.0, 5.0, 10.0, ["tile"], "start"))


@query("""SELECT r.tile, r."row", r.col, CASE WHEN count(n.start) = 13 THEN round(r.start - avg(n.start), 4) END AS tpi FROM raster r, (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE dr * dr + dc * dc <= 4) o
    LEFT JOIN raster n ON n.tile = r.tile AND n."row" = r."row" + o.dr AND n.col = r.col + o.dc GROUP BY r.tile, r."row", r.col, r.start""", "raster")
def ras_disk_difference(spark, d):
    return rounded(raster.disk_difference(view(spark, d, "raster"), 2, 32, "start", ["tile"]))


@query('SELECT tile, "row", col, CASE WHEN greatest(start, "end", start * 9e-1) BETWEEN 2 AND 45 THEN greatest(start, "end", start * 9e-1) END AS top FROM raster', "raster")
def ras_pit_free(spark, d):
    return view(spark, d, "raster").select("tile", "row", "col", raster.pit_free([F.col("start"), F.col("end"), F.col("start") * 0.9], 2, 45).alias("top"))


@query()
def ras_shift_estimate(spark, d):
    cells = windows.slope_aspect(view(spark, d, "raster"), "start", 10, ["tile"]).withColumn("difference", F.col("end") - F.col("start"))
    return raster.shift_system(cells, 1, 80)


# ---------------------------------------------------------------- estimators and models


@query("""SELECT scale, n, round(mean, 4) AS mean, round(nmad, 4) AS nmad, round(sd, 4) AS sd, round(1.96 * nmad, 4) AS lod95, admitted, round(-regr_slope(ln(nmad), 2 * ln(scale / 10)) FILTER (admitted) OVER (), 4) AS decay,
    round(exp(regr_intercept(ln(nmad), 2 * ln(scale / 10)) FILTER (admitted) OVER ()), 4) AS base_sigma, round(regr_r2(ln(nmad), 2 * ln(scale / 10)) FILTER (admitted) OVER (), 4) AS decay_r2
    FROM (SELECT *, n >= 30 AND nmad > 0 AS admitted FROM (SELECT f * 10 AS scale, count(d) AS n, avg(d) AS mean, 1.4826 * mad(d) AS nmad, stddev_samp(d) AS sd FROM (SELECT f, CASE WHEN count("end") >= 5e-1 * f * f AND count(start) >= 5e-1 * f * f THEN avg("end") - avg(start) END AS d FROM raster, (VALUES (1), (2), (4)) s(f) GROUP BY tile, f, floor("row" / f), floor(col / f)) WHERE d IS NOT NULL GROUP BY f))""", "raster")
def sta_noise_table(spark, d):
    rungs = raster.ladder_difference(view(spark, d, "raster"), "start", "end", (1, 2, 4), 0.5, ["tile"]).where("difference is not null")
    got = stats.noise_table(rungs.select((F.col("factor") * 10).alias("scale"), F.col("difference").alias("delta")), 10, 30)
    return rounded(got)


@query("""SELECT CAST(floor(h / 20) AS BIGINT) AS bin, count(*) AS n, round(avg(h), 4) AS distance, round(avg(pow(a - b, 2)) / 2, 4) AS gamma FROM (
    SELECT sqrt(o.dr * o.dr + o.dc * o.dc) * 10 AS h, p.start AS a, q.start AS b FROM raster p, (SELECT dr, dc FROM range(0, 9) a(dr), range(-8, 9) b(dc) WHERE (dr > 0 OR dc > 0) AND dr * dr + dc * dc < 81) o
    JOIN raster q ON q.tile = p.tile AND q."row" = p."row" + o.dr AND q.col = p.col + o.dc) GROUP BY 1""", "raster")
def sta_variogram(spark, d):
    pairs = stats.raster_pairs(view(spark, d, "raster"), 10, 90, ["tile"], "start")
    return rounded(stats.variogram(pairs, 20, 90))


FOLD_SQL = "(SELECT *, CAST(md5_number_lower('') * 0 + block % 5 AS INT) AS fold FROM (SELECT c.*, 1e-2 * value AS s, 1e-2 * value + id % 13 AS e, CASE WHEN id % 7 = 0 THEN 'group:mixed' ELSE kind END AS type, 'g' || id % 2 AS grp FROM {b} c))".replace("md5_number_lower('') * 0 + ", "").replace("{b}", BLOCK_SQL)


def growth(spark, d):
    c = sampling.blocks(view(spark, d, "cells"), "x", "y", 100)
    return c.select("*", (F.col("value") * 0.01).alias("s"), (F.col("value") * 0.01 + F.col("id") % 13).alias("e"), F.when(F.col("id") % 7 == 0, "group:mixed").otherwise(F.col("kind")).alias("type"), F.concat(F.lit("g"), F.col("id") % 2).alias("grp"), (F.col("block") % 5).cast("int").alias("fold"))


@query(f"SELECT t.type, t.grp, CASE WHEN own THEN 'type:' || t.type ELSE 'group:' || t.grp END AS scope, round(CASE WHEN own THEN t.m ELSE g.m END, 4) AS increment, t.n FROM (SELECT type, grp, quantile_cont(e - s, 0.5) AS m, count(*) AS n, count(*) >= 100 AND NOT starts_with(type, 'group:') AS own FROM {FOLD_SQL} GROUP BY 1, 2) t JOIN (SELECT grp, quantile_cont(e - s, 0.5) AS m FROM {FOLD_SQL} GROUP BY 1) g ON t.grp = g.grp".replace("t.type, t.grp, CASE", "t.type, CASE"), "cells")
def ml_median_prior(spark, d):
    return rounded(models.median_prior(growth(spark, d), "type", "grp", "s", "e", 100))


@query(f"""SELECT r.id, round(r.s + CASE WHEN t.n >= 100 AND NOT starts_with(r.type, 'group:') THEN t.m ELSE g.m END, 4) AS predicted FROM {FOLD_SQL} r
    LEFT JOIN (SELECT f, type, count(*) AS n, quantile_cont(e - s, 0.5) AS m FROM {FOLD_SQL}, range(5) k(f) WHERE fold <> f GROUP BY 1, 2) t ON r.fold = t.f AND r.type = t.type
    LEFT JOIN (SELECT f, grp, quantile_cont(e - s, 0.5) AS m FROM {FOLD_SQL}, range(5) k(f) WHERE fold <> f GROUP BY 1, 2) g ON r.fold = g.f AND r.grp = g.grp""", "cells")
def ml_fold_prior(spark, d):
    return models.fold_prior(growth(spark, d), "fold", 5, "type", "grp", "s", "e", 100).select("id", F.round("predicted", 4).alias("predicted"))


@query()
def ml_growth_curves(spark, d):
    c = growth(spark, d).where("s > 0")
    grown = maths.chapman_richards(F.col("s"), F.lit(9.0), F.lit(120.0), F.lit(0.03), F.lit(1.8))
    return models.fitted_curves(c.select(F.col("kind").alias("scope"), "s", grown.alias("e"), F.lit(120.0).alias("top")), "scope", "s", "e", 9.0, "top")


@query()
def sta_block_bootstrap(spark, d):
    """Cross-fitted prior against no change, with the BCa interval over blocks."""
    scored_ = models.fold_prior(growth(spark, d), "fold", 5, "type", "grp", "s", "e", 100)
    sums = stats.block_sums(scored_, "block", F.col("predicted") - F.col("e"), F.col("s") - F.col("e"))
    return spark.createDataFrame([stats.paired_block_bootstrap(sums)])


# ---------------------------------------------------------------- sources and streams


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def src_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT id, CASE WHEN value >= 0 THEN value END AS value FROM cells""", "cells")
def src_nan_to_null(spark, d):
    return files.nan_to_null(view(spark, d, "cells").select("id", F.when(F.col("value") >= 0, F.col("value")).otherwise(float("nan")).alias("value")))


def polylines(spark, d):
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return view(spark, d, "lines").select("line", F.array(F.array(x1, y1), F.array(x2, y2), F.array(x2 + 30, y2 + 40)).alias("points"))


@query("""SELECT line, row_number() OVER (PARTITION BY line ORDER BY edge, k) - 1 AS segment, round(a + (k + 5e-1) / n * (b - a), 4) AS x, round(len / n, 4) AS length FROM (SELECT *, greatest(1, ceil(len / 12)) AS n FROM (
    SELECT line, 0 AS edge, x1 AS a, x2 AS b, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM lines UNION ALL SELECT line, 1, x2, x2 + 30, 50e0 FROM lines) WHERE len > 0), LATERAL (SELECT unnest(range(CAST(n AS BIGINT))) AS k)""", "lines")
def arr_segmented(spark, d):
    got = catalogues.segmented(polylines(spark, d), 12.0)
    return got.select("line", F.col("segment").cast("long").alias("segment"), F.round("x", 4).alias("x"), F.round("length", 4).alias("length"))


@query("""SELECT line, count(*) AS n FROM (SELECT line, greatest(1, ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 7)) + 9 AS n FROM lines), LATERAL (SELECT unnest(range(CAST(n AS BIGINT)))) GROUP BY line""", "lines")
def arr_densified(spark, d):
    return catalogues.densified(polylines(spark, d), 7.0).groupBy("line").agg(F.count("*").alias("n"))


@query()
def src_power_spans(spark, d):
    """Ways of a nested map document, cut at their supports."""
    el = lambda kind, ident, **kw: F.struct(F.lit(kind).alias("type"), ident.cast("long").alias("id"), kw.get("lon", F.lit(None).cast("double")).alias("lon"), kw.get("lat", F.lit(None).cast("double")).alias("lat"), kw.get("nodes", F.lit(None).cast("array<bigint>")).alias("nodes"), kw["tags"].alias("tags"))
    s = view(spark, d, "segments")
    node = lambda k: el("node", F.col("id") * 10 + k, lon=F.col("lon") + k / 100, lat=F.col("lat"), tags=F.create_map(F.lit("power"), F.lit("tower" if k == 2 else "line")))
    way = el("way", F.col("id"), nodes=F.transform(F.array(*[F.lit(k) for k in range(5)]), lambda k: (F.col("id") * 10 + k).cast("long")), tags=F.create_map(F.lit("voltage"), F.lit("115000;60000")))
    docs = s.select(F.to_json(F.struct(F.array(*[node(k) for k in range(5)], way).alias("elements"))).alias("json"))
    return rounded(catalogues.spans(catalogues.power_lines(docs)), 6)


WEEKS_SQL = "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS from_time, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2"


@query(f"SELECT strftime(from_time, '%Y-%m-%d') AS from_day, event_type, n, total, mean FROM ({WEEKS_SQL})")
def str_windowed_batch(spark, d):
    got = rounded(climate.windowed(table(spark, d, "events"), ("event_type",), width="7 days"))
    return got.select(F.date_format("from_time", "yyyy-MM-dd").alias("from_day"), "event_type", "n", "total", "mean")


@query(f"SELECT strftime(from_time, '%Y-%m-%d') AS from_day, event_type, n, total, mean FROM ({WEEKS_SQL}) WHERE from_time + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_windowed(spark, d):
    """The same through a stream: windows that the watermark has closed."""
    out, mark = files.shared_path(spark, "stream"), files.shared_path(spark, "stream-state")
    climate.run(climate.windowed(climate.events(spark, f"{d}/events.parquet"), ("event_type",), width="7 days"), out, mark).awaitTermination()
    got = rounded(spark.read.schema("from_time timestamp, event_type string, n long, total double, mean double").parquet(out))
    return got.select(F.date_format("from_time", "yyyy-MM-dd").alias("from_day"), "event_type", "n", "total", "mean")


@query("""SELECT p_partkey, CASE WHEN f IN ('conifer forest', 'hardwood forest') THEN f WHEN f IN ('shrub', 'riparian shrub', 'non-native shrub') THEN 'shrub' WHEN f IN ('herbaceous', 'herbaceous wetland') THEN 'grass'
    WHEN f IN ('mixed conifer-hardwood forest', 'non-native forest') AND regexp_matches(n, '^(pseudotsuga|sequoia|pinus|hesperocyparis)') THEN 'conifer forest' WHEN f IN ('mixed conifer-hardwood forest', 'non-native forest') AND regexp_matches(n, '^(quercus|eucalyptus)') THEN 'hardwood forest'
    WHEN f = 'riparian forest' AND n LIKE 'populus%' THEN 'hardwood forest' ELSE 'other' END AS grp FROM (SELECT p_partkey, ['conifer forest', 'riparian shrub', 'herbaceous', 'mixed conifer-hardwood forest', 'riparian forest', 'non-native forest', NULL][CAST(p_partkey % 7 AS INT) + 1] AS f, ['pinus x', 'quercus y', 'populus z', 'other'][CAST(p_partkey % 4 AS INT) + 1] AS n FROM part)""")
def str_broad_group(spark, d):
    form = F.get(F.array(*[F.lit(v) for v in ("Conifer Forest", "riparian shrub", "herbaceous", "mixed conifer-hardwood forest", "riparian forest", "non-native forest", None)]), (F.col("p_partkey") % 7).cast("int"))
    name = F.get(F.array(*[F.lit(v) for v in ("Pinus x", "quercus y", "Populus z", "other")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.broad_group(name, form).alias("grp"))


USABLE = '(start + "end") / 2 >= {c} AND abs("end" - start) <= {l}'


@query('SELECT round(count("end") * 1e-4, 6) AS valid_km2, round(count(*) FILTER (("end" + start) / 2 >= 20) * 1e-4, 6) AS canopy_km2, round(count(*) FILTER ("end" - start < -2) * 1e-4, 6) AS loss_km2, 0e0 AS burned_km2, round(count(*) FILTER (' + USABLE.format(c=20, l=2) + ') * 1e-4, 6) AS usable_km2, '
    + ", ".join(f"round(quantile_cont(\"end\" - start, {p}) FILTER ({USABLE.format(c=20, l=2)}), 6) AS {n}" for p, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))) + ", count(*) FILTER (" + USABLE.format(c=20, l=2) + ") * 1e-4 >= 1e-1 AS go FROM raster", "raster")
def job_pair_summary(spark, d):
    return rounded(jobs.pair_summary(view(spark, d, "raster"), {"bare_max": 5, "canopy_min": 20, "limit": 2}, 1e-4, 0.1), 6)


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, {v}e0 AS value, round(count(*) FILTER (" + USABLE.format(c=v if k == "canopy_min" else 20, l=v if k == "limit" else 2) + f") * 1e-4, 6) AS usable_km2, count(*) FILTER (" + USABLE.format(c=v if k == "canopy_min" else 20, l=v if k == "limit" else 2) + ") * 1e-4 >= 1e-1 AS go FROM raster" for k, v in (("canopy_min", 10), ("canopy_min", 30), ("limit", 1), ("limit", 3))), "raster")
def job_sensitivity(spark, d):
    return rounded(jobs.sensitivity(view(spark, d, "raster"), {"bare_max": 5, "canopy_min": 20, "limit": 2}, {"canopy_min": (10, 30), "limit": (1, 3)}, 1e-4, 0.1), 6)


@query()
def ml_fold_curves(spark, d):
    c = growth(spark, d).where("s > 0").select("id", "fold", F.col("kind").alias("type"), "grp", "s", maths.chapman_richards(F.col("s"), F.lit(9.0), F.lit(120.0), F.lit(0.03), F.lit(1.8)).alias("e"))
    return models.fold_curves(c, "fold", 5, "type", "grp", "s", "e", 9.0, {"BUILDING": 120.0, "FURNITURE": 120.0}, 50).select("id", F.round("predicted", 2).alias("predicted"))


# ---------------------------------------------------------------- frames, plans and surfaces

ZONE = projection.frame(32610)
T_SQL = f"sinh(atanh(sin(p)) - {ZONE.e!r} * atanh({ZONE.e!r} * sin(p)))"
XI = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(ZONE.alpha, 1)]])
ETA = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(ZONE.alpha, 1)]])


@query(f"""SELECT id, round(500000 + {ZONE.k0 * ZONE.rectifying!r} * ({XI}), 3) AS x, round({ZONE.k0 * ZONE.rectifying!r} * ({ETA}), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM (
    SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS eta FROM (SELECT *, {T_SQL} AS t FROM (SELECT id, lon, lat, radians(lat) AS p, radians(lon + 123) AS dl FROM segments)))""", "segments")
def geo_projection(spark, d):
    """Points into a zone of the transverse Mercator; the way back must give the degrees they came from."""
    there = projection.placed(view(spark, d, "segments").select("id", "lon", "lat"), ZONE, "lon", "lat", ("x", "y")).select("id", "x", "y")
    back = projection.placed(there, ZONE, "x", "y", ("lon", "lat"), inverse=True)
    return back.select("id", *[F.round(c, n).alias(c) for c, n in (("x", 3), ("y", 3), ("lon", 8), ("lat", 8))])


@query("SELECT id, floor(x0 / 10) * 10 AS origin_x, floor(y0 / 10) * 10 AS origin_y, CAST(ceil((x1 - floor(x0 / 10) * 10) / 10) * 5 AS BIGINT) AS width, CAST(ceil((y1 - floor(y0 / 10) * 10) / 10) * 5 AS BIGINT) AS height FROM boxes", "boxes")
def geo_grids(spark, d):
    return geometry.grids(view(spark, d, "boxes"), 2.0, 10.0).select("id", "origin_x", "origin_y", "width", "height")


def plan_tiles(spark, d):
    k = F.col("s_suppkey") % 40
    tiles = table(spark, d, "supplier").select(k.cast("long").alias("tile"), (k % 8 * 12.0).alias("x0"), (F.floor(k / 8) * 18.0).cast("double").alias("y0")).distinct()
    return tiles.withColumns({"x1": F.col("x0") + 12, "y1": F.col("y0") + 18})


@query("""WITH cells AS (SELECT t.tile, i * 3 + j AS k, x0 + j * 4 AS cx, y0 + i * 6 AS cy FROM (SELECT DISTINCT s_suppkey % 40 AS tile, s_suppkey % 40 % 8 * 12e0 AS x0, floor(s_suppkey % 40 / 8) * 18e0 AS y0 FROM supplier) t, range(3) a(i), range(3) b(j))
    SELECT tile FROM (SELECT DISTINCT c.tile, c.k, b.o_custkey % 5 AS epoch FROM cells c JOIN orders b ON cx >= b.o_orderkey % 90 AND cy >= b.o_custkey % 90 AND cx + 4 <= b.o_orderkey % 90 + 2 + b.o_custkey % 13 AND cy + 6 <= b.o_custkey % 90 + 3 + b.o_orderkey % 11)
    GROUP BY tile HAVING count(*) = 45""")
def pln_covered_tiles(spark, d):
    """Tiles that all five epochs supply in full, cell by cell."""
    boxes = view(spark, d, "boxes").withColumn("epoch", F.col("epoch").cast("string"))
    return planning.covered_tiles(plan_tiles(spark, d), boxes, ["0", "1", "2", "3", "4"], 3).select("tile")


def cloud(spark, d):
    """Points of four tiles with a place inside their cell."""
    p = view(spark, d, "points")
    x, y = F.col("col") + F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(97)) / 97, F.lit(4000.0) - F.col("row") - F.pmod(F.col("l_partkey") * 13 + F.col("l_linenumber"), F.lit(89)) / 89
    return p.select("tile", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("x"), y.alias("y"), "z", "classification")


@query()
def srt_poisson_thinning(spark, d):
    return surfaces.poisson_thinned(cloud(spark, d), 0.8, ["id"]).select("tile", "id")


@query()
def ras_heights_above_ground(spark, d):
    got = surfaces.heights_above_ground(cloud(spark, d).withColumn("ground", F.col("classification") == 2))
    return rounded(got.select("tile", "id", "height"))


@query()
def pln_forest_check(spark, d):
    """The check after the gate, one row: the prior's and the baselines' errors."""
    settings = {"folds": 5, "seed": 42, "min_fit_cells": 100, "block_sizes_m": [100], "primary_block_m": 100, "bootstrap_draws": 500}
    rows = growth(spark, d).drop("block", "fold").withColumnsRenamed({"type": "model_group", "grp": "broader_group"})
    got = planning.forest_check(rows, settings, start="s", end="e")
    one = got["blocks"][100]
    return spark.createDataFrame([(one["cells"], one["blocks"], round(one["candidate_mae"], 6), round(one["reference_mae"], 6), round(got["intercept_only"]["candidate_mae"], 6), round(got["type_mean"]["candidate_mae"], 6))], "cells long, blocks long, prior_mae double, no_change_mae double, intercept_mae double, type_mean_mae double")

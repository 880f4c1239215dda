"""Nested catalogue documents as tables: power lines, corridors, point manifests, scene catalogues, octree hierarchies.

Each takes a frame of JSON text, so a fetch can come from files, a queue or a table; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from understory.functions.text import voltage_kv

OVERPASS = "elements array<struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>>>"
SUPPORTS = ("tower", "pole", "portal")


def power_lines(documents: DataFrame, column: str = "json") -> DataFrame:
    """(way, at, lon, lat, support, kv): the points of each way in order. Nodes that are missing are left out, then ways of under two points."""
    e = documents.select(F.explode(F.from_json(column, OVERPASS)["elements"]).alias("e")).select("e.*")
    nodes = e.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat", F.coalesce(F.col("tags")["power"].isin(*SUPPORTS), F.lit(False)).alias("support")).dropDuplicates(["node"])
    refs = e.where("type = 'way'").select(F.col("id").alias("way"), voltage_kv(F.col("tags")["voltage"]).alias("kv"), F.posexplode("nodes").alias("at", "node"))
    got = refs.join(nodes, "node")
    many = F.count("*").over(_by("way"))
    return got.withColumn("_n", many).where("_n > 1").select("way", "at", "lon", "lat", "support", "kv")


def _by(*keys: str):
    return Window.partitionBy(*keys)


def spans(points: DataFrame) -> DataFrame:
    """(way, span, lon1, lat1, lon2, lat2, points): parts of each way between supports; its ends always break."""
    w = _by("way").orderBy("at")
    last = F.max("at").over(_by("way"))
    n = points.withColumns({"_first": F.row_number().over(w) == 1, "_last": F.col("at") == last})
    n = n.withColumn("_break", (F.col("support") | F.col("_last")) & ~F.col("_first"))
    n = n.withColumn("span", F.coalesce(F.sum(F.col("_break").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    links = n.withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)})
    shift = F.when(F.col("_break"), F.col("span") + 1).otherwise(F.col("span"))
    edges = links.where("lon2 is not null").withColumn("span", shift)
    return edges.groupBy("way", "span").agg(F.min_by("lon", "at").alias("lon1"), F.min_by("lat", "at").alias("lat1"), F.max_by("lon2", "at").alias("lon2"), F.max_by("lat2", "at").alias("lat2"), (F.count("*") + 1).alias("points"))


GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def corridors(documents: DataFrame, column: str = "json") -> DataFrame:
    """(line, kv, points): one row per line of GeoJSON; a multi-line gives one per part, numbered in its id; other shapes are left out."""
    f = documents.select(F.posexplode(F.from_json(column, GEOJSON)["features"]).alias("pos", "f"))
    g, p = F.col("f.geometry"), F.col("f.properties")
    ident = F.coalesce(F.nullif(F.nullif(p["ID"], F.lit("0")), F.lit("")), F.nullif(F.nullif(p["OBJECTID"], F.lit("0")), F.lit("")), F.col("pos").cast("string"))
    kv = F.coalesce(p["VOLTAGE"].try_cast("double"), F.lit(0.0))
    one = F.when(g["type"] == "LineString", F.array(F.from_json(g["coordinates"], "array<array<double>>")))
    many = F.when(g["type"] == "MultiLineString", F.from_json(g["coordinates"], "array<array<array<double>>>"))
    rows = f.select(ident.alias("id"), kv.alias("kv"), g["type"].alias("type"), F.posexplode(F.coalesce(one, many)).alias("part", "points"))
    return rows.select(F.when(F.col("type") == "LineString", F.col("id")).otherwise(F.concat("id", F.lit("_"), "part")).alias("line"), "kv", "points")


def segmented(lines: DataFrame, length: float) -> DataFrame:
    """(line, segment, x, y, length): planar lines cut vertex by vertex into equal parts of at most ``length``; empty edges give none; numbers run on."""
    p = F.col("points")
    edges = lines.select("line", F.posexplode(F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p) - 1).alias("b"))).alias("edge", "e"))
    x1, y1, x2, y2 = (F.col("e")[k][i] for k in ("a", "b") for i in (0, 1))
    size = F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))
    n = F.greatest(F.lit(1), F.ceil(size / length)).cast("int")
    cut = edges.withColumns({"_len": size, "_n": n, "_x1": x1, "_y1": y1, "_x2": x2, "_y2": y2}).where("_len > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("_k") + 0.5) / F.col("_n")
    number = F.row_number().over(_by("line").orderBy("edge", "_k")) - 1
    return cut.select("line", number.alias("segment"), (F.col("_x1") + t * (F.col("_x2") - F.col("_x1"))).alias("x"), (F.col("_y1") + t * (F.col("_y2") - F.col("_y1"))).alias("y"), (F.col("_len") / F.col("_n")).alias("length"))


def densified(lines: DataFrame, step: float) -> DataFrame:
    """(line, x, y): points along planar lines no further apart than ``step``, vertices included."""
    p = F.col("points")
    ends = F.filter(F.arrays_zip(p.alias("a"), F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, F.size(p), 1)).alias("b")), lambda e: e["a"].isNotNull())
    e = lines.select("line", F.posexplode(ends).alias("edge", "e")).select("line", "edge", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) / step)).cast("int")
    cut = e.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    return cut.select("line", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def manifest_boxes(documents: DataFrame, column: str = "json", min_points: int = 1) -> DataFrame:
    """(filename, x0, y0, x1, y1, points) of a point manifest; entries without six bounds or with too few points are left out."""
    e = documents.select(F.explode(F.from_json(column, "array<struct<filename:string,path:string,bounds:array<double>,points:bigint>>")).alias("e")).select("e.*")
    ok = e.where((F.size("bounds") == 6) & (F.col("points") >= min_points) & F.forall("bounds", lambda b: b.isNotNull()))
    b = F.col("bounds")
    return ok.select(F.coalesce("filename", "path").alias("filename"), b[0].alias("x0"), b[1].alias("y0"), b[3].alias("x1"), b[4].alias("y1"), "points")


SCENES = "features array<struct<id:string,properties:struct<datetime:string,`eo:cloud_cover`:double,`grid:code`:string>,assets:map<string,struct<href:string>>>>"


def scenes(pages: DataFrame, assets: Sequence[str], max_cloud: float, tile: str, column: str = "json", order: str = "page") -> DataFrame:
    """(id, datetime, cloud, assets): scenes of a tile under a cloud limit (unknown cloud is over it), the last of equal ids, with the required assets."""
    f = pages.select(order, F.posexplode(F.from_json(column, SCENES)["features"]).alias("pos", "f"))
    p = F.col("f.properties")
    rows = f.select(F.col("f.id").alias("id"), p["datetime"].alias("datetime"), p["eo:cloud_cover"].alias("cloud"), p["grid:code"].alias("tile"), F.col("f.assets").alias("a"), F.struct(order, "pos").alias("o"))
    kept = rows.where((F.col("tile") == tile) & (F.col("cloud") <= max_cloud))
    last = kept.groupBy("id").agg(F.max_by(F.struct("datetime", "cloud", "a"), "o").alias("r")).select("id", "r.*")
    need = F.lit(True)
    for k in assets:
        need = need & F.col("a")[k]["href"].isNotNull()
    checked = F.when(need, F.map_from_arrays(F.array(*[F.lit(k) for k in assets]), F.array(*[F.col("a")[k]["href"] for k in assets]))).otherwise(F.raise_error(F.concat(F.lit("asset missing in "), "id")))
    return last.select("id", "datetime", "cloud", checked.alias("assets"))


def datasets(documents: DataFrame, column: str = "json") -> DataFrame:
    """(identifier, name, start, end, x0, y0, x1, y1) of a dataset catalogue whose entries may be wrapped once more; a box that isn't four numbers is null."""
    v = F.try_parse_json(F.col(column))
    entries = documents.select(F.explode(F.try_variant_get(v, "$.Datasets", "array<variant>")).alias("e"))
    d = entries.select(F.coalesce(F.try_variant_get("e", "$.Dataset", "variant"), F.col("e")).alias("d"))
    get = lambda path: F.try_variant_get("d", path, "string")
    when = F.split(F.coalesce(get("$.temporalCoverage"), F.lit("")), "/")
    box = F.transform(F.split(F.trim(get("$.spatialCoverage.geo.box")), r"\s+"), lambda x: x.try_cast("double"))
    ok = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull())
    # the corners come as latitude, longitude
    sides = {"x0": F.least(box[1], box[3]), "y0": F.least(box[0], box[2]), "x1": F.greatest(box[1], box[3]), "y1": F.greatest(box[0], box[2])}
    return d.select(F.coalesce(get("$.identifier.value"), get("$.identifier")).alias("identifier"), get("$.name").alias("name"), F.trim(when[0]).alias("start"), F.trim(F.element_at(when, -1)).alias("end"), *[F.when(ok, c).alias(k) for k, c in sides.items()])


def perimeters(documents: DataFrame, column: str = "json") -> DataFrame:
    """(name, year, acres, rings) of fire perimeters; unknown acres are zero. Rings are arrays of positions, of all parts."""
    f = documents.select(F.explode(F.from_json(column, "features array<struct<properties:struct<FIRE_NAME:string,YEAR_:string,GIS_ACRES:double>,geometry:struct<type:string,coordinates:string>>>")["features"]).alias("f"))
    p, g = F.col("f.properties"), F.col("f.geometry")
    one = F.when(g["type"] == "Polygon", F.from_json(g["coordinates"], "array<array<array<double>>>"))
    many = F.when(g["type"] == "MultiPolygon", F.flatten(F.from_json(g["coordinates"], "array<array<array<array<double>>>>")))
    return f.select(F.trim(F.coalesce(p["FIRE_NAME"], F.lit(""))).alias("name"), p["YEAR_"].try_cast("int").alias("year"), F.coalesce(p["GIS_ACRES"], F.lit(0.0)).alias("acres"), F.coalesce(one, many).alias("rings"))


def identified_types(documents: DataFrame, column: str = "json") -> DataFrame:
    """(code, name, physiognomy, habit) from identify responses: the first result; -1 and ``Unknown`` where there is none."""
    from understory.functions.text import growth_habit

    v = F.try_parse_json(F.col(column))
    get = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.results[0].attributes.{n}", "string") for n in names])
    name = F.coalesce(get("EVT_Name", "EVT_NAME"), F.lit("Unknown"))
    return documents.select(F.coalesce(get("EVT_Code", "Value").try_cast("int"), F.lit(-1)).alias("code"), name.alias("name"), F.coalesce(get("EVT_PHYS", "EVT_Phys"), F.lit("Unknown")).alias("physiognomy"), growth_habit(name).alias("habit"))


def point_metadata(documents: DataFrame, column: str = "json") -> DataFrame:
    """(points, bounds, conforming, epsg, span) of octree metadata; a document without points, bounds or reference system is an error."""
    m = F.from_json(column, "points bigint, bounds array<double>, boundsConforming array<double>, srs struct<horizontal:string>, span int")
    d = documents.select(m.alias("m")).select("m.*")
    whole = F.col("points").isNotNull() & F.col("bounds").isNotNull() & F.col("srs").isNotNull()
    return d.select(F.when(whole, F.col("points")).otherwise(F.raise_error(F.lit("metadata lacks points, bounds or srs"))).alias("points"), "bounds", F.coalesce("boundsConforming", "bounds").alias("conforming"), F.coalesce("srs.horizontal", F.lit("")).alias("epsg"), F.coalesce("span", F.lit(0)).alias("span"))


def search_url(root: str, collection: str, start: str, end: str, box: tuple[float, float, float, float], max_cloud: float, tile: str, limit: int = 100) -> str:
    """Catalogue search with the date, box and cloud predicates in the request."""
    if end < start:
        raise ValueError("dates run backwards")
    query = {"collections": collection, "datetime": f"{start}T00:00:00Z/{end}T23:59:59Z", "bbox": ",".join(map(str, box)), "filter": f"eo:cloud_cover <= {max_cloud:g} AND grid:code = '{tile}'", "filter-lang": "cql2-text", "limit": limit}
    return root + "?" + urlencode(query)


#: Cells a side of the lattice in which octree nodes meet boxes.
LATTICE = 64


def octree_nodes(spark: SparkSession, hierarchy: DataFrame, cube: tuple[float, float, float], boxes: DataFrame, depth: int) -> DataFrame:
    """(key, points, d): nodes of an octree (key ``d-x-y-z``, points) whose square meets one of the boxes, down to a depth, reached from the root.

    ``cube`` is (x0, y0, size). Each level is one join with the level above, at most ``depth`` + 1 of them.
    """
    k = F.split("key", "-")
    n = hierarchy.select("key", "points", *[k[i].cast("long").alias(c) for i, c in enumerate("dxyz")]).where(F.col("d") <= depth)
    size = F.lit(float(cube[2])) / F.pow(F.lit(2.0), F.col("d"))
    n = n.withColumns({"nx0": cube[0] + F.col("x") * size, "ny0": cube[1] + F.col("y") * size}).withColumns({"nx1": F.col("nx0") + size, "ny1": F.col("ny0") + size})
    # nodes and boxes meet in the cells of a fixed lattice over the cube
    cell = float(cube[2]) / LATTICE
    at = lambda c, o: F.greatest(F.lit(0), F.least(F.lit(LATTICE - 1), F.floor((c - o) / cell)))
    spread = lambda df, a: df.withColumn("_i", F.explode(F.sequence(at(F.col(a + "x0"), cube[0]), at(F.col(a + "x1"), cube[0])))).withColumn("_j", F.explode(F.sequence(at(F.col(a + "y0"), cube[1]), at(F.col(a + "y1"), cube[1]))))
    lim = spread(boxes.select(F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1")), "b")
    met = spread(n, "n").join(lim, ["_i", "_j"]).where("nx0 < bx1 and bx0 < nx1 and ny0 < by1 and by0 < ny1").select("key", "points", "d", "x", "y", "z").distinct()
    level = met.where("d = 0")
    out = level
    for d in range(1, depth + 1):
        up = level.select(*[F.col(c).alias(f"u{c}") for c in "xyz"])
        level = met.where(F.col("d") == d).join(up, [F.shiftright(c, 1) == F.col(f"u{c}") for c in "xyz"], "left_semi")
        out = out.unionByName(level)
    return out.select("key", "points", "d")

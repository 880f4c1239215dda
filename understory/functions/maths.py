"""Geodesy, growth, index and terrain arithmetic as Column expressions. Missing inputs give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
#: Latitude at which web mercator ends.
MERCATOR_LAT = 85.051128779806604
METRES_PER_DEGREE = 111_320.0
CELL_FACTOR = 10_000_000


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    inside = F.abs(lat) <= MERCATOR_LAT
    y = MERCATOR_M * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return F.when(inside, MERCATOR_M * F.radians(lon)), F.when(inside, y)


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)


def mercator_scale(lat: Column) -> Column:
    return 1 / F.cos(F.radians(lat))


def growing_degree_days(tmax: Column, tmin: Column, base: float = 10.0) -> Column:
    """Null when a temperature is missing, unlike ``greatest`` alone."""
    mean = (tmax + tmin) / 2 - base
    return F.when(mean.isNotNull(), F.greatest(mean, F.lit(0.0)))


def height_above_ground(z: Column, ground: Column) -> Column:
    h = z.cast("double") - ground
    return F.when(h.isNotNull(), F.greatest(h, F.lit(0.0)))


def segment_slope_deg(start: Column, end: Column, length_m: Column) -> Column:
    """Slope of a segment in degrees; zero where an input is missing or the length isn't positive."""
    return F.coalesce(F.when(length_m > 0, F.degrees(F.atan(F.abs(end - start) / length_m))), F.lit(0.0))


def aspect_components(aspect_deg: Column) -> tuple[Column, Column]:
    """(northness, eastness), zero for a missing aspect."""
    a = F.radians(aspect_deg)
    return F.coalesce(F.cos(a), F.lit(0.0)), F.coalesce(F.sin(a), F.lit(0.0))


def scaled_reflectance(dn: Column, quantification: float, offset: float = 0.0, nodata: float | None = None) -> Column:
    out = ((dn + offset) / quantification).cast("float")
    return out if nodata is None else F.when(dn != nodata, out)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, (a - b) / (a + b))


def clear_pixel(qa: Column) -> Column:
    """No fill, dilated cloud, cirrus, cloud, shadow or snow bit is set."""
    return qa.bitwiseAND(0b111111) == 0


def heat_load(slope_deg: Column, aspect_deg: Column, lat_deg: Column) -> Column:
    """Heat load index of McCune and Keon (2002), equation 1, with the aspect folded about the north-east axis."""
    s, lat = F.radians(slope_deg), F.radians(lat_deg)
    a = F.radians(180 - F.abs(180 - F.pmod(aspect_deg - 225 + 360.0, F.lit(360.0))))
    # fixed values of the published equation
    terms = -1.467 + 1.582 * F.cos(lat) * F.cos(s) - 1.500 * F.cos(a) * F.sin(s) * F.sin(lat) - 0.262 * F.sin(lat) * F.sin(s) + 0.607 * F.sin(a) * F.sin(s)
    return F.exp(terms)


def pulse_density(spacing_m: Column) -> Column:
    return 1 / (spacing_m * spacing_m)


def return_density(points: Column, area_km2: Column) -> Column:
    return points / (area_km2 * 1e6)


def poisson_radius(density: Column) -> Column:
    return F.sqrt(F.lit(0.70) / density)


def box_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area of a longitude-latitude box, corrected by the cosine of its middle latitude."""
    return (east - west) * F.cos(F.radians((south + north) / 2)) * (north - south) * (METRES_PER_DEGREE / 1000) ** 2


def boxes_intersect(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap with an inner area: touching edges don't count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def cell_id(column: Column, row: Column) -> Column:
    """One number per grid cell; both coordinates must lie in [0, 10^7)."""
    inside = (column >= 0) & (row >= 0) & (column < CELL_FACTOR) & (row < CELL_FACTOR)
    return F.when(inside, column.cast("long") * CELL_FACTOR + row.cast("long"))


def block_of(x: Column, y: Column, x0: Column, y0: Column, columns: Column, size_m: float) -> Column:
    """Row-major number of the square block of a point on a lattice that begins at (x0, y0)."""
    return (F.floor((y - y0) / size_m) * columns + F.floor((x - x0) / size_m)).cast("long")


def lod95(sigma: Column) -> Column:
    return 1.96 * sigma


def spherical(distance: Column, nugget: float, sill: float, reach: float) -> Column:
    """Spherical variogram: the nugget, then up to the sill at ``reach``."""
    h = distance / reach
    return F.when(distance >= reach, F.lit(float(sill))).otherwise(nugget + (sill - nugget) * (1.5 * h - 0.5 * h * h * h))


def chapman_richards(start: Column, years: Column, a: Column, k: Column, c: Column) -> Column:
    """Age-free growth: height after ``years`` on a Chapman-Richards curve; a height at or over the ceiling stays."""
    bad = (years <= 0) | (a <= 0) | (k <= 0) | (c <= 1) | (start < 0)
    grown = a * F.pow(1 - (1 - F.pow(F.least(start, a) / a, 1 / c)) * F.exp(-k * years), c)
    return F.when(bad, F.raise_error(F.lit("growth curve needs positive years, A and k, c over one, heights from zero"))).when(start >= a, start).otherwise(grown)


def annual_rate(delta: Column, years: Column) -> Column:
    return delta / years


def baseline_years(start: Column, end: Column) -> Column:
    """Years between two dates; null unless the second is later."""
    days = F.datediff(end, start)
    return F.when(days > 0, days / 365.25)

"""Map projections as Column expressions: transverse Mercator by Krüger's series, Lambert's conformal conic with two parallels.

A projection is an object with ``forward(lon, lat)`` and ``inverse(x, y)``, both in degrees and metres (or the unit of its radius).
Series go to the fourth power of the third flattening, which holds a transverse Mercator zone to well under a millimetre.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.functions import maths


def _sum(terms) -> Column:
    out = None
    for t in terms:
        out = t if out is None else out + t
    return out


Let = Callable[..., tuple[Column, ...]]


def same(*values: Column) -> tuple[Column, ...]:
    """Values that are used several times, written out each time."""
    return values


def placed(df: DataFrame, at, a: str, b: str, names: tuple[str, str], inverse: bool = False) -> DataFrame:
    """``df`` with the projected (or, inversely, geographic) position of (a, b). Values that are used several times are columns for a while, so each is computed once."""
    held, used = [df], []

    def let(*values: Column) -> tuple[Column, ...]:
        new = [f"_let{len(used) + k}" for k in range(len(values))]
        used.extend(new)
        held[0] = held[0].withColumns(dict(zip(new, values, strict=True)))
        return tuple(F.col(n) for n in new)

    out = (at.inverse if inverse else at.forward)(F.col(a), F.col(b), let)
    return held[0].withColumns(dict(zip(names, out, strict=True))).drop(*used)


@dataclass(frozen=True)
class TransverseMercator:
    """Meridian ``lon0`` at scale ``k0``; the origin (lon0, lat0) lies at (east, north)."""

    lon0: float
    lat0: float = 0.0
    k0: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    radius: float = 6_378_137.0
    flattening: float = 1 / 298.257222101

    @cached_property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @cached_property
    def rectifying(self) -> float:
        n = self.n
        return self.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @cached_property
    def alpha(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4

    @cached_property
    def beta(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4

    @cached_property
    def delta(self) -> tuple[float, ...]:
        n = self.n
        return 2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4

    @cached_property
    def false_north(self) -> float:
        """Northing less that of the origin's latitude on the meridian."""
        p = math.radians(self.lat0)
        chi = math.atan(math.sinh(math.atanh(math.sin(p)) - self.e * math.atanh(self.e * math.sin(p)))) if abs(self.lat0) < 90 else p
        xi = chi + sum(a * math.sin(2 * j * chi) for j, a in enumerate(self.alpha, 1))
        return self.north - self.k0 * self.rectifying * xi

    def forward(self, lon: Column, lat: Column, let: Let = same) -> tuple[Column, Column]:
        p, dl = let(F.radians(lat), F.radians(lon - self.lon0))
        (t,) = let(F.sinh(F.atanh(F.sin(p)) - self.e * F.atanh(self.e * F.sin(p))))
        xi, eta = let(F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) * F.cos(dl))))
        x = eta + _sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(self.alpha, 1))
        y = xi + _sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(self.alpha, 1))
        return self.east + self.k0 * self.rectifying * x, self.false_north + self.k0 * self.rectifying * y

    def inverse(self, x: Column, y: Column, let: Let = same) -> tuple[Column, Column]:
        eta, xi = let((x - self.east) / (self.k0 * self.rectifying), (y - self.false_north) / (self.k0 * self.rectifying))
        h = eta - _sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(self.beta, 1))
        k = xi - _sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(self.beta, 1))
        h, k = let(h, k)
        (chi,) = let(F.asin(F.sin(k) / F.cosh(h)))
        lat = chi + _sum(d * F.sin(2 * j * chi) for j, d in enumerate(self.delta, 1))
        return self.lon0 + F.degrees(F.atan2(F.sinh(h), F.cos(k))), F.degrees(lat)


@dataclass(frozen=True)
class LambertConic:
    """Standard parallels ``first`` and ``second``; (lon0, lat0) lies at (east, north)."""

    lon0: float
    lat0: float
    first: float
    second: float
    east: float = 0.0
    north: float = 0.0
    radius: float = 6_378_137.0
    flattening: float = 1 / 298.257222101

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _t(self, lat: float) -> float:
        p = math.radians(lat)
        return math.tan(math.pi / 4 - p / 2) / ((1 - self.e * math.sin(p)) / (1 + self.e * math.sin(p))) ** (self.e / 2)

    @cached_property
    def cone(self) -> tuple[float, float, float]:
        """Exponent, scale, and radius of the origin's parallel."""
        m = lambda lat: math.cos(math.radians(lat)) / math.sqrt(1 - (self.e * math.sin(math.radians(lat))) ** 2)
        n = math.sin(math.radians(self.first)) if self.first == self.second else math.log(m(self.first) / m(self.second)) / math.log(self._t(self.first) / self._t(self.second))
        f = m(self.first) / (n * self._t(self.first) ** n)
        return n, f, self.radius * f * self._t(self.lat0) ** n

    def forward(self, lon: Column, lat: Column, let: Let = same) -> tuple[Column, Column]:
        n, f, r0 = self.cone
        (p,) = let(F.radians(lat))
        t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - self.e * F.sin(p)) / (1 + self.e * F.sin(p)), F.lit(self.e / 2))
        r, theta = let(self.radius * f * F.pow(t, F.lit(n)), n * F.radians(lon - self.lon0))
        return self.east + r * F.sin(theta), self.north + r0 - r * F.cos(theta)

    def inverse(self, x: Column, y: Column, let: Let = same) -> tuple[Column, Column]:
        n, f, r0 = self.cone
        dx, dy, sign = x - self.east, r0 - (y - self.north), math.copysign(1, n)
        (t,) = let(F.pow(F.sqrt(dx * dx + dy * dy) / (self.radius * abs(f)), F.lit(1 / n)))
        p = math.pi / 2 - 2 * F.atan(t)
        for _ in range(5):
            (p,) = let(p)
            p = math.pi / 2 - 2 * F.atan(t * F.pow((1 - self.e * F.sin(p)) / (1 + self.e * F.sin(p)), F.lit(self.e / 2)))
        return self.lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / n), F.degrees(p)


class WebMercator:
    """Spherical Mercator of web maps; null beyond its last latitude."""

    def forward(self, lon: Column, lat: Column, let: Let = same) -> tuple[Column, Column]:
        return maths.to_web_mercator(lon, lat)

    def inverse(self, x: Column, y: Column, let: Let = same) -> tuple[Column, Column]:
        return maths.from_web_mercator(x, y)


class Geographic:
    def forward(self, lon: Column, lat: Column, let: Let = same) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


#: Codes of the frames that are named in settings. Zones of 6 degrees on GRS 80 (6330 to 6348 and 26901 to 26923) and WGS 84 (32601 to 32660, 32701 to 32760 in the south).
WGS84 = 1 / 298.257223563


def frame(code: int | str):
    """The projection of an EPSG code."""
    number = int(str(code).upper().removeprefix("EPSG:"))
    if number in (4326, 4269, 6318):
        return Geographic()
    if number == 3857:
        return WebMercator()
    if 6330 <= number <= 6348:  # zones 1 to 19
        return TransverseMercator(lon0=-183 + 6 * (number - 6329))
    if 26901 <= number <= 26923:
        return TransverseMercator(lon0=-183 + 6 * (number - 26900))
    if 32601 <= number <= 32660:
        return TransverseMercator(lon0=-183 + 6 * (number - 32600), flattening=WGS84)
    if 32701 <= number <= 32760:
        return TransverseMercator(lon0=-183 + 6 * (number - 32700), north=1e7, flattening=WGS84)
    raise ValueError(f"no projection for EPSG:{number}")


def operation(settings: dict, box: tuple[float, float, float, float]) -> dict:
    """The datum operation that settings pin for a study box; an error if none is pinned, or the box leaves its area of use."""
    found = settings.get("datum_operation")
    if not found:
        raise ValueError("settings pin no datum operation")
    w, s, e, n = found["area"]
    if not (w <= box[0] and s <= box[1] and box[2] <= e and box[3] <= n):
        raise ValueError("the study box leaves the operation's area of use")
    return found

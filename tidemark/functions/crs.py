"""UTM and longitude/latitude in closed form (Krüger series of sixth order in the third flattening, after Karney 2011).

NAD83 and WGS84 are taken as equal. Any other system is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.geometry import let

#: Longitude and latitude. Fixed values.
DEGREES = (4326, 4269)
#: EPSG code of zone 0 and zones of each series: WGS84 north, WGS84 south, NAD83, NAD83(2011). Fixed values.
NORTH, SOUTH, NAD83, NAD83_2011 = (32600, 60), (32700, 60), (26900, 23), (6329, 19)
#: False northing of southern zones. Fixed value.
NORTHING = 10_000_000.0
#: Semi-major axis and flattening of GRS 80; scale and false easting of UTM. Fixed values.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0

_N = FLATTENING / (2 - FLATTENING)
#: Rectifying radius.
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Series coefficients: powers of n from the first used, numerators and denominators as published. Fixed values.
_ALPHA = (
    ((1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)),
    ((13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)),
    ((61, 240), (-103, 140), (15061, 26880), (167603, 181440)),
    ((49561, 161280), (-179, 168), (6601661, 7257600)),
    ((34729, 80640), (-3418889, 1995840)),
    ((212378941, 319334400),),
)
_BETA = (
    ((1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)),
    ((1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)),
    ((17, 480), (-37, 840), (-209, 4480), (5569, 90720)),
    ((4397, 161280), (-11, 504), (-830251, 7257600)),
    ((4583, 161280), (-108847, 3991680)),
    ((20648693, 638668800),),
)


def _series(table: tuple) -> list[float]:
    return [sum(a / b * _N ** (j + i) for i, (a, b) in enumerate(row)) for j, row in enumerate(table, 1)]


ALPHA, BETA = _series(_ALPHA), _series(_BETA)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def zone_of(epsg: int) -> int | None:
    """UTM zone, negative in the south; None: longitude and latitude."""
    if epsg in DEGREES:
        return None
    for series in (NORTH, SOUTH, NAD83, NAD83_2011):
        if 1 <= epsg - series[0] <= series[1]:
            return (epsg - series[0]) * (-1 if series is SOUTH else 1)
    raise ValueError(f"EPSG:{epsg} is not supported; known: longitude and latitude, and UTM on WGS84 and NAD83")


def meridian(zone: int) -> float:
    return 6.0 * abs(zone) - 183.0


def northing(zone: int) -> float:
    return NORTHING if zone < 0 else 0.0


def to_lonlat(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of UTM coordinates."""

    def series(p: Column) -> Column:
        u, v = p["xi"], p["eta"]
        for j, b in enumerate(BETA, 1):
            u = u - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            v = v - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(u.alias("u"), v.alias("v"))

    held = let(F.struct(((y - northing(zone)) / (SCALE * RADIUS)).alias("xi"), ((x - EASTING) / (SCALE * RADIUS)).alias("eta")), series)
    # latitude from the conformal latitude: Newton's method on its tangent, three steps
    e, e2 = ECCENTRICITY, ECCENTRICITY**2

    def step(tau: Column, target: Column) -> Column:
        def improved(p: Column) -> Column:
            slope = (1 + (1 - e2) * tau * tau) / ((1 - e2) * p["root"])
            return tau + (target - p["guess"]) / F.sqrt(1 + p["guess"] * p["guess"]) * slope

        def guess(p: Column) -> Column:
            return F.struct(p["root"].alias("root"), (tau * F.sqrt(1 + p["sigma"] * p["sigma"]) - p["sigma"] * p["root"]).alias("guess"))

        root = F.sqrt(1 + tau * tau)
        return let(let(F.struct(root.alias("root"), F.sinh(e * F.atanh(e * tau / root)).alias("sigma")), guess), improved)

    def latitude(target: Column) -> Column:
        return F.atan(F.aggregate(F.sequence(F.lit(1), F.lit(3)), target / (1 - e2), lambda tau, _: step(tau, target)))

    lon = let(held, lambda p: F.degrees(F.atan2(F.sinh(p["v"]), F.cos(p["u"])))) + meridian(zone)
    return lon, F.degrees(let(let(held, lambda p: F.tan(F.asin(F.sin(p["u"]) / F.cosh(p["v"])))), latitude))


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """UTM coordinates of degrees."""
    e = ECCENTRICITY

    def angles(p: Column) -> Column:
        t = F.sinh(F.atanh(F.sin(p["phi"])) - e * F.atanh(e * F.sin(p["phi"])))
        return F.struct(t.alias("t"), p["lam"].alias("lam"))

    def conformal(p: Column) -> Column:
        return F.struct(F.atan2(p["t"], F.cos(p["lam"])).alias("u"), F.atanh(F.sin(p["lam"]) / F.sqrt(1 + p["t"] * p["t"])).alias("v"))

    def series(p: Column) -> Column:
        x, y = p["v"], p["u"]
        for j, a in enumerate(ALPHA, 1):
            x = x + a * F.cos(2 * j * p["u"]) * F.sinh(2 * j * p["v"])
            y = y + a * F.sin(2 * j * p["u"]) * F.cosh(2 * j * p["v"])
        return F.struct((EASTING + SCALE * RADIUS * x).alias("x"), (northing(zone) + SCALE * RADIUS * y).alias("y"))

    start = F.struct(F.radians(lat).alias("phi"), F.radians(lon - meridian(zone)).alias("lam"))
    out = let(let(let(start, angles), conformal), series)
    return out["x"], out["y"]


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """x, y order throughout; equal systems leave the coordinates alone."""
    a, b = zone_of(source), zone_of(target)
    if source == target or a == b:
        return x, y
    if a is None:
        return to_utm(x, y, b)
    if b is None:
        return to_lonlat(x, y, a)

    def moved(p: Column) -> Column:
        east, north = to_utm(p["lon"], p["lat"], b)
        return F.struct(east.alias("x"), north.alias("y"))

    lon, lat = to_lonlat(x, y, a)
    out = let(F.struct(lon.alias("lon"), lat.alias("lat")), moved)
    return out["x"], out["y"]


def reproject_line(line: Column, source: int, target: int) -> Column:
    if source == target:
        return line

    def moved(p: Column) -> Column:
        x, y = reproject(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(line, moved)

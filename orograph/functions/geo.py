"""Geographic and camera arithmetic as Column functions: no UDF, so all of it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
METERS_PER_DEGREE = 111320.0
EARTH_RADIUS = 6378137.0
MERCATOR_LIMIT = 85.051129
WGS84_E2 = 0.00669437999014


def number(x: float | int | str | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def bounds(lat: Column, lng: Column, radius: Column) -> Column:
    """Struct north, south, east, west of a circle; clamped to the Mercator square, without wrapping."""
    dlat = F.degrees(radius / EARTH_RADIUS)
    dlng = F.degrees(radius / (F.lit(EARTH_RADIUS) * F.cos(F.radians(clamp(lat, -89, 89)))))
    edge = lambda x: clamp(x, -MERCATOR_LIMIT, MERCATOR_LIMIT)
    return F.struct(edge(lat + dlat).alias("north"), edge(lat - dlat).alias("south"), clamp(lng + dlng, -180, 180).alias("east"), clamp(lng - dlng, -180, 180).alias("west"))


def tile_x(lng: Column, zoom: Column) -> Column:
    return ((lng + 180.0) / 360.0) * F.pow(F.lit(2.0), zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    return (F.lit(1.0) - F.ln(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)


def tile_range(b: Column, zoom: Column) -> Column:
    """Struct x_min, x_max, y_min, y_max of whole tiles over bounds."""
    n = F.pow(F.lit(2.0), zoom) - 1
    whole = lambda x: F.greatest(F.lit(0), F.least(n.cast("int"), x.cast("int")))
    return F.struct(
        whole(tile_x(b["west"], zoom)).alias("x_min"), whole(tile_x(b["east"], zoom)).alias("x_max"), whole(tile_y(b["north"], zoom)).alias("y_min"), whole(tile_y(b["south"], zoom)).alias("y_max")
    )


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * v / n))))
    lng = lambda v: v / n * 360.0 - 180.0
    return F.struct(lat(y).alias("north"), lat(y + 1).alias("south"), lng(x + 1).alias("east"), lng(x).alias("west"))


def spans(b: Column) -> tuple[Column, Column]:
    """North-south and east-west extent of bounds in metres."""
    return F.radians(b["north"] - b["south"]) * EARTH_RADIUS, F.radians(b["east"] - b["west"]) * EARTH_RADIUS * F.cos(F.radians((b["north"] + b["south"]) / 2))


def cell_size(b: Column, cells: int) -> Column:
    """Mean cell edge in metres, to one decimal."""
    ns, ew = spans(b)
    return F.bround((ns + ew) / 2 / cells, 1)


def diagonal(b: Column) -> Column:
    ns, ew = spans(b)
    return F.sqrt(ns * ns + ew * ew)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(a))


def planar(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance on a plane of METERS_PER_DEGREE at the mean latitude."""
    north = (lat2 - lat1) * METERS_PER_DEGREE
    east = (lng2 - lng1) * METERS_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(north * north + east * east)


def equirectangular(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    x = F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.lit(EARTH_RADIUS) * F.sqrt(x * x + y * y)


def destination(lat: Column, lng: Column, azimuth: Column, distance: Column) -> Column:
    a = F.radians(azimuth)
    return F.struct((lat + F.degrees(distance * F.cos(a) / EARTH_RADIUS)).alias("lat"), (lng + F.degrees(distance * F.sin(a) / (F.lit(EARTH_RADIUS) * F.cos(F.radians(lat))))).alias("lng"))


def to_enu(lat: Column, lng: Column, lat0: Column, lng0: Column) -> Column:
    return F.struct((F.radians(lng - lng0) * EARTH_RADIUS * F.cos(F.radians(lat0))).alias("e"), (F.radians(lat - lat0) * EARTH_RADIUS).alias("n"))


def from_enu(e: Column, n: Column, lat0: Column, lng0: Column) -> Column:
    return F.struct((lat0 + F.degrees(n / EARTH_RADIUS)).alias("lat"), (lng0 + F.degrees(e / (F.lit(EARTH_RADIUS) * F.cos(F.radians(lat0))))).alias("lng"))


def to_ecef(lat: Column, lng: Column, alt: Column) -> Column:
    r, p = F.radians(lat), F.radians(lng)
    n = F.lit(EARTH_RADIUS) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * F.sin(r) * F.sin(r))
    return F.struct(((n + alt) * F.cos(r) * F.cos(p)).alias("x"), ((n + alt) * F.cos(r) * F.sin(p)).alias("y"), ((n * (1 - WGS84_E2) + alt) * F.sin(r)).alias("z"))


def ecef_to_enu(dx: Column, dy: Column, dz: Column, lat0: Column, lng0: Column) -> Column:
    r, p = F.radians(lat0), F.radians(lng0)
    return F.struct(
        (-F.sin(p) * dx + F.cos(p) * dy).alias("e"),
        (-F.sin(r) * F.cos(p) * dx - F.sin(r) * F.sin(p) * dy + F.cos(r) * dz).alias("n"),
        (F.cos(r) * F.cos(p) * dx + F.cos(r) * F.sin(p) * dy + F.sin(r) * dz).alias("u"),
    )


def heading(de: Column, dn: Column) -> Column:
    """Degrees from north, clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(de, dn)), F.lit(360.0))


def pitch_from_horizon(ratio: Column, fov: Column) -> Column:
    """Pitch that puts the horizon at ``ratio`` of the height; 9:16 of the horizontal field of view is vertical."""
    return F.degrees(F.atan((ratio - 0.5) * 2 * F.tan(F.radians(fov * 9 / 32))))


def heading_delta(a: Column, b: Column) -> Column:
    d = F.abs(F.pmod(a - b, F.lit(360.0)))
    return F.least(d, F.lit(360.0) - d)


def compass(h: Column) -> Column:
    names = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.bround(h / 22.5).cast("int"), F.lit(16)) + 1).cast("int"))


def project(de: Column, dn: Column, du: Column, head: Column, pitch: Column, fov: Column) -> Column:
    """Normalised image point of an offset seen by a pinhole camera; null if behind it or out of the frame."""
    h, p = F.radians(head), F.radians(pitch)
    fn = F.sqrt(F.lit(1.0) + F.sin(p) * F.sin(p))
    fx, fy, fz = F.sin(h) / fn, F.cos(h) / fn, F.sin(p) / fn
    rn = F.sqrt(fx * fx + fy * fy)
    rx, ry = fy / rn, -fx / rn
    ux, uy, uz = ry * fz, -rx * fz, rx * fy - ry * fx
    depth = de * fx + dn * fy + du * fz
    depth = F.when(depth > 0, depth)
    x = F.lit(0.5) + (de * rx + dn * ry) / depth / (F.lit(2.0) * F.tan(F.radians(fov / 2)))
    y = F.lit(0.5) - (de * ux + dn * uy + du * uz) / depth / (F.lit(2.0) * F.tan(F.radians(fov * 9 / 32)))
    return F.when(depth.isNotNull() & x.between(0, 1) & y.between(0, 1), F.struct(x.alias("x"), y.alias("y")))


def to_pixels(e: Column, n: Column, u: Column, head: Column, pitch: Column, roll: Column, fov: Column, width: Column, height: Column) -> Column:
    """Pixel (px, py) of a local offset on a screen of ``width`` x ``height``: turned by heading, then pitch, then roll; ``fov`` is vertical. Null behind the camera."""
    h, p, r = F.radians(head), F.radians(pitch), F.radians(roll)
    side, ahead = F.cos(h) * e + F.sin(h) * n, F.cos(h) * n - F.sin(h) * e
    depth, above = F.cos(p) * ahead - F.sin(p) * u, F.sin(p) * ahead + F.cos(p) * u
    right, up = F.cos(r) * side + F.sin(r) * above, F.cos(r) * above - F.sin(r) * side
    reach = F.when(depth > 0, depth) * F.tan(F.radians(fov / 2))
    x, y = right / (reach * width / height), -up / reach
    return F.when(depth > 0, F.struct(((x + 1) / 2 * width).alias("px"), ((y + 1) / 2 * height).alias("py")))


def grid_to_geo(row: Column, col: Column, b: Column, height: int, width: int) -> Column:
    """Cell to place; the last row and column lie on the south and east bounds."""
    return F.struct(
        F.bround(b["north"] - row / F.lit(height - 1.0) * (b["north"] - b["south"]), 6).alias("lat"), F.bround(b["west"] + col / F.lit(width - 1.0) * (b["east"] - b["west"]), 6).alias("lng")
    )


def geo_to_grid(lat: Column, lng: Column, b: Column, height: int, width: int) -> Column:
    """Place to row and column, unclamped."""
    return F.struct(((b["north"] - lat) / (b["north"] - b["south"]) * (height - 1.0)).alias("row"), ((lng - b["west"]) / (b["east"] - b["west"]) * (width - 1.0)).alias("col"))


def agl_clamp(alt: Column, ground: Column, floor: Column) -> Column:
    """Altitude kept ``floor`` above ground: effective altitude, whether it was raised, clearance."""
    least = ground + floor
    effective = F.greatest(alt, least)
    return F.struct(F.bround(effective, 2).alias("effective"), (alt < least).alias("clamped"), F.bround(effective - ground, 2).alias("clearance"))

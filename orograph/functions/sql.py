"""The engine's arithmetic for SQL text: scalar functions, table functions, and a fold that takes a table.

``register`` makes them temporary functions of a session. Scalar and table
functions are SQL themselves: the optimizer puts their bodies in place, so
filters reach the scan and code is generated as for any expression.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from orograph.functions.geo import EARTH_RADIUS, MERCATOR_LIMIT

BOX = "STRUCT<north: DOUBLE, south: DOUBLE, east: DOUBLE, west: DOUBLE>"
SPAN = "STRUCT<x_min: INT, x_max: INT, y_min: INT, y_max: INT>"

SCALARS = {
    "oro_tile_x(lng DOUBLE, zoom INT) RETURNS DOUBLE": "(lng + 180.0) / 360.0 * pow(2.0D, zoom)",
    "oro_tile_y(lat DOUBLE, zoom INT) RETURNS DOUBLE": "(1.0D - ln(tan(radians(lat)) + 1.0D / cos(radians(lat))) / pi()) / 2.0D * pow(2.0D, zoom)",
    "oro_clamp(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "greatest(low, least(high, x))",
    f"oro_bounds(lat DOUBLE, lng DOUBLE, radius DOUBLE) RETURNS {BOX}": f"""named_struct(
        'north', oro_clamp(lat + degrees(radius / {EARTH_RADIUS}D), -{MERCATOR_LIMIT}D, {MERCATOR_LIMIT}D), 'south', oro_clamp(lat - degrees(radius / {EARTH_RADIUS}D), -{MERCATOR_LIMIT}D, {MERCATOR_LIMIT}D),
        'east', oro_clamp(lng + degrees(radius / ({EARTH_RADIUS}D * cos(radians(oro_clamp(lat, -89D, 89D))))), -180D, 180D), 'west', oro_clamp(lng - degrees(radius / ({EARTH_RADIUS}D * cos(radians(oro_clamp(lat, -89D, 89D))))), -180D, 180D))""",
    "oro_tile(at DOUBLE, zoom INT) RETURNS INT": "greatest(0, least(CAST(pow(2.0D, zoom) AS INT) - 1, CAST(at AS INT)))",
    f"oro_tile_range(b {BOX}, zoom INT) RETURNS {SPAN}": "named_struct('x_min', oro_tile(oro_tile_x(b.west, zoom), zoom), 'x_max', oro_tile(oro_tile_x(b.east, zoom), zoom), 'y_min', oro_tile(oro_tile_y(b.north, zoom), zoom), 'y_max', oro_tile(oro_tile_y(b.south, zoom), zoom))",
    "oro_haversine(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE) RETURNS DOUBLE": f"2.0D * {EARTH_RADIUS}D * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)))",
    "oro_destination(lat DOUBLE, lng DOUBLE, azimuth DOUBLE, meters DOUBLE) RETURNS STRUCT<lat: DOUBLE, lng: DOUBLE>": f"named_struct('lat', lat + degrees(meters * cos(radians(azimuth)) / {EARTH_RADIUS}D), 'lng', lng + degrees(meters * sin(radians(azimuth)) / ({EARTH_RADIUS}D * cos(radians(lat)))))",
    "oro_heading_delta(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "least(pmod(a - b, 360D), 360D - pmod(a - b, 360D))",
    "oro_elevation(r INT, g INT, b INT) RETURNS DOUBLE": "r * 256.0D + g + b / 256.0D - 32768.0D",
}

TABLES = {
    "oro_tiles(lat DOUBLE, lng DOUBLE, radius DOUBLE, zoom INT) RETURNS TABLE (x BIGINT, y BIGINT)": """SELECT x, y FROM (SELECT oro_tile_range(oro_bounds(lat, lng, radius), zoom) AS t),
        LATERAL explode(sequence(CAST(t.x_min AS BIGINT), CAST(t.x_max AS BIGINT))) AS a(x), LATERAL explode(sequence(CAST(t.y_min AS BIGINT), CAST(t.y_max AS BIGINT))) AS o(y)""",
    "oro_rays(lat DOUBLE, lng DOUBLE, rays INT, steps INT, meters DOUBLE) RETURNS TABLE (ray INT, step INT, at STRUCT<lat: DOUBLE, lng: DOUBLE>)": """SELECT CAST(i div steps AS INT), i % steps + 1, oro_destination(lat, lng, (i div steps) * 360.0D / rays, (i % steps + 1) * meters)
        FROM explode(sequence(0, rays * steps - 1)) AS n(i)""",
    "oro_windows(height INT, width INT, side INT, stride INT) RETURNS TABLE (r0 INT, c0 INT)": """SELECT CAST(i div ((width - side) div stride + 1) AS INT) * stride, CAST(i % ((width - side) div stride + 1) AS INT) * stride
        FROM explode(CASE WHEN height >= side AND width >= side THEN sequence(0L, ((height - side) div stride + 1) * ((width - side) div stride + 1) - 1L) ELSE array() END) AS n(i)""",
}


@udtf(returnType="part int, kind string, text string")
class Fold:
    """Adjacent rows (kind, text) of a partition in its order, joined to parts: ``oro_fold(TABLE(...) PARTITION BY key ORDER BY place)``."""

    def __init__(self) -> None:
        self.part, self.kind, self.texts = 0, None, []

    def closed(self) -> Iterator[tuple]:
        if self.part:
            yield self.part, self.kind, "".join(self.texts)

    def eval(self, row) -> Iterator[tuple]:
        if not self.part or row["kind"] != self.kind:
            yield from self.closed()
            self.part, self.kind, self.texts = self.part + 1, row["kind"], []
        self.texts.append(row["text"] or "")

    def terminate(self) -> Iterator[tuple]:
        yield from self.closed()


def register(spark: SparkSession) -> None:
    """Makes all functions known to the session, in the order in which they build on one another."""
    for head, body in (SCALARS | TABLES).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("oro_fold", Fold)

"""Distance joins by an equi-join on buckets of places, then the exact test; clearing of near repeats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions import geo


def within(left: DataFrame, right: DataFrame, radius: float, strict: bool = False, flat: bool = False) -> DataFrame:
    """Pairs of ``left`` (lat, lng) and ``right`` (lat2, lng2), with ``meters``, no farther than ``radius`` on the sphere (``flat``: on a plane at the mean latitude).

    Bands of latitude are at least the radius tall. A band has as many buckets
    around the globe as leave each wide enough at the band's highest latitude:
    one where the radius can reach over a pole. The right side is sent to three
    buckets, around the globe, in its own band and the two beside it, so the work
    grows with the pairs near each other.
    """
    angle = radius / geo.EARTH_RADIUS * (1.01 if flat else 1.0001)
    tall = math.degrees(angle) * 1.001

    def band(lat: Column) -> Column:
        return F.floor((lat + 90.0) / tall)

    def buckets(y: Column) -> Column:
        highest = F.least(F.lit(90.0), F.greatest(F.abs(y * tall - 90.0), F.abs((y + 1) * tall - 90.0)))
        share = F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians(highest))
        return F.when(share < 1, F.greatest(F.lit(1), F.floor(F.lit(360.0) / (F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 1.001)).cast("int"))).otherwise(F.lit(1))

    def bucket(lng: Column, n: Column) -> Column:
        return F.pmod(F.floor((lng + 180.0) / 360.0 * n).cast("int"), n)

    a = left.withColumn("__y", band(F.col("lat"))).withColumn("__n", buckets(F.col("__y"))).withColumn("__x", bucket(F.col("lng"), F.col("__n"))).drop("__n")
    b = right.withColumn("__y", F.explode(F.sequence(band(F.col("lat2")) - 1, band(F.col("lat2")) + 1))).withColumn("__n", buckets(F.col("__y")))
    around = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(bucket(F.col("lng2"), F.col("__n")) + d, F.col("__n"))))
    b = b.withColumn("__x", F.explode(around)).drop("__n")
    meters = (geo.planar if flat else geo.haversine)(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    pairs = a.join(b, ["__y", "__x"]).drop("__y", "__x").withColumn("meters", meters)
    return pairs.filter(F.col("meters") < radius if strict else F.col("meters") <= radius)


def greedy(rows: DataFrame, by: list[str], order: list[Column], close) -> DataFrame:
    """In order within groups, a row goes if it is ``close`` (of it and another, both structs) to one that stays.

    A group is one array, folded in generated expressions; groups must be bounded, as those of a scene or area are.
    """
    packed = F.array_sort(F.collect_list(F.struct(*[o.alias(f"__{i}") for i, o in enumerate(order)], F.struct(*rows.columns).alias("row"))))
    grouped = rows.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(F.transform(packed, lambda x: x["row"]).alias("__all"))
    start = F.filter("__all", lambda _: F.lit(False))
    kept = F.aggregate("__all", start, lambda held, v: F.when(F.exists(held, lambda t: close(v, t)), held).otherwise(F.array_append(held, v)))
    return grouped.select(F.inline(kept))

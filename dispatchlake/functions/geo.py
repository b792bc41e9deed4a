"""Distances, boxes and rings as column expressions. A coordinate of 0 counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchlake.functions import fixed

EARTH_KM = 6371.0


def present(lat: Column, lng: Column) -> Column:
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng2 - lng1)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lat: Column, lng: Column, box=fixed.GEOCODER_BOX) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring, an array of struct(x, y); edges are crossed an odd number of times."""

    def crossed(inside: Column, i: Column) -> Column:
        a, b = ring[i], F.element_at(ring, F.when(i == 0, -1).otherwise(i))
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return inside != (((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False)))

    return F.when(F.size(ring) > 2, F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(False), crossed)).otherwise(F.lit(False))


def proximity(km: Column) -> Column:
    out = F
    for below, share in fixed.PROXIMITY:
        out = out.when(km < below, F.lit(share))
    return out.otherwise(F.lit(0.0))


def in_feed_area(feed: Column, lat: Column, lng: Column) -> Column:
    """Whether a point is within the radius of its feed's area; unknown feeds have a default area."""
    areas = F.create_map(*[x for k, v in fixed.FEED_AREAS.items() for x in (F.lit(k), F.array(*map(F.lit, v[:3])))])
    area = F.coalesce(F.try_element_at(areas, feed), F.array(*map(F.lit, fixed.DEFAULT_AREA[:3])))
    return haversine_km(area[0], area[1], lat, lng) <= area[2]

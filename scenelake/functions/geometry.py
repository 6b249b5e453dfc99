"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_segment_distance(px: Column, pz: Column, x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    """Distance of a point from a segment; a segment without length is its first end."""
    dx, dz = x2 - x1, z2 - z1
    square = dx * dx + dz * dz
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (pz - z1) * dz) / F.when(square >= 1e-12, square)))
    return F.when(square < 1e-12, F.hypot(px - x1, pz - z1)).otherwise(F.hypot(px - (x1 + t * dx), pz - (z1 + t * dz)))


def polygon_distance(px: Column, pz: Column, xs: Column, zs: Column) -> Column:
    """Distance of a point from the edges of a closed polygon; null below two corners."""
    n = F.least(F.size(xs), F.size(zs))

    def edge(i: Column) -> Column:
        j = (i + 1) % n
        return point_segment_distance(px, pz, F.get(xs, i), F.get(zs, i), F.get(xs, j), F.get(zs, j))

    return F.when(n >= 2, F.array_min(F.transform(F.sequence(F.lit(0), n - 1), edge)))


def nearest_corner_distance(cx: Column, cz: Column, width: Column, depth: Column, xs: Column, zs: Column) -> Column:
    """Least distance of the four corners of a box from a polygon; null for a box without extent."""
    corners = [polygon_distance(cx + sx * width / 2, cz + sz * depth / 2, xs, zs) for sx in (-1, 1) for sz in (-1, 1)]
    return F.when((width > 0) & (depth > 0), F.least(*corners))


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def extent(values: Column) -> Column:
    """Largest less least value of an array."""
    return F.array_max(values) - F.array_min(values)


def half_extent(values: Column, least: float = 0.1) -> Column:
    """Half the extent, at least ``least``."""
    return F.greatest(extent(values) / 2, F.lit(least))


def clip(value: Column, low: float, high: float) -> Column:
    """The value held between two bounds."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def fixed_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of equal width, the last one closed; null outside."""
    inside = (value >= low) & (value <= high)
    return F.when(inside, F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long"))

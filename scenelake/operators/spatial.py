"""Box and room geometry, and robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import extent, half_extent, mean_of, nearest_corner_distance, polygon_distance

ON_FLOOR = 0.15
OBJECTS = (
    "struct<objects: array<struct<name: string, polygon: array<struct<"
    "X: array<double>, Z: array<double>, Ymin: double, Ymax: double>>>>>"
)


def first_room(objects: Column) -> Column:
    """The first polygon of an object named ``room…`` with a floor and corners; null if none."""
    usable = F.filter(
        objects,
        lambda o: F.lower(o["name"]).startswith("room")
        & (F.size(o["polygon"]) > 0)
        & F.get(o["polygon"], F.lit(0))["Ymax"].isNotNull()
        & (F.size(F.get(o["polygon"], F.lit(0))["X"]) > 0)
        & (F.size(F.get(o["polygon"], F.lit(0))["Z"]) > 0),
    )
    return F.get(F.get(usable, F.lit(0))["polygon"], F.lit(0))


def object_features(scenes: DataFrame, label: Column | None = None, on_floor: float = ON_FLOOR) -> DataFrame:
    """The 14 features of each object of ``scene``, ``annotation`` (objects) and ``layout`` (objects or null).

    Y points down. Objects without a usable polygon are dropped; scenes without
    a room keep their objects with null floor, wall and room columns.
    """
    named = label if label is not None else F.substring_index(F.col("o.name"), ":", 1)
    rows = scenes.withColumn("room", first_room(F.col("layout.objects"))).select(
        "scene", "room", F.explode("annotation.objects").alias("o")
    )
    rows = rows.select("scene", "room", named.alias("category"), F.get("o.polygon", F.lit(0)).alias("p"))
    rows = rows.where("size(p.X) > 0 and size(p.Z) > 0 and p.Ymax > p.Ymin and category is not null")
    xs, zs, wall_x, wall_z = F.col("p.X"), F.col("p.Z"), F.col("room.X"), F.col("room.Z")
    cx, cz = mean_of(xs), mean_of(zs)
    width, depth = extent(xs), extent(zs)
    above = F.col("room.Ymax") - F.col("p.Ymax")
    wall, edge = polygon_distance(cx, cz, wall_x, wall_z), nearest_corner_distance(cx, cz, width, depth, wall_x, wall_z)
    r4 = lambda c: F.round(c, 4)
    return rows.select(
        "scene",
        "category",
        r4(cx).alias("cx"),
        r4((F.col("p.Ymin") + F.col("p.Ymax")) / 2).alias("cy"),
        r4(cz).alias("cz"),
        r4(F.col("p.Ymax") - F.col("p.Ymin")).alias("height_m"),
        r4(width).alias("width_m"),
        r4(depth).alias("depth_m"),
        r4(above).alias("bottom_above_floor_m"),
        (above < on_floor).alias("on_floor"),
        r4(wall).alias("dist_to_wall_m"),
        r4(edge).alias("nearest_edge_dist_to_wall_m"),
        r4((cx - mean_of(wall_x)) / half_extent(wall_x)).alias("norm_cx"),
        r4((cz - mean_of(wall_z)) / half_extent(wall_z)).alias("norm_cz"),
    )


def percentiles(column: str, shares: list[float]) -> list[Column]:
    """Exact percentiles with linear interpolation, one column each: p05, p25, …"""
    return [F.round(F.percentile(column, F.lit(s)), 6).alias(f"p{round(100 * s):02d}") for s in shares]


def robust(column: str, prefix: str) -> list[Column]:
    """Median and interquartile range."""
    q = lambda s: F.percentile(column, F.lit(s))
    return [F.round(q(0.5), 6).alias(f"median_{prefix}"), F.round(q(0.75) - q(0.25), 6).alias(f"iqr_{prefix}")]


def spatial_summary(features: DataFrame) -> DataFrame:
    """The robust summary of each category."""
    return features.groupBy("category").agg(
        F.count("*").alias("n_objects"),
        F.count("bottom_above_floor_m").alias("n_with_floor_data"),
        *robust("bottom_above_floor_m", "bottom_above_floor_m"),
        F.round(F.avg(F.col("on_floor").cast("int")) * 100, 6).alias("pct_on_floor"),
        F.count("nearest_edge_dist_to_wall_m").alias("n_with_wall_data"),
        *robust("nearest_edge_dist_to_wall_m", "dist_to_wall_m"),
        *robust("height_m", "height_m"),
    )


def bands(summary: DataFrame) -> DataFrame:
    """Floor and wall bands of each category of a summary."""
    wall, floor = F.col("median_dist_to_wall_m"), F.col("pct_on_floor")
    return summary.select(
        "category",
        F.when(floor > 70, "floor").when(floor < 20, "elevated").otherwise("mixed").alias("floor_band"),
        F.when(wall < 0.1, "wall-contact").when(wall < 0.4, "wall-adjacent").when(wall > 1.0, "centre").otherwise("between").alias("wall_band"),
    )


def band_lists(summary: DataFrame) -> DataFrame:
    """``band``, ``n`` and the joined ``categories`` of the floor and wall bands, and of the three lowest and tallest medians."""
    of_bands = bands(summary).select(F.explode(F.array("floor_band", "wall_band")).alias("band"), "category")
    known = summary.where("median_height_m is not null")
    ends = []
    for name, order in (("shortest", F.asc("median_height_m")), ("tallest", F.desc("median_height_m"))):
        place = F.row_number().over(Window.orderBy(order, "category"))  # a row for each category
        ends.append(known.withColumn("r", place).where("r <= 3").select(F.lit(name).alias("band"), "category"))
    rows = of_bands.unionByName(ends[0]).unionByName(ends[1])
    names = F.array_join(F.sort_array(F.collect_list("category")), ", ")
    return rows.groupBy("band").agg(F.count("*").alias("n"), names.alias("categories"))


def floor_probe(features: DataFrame, category: str) -> DataFrame:
    """Median height of a category's bottoms above the floor; near 0 if the axis points as expected."""
    of = features.where(F.col("category") == category)
    return of.agg(F.count("bottom_above_floor_m").alias("n"), F.round(F.median("bottom_above_floor_m"), 3).alias("median_bottom_above_floor_m")).select(
        F.lit(category).alias("category"), "n", "median_bottom_above_floor_m"
    )


def below_floor(features: DataFrame) -> DataFrame:
    """Objects of each category with a known floor, how many of them reach below it, their share and their scenes."""
    known = features.where("bottom_above_floor_m is not null")
    below = F.col("bottom_above_floor_m") < 0
    return known.groupBy("category").agg(
        F.count("*").alias("n"),
        F.count_if(below).alias("n_below"),
        F.round(100.0 * F.count_if(below) / F.count("*"), 6).alias("pct_below"),
        F.count_distinct(F.when(below, F.col("scene"))).alias("n_scenes_below"),
    )


def stable_sample(rows: DataFrame, key: str, n: int, seed: int = 42, per: str | None = None) -> DataFrame:
    """``n`` rows (for each value of ``per``) by a hash of the key, however the rows are partitioned.

    With ``per``, each task keeps the first ``n`` of a value before the shuffle.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    if per is None:
        return rows.orderBy(order, key).limit(n)
    place = F.row_number().over(Window.partitionBy(per).orderBy(order, key))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")

"""Depth decoding, point clouds, voxels, and the decoding of detections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The pyramid level that detects each of the ten classes.
LABEL_TO_LEVEL = (1, 1, 1, 0, 0, 1, 0, 0, 1, 0)
VOXEL = 0.02


def decode_depth(pixels: DataFrame, raw: str = "depth_raw", filled: str = "depth_filled") -> DataFrame:
    """Metres of both rasters, and the masks of holes and of filled holes."""
    hole = F.col(raw) == 0
    return pixels.withColumns(
        {
            "depth_m": F.col(raw) / 10000.0,
            "filled_m": F.col(filled) / 10000.0,
            "is_hole": hole,
            "is_filled": hole & (F.col(filled) > 0),
            "inpainted_m": F.when(hole, F.col(filled) / 10000.0).otherwise(0.0),
        }
    )


def coverage(decoded: DataFrame, *keys: str) -> DataFrame:
    """Shares of valid, hole and filled pixels."""
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return decoded.groupBy(*keys).agg(
        F.count("*").alias("n_pixels"),
        share(~F.col("is_hole")).alias("valid"),
        share(F.col("is_hole")).alias("holes"),
        share(F.col("is_filled")).alias("filled"),
    )


def back_project(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, flip: bool = True) -> DataFrame:
    """``x``, ``y``, ``z`` of pixels with depth; ``flip`` turns Y up."""
    z = F.col("depth_m")
    y = (F.col("v") - cy) * z / fy
    return pixels.where("depth_m > 0").withColumns(
        {"x": (F.col("u") - cx) * z / fx, "y": -y if flip else y, "z": z}
    )


def stride_sample(rows: DataFrame, order: list[str], step: int, per: list[str]) -> DataFrame:
    """Every ``step``-th row of each group in a stated order."""
    number = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return rows.withColumn("__r", number).where((F.col("__r") - 1) % step == 0).drop("__r")


def voxel_of(value: Column, size: float = VOXEL) -> Column:
    """Voxel index, cut towards zero."""
    return (value / size).cast("long")


def voxel_means(points: DataFrame, axes: tuple[str, str, str], features: list[str], size: float = VOXEL) -> DataFrame:
    """Mean features and number of points of each voxel."""
    keys = [voxel_of(F.col(a), size).alias(n) for a, n in zip(axes, ("vx", "vy", "vz"))]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(f), 4).alias(f) for f in features])


def flat_key(vx: Column, vy: Column, vz: Column, m: Column) -> Column:
    """One number for a voxel triple, given a bound of the indices."""
    return vx * m * m + vy * m + vz


def coarser(voxels: DataFrame, levels: int) -> DataFrame:
    """Distinct voxels of each pyramid level, the coordinates halved from level to level."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    return voxels.select("*", level).select(
        "level", *[F.expr(f"shiftright({c}, level)").alias(c) for c in ("vx", "vy", "vz")]
    ).distinct()


def batch_items(voxels: DataFrame, batch: int) -> DataFrame:
    """The voxels of one item of a batch, without the batch column."""
    return voxels.where(F.col("batch") == batch).drop("batch")


def numbered(rows: DataFrame, key: str, name: str, parts: int = 200) -> DataFrame:
    """``rows`` with 0-based numbers in the order of ``key``, a number, date or time without repeats.

    Rows are cut into ranges of the key at its approximate percentiles, numbered
    within each range, and moved on by the counts of the ranges before.
    """
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)]).alias("cuts"))
    ranged = rows.crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("cuts", lambda c: c < F.col(key)))).drop("cuts")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, number).drop("__part", "__before")


def merge_levels(fine: DataFrame, deep: DataFrame, key: str, value: str) -> DataFrame:
    """Add the deeper level's rows, repeated in a cycle, to the finer level's rows, both in the order of ``key``."""
    n = deep.agg(F.count("*").alias("n_deep"))
    a = numbered(fine, key, "__r").crossJoin(F.broadcast(n)).withColumn("__k", F.col("__r") % F.col("n_deep"))
    b = numbered(deep, key, "__k").select("__k", F.col(value).alias("__deep"))
    return a.join(b, "__k").withColumn(value, F.col(value) + F.col("__deep")).drop("__r", "__k", "__deep", "n_deep")


def concat_levels(levels: list[DataFrame]) -> DataFrame:
    """The rows of all pyramid levels under one another, with their ``level``."""
    out = None
    for i, rows in enumerate(levels):
        rows = rows.withColumn("level", F.lit(i).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_colour(points: DataFrame, *channels: str) -> DataFrame:
    """Eight-bit colour channels as shares of 255."""
    return points.withColumns({c: F.col(c) / 255.0 for c in channels})


def decode_boxes(points: DataFrame, size: float = VOXEL) -> DataFrame:
    """Box centres and extents from voxel indices, offsets (d0..d2) and log extents (d3..d5)."""
    centre = [(F.col(v) * size + F.col(d)).alias(n) for v, d, n in (("vx", "d0", "cx"), ("vy", "d1", "cy"), ("vz", "d2", "cz"))]
    return points.select("*", *centre, *[F.exp(d).alias(n) for d, n in (("d3", "w"), ("d4", "h"), ("d5", "l"))])


def score_labels(rows: DataFrame, logits: str) -> DataFrame:
    """Largest sigmoid score, and the 0-based class that has it first."""
    scores = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    top = F.array_max(scores)
    return rows.select("*", top.alias("score"), (F.array_position(scores, top) - 1).cast("long").alias("label"))


def simulated_survivors(n: Column) -> Column:
    """The number of detections that the simulated suppression leaves."""
    return F.greatest(F.lit(1), F.floor(n / 20)).cast("long")


def separate(boxes: DataFrame, keys: list[str], name: str = "island") -> DataFrame:
    """``boxes`` with the number of their island: boxes of different islands of a group do not meet along x.

    In the order of the lower end, a box that begins beyond the ends of all
    before it begins an island.
    """
    low, high = F.col("cx") - F.col("w") / 2, F.col("cx") + F.col("w") / 2
    order = Window.partitionBy(*keys).orderBy(low, high, "cy", "cz")
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(low > reach, 1).otherwise(0)
    return boxes.withColumn("__new", begins).withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def suppress(boxes: DataFrame, keys: list[str], threshold: float = 0.25) -> DataFrame:
    """Greedy suppression of axis-aligned boxes by overlap, per group of keys.

    Boxes that do not meet cannot suppress one another, so a group is cut into
    islands along x, and each island is a task's work. Ties of the score go by
    centre.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "cx", "cy", "cz"], ascending=[False, True, True, True], kind="stable")
        low = (frame[["cx", "cy", "cz"]].to_numpy() - frame[["w", "h", "l"]].to_numpy() / 2)
        high = low + frame[["w", "h", "l"]].to_numpy()
        volume = (high - low).prod(1)
        kept: list[int] = []
        for i in range(len(frame)):
            if kept:
                inside = np.maximum(0, np.minimum(high[kept], high[i]) - np.maximum(low[kept], low[i])).prod(1)
                if (inside / np.maximum(volume[kept] + volume[i] - inside, 1e-12)).max() > threshold:
                    continue
            kept.append(i)
        return frame.iloc[kept]

    apart = separate(boxes, keys, "__island")
    return apart.groupBy(*keys, "__island").applyInPandas(run, apart.schema).drop("__island")


def level_table(spark: SparkSession, routing: tuple[int, ...] = LABEL_TO_LEVEL) -> DataFrame:
    """``label`` and ``level``."""
    return spark.createDataFrame([(i, level) for i, level in enumerate(routing)], "label long, level long")


def _unit(key: Column, i: int, seed: int) -> Column:
    """A number from 0 up to 1, from a digest of seed, column and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}/{i}/"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def synthetic_cloud(spark: SparkSession, n: int = 50_000, scale: float = 6.0, seed: int = 0) -> DataFrame:
    """Uniform points with colours, alike however they are partitioned."""
    names = ("x", "y", "z", "r", "g", "b")
    values = [(_unit(F.col("id"), i, seed) * (scale if i < 3 else 1.0)).alias(c) for i, c in enumerate(names)]
    return spark.range(n).select("id", *values)


def synthetic_image(spark: SparkSession, height: int = 530, width: int = 730, seed: int = 0) -> DataFrame:
    """``v``, ``u`` and eight-bit ``r``, ``g``, ``b`` of uniform noise, alike however they are partitioned."""
    place = [F.expr(f"id div {width}").alias("v"), (F.col("id") % width).alias("u")]
    values = [F.floor(_unit(F.col("id"), i, seed) * 256).alias(c) for i, c in enumerate(("r", "g", "b"), 6)]
    return spark.range(height * width).select(*place, *values)

"""Filling the holes of depth rasters by a cross-bilateral filter, in tiles with halos.

A raster is a table of pixels. In a round each hole that has enough known pixels
in its window takes their mean, weighted by distance and by likeness of the guide
image; rounds go on until no hole changes, so large holes fill from their rims.

Pixels are dealt to square tiles, and those within a window's reach of a border to
the neighbours as well: the halo. A tile with its halo is one task's array, whose
size is a parameter. Tiles without open holes take no part; what a round has filled
is in the next round's halos.

Defined results:
- a null, non-finite or non-positive depth is a hole; pixels that are not in the
  table are neither holes nor known;
- repeated pixels are one, with the least depth (so a hole if any is one) and the
  greatest guide; a null guide counts as 0;
- holes that no known pixel reaches stay null; an empty table gives no rows;
- a null image is an image; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import dropped, written

TILE = 128


def raster(pixels: DataFrame, image: str, u: str, v: str, depth: str, guide: str) -> DataFrame:
    """``image``, ``u``, ``v``, ``d`` (null in a hole) and ``g``, one row a pixel."""
    known = F.coalesce((F.col(depth) > 0) & (F.col(depth) < float("inf")) & ~F.isnan(F.col(depth).cast("double")), F.lit(False))
    rows = pixels.select(
        F.col(image).alias("image"), F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"),
        F.when(known, F.col(depth).cast("double")).alias("d"), F.coalesce(F.col(guide).cast("double"), F.lit(0.0)).alias("g"),
    )
    whole = F.count("*") == F.count("d")
    return rows.groupBy("image", "u", "v").agg(F.when(whole, F.min("d")).alias("d"), F.max("g").alias("g"))


def _windowed(d: np.ndarray, g: np.ndarray, radius: int, near: float, like: float, least: int) -> np.ndarray:
    """The filter's value at each place of a tile with halo, NaN where it gives none."""
    size = d.shape[0] - 2 * radius
    core = slice(radius, radius + size)
    total, weight, count = np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size), np.int64)
    for du in range(-radius, radius + 1):
        for dv in range(-radius, radius + 1):
            there = (slice(radius + du, radius + du + size), slice(radius + dv, radius + dv + size))
            known = ~np.isnan(d[there])
            w = np.exp(-(du * du + dv * dv) / (2 * near * near)) * np.exp(-((g[core, core] - g[there]) ** 2) / (2 * like * like))
            total += np.where(known, w * np.nan_to_num(d[there]), 0.0)
            weight += np.where(known, w, 0.0)
            count += known
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((count >= least) & (weight > 0), total / weight, np.nan)


def _with_halo(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Each pixel under its tile (``tu``, ``tv``) and under those whose halo it is in."""
    tiles = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + s) / tile) for s in (-radius, 0, radius)]))
    return rows.withColumn("tu", F.explode(tiles("u"))).withColumn("tv", F.explode(tiles("v")))


def filled_once(known: DataFrame, holes: DataFrame, radius: int, near: float, like: float, least: int, tile: int = TILE) -> DataFrame:
    """The holes that one round fills, with their depth ``d``."""
    at = [F.floor(F.col(c) / tile).alias(t) for c, t in (("u", "tu"), ("v", "tv"))]
    active = holes.select(F.col("image").alias("a_image"), *[c.alias(f"a_{t}") for c, t in zip(at, ("tu", "tv"))]).distinct()
    met = F.col("image").eqNullSafe(F.col("a_image")) & (F.col("tu") == F.col("a_tu")) & (F.col("tv") == F.col("a_tv"))
    around = _with_halo(known, radius, tile).join(active, met, "left_semi")
    rows = around.unionByName(holes.select("*", *at))
    side = tile + 2 * radius
    kind = holes.schema["image"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        u0, v0 = int(frame.tu.iloc[0]) * tile - radius, int(frame.tv.iloc[0]) * tile - radius
        d, g = np.full((side, side), np.nan), np.zeros((side, side))
        u, v = frame.u.to_numpy() - u0, frame.v.to_numpy() - v0
        d[u, v], g[u, v] = frame.d.to_numpy(float, na_value=np.nan), frame.g.to_numpy()
        value = np.full((side, side), np.nan)
        value[radius : radius + tile, radius : radius + tile] = _windowed(d, g, radius, near, like, least)
        open_ = np.isnan(d[u, v])
        out = frame.loc[open_, ["image", "u", "v", "g"]].assign(d=value[u[open_], v[open_]])
        return out[["image", "u", "v", "d", "g"]].dropna(subset=["d"])

    return rows.groupBy("image", "tu", "tv").applyInPandas(run, f"image {kind}, u long, v long, d double, g double")


def fill(pixels: DataFrame, radius: int = 2, near: float = 1.5, like: float = 20.0, least: int = 1, tile: int = TILE) -> DataFrame:
    """All pixels of a :func:`raster` with ``d`` filled and the ``round`` that filled it: 0 for known pixels, null for holes that stay."""
    if not 0 < radius <= tile:
        raise ValueError("a window must not reach beyond the next tile")
    start = written(pixels, "raster")
    parts = [start.where("d is not null").withColumn("round", F.lit(0))]
    holes = written(start.where("d is null"), "holes")
    count = 0
    while not holes.isEmpty():
        count += 1
        known = reduce(DataFrame.unionByName, parts).drop("round")
        new = written(filled_once(known, holes, radius, near, like, least, tile), "filled")
        if new.isEmpty():
            break
        parts.append(new.withColumn("round", F.lit(count)).select(*parts[0].columns))
        gone = new.select(F.col("image").alias("n_image"), F.col("u").alias("n_u"), F.col("v").alias("n_v"))
        left = holes.join(gone, F.col("image").eqNullSafe(F.col("n_image")) & (F.col("u") == F.col("n_u")) & (F.col("v") == F.col("n_v")), "left_anti")
        after = written(left, "holes")
        dropped(holes)
        holes = after
    return reduce(DataFrame.unionByName, [*parts, holes.withColumn("round", F.lit(None).cast("int"))])

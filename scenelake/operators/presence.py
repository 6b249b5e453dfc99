"""Which class occurs in which scene, and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def presence(rows: DataFrame, scene: str, label) -> DataFrame:
    """Distinct ``scene`` and ``class``; rows without either are left out."""
    label = F.col(label) if isinstance(label, str) else label
    out = rows.select(F.col(scene).alias("scene"), label.alias("class"))
    return out.where(F.col("scene").isNotNull() & F.col("class").isNotNull()).distinct()


def class_frequency(found: DataFrame, scenes: DataFrame, scene: str = "scene") -> DataFrame:
    """``rank``, ``class``, ``scene_frequency``, ``pct_of_scenes``; all scenes count, ties go by name."""
    total = scenes.agg(F.count_distinct(scene).alias("total"))
    counts = found.groupBy("class").agg(F.count("*").alias("scene_frequency"))
    order = Window.orderBy(F.desc("scene_frequency"), "class")  # over one row for each class
    return counts.crossJoin(F.broadcast(total)).select(
        F.row_number().over(order).cast("long").alias("rank"),
        "class",
        "scene_frequency",
        F.round(100.0 * F.col("scene_frequency") / F.nullif("total", F.lit(0)), 6).alias("pct_of_scenes"),
    )


def top_classes(frequency: DataFrame, n: int, excluded: list[str] | None = None) -> DataFrame:
    """The ``n`` most frequent classes after the exclusion, ranked anew."""
    kept = frequency.where(~F.col("class").isin(excluded)) if excluded else frequency
    top = kept.orderBy("rank").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long"))


def restrict(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Presence of the given classes only."""
    return found.join(classes.select("class"), "class", "left_semi").select("scene", "class")


def incidence(found: DataFrame, classes: list[str]) -> DataFrame:
    """One 0/1 column for each listed class, a row for each scene that has one of them."""
    chosen = found.where(F.col("class").isin(classes))
    wide = chosen.groupBy("scene").pivot("class", classes).agg(F.lit(1).cast("long"))
    return wide.fillna(0, classes)

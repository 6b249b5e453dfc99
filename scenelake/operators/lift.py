"""Lift of classes in categories of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lift(found: DataFrame, scenes: DataFrame) -> DataFrame:
    """``class``, ``scene_type``, ``n_scenes``, ``freq_in_type``, ``overall_freq``, ``lift`` for every combination.

    ``scenes`` holds ``scene`` and ``scene_type`` of all scenes; those without a
    known class count in the shares.
    """
    totals = scenes.groupBy("scene_type").agg(F.count("*").alias("in_type"))
    everything = scenes.agg(F.count("*").alias("total"))
    cells = found.join(scenes, "scene").groupBy("class", "scene_type").agg(F.count("*").alias("n_scenes"))
    overall = cells.groupBy("class").agg(F.sum("n_scenes").alias("f"))
    grid = overall.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(everything))  # classes by types
    out = grid.join(cells, ["class", "scene_type"], "left").fillna(0, ["n_scenes"])
    in_type, all_types = F.col("n_scenes") / F.col("in_type"), F.col("f") / F.col("total")
    return out.select(
        "class",
        "scene_type",
        "n_scenes",
        F.round(in_type, 6).alias("freq_in_type"),
        F.round(all_types, 6).alias("overall_freq"),
        F.round(F.when(all_types > 0, in_type / all_types).otherwise(0.0), 4).alias("lift"),
    )


def decisiveness(lifts: DataFrame, order: DataFrame) -> DataFrame:
    """Best less second-best lift of each class, ranked; ties keep the order of ``order`` (class, rank)."""
    by_lift = Window.partitionBy("class").orderBy(F.desc("lift"), "scene_type")
    ranked = lifts.withColumn("r", F.row_number().over(by_lift))
    gap = ranked.groupBy("class").agg(
        F.max(F.when(F.col("r") == 1, F.col("lift"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("lift"))), F.lit(0.0)).alias("second"),
    )
    gap = gap.withColumn("decisiveness", F.round(F.col("best") - F.col("second"), 4)).join(order.select("class", "rank"), "class")
    position = F.row_number().over(Window.orderBy(F.desc("decisiveness"), "rank")).cast("long")
    return gap.select("class", "best", "second", "decisiveness", position.alias("position"))


def pivot(lifts: DataFrame, types: list[str], names: list[str]) -> DataFrame:
    """One row for each class, one column for each type."""
    wide = lifts.groupBy("class").pivot("scene_type", types).agg(F.first("lift")).fillna(0.0, types)
    return wide.toDF("class", *names)


def assignment_table(lifts: DataFrame, assigned: DataFrame, types: list[str]) -> DataFrame:
    """A row for each class with its lifts as text, the assigned type's marked by ``*``, and that type."""
    wide = lifts.groupBy("class").pivot("scene_type", types).agg(F.first("lift")).fillna(0.0, types)
    rows = wide.join(assigned.select("class", F.col("scene_type").alias("assigned")), "class", "left")
    cells = [
        F.concat(F.when(F.col("assigned") == t, "*").otherwise(" "), F.format_string("%.4f", F.col(f"`{t}`"))).alias(f"lift_{i + 1}")
        for i, t in enumerate(types)
    ]
    return rows.select("class", *cells, F.coalesce("assigned", F.lit("?")).alias("assigned"))

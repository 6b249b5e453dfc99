"""Staged splits: assignment of classes, strict filters, orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lift import decisiveness

VIABLE = 50


def assign_balanced(lifts: DataFrame, order: DataFrame, types: list[str], capacity: int) -> DataFrame:
    """Give each class, the decisive ones first, its best type that has room left.

    A fold over one array of the classes; ``order`` holds ``class`` and ``rank``.
    Returns ``class``, ``scene_type``, ``position`` and ``stage_idx`` (1-based).
    """
    index = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("scene_type")).cast("int")
    choice = F.sort_array(F.collect_list(F.struct((-F.col("lift")).alias("back"), index.alias("i"))))
    choices = lifts.where(F.col("scene_type").isin(types)).groupBy("class").agg(F.transform(choice, lambda x: x["i"]).alias("to"))
    rows = decisiveness(lifts.where(F.col("scene_type").isin(types)), order).join(choices, "class")
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("position", "class", "to"))).alias("all"))
    start = F.struct(
        F.array(*[F.lit(capacity)] * len(types)).alias("room"),
        F.array().cast("array<struct<class:string,position:long,at:int>>").alias("out"),
    )

    def step(state: Column, x: Column) -> Column:
        at = F.get(F.filter(x["to"], lambda i: F.get(state["room"], i - 1) > 0), F.lit(0))
        room = F.transform(state["room"], lambda r, i: F.when(i + 1 == at, r - 1).otherwise(r))
        made = F.struct(x["class"].alias("class"), x["position"].alias("position"), at.alias("at"))
        return F.struct(room.alias("room"), F.concat(state["out"], F.array(made)).alias("out"))

    folded = listed.select(F.explode(F.aggregate("all", start, step)["out"]).alias("x"))
    named = F.get(F.array(*[F.lit(t) for t in types]), F.col("x.at") - 1)
    return folded.select("x.class", named.alias("scene_type"), "x.position", F.col("x.at").cast("long").alias("stage_idx"))


def stage_masks(found: DataFrame, scenes: DataFrame, stages: DataFrame) -> DataFrame:
    """``scene_type``, ``mask`` (bits of the stages whose classes a scene holds) and ``n`` scenes.

    One pass over the scenes; every ordering is then judged on these few rows.
    """
    bit = F.expr("shiftleft(1L, cast(stage_idx - 1 as int))").alias("bit")
    held = found.join(stages.select("class", "stage_idx"), "class").select("scene", bit)
    masks = held.groupBy("scene").agg(F.bit_or("bit").alias("mask"))
    rows = scenes.join(masks, "scene", "left").select("scene_type", F.coalesce("mask", F.lit(0)).alias("mask"))
    return rows.groupBy("scene_type", "mask").agg(F.count("*").alias("n"))


def strict_by_type(masks: DataFrame, stage_types: DataFrame) -> DataFrame:
    """Scenes of a stage's type that hold no class of a later stage.

    ``stage_types``: ``scene_type`` and ``stage_idx``, the default order.
    """
    rows = masks.join(F.broadcast(stage_types), "scene_type")
    alive = F.expr("shiftright(mask, cast(stage_idx as int)) = 0")
    out = rows.groupBy("stage_idx", "scene_type").agg(
        F.sum("n").alias("total"), F.sum(F.when(alive, F.col("n")).otherwise(0)).alias("survived")
    )
    return _losses(out)


def strict_by_presence(masks: DataFrame, n_stages: int) -> DataFrame:
    """Scenes with a class of the stage and none of a later one, whatever their type."""
    stage = masks.select(F.explode(F.sequence(F.lit(1), F.lit(n_stages))).alias("s"), "mask", "n")
    has = F.expr("shiftright(mask, s - 1) & 1 = 1")
    alive = F.expr("shiftright(mask, s - 1) = 1")
    out = stage.where(has).groupBy(F.col("s").cast("long").alias("stage_idx")).agg(
        F.sum("n").alias("total"), F.sum(F.when(alive, F.col("n")).otherwise(0)).alias("survived")
    )
    return _losses(out)


def _losses(out: DataFrame) -> DataFrame:
    lost = F.round(100.0 * (1 - F.try_divide(F.col("survived").cast("double"), F.col("total"))), 4)
    return out.withColumn("pct_lost", lost).withColumn("viable", F.col("survived") >= VIABLE)


def future_classes(stages: DataFrame) -> DataFrame:
    """Per stage its classes, and those of all later stages, as ``|``-joined text."""
    per = stages.groupBy("stage_idx").agg(F.sort_array(F.collect_list("class")).alias("own"))
    later = Window.orderBy("stage_idx").rowsBetween(1, Window.unboundedFollowing)  # a row for each stage
    return per.select(
        "stage_idx",
        F.array_join("own", "|").alias("classes"),
        F.array_join(F.sort_array(F.flatten(F.collect_list("own").over(later))), "|").alias("future"),
    )


def surviving_scenes(found: DataFrame, scenes: DataFrame, stages: DataFrame, stage_types: DataFrame) -> DataFrame:
    """``stage_idx``, ``scene_type``, ``scene`` and the ``|``-joined stage classes, in rank order, of scenes that survive."""
    held = found.join(stages.select("class", "stage_idx", "position"), "class")
    per = held.groupBy("scene").agg(
        F.max("stage_idx").alias("last"), F.sort_array(F.collect_list(F.struct("position", "class"))).alias("c")
    )
    rows = scenes.join(F.broadcast(stage_types), "scene_type").join(per, "scene", "left")
    alive = rows.where(F.coalesce("last", F.lit(0)) <= F.col("stage_idx"))
    names = F.coalesce(F.array_join(F.transform("c", lambda x: x["class"]), "|"), F.lit(""))
    return alive.select("stage_idx", "scene_type", "scene", names.alias("classes_present"))


def orderings(spark, types: list[str]) -> DataFrame:
    """``ordering`` (1-based, lexicographic by position) and ``types``, the array of an order."""
    listed = F.array(*[F.lit(t) for t in types])
    orders = F.array(F.array().cast("array<string>"))
    for _ in types:
        orders = F.flatten(
            F.transform(
                orders,
                lambda p: F.transform(F.filter(listed, lambda t: ~F.array_contains(p, t)), lambda t: F.concat(p, F.array(t))),
            )
        )
    rows = spark.range(1).select(F.posexplode(orders).alias("i", "types"))
    return rows.select((F.col("i") + 1).cast("long").alias("ordering"), "types")


def sweep(masks: DataFrame, orders: DataFrame, types: list[str]) -> DataFrame:
    """Least and total survival of every ordering.

    Bit ``i`` of a mask belongs to ``types[i]``. ``masks`` has at most
    ``len(types) * 2 ** len(types)`` rows.
    """
    steps = orders.select("ordering", "types", F.posexplode("types").alias("i", "scene_type"))
    later = F.slice("types", F.col("i") + 2, F.lit(len(types)))
    bits = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(1 << i))])
    future = F.aggregate(later, F.lit(0), lambda a, t: a + F.element_at(bits, t))
    steps = steps.select("ordering", "scene_type", future.cast("long").alias("future"))
    alive = F.when(F.expr("mask & future = 0"), F.col("n")).otherwise(0)
    per = steps.join(F.broadcast(masks), "scene_type", "left").groupBy("ordering", "scene_type").agg(
        F.coalesce(F.sum(alive), F.lit(0)).alias("survived")
    )
    return per.groupBy("ordering").agg(F.min("survived").alias("min_survived"), F.sum("survived").alias("total_survived"))


def best_ordering(swept: DataFrame) -> DataFrame:
    """The first ordering by least survival, then total, then enumeration."""
    return swept.orderBy(F.desc("min_survived"), F.desc("total_survived"), "ordering").limit(1)

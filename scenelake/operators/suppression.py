"""Greedy suppression of boxes in rounds, over pairs from a grid join.

Boxes are listed in the cells of a grid whose edge is the power of two from their
longest side up, so a box has at most eight cells; it meets boxes of its own grid and
of coarser ones. Pairs that overlap by more than the threshold have a better and a
worse box. In a round, boxes that no live better box beats stay, and the boxes they
beat go; what is left goes on. That is the result of taking all boxes one by one from
the best down, without bringing a chain of overlapping boxes to one task.

Defined results:
- the better box has the greater score, then the lesser centre, then the lesser id;
- boxes of other keys do not meet; null keys are keys; boxes with a null or
  non-finite number overlap none and stay;
- extents of zero or less have no volume and overlap none; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import dropped, written

_SIDES = (("cx", "w", "x"), ("cy", "h", "y"), ("cz", "l", "z"))


def overlapping(boxes: DataFrame, keys: list[str], threshold: float, box_id: str) -> DataFrame:
    """``better`` and ``worse``: ids of boxes of one key that overlap by more than ``threshold`` of their union."""
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    sides = [c for m, e, a in _SIDES for c in ((F.col(m) - F.col(e) / 2).alias(f"{a}0"), (F.col(m) + F.col(e) / 2).alias(f"{a}1"))]
    rank = F.struct((-F.col("score")).alias("s"), "cx", "cy", "cz", F.col(box_id).alias("i")).alias("rank")
    usable = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(F.col(c).cast("double")) for c in ("cx", "cy", "cz", "w", "h", "l", "score")])
    solid = reduce(lambda a, b: a & b, [F.col(e) > 0 for _, e, _ in _SIDES])
    level = F.ceil(F.log2(F.greatest("w", "h", "l"))).cast("int").alias("level")
    flat = written(boxes.where(usable & solid).select(F.col(box_id).alias("id"), *parts, rank, *sides, level), "boxes")
    keyed = [f"k{i}" for i in range(len(keys))]
    levels = flat.groupBy(*[F.col(k).alias(f"l_{k}") for k in keyed]).agg(F.collect_set("level").alias("levels"))  # few: powers of two
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keyed]) if keyed else F.lit(True)

    def cells(rows: DataFrame, grid) -> DataFrame:
        edge = F.pow(F.lit(2.0), grid)
        for _, _, a in _SIDES:
            rows = rows.withColumn(f"g{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / edge), F.floor(F.col(f"{a}1") / edge))))
        return rows

    there = cells(flat.withColumn("grid", F.col("level")), F.col("level"))
    asks = flat.join(levels, same).drop(*[f"l_{k}" for k in keyed]).withColumn("grid", F.explode("levels")).where("grid >= level").drop("levels")
    asks = cells(asks, F.col("grid"))
    where = ["grid", "gx", "gy", "gz"]
    names = [c for c in there.columns if c not in ("level",)]
    there = there.select(*[F.col(c).alias(f"t_{c}") for c in names])
    meet = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in (*keyed, *where)])
    # Boxes of one grid meet from both sides: one is enough.
    met = asks.join(there, meet & (F.col("id") != F.col("t_id"))).where("grid > level or id < t_id")
    inside = reduce(lambda a, b: a * b, [F.greatest(F.lit(0.0), F.least(F.col(f"{a}1"), F.col(f"t_{a}1")) - F.greatest(F.col(f"{a}0"), F.col(f"t_{a}0"))) for _, _, a in _SIDES])
    volume = lambda p: reduce(lambda a, b: a * b, [F.col(f"{p}{a}1") - F.col(f"{p}{a}0") for _, _, a in _SIDES])
    share = inside / F.greatest(volume("") + volume("t_") - inside, F.lit(1e-12))
    first = F.col("rank") < F.col("t_rank")
    pairs = met.where(share > threshold).select(F.when(first, F.col("id")).otherwise(F.col("t_id")).alias("better"), F.when(first, F.col("t_id")).otherwise(F.col("id")).alias("worse"))
    return pairs.distinct()


def suppress(boxes: DataFrame, keys: list[str], threshold: float = 0.25, box_id: str = "id") -> DataFrame:
    """The boxes that greedy suppression keeps, all columns; ``box_id`` tells boxes apart."""
    pairs = written(overlapping(boxes, keys, threshold, box_id), "pairs")
    gone = None
    while not pairs.isEmpty():
        beaten = pairs.select(F.col("worse").alias("id")).distinct()
        # Best of the live: boxes that beat others and are beaten by none.
        wins = pairs.select(F.col("better").alias("id")).distinct().join(beaten, "id", "left_anti")
        lost = written(pairs.join(wins.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        left = pairs.join(lost.withColumnRenamed("id", "worse"), "worse", "left_anti").join(lost.withColumnRenamed("id", "better"), "better", "left_anti")
        after = written(left, "pairs")
        dropped(pairs)
        pairs = after
    if gone is None:
        return boxes
    return boxes.join(gone.select(F.col("id").alias("__gone")), F.col(box_id) == F.col("__gone"), "left_anti")

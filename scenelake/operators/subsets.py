"""Best orderings and merges of stages by dynamic programming over sets of stages.

What a scene type loses at a stage depends only on the set of stages that are
already placed, not on their order. So ``2 ** n`` sets, in layers of one size, stand
for ``n!`` orders; each layer is a join of the one before with the survivors of one
more stage, and a maximum by set.

Defined results:
- an order is better by its least survival, then by its total, then by coming first
  in lexicographic order of the types' places;
- a type without scenes survives with 0; no masks at all give the first order;
- bits of a mask beyond the types do not count; more than 20 types are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import dropped, written

MOST = 20


def survivors(masks: DataFrame, types: list[str]) -> DataFrame:
    """``t`` (place of the type), ``held`` (a set of stages as bits) and ``n``: scenes of the type whose classes are all of these stages.

    Sums over subsets, a doubling step for each stage. Each step reads its rows twice, so the
    first ones, a row for each type and set that occurs, are written, and the masks are made once.
    """
    places = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(i))])
    own = F.col("mask").bitwiseAND(F.lit((1 << len(types)) - 1).cast("long")).alias("held")
    rows = masks.where(F.col("scene_type").isin(types)).select(F.element_at(places, F.col("scene_type")).alias("t"), own, "n")
    rows = written(rows.groupBy("t", "held").agg(F.sum("n").alias("n")), "subset-sums")
    for i in range(len(types)):
        bit = 1 << i
        more = rows.where(f"held & {bit}L = 0").select("t", F.col("held").bitwiseOR(F.lit(bit).cast("long")).alias("held"), "n")
        rows = rows.unionByName(more).groupBy("t", "held").agg(F.sum("n").alias("n"))
        if i % 4 == 3:
            rows = written(rows, "subset-sums")
    return written(rows, "subset-sums")


def _layers(sums: DataFrame, n: int, start: DataFrame, reach) -> DataFrame:
    """Fold from the full set to the empty one: each set takes the best of its sets with one more stage.

    ``reach`` gets the smaller sets (``held``) with the stage ``t`` that leads on, its
    ``survived`` and the columns of ``start``, and keeps the best row of each set.
    """
    state = start
    for _ in range(n):
        out = F.explode(F.filter(F.array(*[F.lit(i) for i in range(n)]), lambda t: F.call_function("bit_get", F.col("held"), t) == 1)).alias("t")
        rows = state.select("*", out)
        met = rows.join(sums.select(F.col("t").alias("s_t"), F.col("held").alias("s_held"), F.col("n").alias("survived")), F.expr("t = s_t and held = s_held"), "left")
        met = met.withColumn("survived", F.coalesce("survived", F.lit(0).cast("long"))).drop("s_t", "s_held")
        met = met.withColumn("held", F.expr("held & ~shiftleft(1L, t)"))
        after = written(reach(met), "layer")
        dropped(state)
        state = after
    return state


def best_ordering(masks: DataFrame, types: list[str]) -> DataFrame:
    """``types`` (the best order), ``min_survived`` and ``total_survived``; as the sweep over all orders finds it.

    ``masks``: ``scene_type``, ``mask`` (bit ``i``: classes of the stage of ``types[i]``), ``n``.
    """
    n = len(types)
    if not 0 < n <= MOST:
        raise ValueError(f"between 1 and {MOST} types")
    spark = masks.sparkSession
    sums = survivors(masks, types)
    full = (1 << n) - 1

    def least(rows: DataFrame) -> DataFrame:
        value = F.least("least", "survived")
        return rows.select("held", value.alias("v")).groupBy("held").agg(F.max("v").alias("least"))

    bottleneck = _layers(sums, n, spark.createDataFrame([(full, (1 << 62))], "held long, least long"), least)
    bound = bottleneck.select(F.col("least").alias("bound"))

    def most(rows: DataFrame) -> DataFrame:
        allowed = rows.where("survived >= bound")
        total = (F.col("total") + F.col("survived")).alias("total")
        order = F.concat(F.array(F.col("t")), F.col("places")).alias("places")
        step = allowed.select("held", "bound", total, order, F.least("least", "survived").alias("least"), (-F.col("t")).alias("back"))
        best = step.groupBy("held", "bound").agg(F.max_by(F.struct("total", "places", "least"), F.struct("total", "back")).alias("b"))
        return best.select("held", "bound", "b.total", "b.places", "b.least")

    begin = spark.createDataFrame([(full, 0, [], 1 << 62)], "held long, total long, places array<int>, least long").crossJoin(F.broadcast(bound))
    found = _layers(sums, n, written(begin.select("held", "bound", "total", "places", "least"), "layer"), most)
    names = F.array(*[F.lit(t) for t in types])
    return found.select(F.transform("places", lambda i: F.get(names, i)).alias("types"), F.col("least").alias("min_survived"), F.col("total").alias("total_survived"))


def best_merge(masks: DataFrame, types: list[str], least: int) -> DataFrame:
    """Neighbouring stages put together so that each part keeps at least ``least`` scenes: the most parts, then the greatest total, then the first cuts.

    A part's scenes survive if they hold no class of a later part. Rows: ``part``
    (1-based), ``types``, ``total`` and ``survived``; none if not even one part keeps enough.
    """
    n = len(types)
    spark = masks.sparkSession
    sums = survivors(masks, types)
    # A part of the stages a to b - 1 has placed all stages before b.
    cuts = spark.range(n).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.col("id").cast("int") + 1, F.lit(n))).alias("b"))
    kept = cuts.join(sums.withColumnRenamed("n", "alive"), F.expr("t >= a and t < b and held = shiftleft(1L, b) - 1"), "left")
    kept = kept.groupBy("a", "b").agg(F.coalesce(F.sum("alive"), F.lit(0)).alias("survived"))
    per = sums.where(f"held = {(1 << n) - 1}L").select(F.col("t").alias("p_t"), F.col("n").alias("all"))
    whole = cuts.join(per, F.expr("p_t >= a and p_t < b"), "left").groupBy(F.col("a").alias("w_a"), F.col("b").alias("w_b")).agg(F.coalesce(F.sum("all"), F.lit(0)).alias("total"))
    parts = written(kept.join(whole, F.expr("a = w_a and b = w_b")).select("a", "b", "total", "survived").where(F.col("survived") >= least), "parts")
    state = written(spark.createDataFrame([(n, 0, 0, [])], "start int, parts int, kept long, path array<struct<a:int,b:int,total:long,survived:long>>"), "merges")
    for a in range(n - 1, -1, -1):
        more = parts.where(F.col("a") == a).join(state, F.expr("b = start"))
        step = more.select(
            "b", (F.col("parts") + 1).alias("parts"), (F.col("kept") + F.col("survived")).alias("kept"),
            F.concat(F.array(F.struct("a", "b", "total", "survived")), F.col("path")).alias("path"),
        )
        best = step.agg(F.max_by(F.struct("parts", "kept", "path"), F.struct("parts", "kept", -F.col("b"))).alias("x")).where("x is not null")
        after = written(state.unionByName(best.select(F.lit(a).alias("start"), "x.parts", "x.kept", "x.path")), "merges")
        dropped(state)
        state = after
    names = F.array(*[F.lit(t) for t in types])
    rows = state.where("start = 0").select(F.posexplode("path").alias("i", "x"))
    return rows.select(
        (F.col("i") + 1).cast("long").alias("part"), F.slice(names, F.col("x.a") + 1, F.col("x.b") - F.col("x.a")).alias("types"), "x.total", "x.survived"
    )

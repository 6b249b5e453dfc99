"""Exact percentiles by rank selection: counted ranges are refined until the wanted ranks are alone.

A pass counts the values of each wanted rank's range in ``PARTS`` equal parts, with
the least and the greatest value of each part. The part that holds the rank is the
next range, cut to the values it really has; a range of one value is the answer.
So a pass sends ``PARTS`` rows a rank and nothing is buffered by group. Passes cut
ranges by value and by magnitude in turn, so a few do for any numbers.

Defined results:
- nulls take no part, as in an average; NaN is greater than all numbers;
- between two ranks values are interpolated linearly; infinite ends as arithmetic gives them;
- a group without values has nulls; a null group is a group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import dropped, sent_if_few, written

PARTS = 256


def _magnitude(x: Column) -> Column:
    """The logarithm of a number's size with its sign, from the least positive number up; in the numbers' order."""
    return F.signum(x) * F.greatest(F.log(F.abs(x)) + 745.0, F.lit(0.0))


def _part(x: Column, low: Column, high: Column, turn: int) -> Column:
    """The part of [low, high] that holds x: 0 to PARTS - 1; halves, so that no difference overflows."""
    scale = (lambda v: v / 2) if turn % 2 == 0 else (lambda v: F.coalesce(_magnitude(v), F.lit(0.0)))
    share = F.try_divide(scale(x) - scale(low), scale(high) - scale(low))
    return F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * PARTS), F.lit(PARTS - 1)).cast("int")


def ranks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``g``, ``rank`` (from 0) and its ``value``; ``rows`` have ``g`` and ``x``, ``wanted`` has ``g`` and ``rank``."""
    fine = rows.where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    ends = fine.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    # Infinities and NaN stand before and behind the finite values.
    odd = rows.where("x is not null").groupBy(F.col("g").alias("o_g")).agg(
        F.count_if(F.expr("x = -double('infinity')")).alias("under"), F.count_if(F.expr("x = double('infinity')")).alias("over")
    )
    asked = wanted.join(ends.withColumnRenamed("g", "e_g"), F.expr("g <=> e_g"), "left").join(odd, F.expr("g <=> o_g"), "left")
    place = F.col("rank") - F.col("under")
    outside = (
        F.when(F.col("under").isNull(), F.lit(None).cast("double"))
        .when(place < 0, F.lit(float("-inf")))
        .when(place < F.coalesce("n", F.lit(0)), F.lit(None).cast("double"))
        .when(place < F.coalesce("n", F.lit(0)) + F.col("over"), F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )
    open_ = F.coalesce((place >= 0) & (place < F.col("n")), F.lit(False))
    state = asked.select("g", "rank", place.alias("at"), "low", "high", open_.alias("going"), outside.alias("value"))
    state = written(state.withColumn("value", F.when(F.col("going") & (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("value"))).withColumn(
        "going", F.col("going") & (F.col("low") < F.col("high"))
    ), "ranks")
    turn = 0
    while not state.where("going").isEmpty():
        ranges = state.where("going").select(F.col("g").alias("r_g"), "low", "high").distinct()
        met = fine.join(sent_if_few(ranges), F.expr("g <=> r_g and x >= low and x <= high"))
        parts = met.groupBy("r_g", "low", "high", _part(F.col("x"), F.col("low"), F.col("high"), turn).alias("part")).agg(
            F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")
        )
        held = parts.groupBy("r_g", "low", "high").agg(F.sort_array(F.collect_list(F.struct("part", "n", "least", "most"))).alias("parts"))
        held = held.select("r_g", F.col("low").alias("r_low"), F.col("high").alias("r_high"), "parts")
        joined = state.join(held, F.expr("going and g <=> r_g and low = r_low and high = r_high"), "left")
        # Walk over the parts: the rank is in the first one whose count it does not pass.
        begin = F.struct(F.col("at").alias("at"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
        walk = F.aggregate(
            "parts", begin,
            lambda s, p: F.when(s["low"].isNotNull(), s).when(
                s["at"] < p["n"], F.struct(s["at"].alias("at"), p["least"].alias("low"), p["most"].alias("high"))
            ).otherwise(F.struct((s["at"] - p["n"]).alias("at"), s["low"].alias("low"), s["high"].alias("high"))),
        )
        step = joined.withColumn("s", walk)
        on = F.col("going")
        alone = F.col("s.low") == F.col("s.high")
        after = step.select(
            "g", "rank", F.when(on, F.col("s.at")).otherwise(F.col("at")).alias("at"), F.when(on, F.col("s.low")).otherwise(F.col("low")).alias("low"),
            F.when(on, F.col("s.high")).otherwise(F.col("high")).alias("high"), (on & ~alone).alias("going"),
            F.when(on & alone, F.col("s.low")).otherwise(F.col("value")).alias("value"),
        )
        after = written(after, "ranks")
        dropped(state)
        state, turn = after, turn + 1
    return state.select("g", "rank", "value")


def percentiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """``group``, ``n`` values and ``p0``, ``p1``, ...: the percentiles at ``shares``, interpolated linearly."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    counts = written(rows.groupBy("g").agg(F.count("x").alias("n")), "counts")
    places = F.array(*[F.lit(float(s)) for s in shares])
    wanted = counts.where("n > 0").select("g", "n", F.posexplode(places).alias("i", "share"))
    wanted = wanted.withColumn("pos", F.col("share") * (F.col("n") - 1)).withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos")})
    wanted = written(wanted.select("g", "i", "pos", "lo", "hi"), "wanted")
    each = wanted.select("g", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    found = ranks(rows, each)
    lower = found.select(F.col("g").alias("l_g"), F.col("rank").alias("l_rank"), F.col("value").alias("a"))
    upper = found.select(F.col("g").alias("u_g"), F.col("rank").alias("u_rank"), F.col("value").alias("b"))
    both = wanted.join(lower, F.expr("g <=> l_g and lo = l_rank")).join(upper, F.expr("g <=> u_g and hi = u_rank"))
    at = F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("lo")))
    wide = both.groupBy(F.col("g").alias("w_g")).agg(*[F.max(F.when(F.col("i") == i, at)).alias(f"p{i}") for i in range(len(shares))])
    out = counts.join(wide, F.expr("g <=> w_g"), "left")
    return out.select(F.col("g").alias(group), "n", *[f"p{i}" for i in range(len(shares))])

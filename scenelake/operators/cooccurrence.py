"""Co-occurrence of classes within scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import written


def pair_counts(found: DataFrame) -> DataFrame:
    """``class_i`` < ``class_j`` and ``n`` scenes that hold both.

    Pairs are made inside a scene's set of classes, so the only shuffles are by
    scene and by pair, the latter behind partial sums.
    """
    sets = found.groupBy("scene").agg(F.sort_array(F.collect_set("class")).alias("c"))
    pairs = F.flatten(
        F.transform(
            "c",
            lambda x, i: F.transform(
                F.slice("c", i + 2, F.greatest(F.size("c") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("i"), y.alias("j"))
            ),
        )
    )
    rows = sets.where(F.size("c") > 1).select(F.explode(pairs).alias("p"))
    return rows.groupBy(F.col("p.i").alias("class_i"), F.col("p.j").alias("class_j")).agg(F.count("*").alias("n"))


def marginals(found: DataFrame) -> DataFrame:
    """``class`` and ``f``, its number of scenes."""
    return found.groupBy("class").agg(F.count("*").alias("f"))


def with_marginals(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs with both classes' numbers of scenes, from the same presence."""
    f = marginals(found)
    return pairs.join(f.select(F.col("class").alias("class_i"), F.col("f").alias("f_i")), "class_i").join(
        f.select(F.col("class").alias("class_j"), F.col("f").alias("f_j")), "class_j"
    )


def jaccard(found: DataFrame) -> DataFrame:
    """``class_i`` < ``class_j``, ``n`` and ``jaccard`` of the pairs that occur."""
    both = with_marginals(pair_counts(found), found)
    union = F.col("f_i") + F.col("f_j") - F.col("n")
    return both.select("class_i", "class_j", "n", F.coalesce(F.round(F.try_divide(F.col("n").cast("double"), union), 6), F.lit(0.0)).alias("jaccard"))


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """Both directions of each pair."""
    back = pairs.select(F.col("class_j").alias("class_i"), F.col("class_i").alias("class_j"), value)
    return pairs.select("class_i", "class_j", value).union(back)


#: Classes of which a full matrix is made at most.
WIDEST = 2_000


def full_matrix(found: DataFrame) -> DataFrame:
    """All ordered pairs of classes with their count, zero on the diagonal and for pairs that never occur.

    Meant for selected classes; more than ``WIDEST`` are refused, as the matrix
    grows with their square.
    """
    classes = found.select("class").distinct()
    n = classes.count()
    if n > WIDEST:
        raise ValueError(f"a full matrix of {n} classes: restrict the presence to at most {WIDEST} first")
    grid = classes.select(F.col("class").alias("class_i")).crossJoin(classes.select(F.col("class").alias("class_j")))
    counts = symmetric(pair_counts(found), "n")
    return grid.join(counts, ["class_i", "class_j"], "left").select("class_i", "class_j", F.coalesce("n", F.lit(0)).alias("n"))


def gram(found: DataFrame) -> DataFrame:
    """The product of the incidence matrix with itself, by a self-join; the diagonal is the frequency."""
    left = found.select("scene", F.col("class").alias("class_i"))
    right = found.select("scene", F.col("class").alias("class_j"))
    return left.join(right, "scene").groupBy("class_i", "class_j").agg(F.count("*").alias("n"))


def gram_sliced(found: DataFrame) -> DataFrame:
    """The product of the incidence matrix with itself, from slices of 64 scenes as the bits of a word.

    A class has a word for each slice that it occurs in; words of two classes are
    and-ed and their bits counted, so a slice costs a row for each pair of its
    classes, however many of its scenes hold them. The scenes' numbers are written
    once, as a lost task would number its scenes anew.
    """
    scenes = found.select(F.col("scene").alias("s")).distinct().withColumn("id", F.monotonically_increasing_id())
    scenes = written(scenes, "scene-numbers")
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    placed = found.join(scenes, F.expr("scene <=> s")).select("class", F.shiftright("id", 6).alias("slice"), bit.alias("bit"))
    words = placed.groupBy("class", "slice").agg(F.bit_or("bit").alias("word"))
    left = words.select(F.col("class").alias("class_i"), "slice", F.col("word").alias("a"))
    right = words.select(F.col("class").alias("class_j"), "slice", F.col("word").alias("b"))
    both = F.bit_count(F.col("a").bitwiseAND(F.col("b")))
    counts = left.join(right, "slice").groupBy("class_i", "class_j").agg(F.sum(both).cast("long").alias("n"))
    return counts.where("n > 0")


def conditional(found: DataFrame) -> DataFrame:
    """P(class_j | class_i) for all pairs that occur."""
    f = marginals(found).select(F.col("class").alias("class_i"), "f")
    return symmetric(pair_counts(found), "n").join(f, "class_i").select(
        "class_i", "class_j", F.round(F.col("n") / F.col("f"), 6).alias("p")
    )


def co_features(found: DataFrame, threshold: float, min_scenes: int = 0, min_features: int = 0) -> DataFrame:
    """Per focal class the classes with a Jaccard from the threshold up, above the minimum support."""
    edges = symmetric(jaccard(found), "jaccard").where(F.col("jaccard") >= threshold)
    per = edges.groupBy(F.col("class_i").alias("focal_class")).agg(
        F.count("*").alias("n_features"), F.array_join(F.sort_array(F.collect_list("class_j")), "|").alias("features")
    )
    f = marginals(found).select(F.col("class").alias("focal_class"), F.col("f").alias("n_scenes"))
    return per.join(f, "focal_class").where((F.col("n_scenes") >= min_scenes) & (F.col("n_features") >= min_features))


def threshold_curve(found: DataFrame, thresholds: list[float]) -> DataFrame:
    """Number of co-classes of each focal class at each threshold, zero included."""
    edges = symmetric(jaccard(found), "jaccard").withColumnRenamed("class_i", "focal_class")
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    hit = F.when(F.col("jaccard") >= F.col("threshold"), 1).otherwise(0)
    return edges.select("focal_class", "jaccard", grid).groupBy("focal_class", "threshold").agg(F.sum(hit).alias("n_features"))

"""Checks that hold results against independent formulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import written
from .cooccurrence import gram, pair_counts


def result(condition: Column) -> Column:
    """PASS, FAIL, or SKIP where the condition is unknown."""
    return F.when(condition, "PASS").when(~condition, "FAIL").otherwise("SKIP")


def two_algorithms(found: DataFrame) -> DataFrame:
    """Counts of the pair enumeration and of the Gram matrix, cell by cell of the upper triangle."""
    a = pair_counts(found).withColumnRenamed("n", "algo1_count")
    b = gram(found).where("class_i < class_j").withColumnRenamed("n", "algo2_count")
    both = a.join(b, ["class_i", "class_j"], "full_outer").fillna(0, ["algo1_count", "algo2_count"])
    return both.withColumn("discrepancy", F.col("algo1_count") - F.col("algo2_count"))


def asymmetric_cells(matrix: DataFrame) -> DataFrame:
    """Cells whose mirror image differs."""
    back = matrix.select(F.col("class_j").alias("class_i"), F.col("class_i").alias("class_j"), F.col("n").alias("m"))
    return matrix.join(back, ["class_i", "class_j"], "left").where(~F.col("n").eqNullSafe(F.col("m")))


#: Rows that a task of a self-join sorts on each side, about.
SORTED = 500_000


def diagonal_deviation(found: DataFrame, tolerance: int = 1) -> DataFrame:
    """Diagonal of the Gram matrix against the class frequency.

    The presence is written and dealt by its number of rows, so that a task of the
    self-join holds no more of a larger table.
    """
    found = written(found, "presence")
    dealt = found.repartition(1 + found.count() // SORTED, "scene", "class")
    diagonal = gram(dealt).where("class_i = class_j").select(F.col("class_i").alias("class"), F.col("n").alias("diagonal"))
    f = found.groupBy("class").agg(F.count("*").alias("frequency"))
    out = f.join(diagonal, "class", "left")
    return out.withColumn("result", result(F.abs(F.col("diagonal") - F.col("frequency")) <= tolerance))


def in_two_stages(survivors: DataFrame) -> DataFrame:
    """Rows whose scene stands more than once in its split."""
    n = F.count("*").over(Window.partitionBy("split", "scene"))
    return survivors.withColumn("copies", n).where("copies > 1")


def coverage(classes: DataFrame, stages: DataFrame) -> DataFrame:
    """How many stages hold each class: missing, duplicated or unexpected ones stand out."""
    held = stages.groupBy("class").agg(F.count("*").alias("n_stages"))
    both = classes.select("class", F.lit(True).alias("expected")).join(held, "class", "full_outer")
    n = F.coalesce("n_stages", F.lit(0))
    status = F.when(F.col("expected").isNull(), "unexpected").when(n == 0, "missing").when(n > 1, "duplicated").otherwise("ok")
    return both.select("class", n.alias("n_stages"), status.alias("status"))


def filter_holds(survivors: DataFrame, stages: DataFrame) -> DataFrame:
    """Per surviving row, the number of its classes of its own stage and of later ones."""
    own = F.explode_outer(F.split("classes_present", r"\|")).alias("class")
    rows = survivors.select("stage_idx", "scene", own).join(
        stages.select("class", F.col("stage_idx").alias("c_stage")), "class", "left"
    )
    return rows.groupBy("stage_idx", "scene").agg(
        F.count_if(F.col("c_stage") == F.col("stage_idx")).alias("own_hits"),
        F.count_if(F.col("c_stage") > F.col("stage_idx")).alias("future_hits"),
    )


def pair_checks(pairs: DataFrame, bounds: list[tuple[str, str, str, float]]) -> DataFrame:
    """``check_name`` and ``result`` of bounds (name, class, class, least value) on a pair's ``jaccard``; SKIP if a class is unknown."""
    spark = pairs.sparkSession
    wanted = spark.createDataFrame(bounds, "check_name string, a string, b string, bound double")
    classes = pairs.select(F.explode(F.array("class_i", "class_j")).alias("class")).distinct()
    held = wanted.join(pairs, F.expr("least(a, b) = class_i and greatest(a, b) = class_j"), "left")
    for side in ("a", "b"):
        known = classes.select(F.col("class").alias(f"known_{side}"))
        held = held.join(known, F.col(side) == F.col(f"known_{side}"), "left")
    known = F.col("known_a").isNotNull() & F.col("known_b").isNotNull()
    value = F.when(known, F.coalesce("jaccard", F.lit(0.0)))
    return held.select("check_name", result(value > F.col("bound")).alias("result"))


def against_report(found: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Measured counts beside reported ones (column ``expected``), and whether they agree; SKIP without a report."""
    both = found.select(*keys, value).join(F.broadcast(expected.select(*keys, "expected")), keys, "left")
    return both.withColumn("result", result(F.col(value) == F.col("expected")))


def corroborated(rows: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``scene`` and ``classes_present`` against a second source, joined by the last part of the scene's path.

    ``second``: ``scene`` and ``class``. ``n_first`` classes, ``n_both`` that the second source has too,
    and whether it knows the scene at all.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    held = second.groupBy(name(F.col("scene").cast("string")).alias("name")).agg(F.collect_set("class").alias("others"))
    mine = rows.select("scene", name(F.col("scene").cast("string")).alias("name"), F.filter(F.split("classes_present", r"\|"), lambda c: c != "").alias("own"))
    both = mine.join(held, "name", "left")
    return both.select(
        "scene",
        F.size("own").cast("long").alias("n_first"),
        F.when(F.col("others").isNotNull(), F.size(F.array_intersect("own", "others"))).otherwise(0).cast("long").alias("n_both"),
        F.col("others").isNotNull().alias("in_second"),
    )

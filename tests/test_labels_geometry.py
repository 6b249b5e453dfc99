import math

import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry as G
from scenelake.functions import labels as L


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Chair1 ", "chair"), ("couch", "sofa"), ("sofachair", "sofa"), ("chair12", "chair"), ("123", "1"), ("lamp3", "lamp"),
        ("gizmo7", "gizmo"), ("chair 1", "chair "), ("notebook", "notebook"), ("chair:truncated", "chair:truncated"),
        ("\t desk ", "desk"), ("x٣", "x"),
    ],
)
def test_normalise(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(L.normalise(F.col("raw"))).first()[0] == want


def test_label_helpers(spark):
    row = spark.range(1).select(
        L.normalise(L.without_suffix(F.lit("chair:truncated"))).alias("a"),
        L.stage_title(F.lit(2), F.lit("living_room")).alias("b"),
        L.split_set(F.lit("a|b|a")).alias("c"),
        L.split_set(F.lit(None).cast("string")).alias("d"),
        L.fold_dashes(F.lit("a –— b")).alias("e"),
    )
    assert tuple(row.first()) == ("chair", "Stage 2 – Living Room", ["a", "b"], [], "a - b")


@pytest.mark.parametrize(
    "segment, want", [((-1, 0, 1, 0), 1.0), ((2, 0, 3, 0), math.sqrt(5)), ((2, 1, 2, 1), 2.0)]
)
def test_point_segment(spark, segment, want):
    values = [F.lit(float(x)) for x in (0, 1, *segment)]
    assert spark.range(1).select(G.point_segment_distance(*values)).first()[0] == pytest.approx(want)


def test_polygon_and_clip(spark):
    square = [F.array(*[F.lit(float(x)) for x in xs]) for xs in ((0, 1, 1, 0), (0, 0, 1, 1))]
    one = F.array(F.lit(0.0))
    row = spark.range(1).select(
        G.polygon_distance(F.lit(0.5), F.lit(0.25), *square),
        G.polygon_distance(F.lit(0.5), F.lit(0.25), one, one),
        G.nearest_corner_distance(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(0.5), *square),
        G.nearest_corner_distance(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(0.5), *square),
        G.fixed_bin(F.lit(2.5), -0.6, 2.5, 64),
        G.clip(F.lit(9.0), 0.0, 1.0),
    )
    assert tuple(row.first()) == (0.25, None, 0.25, None, 63, 1.0)

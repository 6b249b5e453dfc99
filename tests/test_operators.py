import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import checks, cluster, cooccurrence, lift, pointcloud, presence, spatial, splits


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def small(spark):
    data = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "c"), (3, "c"), (4, None), (None, "a")]
    return presence.presence(spark.createDataFrame(data, "s long, l string"), "s", "l")


def test_pairs_and_jaccard(spark, small):
    assert rows(cooccurrence.jaccard(small), "class_i", "class_j", "n", "jaccard") == [("a", "b", 1, 0.333333), ("b", "c", 1, 0.5)]
    full = {(i, j): n for i, j, n in rows(cooccurrence.full_matrix(small), "class_i", "class_j", "n")}
    assert full[("a", "c")] == 0 and full[("a", "a")] == 0 and full[("b", "a")] == full[("a", "b")] == 1
    assert checks.asymmetric_cells(cooccurrence.gram(small)).isEmpty()
    assert {r["result"] for r in checks.diagonal_deviation(small).collect()} == {"PASS"}
    assert {r["discrepancy"] for r in checks.two_algorithms(small).collect()} == {0}


def test_empty_tables(spark, small):
    none, scenes = small.limit(0), spark.createDataFrame([], "scene long, scene_type string")
    assert cooccurrence.jaccard(none).count() == 0
    assert presence.class_frequency(none, scenes).count() == 0
    assert lift.lift(none, scenes).count() == 0


def test_frequency_counts_all_scenes_and_filters_before_the_slice(spark):
    found = spark.createDataFrame([(1, "wall"), (2, "wall"), (3, "wall"), (1, "chair"), (2, "chair"), (1, "floor"), (1, "table")], "scene long, class string")
    scenes = spark.range(1, 6).withColumnRenamed("id", "scene")
    frequency = presence.class_frequency(found, scenes)
    assert rows(frequency, "rank", "class", "pct_of_scenes")[0] == (1, "wall", 60.0)
    assert [r["class"] for r in presence.top_classes(frequency, 2, ["wall", "floor"]).orderBy("rank").collect()] == ["chair", "table"]


def world(spark, seed=3, n=300, types="ABC", classes="uvwxyz"):
    rng = random.Random(seed)
    scenes = [(i, rng.choice(types)) for i in range(n)]
    found = [(i, c) for i, t in scenes for c in classes if rng.random() < 0.15 + 0.3 * (ord(c) % 3 == ord(t) % 3)]
    return spark.createDataFrame(found, "scene long, class string"), spark.createDataFrame(scenes, "scene long, scene_type string"), found, scenes


def greedy(lifts, order, types, capacity):
    gap = {c: sorted((lifts[c, t] for t in types), reverse=True) for c in order}
    room, out = dict.fromkeys(types, capacity), {}
    for c in sorted(order, key=lambda c: (-round(gap[c][0] - gap[c][1], 4), order.index(c))):
        t = min((t for t in types if room[t]), key=lambda t: (-lifts[c, t], types.index(t)))
        room[t] -= 1
        out[c] = t
    return out


def test_assignment_sweep_and_filters(spark):
    types = ["A", "B", "C"]
    found, scenes, f, s = world(spark)
    order = presence.class_frequency(found, scenes)
    lifts = lift.lift(found, scenes)
    table = {(r["class"], r.scene_type): r.lift for r in lifts.collect()}
    listed = [r["class"] for r in order.orderBy("rank").collect()]
    stages = splits.assign_balanced(lifts, order, types, 2)
    got = {r["class"]: r.scene_type for r in stages.collect()}
    assert got == greedy(table, listed, types, 2)
    masks = splits.stage_masks(found, scenes, stages)
    swept = {r.ordering: (r.min_survived, r.total_survived) for r in splits.sweep(masks, splits.orderings(spark, types), types).collect()}
    held = {i: {c for j, c in f if j == i} for i, _ in s}
    for n, perm in enumerate(itertools.permutations(types), 1):
        alive = [sum(t == own and not any(got[c] in perm[k + 1 :] for c in held[i]) for i, t in s) for k, own in enumerate(perm)]
        assert swept[n] == (min(alive), sum(alive))
    best = splits.best_ordering(splits.sweep(masks, splits.orderings(spark, types), types)).first()
    assert (best.min_survived, best.total_survived) == max(swept.values())
    by_presence = splits.strict_by_presence(masks, 3).collect()
    assert sum(r.survived for r in by_presence) == sum(bool(h) for h in held.values())  # each scene survives once
    assert next(r.pct_lost for r in by_presence if r.stage_idx == 3) == 0.0
    default = spark.createDataFrame([(t, i + 1) for i, t in enumerate(types)], "scene_type string, stage_idx long")
    kept = splits.surviving_scenes(found, scenes, stages, default)
    assert kept.count() == splits.strict_by_type(masks, default).agg(F.sum("survived")).first()[0]
    assert checks.filter_holds(kept, stages).where("future_hits > 0").isEmpty()


def test_robust_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert tuple(df.agg(*spatial.percentiles("x", [0.25, 0.5, 0.95])).first()) == (1.75, 2.5, 8.95)
    first, again = (spatial.stable_sample(spark.range(100).repartition(k), "id", 7) for k in (1, 5))
    assert rows(first, "id") == rows(again, "id")


def test_gap_rule(spark):
    gaps = spark.createDataFrame(
        [("c", 2, 0.10, 0.0), ("c", 3, 0.20, 0.01), ("c", 4, 0.21, 0.02), ("r", 2, 0.1, 0.0), ("r", 3, 0.3, 0.0), ("r", 4, 0.6, 0.0)],
        "focal_class string, k int, gap double, sk double",
    )
    assert rows(cluster.best_k(gaps), "focal_class", "best_k") == [("c", 3), ("r", 4)]


def test_kmeans_and_silhouette_under_weights():
    rng = np.random.default_rng(1)
    x = (rng.random((60, 4)) < 0.4).astype(float)
    patterns, w = np.unique(x, axis=0, return_counts=True)
    labels, inertia = cluster.weighted_kmeans(patterns, w.astype(float), 3, 5)
    full = labels[[int(np.flatnonzero((patterns == r).all(1))[0]) for r in x]]
    centres = np.array([x[full == c].mean(0) for c in range(3)])
    assert inertia == pytest.approx(((x - centres[full]) ** 2).sum())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(60):
        own = (full == full[i]) & (np.arange(60) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, full == c].mean() for c in range(3) if c != full[i])
        s.append((b - a) / max(a, b))
    assert cluster.weighted_silhouette(patterns, w.astype(float), labels) == pytest.approx(np.mean(s))


def test_gap_end_to_end_finds_planted_groups(spark):
    found = [(i, "focal") for i in range(120)] + [(i, c) for i in range(120) for c in ("ab", "cd", "ef")[i % 3]]
    presence_df = spark.createDataFrame(found, "scene long, class string")
    features = spark.createDataFrame([("focal", c) for c in "abcdef"], "focal_class string, feature string")
    fitted = cluster.fits(cluster.presence_patterns(presence_df, features), [2, 3, 4], draws=4, n_init=3)
    assert cluster.argmax_silhouette(fitted.where("draw = 0")).first().best_k == 3
    gaps = cluster.gap_table(fitted)
    assert gaps.where("k = 3").first().gap > gaps.where("k = 2").first().gap


def test_depth_and_voxels(spark):
    pixels = spark.createDataFrame([(50, 150, 12345, 12000), (1, 2, 0, 500), (1, 3, 0, 0)], "v int, u int, depth_raw int, depth_filled int")
    decoded = pointcloud.decode_depth(pixels)
    assert rows(decoded, "is_hole", "is_filled") == [(False, False), (True, False), (True, True)]
    p = pointcloud.back_project(decoded, 500.0, 500.0, 100.0, 100.0, flip=False).first()
    assert (round(p.x, 6), round(p.y, 6), p.z) == (0.12345, -0.12345, 1.2345)
    got = spark.createDataFrame([(0.059,), (0.061,), (-0.01,)], "x double").select(pointcloud.voxel_of(F.col("x")))
    assert [r[0] for r in got.collect()] == [2, 3, 0]


def test_greedy_suppression(spark):
    data = [("a", 0.9, 0.0), ("a", 0.8, 0.1), ("a", 0.7, 5.0), ("b", 0.6, 0.0)]
    boxes = spark.createDataFrame([(k, s, x, 0.0, 0.0, 1.0, 1.0, 1.0) for k, s, x in data], "k string, score double, cx double, cy double, cz double, w double, h double, l double")
    assert rows(pointcloud.suppress(boxes, ["k"]), "k", "score") == [("a", 0.7), ("a", 0.9), ("b", 0.6)]


def test_silhouette_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (90, 5)) + (np.arange(90) % 3)[:, None]
    v[7] = v[10]  # equal points
    points = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(89)] + [(89, 9, v[89].tolist())], "id long, label long, v array<double>")
    one, many = (rows(cluster.silhouette_of_labels(points, block), "label", "n", "silhouette") for block in (2048, 20))
    assert one == many and (9, 1, 0.0) in one
    labels = np.array([i % 3 for i in range(89)] + [9])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    s = []
    for i in np.flatnonzero(labels == 1):
        own = (labels == 1) & (np.arange(90) != i)
        a, b = d[i, own].mean(), min(d[i, labels == c].mean() for c in (0, 2, 9))
        s.append((b - a) / max(a, b))
    assert dict((r[0], r[2]) for r in one)[1] == pytest.approx(np.mean(s), abs=1e-5)


def test_null_reference_keeps_shares_and_counts():
    x = np.array([[0, 1, 1], [1, 0, 1], [0, 0, 1]], float)
    w = np.array([50_000.0, 30_000.0, 60_000.0])
    patterns, counts = cluster.null_reference(x, w, np.random.default_rng(4))
    assert counts.sum() == 140_000 and len(patterns) == len({tuple(p) for p in patterns.tolist()}) <= 8
    assert (counts[:, None] * patterns).sum(0) / 140_000 == pytest.approx([3 / 14, 5 / 14, 1], abs=0.01)
    again = cluster.null_reference(x, w, np.random.default_rng(4))
    assert (again[0] == patterns).all() and (again[1] == counts).all()


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long").repartition(5)
    assert rows(pointcloud.numbered(df, "k", "r", 8), "k", "r") == [(i, i) for i in range(101)]
    assert pointcloud.numbered(df.limit(0), "k", "r").count() == 0


def test_suppression_does_not_depend_on_islands(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = [("a", float(s), *map(float, c), *map(float, e)) for s, c, e in zip(rng.random(120), rng.random((120, 3)) * [150, 1, 1], rng.random((120, 3)) + 0.5)]
    boxes = spark.createDataFrame(data, "k string, score double, cx double, cy double, cz double, w double, h double, l double")
    assert pointcloud.separate(boxes, ["k"]).select("island").distinct().count() > 3
    got = rows(pointcloud.suppress(boxes, ["k"]), "score")
    monkeypatch.setattr(pointcloud, "separate", lambda b, keys, name: b.withColumn(name, F.lit(0)))
    assert got == rows(pointcloud.suppress(boxes, ["k"]), "score")


def test_samples_by_group_are_bounded_and_stable(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g")
    first, again = (rows(spatial.stable_sample(df.repartition(k), "id", 7, per="g"), "g", "id") for k in (1, 6))
    assert first == again and [g for g, _ in first] == [0] * 7 + [1] * 7 + [2] * 7
    assert first != rows(spatial.stable_sample(df, "id", 7, seed=1, per="g"), "g", "id")


def test_full_matrix_is_refused_for_raw_labels(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "WIDEST", 3)
    found = spark.createDataFrame([(i, f"c{i}") for i in range(4)], "scene long, class string")
    with pytest.raises(ValueError, match="4 classes"):
        cooccurrence.full_matrix(found)
    assert cooccurrence.full_matrix(found.where("scene < 3")).count() == 9


def test_null_reference_of_very_many_scenes():
    x = np.array([[0, 1, 1], [1, 0, 1]], float)
    patterns, counts = cluster.null_reference(x, np.array([3e12, 1e12]), np.random.default_rng(1))
    assert counts.sum() == 4e12 and (counts[:, None] * patterns).sum(0) / 4e12 == pytest.approx([0.25, 0.75, 1], abs=1e-4)
    both = counts[[p[0] == 1 and p[1] == 1 for p in patterns.tolist()]].sum() / 4e12
    assert both == pytest.approx(0.25 * 0.75, abs=1e-4)  # columns are independent


def test_silhouette_sends_a_point_to_a_bounded_number_of_parts(spark, monkeypatch):
    import re

    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, i % 3, (rng.normal(size=3) + i % 3).tolist()) for i in range(700)], "id long, label long, v array<double>")
    made = cluster.silhouette_of_labels(points, 4)
    sent = [int(m) + 1 for m in re.findall(r"sequence\(0, (\d+)", made._jdf.queryExecution().analyzed().toString())]
    assert sent and max(sent) <= 32 and sum(set(sent)) <= 40
    key = ("label", "n", "silhouette")
    assert rows(made, *key) == rows(cluster.silhouette_of_labels(points), *key)


def test_diagonal_is_dealt_by_the_rows_of_the_presence(spark, monkeypatch):
    monkeypatch.setattr(checks, "SORTED", 50, raising=False)
    found = spark.createDataFrame([(i, c) for i in range(60) for c in "abcdef"[: 1 + i % 6]], "scene long, class string")
    made = checks.diagonal_deviation(found)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert f", {1 + found.count() // 50}), REPARTITION_BY_NUM" in plan
    assert {(r["class"], r.frequency, r.diagonal, r.result) for r in made.collect()} == {(c, 60 - 10 * i, 60 - 10 * i, "PASS") for i, c in enumerate("abcdef")}

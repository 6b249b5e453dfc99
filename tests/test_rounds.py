"""Depth filling and k-means in rounds against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import depthfill, kmeans


def plain_fill(pixels, radius, near, like, least):
    d = {k: x for k, (x, _) in pixels.items()}
    g = {k: y for k, (_, y) in pixels.items()}
    when, count = {k: 0 for k, x in d.items() if x is not None}, 0
    while True:
        count, new = count + 1, {}
        for (i, u, v), x in d.items():
            if x is None:
                around = [(i, u + a, v + b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
                known = [q for q in around if d.get(q) is not None]
                w = [np.exp(-((q[1] - u) ** 2 + (q[2] - v) ** 2) / (2 * near**2)) * np.exp(-((g[q] - g[i, u, v]) ** 2) / (2 * like**2)) for q in known]
                if len(known) >= least and sum(w) > 0:
                    new[i, u, v] = sum(a * d[q] for a, q in zip(w, known)) / sum(w)
        if not new:
            return {k: (x, when.get(k)) for k, x in d.items()}
        d.update(new)
        when.update({k: count for k in new})


@pytest.mark.parametrize("tile,radius", [(4, 2), (64, 1), (3, 3)])
def test_filled_depth_against_loops(spark, tile, radius):
    rng = np.random.default_rng(tile)
    pixels = {}
    for image in ("a", None):
        for u in range(-5, 12):
            for v in range(9):
                if rng.random() < 0.9:
                    hole = rng.random() < 0.3 or (2 <= u <= 7 and 1 <= v <= 6)
                    pixels[image, u, v] = (None if hole else float(rng.integers(1, 90)), float(rng.integers(0, 60)))
    rows = spark.createDataFrame([(*k, x, g, "kept") for k, (x, g) in pixels.items()], "image string, u int, v int, d double, g double, tu string")
    least = 3
    found = depthfill.fill(depthfill.raster(rows, "image", "u", "v", "d", "g"), radius, 1.5, 30.0, least, tile).collect()
    expected = plain_fill(pixels, radius, 1.5, 30.0, least)
    assert len(found) == len(expected) and max(r.round or 0 for r in found) >= (2 if radius < 3 else 1)
    for r in found:
        d, when = expected[r.image, r.u, r.v]
        assert r.round == when and (r.d is None) == (d is None) and (d is None or abs(r.d - d) < 1e-9)


def test_raster_of_broken_repeated_and_no_pixels(spark):
    rows = [("a", 0, 0, 5.0, 1.0), ("a", 0, 0, 7.0, None), ("a", 0, 1, 5.0, 1.0), ("a", 0, 1, 0.0, 1.0), ("a", 0, 2, float("nan"), 1.0), ("a", 0, 3, float("inf"), 1.0), ("a", 9, 9, None, 2.0)]
    df = spark.createDataFrame(rows, "image string, u int, v int, d double, g double")
    made = {(r.u, r.v): (r.d, r.g) for r in depthfill.raster(df, "image", "u", "v", "d", "g").collect()}
    assert made == {(0, 0): (5.0, 1.0), (0, 1): (None, 1.0), (0, 2): (None, 1.0), (0, 3): (None, 1.0), (9, 9): (None, 2.0)}
    filled = {(r.u, r.v): (r.d, r.round) for r in depthfill.fill(depthfill.raster(df, "image", "u", "v", "d", "g"), 1).collect()}
    assert filled == {(0, 0): (5.0, 0), (0, 1): (5.0, 1), (0, 2): (5.0, 2), (0, 3): (5.0, 3), (9, 9): (None, None)}
    assert depthfill.fill(depthfill.raster(df.limit(0), "image", "u", "v", "d", "g")).collect() == []


def cloud(fits):
    rng = np.random.default_rng(3)
    rows = []
    for fit, k in fits.items():
        centres = 20 * rng.random((k, 3))
        for i in range(60):
            rows.append((fit, i, float(rng.integers(1, 4)), (centres[i % k] + 0.3 * rng.normal(size=3)).tolist()))
    return rows


def test_lloyd_rounds_against_numpy(spark, monkeypatch):
    rows = cloud({"a": 2, "b": 4})
    begun = [(f, c, rows[60 * i + 7 * c][3]) for i, (f, k) in enumerate((("a", 2), ("b", 4))) for c in range(k)] + [("a", 2, [1e6] * 3)]
    points = spark.createDataFrame(rows, "fit string, id long, w double, v array<double>")
    centres = spark.createDataFrame(begun, "fit string, cluster long, v array<double>")
    for rounds in (1, 3):
        state = {(f, c): np.array(v) for f, c, v in begun}
        for _ in range(rounds):
            sums = {}
            for f, _, w, v in rows:
                c = min((((np.array(v) - x) ** 2).sum(), c) for (g, c), x in state.items() if g == f)[1]
                s, t = sums.get((f, c), (0, 0))
                sums[f, c] = s + w * np.array(v), t + w
            state = {k: sums[k][0] / sums[k][1] if k in sums else x for k, x in state.items()}
        for salted in (False, True):
            monkeypatch.setattr(kmeans, "NUMBERS", 0 if salted else 4_000_000)
            found = {(r.fit, r.cluster): r.v for r in kmeans.lloyd(points, centres, rounds, -1.0).collect()}
            assert found.keys() == state.keys() and all(np.allclose(found[k], state[k]) for k in state)


def test_seeded_fits_find_planted_clusters(spark):
    rows = cloud({"a": 2, "b": 4}) + [("c", 1, 1.0, [1.0, 2.0, 3.0]), ("c", 2, 1.0, [1.0, 2.0, 3.0]), ("c", 3, 0.0, [9.0, 9.0, 9.0]), ("c", 4, 1.0, None)]
    points = spark.createDataFrame(rows, "fit string, id long, w double, v array<double>")
    ks = spark.createDataFrame([("a", 2), ("b", 4), ("c", 3)], "fit string, k int")
    centres = kmeans.kmeans(points, ks)
    found = {r.fit: r for r in kmeans.scores(points, centres).collect()}
    assert (found["a"].k, found["b"].k, found["c"].k) == (2, 4, 1)
    assert found["c"].inertia == 0 and found["c"].n == 2
    for f, k in (("a", 2), ("b", 4)):
        own = [(i % k, w, np.array(v)) for g, i, w, v in rows if g == f]
        best = 0.0
        for c in range(k):
            w, x = np.array([w for j, w, _ in own if j == c]), np.stack([v for j, _, v in own if j == c])
            best += (w[:, None] * (x - (w[:, None] * x).sum(0) / w.sum()) ** 2).sum()
        assert found[f].inertia < 1.5 * best + 1e-9


def test_null_references_have_the_shares_and_sizes(spark):
    rows = [("a", i, 40.0, [1.0 if i % 2 else 0.0, 1.0, 0.0, 1.0 if i % 4 == 0 else 0.0]) for i in range(40)]
    points = spark.createDataFrame(rows, "fit string, id long, w double, v array<double>")
    drawn = kmeans.null_references(points, 3)
    assert [r.n for r in drawn.groupBy("draw").agg(F.sum("w").alias("n")).orderBy("draw").collect()] == [1600.0] * 3
    means = drawn.select("draw", "w", F.posexplode("v").alias("i", "x")).groupBy("i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("p"))
    assert np.allclose([r.p for r in means.orderBy("i").collect()], [0.5, 1, 0, 0.25], atol=0.03)
    assert drawn.where("draw = 1").exceptAll(drawn.where("draw = 2").withColumn("draw", F.lit(1))).count() > 0


def test_a_round_shuffles_sums_of_tasks_and_not_coordinates(spark):
    rows = [(f, i, 1.0 + i % 3, [float(i % 7), float(i % 5), float(-i)]) for f in ("a", "b") for i in range(500)] + [("a", 999, 1.0, None), (None, 1, 1.0, [0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "fit string, id long, w double, v array<double>")
    centres = spark.createDataFrame([("a", 0, [0.0, 0.0, 0.0]), ("a", 1, [3.0, 3.0, -300.0]), ("b", 5, [0.0, 0.0, 0.0])], "fit string, cluster long, v array<double>")
    moved = kmeans.step(points, centres)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(v" not in plan and "posexplode(v" not in plan
    found = {(r.fit, r.cluster): r for r in moved.collect()}
    for f, numbers in (("a", (0, 1)), ("b", (5,))):
        x, w = (np.array([r[j] for r in rows if r[0] == f and r[3]], float) for j in (3, 2))
        c = np.array([r.v for r in sorted(centres.where(f"fit = '{f}'").collect(), key=lambda r: r.cluster)])
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        for i, number in enumerate(numbers):
            own = d.argmin(1) == i
            r = found[f, number]
            assert np.allclose(r.v, (w[own, None] * x[own]).sum(0) / w[own].sum()) and abs(r.w - w[own].sum()) < 1e-9 and np.isclose(r.inertia, (w * d[:, i])[own].sum())

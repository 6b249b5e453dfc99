"""Grid neighbours, outliers and alignment against all pairs."""

import numpy as np

from scenelake.operators import neighbours as N


def frame(spark, clouds):
    rows = [(c, float(x), float(y), float(z), "kept") for c, p in clouds.items() for x, y, z in p]
    return spark.createDataFrame(rows, "cloud string, x double, y double, z double, hx string")


def plain(points, k):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, 1)[:, : min(k, len(points) - 1)]
    return near.mean(1) if near.shape[1] else np.full(len(points), np.nan)


def clouds():
    rng = np.random.default_rng(4)
    ball = rng.normal(0, 1, (150, 3))
    tight = np.vstack([rng.normal(0, 1e-2, (120, 3)), rng.normal(5, 1, (30, 3)), [[90.0, -5, 2]]])
    heap = np.vstack([np.repeat([[1.0, 2, 3]], 60, 0), np.repeat([[1.0, 2, 4]], 3, 0), rng.random((25, 3))])
    flat = np.column_stack([rng.random((80, 2)), np.zeros(80)])
    line = np.column_stack([np.arange(40.0) ** 2, np.zeros(40), np.zeros(40)])
    return {"ball": ball, "tight": tight, "heap": heap, "flat": flat, "line": line, "few": rng.random((4, 3)), "one": np.array([[1.0, 1, 1]]), "same": np.zeros((9, 3))}


def test_mean_distances_against_all_pairs(spark):
    k = 6
    found = {}
    for r in N.mean_distances(frame(spark, clouds()), k).collect():
        found[r.cloud, r.x, r.y, r.z] = (r["mean"], r.n)
    for c, p in clouds().items():
        for point, d in zip(p, plain(p, k)):
            mean, n = found.pop((c, *point), None) or found.get((c, *point)) or (None, 0)
            if n > 1:
                found[c, *point] = (mean, n)
            assert (mean is None and np.isnan(d)) or abs(mean - d) < 1e-9, (c, point)


def test_planted_outliers_go_and_others_stay(spark):
    rng = np.random.default_rng(8)
    inside = rng.random((400, 3))
    stray = np.array([[3.0, 3, 3], [-2, 0, 0], [0.5, 0.5, 5]])
    rows = N.outliers(frame(spark, {"a": np.vstack([inside, stray]), "b": inside[:50]}), 8, 3.0).collect()
    assert {(r.x, r.y, r.z) for r in rows if r.outlier and r.cloud == "a"} == set(map(tuple, stray))
    d = plain(np.vstack([inside, stray]), 8)
    assert abs(rows[0].cut - (d.mean() + 3 * d.std(ddof=1))) < 1e-9 or rows[0].cloud != "a"
    assert all(r.hx == "kept" for r in rows) and len(rows) == 453


def test_broken_coordinates_and_empty_clouds(spark):
    df = spark.createDataFrame([(None, 1.0, None, 1.0), (None, float("nan"), 1.0, 1.0), (None, 0.0, 0.0, float("inf")), (None, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 1.0)], "cloud string, x double, y double, z double")
    rows = N.outliers(df, 3).collect()
    assert len(rows) == 5 and not any(r.outlier for r in rows)
    assert sorted(r.mean_distance is not None for r in rows) == [False, False, False, True, True]
    assert N.outliers(df.limit(0), 3).collect() == []


def turn(a, b):
    x = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    z = np.array([[np.cos(b), -np.sin(b), 0], [np.sin(b), np.cos(b), 0], [0, 0, 1]])
    return z @ x


def test_alignment_finds_planted_motions(spark):
    rng = np.random.default_rng(1)
    source, target, planted = {}, {}, {}
    for i, (a, b) in enumerate([(0.0, 0.0), (0.03, -0.02), (-0.05, 0.04)]):
        p = rng.random((300, 3))
        planted[str(i)] = turn(a, b), np.array([0.01 * i, -0.005, 0.004 * i])
        source[str(i)], target[str(i)] = p, p @ planted[str(i)][0].T + planted[str(i)][1]
    for r in N.align(frame(spark, source), frame(spark, target)).collect():
        turned = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(turned, planted[r.cloud][0], atol=1e-7) and np.allclose([r.tx, r.ty, r.tz], planted[r.cloud][1], atol=1e-7)
        assert r.rmse < 1e-7 and 1 <= r.rounds < 30


def test_rigid_motion_of_mirrored_points_is_no_mirror(spark):
    p = np.random.default_rng(2).random((40, 3))
    sums = N.pair_sums(frame(spark, {"m": p}), frame(spark, {"m": p * [1, 1, -1]}))
    r = N.rigid_motions(sums).first()
    assert abs(np.linalg.det(np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])) - 1) < 1e-9


def test_rounds_do_not_grow_with_uneven_density(spark, monkeypatch):
    rng = np.random.default_rng(6)
    uneven = {"scales": np.vstack([rng.normal(0, 10.0**-e, (60, 3)) for e in range(-3, 9)]), "flat": clouds()["flat"], "heap": clouds()["heap"]}
    real, calls = N.written, []
    monkeypatch.setattr(N, "FULL", 8, raising=False)
    monkeypatch.setattr(N, "TOPS", 2, raising=False)
    monkeypatch.setattr(N, "written", lambda df, name: calls.append(name) or real(df, name))
    found = {(r.cloud, r.x, r.y, r.z): r["mean"] for r in N.mean_distances(frame(spark, uneven), 5).collect()}
    assert len(calls) <= 6
    for c, p in uneven.items():
        for point, d in zip(p, plain(p, 5)):
            assert abs(found[c, *point] - d) < 1e-9 * max(1, d), (c, point)


def test_nearest_of_other_places_over_several_boxes(spark, monkeypatch):
    monkeypatch.setattr(N, "FULL", 8, raising=False)
    rng = np.random.default_rng(7)
    held, asked = np.round(rng.random((300, 3)), 1), np.round(4 * rng.random((80, 3)) - 2, 1)  # many ties
    rows = N.nearest(N.places(frame(spark, {None: asked, "none": asked[:2]}), "cloud"), N.places(frame(spark, {None: held}), "cloud"), 1).collect()
    found = {(r.x, r.y, r.z): (r.d, r.hx, r.hy, r.hz) for r in rows}
    assert len(rows) == len(found) == len({tuple(p) for p in asked + 0.0})
    for p in asked + 0.0:
        assert found[tuple(p)] == min((float(np.sqrt(sum((p - q) ** 2))), *q) for q in held + 0.0)


def test_few_points_ask_further_boxes(spark, monkeypatch):
    p = np.random.default_rng(9).random((9000, 3))
    real, near = N.written, []

    def written(df, name):
        out = real(df, name)
        if name == "near":
            near.append(out.selectExpr("avg(int(size(cells) > 0)) AS s").first().s)
        return out

    monkeypatch.setattr(N, "written", written)
    found = N.outliers(frame(spark, {"a": p}), 20)
    assert len(near) == 1 and 0 < near[0] < 0.4
    some = found.where("x < 0.1").collect()
    assert len(some) == (p[:, 0] < 0.1).sum() > 500
    for r in some:
        d = np.sort(np.sqrt(((p - [r.x, r.y, r.z]) ** 2).sum(1)))[1:21]
        assert abs(r.mean_distance - d.mean()) < 1e-9


def test_outliers_with_more_copies_than_a_box_has_points(spark, monkeypatch):
    monkeypatch.setattr(N, "FULL", 8)
    rng = np.random.default_rng(10)
    p = np.vstack([np.repeat([[0.5, 0.5, 0.5]], 700, 0), np.repeat([[0.5, 0.5, 0.75]], 4, 0), rng.random((300, 3))])
    rows = N.outliers(frame(spark, {"a": p, None: p[690:800]}), 6).collect()
    assert len(rows) == 1004 + 110
    for c, points in (("a", p), (None, p[690:800])):
        want = plain(points, 6)
        cut = want.mean() + 2 * want.std(ddof=1)
        means = dict(zip(map(tuple, points), want))
        got = [r for r in rows if r.cloud == c]
        assert len(got) == len(points)
        for r in got:
            assert abs(r.mean_distance - means[r.x, r.y, r.z]) < 1e-9 and abs(r.cut - cut) < 1e-9
            assert r.outlier == (r.mean_distance > r.cut)


def test_a_round_of_alignment_reads_packed_points(spark, monkeypatch):
    monkeypatch.setattr(N, "FULL", 40)
    rng = np.random.default_rng(11)
    real, calls = N.written, []
    monkeypatch.setattr(N, "written", lambda df, name: calls.append(name) or real(df, name))
    p, far = rng.random((500, 3)), rng.random((200, 3))
    r = turn(0.02, -0.03)
    source, target = {"a": np.vstack([p, p[:9]]), None: far, "alone": far[:5]}, {"a": p @ r.T + [0.01, -0.005, 0.004], None: far + [0.06, 0.0, -0.05]}
    rows = {x.cloud: x for x in N.align(frame(spark, source), frame(spark, target)).collect()}
    assert calls.count("packs") <= 3 and calls.count("near") < calls.count("round")
    for c, turned, shift in (("a", r, [0.01, -0.005, 0.004]), (None, np.eye(3), [0.06, 0.0, -0.05])):
        x = rows[c]
        assert np.allclose([[x[f"r{i}{j}"] for j in range(3)] for i in range(3)], turned, atol=1e-7) and np.allclose([x.tx, x.ty, x.tz], shift, atol=1e-7)
    assert rows["alone"].rounds == 0 and rows["alone"].tx == 0


def test_packed_sums_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "FULL", 8)
    rng = np.random.default_rng(12)
    p, q = np.round(rng.random((200, 3)), 1), np.round(rng.random((250, 3)), 1)  # many ties
    source, target = frame(spark, {"a": p}), N.Index(N.written(N.places(frame(spark, {"a": q}), "cloud"), "target"), 1)
    still = spark.createDataFrame([("a", *map(float, np.eye(3).ravel()), 0.0, 0.0, 0.0)], "cloud string, " + ", ".join(f"{c} double" for c in (*N._TURN, *N._SHIFT)))
    found = N._round(N._packs(N.written(N.places(source, "cloud"), "source"), target, still), still)
    rest = N.places(found.selectExpr("cloud", "inline(arrays_zip(x, y, z, n))"), "cloud", "n")
    got = N._centred(found.select("cloud", *N._SUMMED).unionByName(N._paired(rest, target))).first()
    near = np.array([min((float(np.sqrt(sum((x - y) ** 2))), *y) for y in q) for x in p])
    want = p.mean(0), near[:, 1:].mean(0), (p - p.mean(0)).T @ (near[:, 1:] - near[:, 1:].mean(0)), np.sqrt((near[:, 0] ** 2).mean())
    assert got.pairs == 200 and np.allclose([got.ax, got.ay, got.az], want[0]) and np.allclose([got.bx, got.by, got.bz], want[1])
    assert np.allclose([[got[f"s{i}{j}"] for j in range(3)] for i in range(3)], want[2]) and abs(got.rmse - want[3]) < 1e-12

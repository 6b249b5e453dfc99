"""Rank selection, orderings by sets, suppression in rounds, bit slices and streamed pairs against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import cooccurrence, selection, splits, subsets, suppression
from scenelake.streaming import cooccurrence as streamed

INF = float("inf")


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.normal(size=500).tolist(), "far": [*(10.0 ** rng.integers(-300, 300, 200)), -1.5e308, 1.7e308], "ties": [1.0] * 60 + [2.0] * 40,
        "one": [3.5], "two": [-1.0, 4.0], "close": [1.0, np.nextafter(1.0, 2), 1.0], None: rng.random(50).tolist(), "none": [None, None],
    }
    rows = [(g, None if x is None else float(x), "kept") for g, v in groups.items() for x in [*v, None]]
    shares = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "grp string, v double, n string")
    found = {r.grp: r for r in selection.percentiles(df, "grp", "v", shares).collect()}
    exact = {r.grp: r for r in df.groupBy("grp").agg(*[F.percentile("v", s).alias(f"p{i}") for i, s in enumerate(shares)]).collect()}
    assert found.keys() == groups.keys()
    for g, v in groups.items():
        assert found[g].n == sum(x is not None for x in v)
        for i in range(len(shares)):
            a, b = found[g][f"p{i}"], exact[g][f"p{i}"]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12)), (g, i)


def test_percentiles_of_infinite_values_and_of_no_rows(spark):
    rows = [("a", x) for x in (-INF, 1.0, 2.0, 3.0, INF, float("nan"))] + [("b", INF)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in selection.percentiles(df, "g", "v", [0.0, 0.4, 0.8, 1.0]).collect()}
    assert (found["a"].p0, found["a"].p1, found["a"].p2) == (-INF, 2.0, INF) and np.isnan(found["a"].p3) and found["b"].p1 == INF
    assert selection.percentiles(df.limit(0), "g", "v", [0.5]).collect() == []


def test_no_percentile_and_no_buffer_in_the_plan(spark, monkeypatch):
    seen = []
    plain = selection.written
    monkeypatch.setattr(selection, "written", lambda df, name: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    selection.percentiles(spark.range(100).selectExpr("id % 3 as g", "id * id as v"), "g", "v", [0.5]).collect()
    assert len(seen) > 3 and not any("percentile" in p for p in seen)


def random_masks(seed, n):
    rng = random.Random(seed)
    return [(f"t{t}", rng.randrange(1 << n), rng.randrange(1, 30)) for t in range(n) for _ in range(12)]


def by_loops(masks, types):
    best = None
    for i, order in enumerate(itertools.permutations(range(len(types)))):
        kept = []
        for at, t in enumerate(order):
            future = sum(1 << x for x in order[at + 1 :])
            kept.append(sum(n for name, m, n in masks if name == types[t] and not m & future))
        key = (min(kept), sum(kept), -i)
        if best is None or key > best[0]:
            best = key, [types[t] for t in order]
    return best[1], best[0][0], best[0][1]


@pytest.mark.parametrize("seed,n", [(2, 4), (3, 6)])
def test_best_ordering_against_all_orders(spark, seed, n):
    masks, types = random_masks(seed, n), [f"t{t}" for t in range(n)]
    df = spark.createDataFrame([*masks, ("other", 3, 99)], "scene_type string, mask long, n long")
    r = subsets.best_ordering(df, types).first()
    assert (r.types, r.min_survived, r.total_survived) == by_loops(masks, types)
    if n == 4:
        swept = splits.sweep(df, splits.orderings(spark, types), types)
        best = splits.best_ordering(swept).join(splits.orderings(spark, types), "ordering").first()
        assert (best.types, best.min_survived, best.total_survived) == (r.types, r.min_survived, r.total_survived)


def test_twelve_types_against_plain_sets(spark):
    n = 12
    rng = random.Random(9)
    masks = [(f"t{t:02d}", (1 << t) | (1 << rng.randrange(n)), rng.randrange(1, 99)) for t in range(n) for _ in range(8)]
    types = [f"t{t:02d}" for t in range(n)]
    r = subsets.best_ordering(spark.createDataFrame(masks, "scene_type string, mask long, n long"), types).first()
    alive = lambda t, held: sum(k for name, m, k in masks if name == types[t] and not m & ~held)
    least = {0: 1 << 62}
    for held in range(1, 1 << n):
        least[held] = max(min(least[held & ~(1 << t)], alive(t, held)) for t in range(n) if held >> t & 1)
    placed, kept = 0, []
    for t in r.types:
        placed |= 1 << types.index(t)
        kept.append(alive(types.index(t), placed))
    assert sorted(r.types) == types and min(kept) == r.min_survived == least[(1 << n) - 1] and sum(kept) == r.total_survived


def test_orderings_of_no_scenes_and_of_too_many_types(spark):
    empty = spark.createDataFrame([], "scene_type string, mask long, n long")
    r = subsets.best_ordering(empty, ["a", "b"]).first()
    assert (r.types, r.min_survived, r.total_survived) == (["a", "b"], 0, 0)
    with pytest.raises(ValueError):
        subsets.best_ordering(empty, [str(i) for i in range(21)])


@pytest.mark.parametrize("least", [40, 10_000])
def test_best_merge_against_all_cuts(spark, least):
    n = 5
    masks, types = random_masks(4, n), [f"t{t}" for t in range(n)]
    best = None
    for cuts in itertools.product((0, 1), repeat=n - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
        parts = list(zip([0, *ends[:-1]], ends))
        alive = [sum(k for name, m, k in masks if a <= int(name[1:]) < b and m >> b == 0) for a, b in parts]
        if min(alive) >= least:
            key = (len(parts), sum(alive), [-e for e in ends])
            if best is None or key > best[0]:
                best = key, [(types[a:b], s) for (a, b), s in zip(parts, alive)]
    df = spark.createDataFrame(masks, "scene_type string, mask long, n long")
    found = [(r.types, r.survived) for r in subsets.best_merge(df, types, least).orderBy("part").collect()]
    assert found == (best[1] if best else [])


def boxes(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None]), round(rng.random(), 1), *[4 * rng.random() for _ in range(3)], *[2 ** rng.uniform(-3, 2) for _ in range(3)]) for i in range(n)]
    chain = [(1000 + i, "chain", 1 - i / 100, 0.5 * i, 0.0, 0.0, 1.0, 1.0, 1.0) for i in range(40)]
    odd = [(2000, "a", 0.5, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0), (2001, "a", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2002, "a", 0.1, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0)]
    same = [(3000 + i, "same", 0.7, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(5)]
    return rows + chain + odd + same


def test_suppression_in_rounds_against_one_by_one(spark):
    rows = boxes(7, 300)
    names = ["id", "key", "score", "cx", "cy", "cz", "w", "h", "l"]
    df = spark.createDataFrame(rows, "id long, key string, score double, cx double, cy double, cz double, w double, h double, l double")
    kept = []
    usable = [r for r in rows if r[0] not in (2000, 2001, 2002)]
    for r in sorted(usable, key=lambda r: (-r[2], *r[3:6], r[0])):
        low, high = [c - e / 2 for c, e in zip(r[3:6], r[6:])], [c + e / 2 for c, e in zip(r[3:6], r[6:])]
        for q in kept:
            if q[1] == r[1]:
                qlow, qhigh = [c - e / 2 for c, e in zip(q[3:6], q[6:])], [c + e / 2 for c, e in zip(q[3:6], q[6:])]
                both = np.prod([max(0.0, min(a, b) - max(c, d)) for a, b, c, d in zip(high, qhigh, low, qlow)])
                if both / max(np.prod(r[6:]) + np.prod(q[6:]) - both, 1e-12) > 0.25:
                    break
        else:
            kept.append(r)
    found = suppression.suppress(df, ["key"])
    assert found.columns == names and sorted(r.id for r in found.collect()) == sorted([r[0] for r in kept] + [2000, 2001, 2002])
    assert suppression.suppress(df.limit(0), ["key"]).collect() == []


def test_sliced_gram_equals_the_joined_one(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(500), rng.choice("abcdefg")) for _ in range(1500)}
    found = spark.createDataFrame([*rows], "scene long, class string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(cooccurrence.gram_sliced(found)) == key(cooccurrence.gram(found))
    assert cooccurrence.gram_sliced(found.limit(0)).collect() == []


def test_streamed_pairs_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(12)
    rows = [(f"s{rng.randrange(30)}", rng.choice(["a", "b", "c", "d", None])) for _ in range(300)] + [(None, "a")]
    schema = "scene string, class string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in (rows[:100], rows[100:]):  # a query starts again on its checkpoint
        for i in range(0, len(part), 60):
            spark.createDataFrame(part[i : i + 60], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streamed.keep_counts(stream(), str(tmp_path)).awaitTermination()
    alone, pairs = streamed.counts(spark, str(tmp_path))
    whole = spark.createDataFrame([*{r for r in rows if None not in r}], schema)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(pairs) == key(cooccurrence.pair_counts(whole)) and key(alone) == key(cooccurrence.marginals(whole))


def test_top_positions_keeps_every_row(spark, tmp_path):
    import duckdb

    from scenelake import queries, scene_queries

    rows = spark.range(16_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1000)) / 500.0 - 1).cast("float")).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {tuple(r) for r in scene_queries.top_positions(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(duck.execute(queries.QUERIES["top_positions"][1]).fetchall())
    per = {c: sum(w[0] == c for w in want) for c in {w[0] for w in want}}
    assert max(per.values()) > 2000 and found == want


@pytest.mark.parametrize("judge", ["ordering", "merge"])
def test_masks_are_made_once(spark, judge):
    masks, types = random_masks(5, 5), [f"t{t}" for t in range(5)]
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    counted = F.udf(count, "long").asNondeterministic()
    df = spark.createDataFrame(masks, "scene_type string, mask long, n long").withColumn("n", counted("n"))
    (subsets.best_ordering(df, types) if judge == "ordering" else subsets.best_merge(df, types, 1)).collect()
    assert seen.value == len(masks)


def test_batches_add_classes_and_pairs_without_python_rows(spark):
    schema = "scene string, class string"
    held = spark.createDataFrame([("s", "b"), ("s", "d"), ("t", "a")], schema)
    batch = spark.createDataFrame([("s", "c"), ("s", "a"), ("s", "b"), ("u", "x"), ("u", "x"), ("t", "a"), (None, "a"), ("u", None)], schema)
    added = streamed.grown(batch, held)
    assert "Python" not in streamed.deltas(added)._jdf.queryExecution().executedPlan().toString()
    assert {(r.scene, *r.fresh) for r in added.collect()} == {("s", "a", "c"), ("u", "x")}
    want = {("a", None, 1), ("c", None, 1), ("x", None, 1), ("a", "b", 1), ("a", "d", 1), ("a", "c", 1), ("b", "c", 1), ("c", "d", 1)}
    assert {tuple(r) for r in streamed.deltas(added).collect()} == want

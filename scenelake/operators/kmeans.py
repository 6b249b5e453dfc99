"""Weighted k-means as jobs over all points, many fits at once.

A fit is a key: a class, a number of clusters, a draw, a start. Its points and
centres carry the key, so one round of a job moves the centres of all fits. Batches of
points meet the few centres of their fits as matrices; members, inertia and coordinate
sums are partial sums of a task by fit and cluster, so a fit of any size is the work of
all tasks and a round shuffles a row for each task and cluster. Fits whose centres
stand still leave the rounds.

Seeds come in rounds as well (k-means||): each round takes a point with a
probability of its share of the error, about twice as many points as clusters; the
candidates, weighted by the points nearest to them, are a bounded table, of which
each fit draws its seeds. All draws are hashes of the seed, the round and the
point, so a lost task draws the same again.

Defined results:
- ties of distances go to the least cluster number; a cluster without points keeps
  its centre;
- weights of zero or less and null vectors take no part;
- a fit of fewer distinct points than clusters has as many clusters as points;
- all vectors of a fit have one length; an empty table gives no centres.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.stages import dropped, written

#: Numbers in all centres that are sent to all executors, at most; beyond, points and centres are shuffled over SALTS.
NUMBERS, SALTS = 4_000_000, 32


def square(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _few(centres: DataFrame) -> dict | None:
    """The centres as ``fit`` -> (cluster numbers, matrix), in the order of the numbers; none if there are too many to send."""
    if centres.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] > NUMBERS:
        return None
    books: dict = {}
    for r in sorted(centres.select("fit", "cluster", "v").collect(), key=lambda r: r.cluster):
        books.setdefault(r.fit, []).append((r.cluster, r.v))
    return {fit: (np.array([c for c, _ in rows]), np.array([v for _, v in rows], float)) for fit, rows in books.items()}


def _nearest(batch: pa.RecordBatch, books: dict):
    """For each fit of a batch its rows, their vectors, and the index and squared distance of the nearest centre."""
    fits = batch.column("fit").dictionary_encode()
    codes, vectors = fits.indices.fill_null(-1).to_numpy(zero_copy_only=False), batch.column("v")
    for code, fit in enumerate(fits.dictionary.to_pylist()):
        if fit not in books:
            continue
        rows = np.flatnonzero((codes == code) & vectors.is_valid().to_numpy(zero_copy_only=False))
        if not len(rows):
            continue
        x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        at, least = np.zeros(len(rows), int), np.full(len(rows), np.inf)
        for i, c in enumerate(books[fit][1]):
            gap = x - c
            d = np.einsum("ij,ij->i", gap, gap)
            at, least = np.where(d < least, i, at), np.minimum(d, least)
        yield fit, rows, x, at, least


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``points`` (``fit``, ``id``, ``w``, ``v``) with the nearest ``cluster`` of their fit and its squared distance ``d``."""
    few, names = _few(centres), points.columns
    if few is not None:

        def run(batches):
            for batch in batches:
                for fit, rows, _, at, d in _nearest(batch, few):
                    columns = [*batch.take(pa.array(rows)).columns, pa.array(few[fit][0][at]), pa.array(d)]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "cluster", "d"])

        kind = centres.schema["cluster"].dataType
        return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cluster", kind), T.StructField("d", T.DoubleType())]))
    books = centres.groupBy(F.col("fit").alias("c_fit")).agg(F.sort_array(F.collect_list(F.struct("cluster", F.col("v").alias("c")))).alias("book"))
    salted = books.withColumn("c_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = points.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, F.expr("fit = c_fit and salt = c_salt"))
    best = F.array_min(F.transform("book", lambda x: F.struct(square(F.col("v"), x["c"]).alias("d"), x["cluster"].alias("cluster"))))
    return met.withColumn("best", best).select(*points.columns, F.col("best.cluster").alias("cluster"), F.col("best.d").alias("d"))


def _sums(points: DataFrame, few: dict, kind: T.DataType) -> DataFrame:
    """``fit``, ``cluster``, ``i``, and sums of ``w * x``, ``w`` and ``w * d``: those of a task's batches, added."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            weights = batch.column("w").to_numpy(zero_copy_only=False)
            for fit, rows, x, at, d in _nearest(batch, few):
                w = weights[rows]
                for c in np.unique(at):
                    of = at == c
                    more = np.concatenate([w[of] @ x[of], [w[of].sum(), (w[of] * d[of]).sum()]])
                    held[fit, c] = held.get((fit, c), 0.0) + more
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in keys], fit_type), pa.array([int(few[f][0][c]) for f, c in keys], pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
            ["fit", "cluster", "s"],
        )

    fit_type = to_arrow_type(points.schema["fit"].dataType)
    shape = T.StructType([points.schema["fit"], T.StructField("cluster", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    parts = points.select("fit", "w", "v").mapInArrow(run, shape)
    per = parts.select("fit", F.col("cluster").cast(kind).alias("cluster"), F.posexplode("s").alias("i", "x")).groupBy("fit", "cluster", "i").agg(F.sum("x").alias("x"))
    whole = per.groupBy("fit", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("s"))
    w, e = F.element_at("s", -2), F.element_at("s", -1)
    return whole.select("fit", "cluster", F.posexplode(F.slice("s", 1, F.size("s") - 2)).alias("i", "x"), w.alias("w"), e.alias("e")).withColumn("x", F.col("x") / F.col("w"))


def step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """The centres after one round: ``fit``, ``cluster``, ``v``, its members' weight ``w`` and ``inertia`` about the centre before."""
    few = _few(centres)
    if few is not None:
        sums = _sums(points, few, centres.schema["cluster"].dataType)
    else:
        flat = assigned(points, centres).select("fit", "cluster", "w", "d", F.posexplode("v").alias("i", "x"))
        sums = flat.groupBy("fit", "cluster", "i").agg(
            (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d")).alias("e")
        )
    rows = F.sort_array(F.collect_list(F.struct("i", "x")))
    moved = sums.groupBy(F.col("fit").alias("m_fit"), F.col("cluster").alias("m_cluster")).agg(
        F.transform(rows, lambda r: r["x"]).alias("to"), F.max("w").alias("w"), F.max("e").alias("inertia")
    )
    both = centres.select("fit", "cluster", "v").join(moved, F.expr("fit = m_fit and cluster = m_cluster"), "left")
    return both.select(
        "fit", "cluster", F.coalesce("to", "v").alias("v"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("inertia", F.lit(0.0)).alias("inertia"),
        F.coalesce(square(F.col("to"), F.col("v")), F.lit(0.0)).alias("shift"),
    )


def lloyd(points: DataFrame, centres: DataFrame, rounds: int = 100, still: float = 1e-18) -> DataFrame:
    """The centres after rounds in which a centre moves by more than ``still`` (squared): ``fit``, ``cluster``, ``v``, and the fit's ``rounds``.

    ``points``: ``fit``, ``id``, ``w``, ``v``; ``centres``: ``fit``, ``cluster``, ``v``.
    """
    first = written(centres.select("fit", "cluster", "v"), "centres")
    going, rested, mine = first, [], points
    for i in range(rounds):
        moved = step(mine, going)
        most = F.max("shift").over(Window.partitionBy("fit")).alias("most")  # a row for each cluster of a fit
        after = written(moved.select("fit", "cluster", "v", most), "centres")
        last = i == rounds - 1
        done = after.where("true" if last else f"most <= {still}").select("fit", "cluster", "v", F.lit(i + 1).alias("rounds"))
        going = after.where("false" if last else f"most > {still}").select("fit", "cluster", "v")
        rested.append(done)
        ended, left = after.agg(F.count_if(F.col("most") <= still), F.count_if(F.col("most") > still)).first()
        if last or not left:
            break
        if ended:
            mine = points.join(going.select(F.col("fit").alias("g_fit")).distinct(), F.expr("fit = g_fit"), "left_semi")
    return reduce(DataFrame.unionByName, rested) if rested else first.withColumn("rounds", F.lit(0))


def _unit(seed: int, name: str) -> Column:
    """A number in (0, 1) from a hash of seed, name, fit and point."""
    return (F.pmod(F.xxhash64(F.lit(f"{seed}/{name}"), F.col("fit"), F.col("id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def seeds(points: DataFrame, ks: DataFrame, seed: int = 42, rounds: int = 5, over: int = 2) -> DataFrame:
    """First centres (``fit``, ``cluster``, ``v``) of each fit, as many as ``ks`` (``fit``, ``k``) says.

    A first candidate by weight, then in each round points with the probability
    ``over * k * w * d / error``. The candidates are weighted by their nearest points
    and drawn from by weighted squared distances, a fit's some ``over * rounds * k``
    candidates in one task.
    """
    usable = points.where("w > 0 and v is not null")
    race = -F.log(_unit(seed, "first")) / F.col("w")
    first = usable.groupBy("fit").agg(F.min_by("v", race).alias("v")).select("fit", F.lit(0).cast("long").alias("cluster"), "v")
    chosen = written(first, "candidates")
    wanted = F.broadcast(ks.select(F.col("fit").alias("k_fit"), "k"))
    for i in range(rounds):
        near = assigned(usable, chosen)
        errors = near.groupBy(F.col("fit").alias("e_fit")).agg(F.sum(F.col("w") * F.col("d")).alias("error"))
        chance = F.col("w") * F.col("d") * over * F.col("k") / F.col("error")
        drawn = near.join(errors, F.expr("fit = e_fit")).join(wanted, F.expr("fit = k_fit")).where((F.col("error") > 0) & (_unit(seed, str(i)) < chance))
        # Equal points are one candidate; its number is a hash, so that rounds need no order.
        number = F.xxhash64("v").alias("cluster")
        after = written(chosen.unionByName(drawn.select("fit", number, "v")).dropDuplicates(["fit", "v"]), "candidates")
        dropped(chosen)
        chosen = after
    weights = assigned(usable, chosen).groupBy("fit", "cluster").agg(F.sum("w").alias("w"))
    weighted = chosen.join(weights, ["fit", "cluster"]).join(wanted, F.expr("fit = k_fit")).drop("k_fit")
    kind = points.schema["fit"].dataType.simpleString()

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(key=[tuple(v) for v in frame.v]).sort_values("key")
        x, w, k = np.stack(frame.v.to_numpy()), frame.w.to_numpy(float), int(frame.k.iloc[0])
        rng = np.random.default_rng([seed, len(frame), k])
        picks = [int(rng.choice(len(x), p=w / w.sum()))]
        near = ((x - x[picks[0]]) ** 2).sum(1)
        while len(picks) < k and (w * near).sum() > 0:
            picks.append(int(rng.choice(len(x), p=w * near / (w * near).sum())))
            near = np.minimum(near, ((x - x[picks[-1]]) ** 2).sum(1))
        return pd.DataFrame({"fit": frame.fit.iloc[0], "cluster": np.arange(len(picks)), "v": [x[p].tolist() for p in picks]})

    return weighted.groupBy("fit").applyInPandas(draw, f"fit {kind}, cluster long, v array<double>")


def kmeans(points: DataFrame, ks: DataFrame, seed: int = 42, rounds: int = 100) -> DataFrame:
    """The centres of each fit after seeding and Lloyd rounds: ``fit``, ``cluster``, ``v``, ``rounds``."""
    usable = written(points.where("w > 0 and v is not null"), "points")
    begun = written(seeds(usable, ks, seed), "seeds")
    return lloyd(usable, begun, rounds)


def scores(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``fit``, clusters with members ``k``, their weight ``n`` and the fit's ``inertia``."""
    near = assigned(points.where("w > 0 and v is not null"), centres)
    per = near.groupBy("fit", "cluster").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d")).alias("e"))
    return per.groupBy("fit").agg(F.count("*").alias("k"), F.sum("w").alias("n"), F.sum("e").alias("inertia"))


def null_references(points: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """Points of independent coordinates with the shares of 0/1 ``points``, counted by pattern, for each ``draw`` from 1.

    A fit's draws have as many rows as its points weigh; each row's coordinates are
    hashes of seed, draw, place and row, drawn and counted where the points lie.
    """
    total = F.sum("w")
    flat = points.select("fit", "w", F.posexplode("v").alias("i", "x")).groupBy("fit", "i").agg((F.sum(F.col("w") * F.col("x")) / total).alias("p"))
    shares = flat.groupBy(F.col("fit").alias("p_fit")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda r: r["p"]).alias("p"))
    rows = points.where("w >= 1").select("fit", "id", F.explode(F.sequence(F.lit(1), F.col("w").cast("long"))).alias("copy"))
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).join(F.broadcast(shares), F.expr("fit = p_fit"))
    unit = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), i, F.col("fit"), F.col("id"), F.col("copy")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    v = F.transform("p", lambda p, i: F.when(unit(i) < p, 1.0).otherwise(0.0))
    return rows.select("fit", "draw", v.alias("v")).groupBy("fit", "draw", "v").agg(F.count("*").cast("double").alias("w"))

"""Clustering of binary presence vectors: k-means, silhouette, Gap statistic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def presence_patterns(found: DataFrame, features: DataFrame) -> DataFrame:
    """``focal_class``, ``pattern`` (0/1 text over the sorted features) and ``n`` scenes.

    ``features``: ``focal_class`` and ``feature``; where ``focal_class`` only names a
    case, ``class`` holds the class whose scenes are meant. Thousands of scenes
    collapse to few patterns, over which inertia and silhouette are exact under
    weights.
    """
    of = F.col("class") if "class" in features.columns else F.col("focal_class")
    listed = features.select("focal_class", "feature", of.alias("__of")).groupBy("focal_class", "__of")
    listed = listed.agg(F.sort_array(F.collect_set("feature")).alias("f"))
    focal = found.join(listed, found["class"] == listed["__of"]).select("scene", "focal_class", "f")
    sets = found.groupBy("scene").agg(F.collect_set("class").alias("c"))
    bits = F.array_join(F.transform("f", lambda x: F.when(F.array_contains("c", x), "1").otherwise("0")), "")
    return focal.join(sets, "scene").groupBy("focal_class", bits.alias("pattern")).agg(F.count("*").alias("n"))


def _spread(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres, each drawn by its weighted squared distance from those before."""
    centres = [x[rng.choice(len(x), p=w / w.sum())]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        mass = w * near
        pick = rng.choice(len(x), p=mass / mass.sum()) if mass.sum() > 0 else rng.integers(len(x))
        centres.append(x[pick])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, seed: int, n_init: int = 10) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of ``n_init`` runs."""
    rng = np.random.default_rng(seed)
    best: tuple[np.ndarray, float] | None = None
    for _ in range(n_init):
        centres = _spread(x, w, k, rng)
        for _ in range(100):
            distance = ((x[:, None, :] - centres[None]) ** 2).sum(2)
            labels = distance.argmin(1)
            mass = np.bincount(labels, w, k)
            sums = np.stack([np.bincount(labels, w * x[:, j], k) for j in range(x.shape[1])], 1)
            moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-12)[:, None], centres)
            if np.allclose(moved, centres, atol=1e-12):
                break
            centres = moved
        distance = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        labels = distance.argmin(1)
        inertia = float((w * distance[np.arange(len(x)), labels]).sum())
        if best is None or inertia < best[1] - 1e-12:
            best = labels, inertia
    return best


#: Rows of a block whose distances to all rows are held at once.
BLOCK = 1024


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices, by one product."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def weighted_silhouette(x: np.ndarray, w: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette of rows with multiplicities, a block of rows at a time."""
    kinds, own = np.unique(labels, return_inverse=True)
    if kinds.size < 2:
        return float("nan")
    member = np.zeros((len(x), kinds.size))
    member[np.arange(len(x)), own] = w
    mass = member.sum(0)
    total = 0.0
    for first in range(0, len(x), BLOCK):
        part = slice(first, first + BLOCK)
        distance = _distances(x[part], x)
        rows, mine = np.arange(distance.shape[0]), own[part]
        distance[rows, rows + first] = 0.0
        sums = distance @ member
        a = sums[rows, mine] / np.maximum(mass[mine] - 1, 1e-12)
        other = sums / mass
        other[rows, mine] = np.inf
        b = other.min(1)
        s = np.where(mass[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        total += float((w[part] * s).sum())
    return total / float(w.sum())


def null_reference(x: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their counts of as many draws as the rows weigh, with independent columns of the same shares.

    The draws are split column by column, a pattern's so far by one binomial number, so
    the work grows with the patterns that occur and not with the draws.
    """
    p = np.clip((w[:, None] * x).sum(0) / w.sum(), 1e-6, 1 - 1e-6)
    bits, counts = np.zeros((1, 0)), np.array([int(w.sum())])
    for share in p:
        ones = rng.binomial(counts, share)
        column = np.repeat([0.0, 1.0], len(counts))[:, None]
        bits, counts = np.hstack([np.vstack([bits, bits]), column]), np.concatenate([counts - ones, ones])
        bits, counts = bits[counts > 0], counts[counts > 0]
    order = np.lexsort(bits.T[::-1])
    return bits[order], counts[order].astype(float)


_FITS = "focal_class string, k int, draw int, log_w double, silhouette double, labels string"


def fits(patterns: DataFrame, ks: list[int], draws: int = 0, seed: int = 42, n_init: int = 10) -> DataFrame:
    """K-means of each focal class for each k, on the data (draw 0) and on ``draws`` null references.

    A null reference has independent columns with the data's shares; it depends
    on the class, k and the draw alone. Each combination is a task of its own
    over the class's patterns. Fits with one distinct label are left out.
    """
    jobs = patterns.groupBy("focal_class").agg(
        F.collect_list(F.struct("pattern", "n")).alias("rows"), F.sum("n").alias("total")
    )
    jobs = jobs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("k < total")
    jobs = jobs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for focal, k, draw, rows in zip(frame.focal_class, frame.k, frame.draw, frame["rows"]):
            rows = sorted((r["pattern"], r["n"]) for r in rows)
            x = np.array([[int(c) for c in p] for p, _ in rows], float)
            w = np.array([n for _, n in rows], float)
            if draw:
                x, w = null_reference(x, w, np.random.default_rng([seed, draw, k, *focal.encode()]))
            labels, inertia = weighted_kmeans(x, w, int(k), seed, n_init)
            if np.unique(labels).size < 2:
                continue
            score = None if draw else weighted_silhouette(x, w, labels)
            text = "" if draw else ",".join(f"{p}:{c}" for (p, _), c in zip(rows, labels))
            out.append((focal, int(k), int(draw), float(np.log(inertia + 1e-10)), score, text))
        return pd.DataFrame(out, columns=["focal_class", "k", "draw", "log_w", "silhouette", "labels"])

    spread = jobs.select("focal_class", "k", "draw", "rows").repartition("focal_class", "k", "draw")
    return spread.mapInPandas(lambda frames: map(run, frames), _FITS)


def gap_table(fitted: DataFrame) -> DataFrame:
    """``focal_class``, ``k``, ``gap`` and ``sk`` from the fits of data and null references."""
    null = F.when(F.col("draw") > 0, F.col("log_w"))
    out = fitted.groupBy("focal_class", "k").agg(
        F.max(F.when(F.col("draw") == 0, F.col("log_w"))).alias("log_w"),
        F.avg(null).alias("m"),
        F.stddev_pop(null).alias("s"),
        F.count(null).alias("b"),
    )
    return out.select(
        "focal_class",
        "k",
        F.round(F.col("m") - F.col("log_w"), 6).alias("gap"),
        F.round(F.col("s") * F.sqrt(1 + 1 / F.col("b")), 6).alias("sk"),
        F.round("log_w", 6).alias("log_w"),
    )


def one_se_steps(gaps: DataFrame) -> DataFrame:
    """Each k with the bound set by the next k, and whether the rule fires there."""
    order = Window.partitionBy("focal_class").orderBy("k")
    bound = F.lead(F.col("gap") - F.col("sk")).over(order)
    steps = gaps.withColumn("bound", F.round(bound, 6))
    return steps.withColumn("fires", F.coalesce(F.col("gap") >= F.col("bound"), F.lit(False)))


def best_k(gaps: DataFrame) -> DataFrame:
    """The least k that satisfies the one-standard-error rule, else that of the largest gap."""
    steps = one_se_steps(gaps)
    return steps.groupBy("focal_class").agg(
        F.coalesce(F.min(F.when(F.col("fires"), F.col("k"))), -F.max(F.struct("gap", (-F.col("k")).alias("back")))["back"]).alias("best_k")
    )


def argmax_silhouette(curve: DataFrame) -> DataFrame:
    """The k of the largest silhouette, the least k on ties."""
    best = F.max(F.struct("silhouette", (-F.col("k")).alias("back")))
    return curve.groupBy("focal_class").agg(best.alias("b")).select(
        "focal_class", (-F.col("b.back")).alias("best_k"), F.col("b.silhouette").alias("silhouette")
    )


def assignments(fitted: DataFrame, chosen: DataFrame) -> DataFrame:
    """``focal_class``, ``k``, ``silhouette``, ``pattern`` and 0-based ``cluster`` of the chosen fits."""
    rows = fitted.where("draw = 0").join(chosen.select("focal_class", F.col("best_k").alias("k")), ["focal_class", "k"])
    parts = rows.select("focal_class", "k", "silhouette", F.explode(F.split("labels", ",")).alias("x"))
    return parts.select(
        "focal_class", "k", "silhouette", F.split_part("x", F.lit(":"), F.lit(1)).alias("pattern"),
        F.split_part("x", F.lit(":"), F.lit(2)).cast("int").alias("cluster"),
    )


def version_comparison(old: DataFrame, new: DataFrame) -> DataFrame:
    """Best k of two versions side by side; a class that only one has counts as changed."""
    a = old.select("focal_class", F.col("best_k").alias("k_old"))
    b = new.select("focal_class", F.col("best_k").alias("k_new"))
    both = a.join(b, "focal_class", "full_outer")
    return both.withColumn("delta", F.col("k_new") - F.col("k_old")).withColumn(
        "changed", ~F.col("k_new").eqNullSafe(F.col("k_old"))
    )


def version_counts(comparison: DataFrame) -> DataFrame:
    """How many classes there are, and for how many k changed, fell and rose."""
    return comparison.agg(
        F.count("*").alias("n_classes"),
        F.count_if("changed").alias("n_changed"),
        F.count_if(F.col("changed") & (F.col("delta") < 0)).alias("n_lower"),
        F.count_if(F.col("changed") & (F.col("delta") > 0)).alias("n_higher"),
    )


def diagnosis(gaps: DataFrame) -> DataFrame:
    """Each k's bound, with tags: ``chosen``, ``argmax`` (of the gap), ``ignored`` (the rule holds, behind the chosen k).

    ``fired_early`` tells whether the rule chose another k than that of the largest gap.
    """
    steps, chosen = one_se_steps(gaps), best_k(gaps)
    top = gaps.groupBy("focal_class").agg((-F.max(F.struct("gap", (-F.col("k")).alias("back")))["back"]).alias("argmax_k"))
    rows = steps.join(chosen, "focal_class").join(top, "focal_class")
    tag = (
        F.when(F.col("k") == F.col("best_k"), "chosen")
        .when(F.col("k") == F.col("argmax_k"), "argmax")
        .when(F.col("fires"), "ignored")
        .otherwise("")
    )
    early = F.col("best_k") != F.col("argmax_k")
    return rows.select("focal_class", "k", "gap", "sk", "bound", "fires", "best_k", "argmax_k", tag.alias("tag"), early.alias("fired_early"))


#: Parts of the asking points, and of those they are compared with, at most; the former is a multiple of the latter.
ASKING, HELD = 32, 8


def silhouette_of_labels(points: DataFrame, block: int = 2048) -> DataFrame:
    """Mean Euclidean silhouette of each label, of ``id``, ``v`` (array) and ``label``.

    Exact, so each point meets all others, and work grows with the square of the
    points. They are dealt into at most ``ASKING`` parts that ask and ``HELD`` that are
    asked; a pair of parts is a task of matrix products of ``block`` points, which gives
    a sum of distances for each point and label. So a point is sent at most ``ASKING +
    HELD`` times, and a task holds an eighth of the points and a block of matrices.
    """
    n = points.count()
    parts = max(1, -(-n // block))
    few = min(HELD, parts)
    many = few * max(1, min(ASKING // HELD, -(-parts // few)))
    dealt = points.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("part"))
    own = (F.col("part") % few).cast("int")  # points of one id meet in these pairs only
    asks = dealt.select("id", "label", "v", F.col("part").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("y"), F.lit(1).alias("role"))
    held = dealt.select("id", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("x"), own.alias("y"), F.lit(0).alias("role"))
    rows = asks.union(held).repartition(many * few, "x", "y").sortWithinPartitions("x", "y", "role")
    kind = points.schema

    def run(frames):
        now, have, book = None, [], None

        def sums(frame: pd.DataFrame, meets: bool) -> pd.DataFrame:
            labels, ids, matrix, kinds, member = book
            asked = np.stack(frame.v.to_numpy())
            total, met = np.zeros((len(frame), len(kinds))), np.tile(member.sum(0), (len(frame), 1))
            for first in range(0, len(matrix), block):
                part = slice(first, first + block)
                distance = _distances(asked, matrix[part])
                if meets:
                    same = frame.id.to_numpy()[:, None] == ids[None, part]
                    distance[same] = 0.0
                    met -= same @ member[part]
                total += distance @ member[part]
            of = np.tile(np.arange(len(kinds)), len(frame))
            out = frame.loc[frame.index.repeat(len(kinds)), ["id", "label"]].set_axis(["i", "li"], axis=1)
            return out.assign(lj=kinds[of], d=total.ravel(), n=met.ravel().astype("int64"))

        for frame in frames:
            for key, part in frame.groupby(["x", "y"], sort=False):
                if key != now:
                    now, have, book = key, [], None
                for role, rows in part.groupby("role"):
                    if not role:
                        have.append(rows)
                        continue
                    if book is None and have:
                        labels = np.concatenate([f.label.to_numpy() for f in have])
                        kinds, at = np.unique(labels, return_inverse=True)
                        book = labels, np.concatenate([f.id.to_numpy() for f in have]), np.concatenate([np.stack(f.v.to_numpy()) for f in have]), kinds, np.eye(len(kinds))[at]
                        have = []
                    for first in range(0, len(rows) if book is not None else 0, block):
                        yield sums(rows.iloc[first : first + block].reset_index(drop=True), key[0] % few == key[1])

    schema = f"i {kind['id'].dataType.simpleString()}, li {kind['label'].dataType.simpleString()}, lj {kind['label'].dataType.simpleString()}, d double, n long"
    met = rows.mapInPandas(run, schema).groupBy("i", "li", "lj").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    per = met.groupBy("i", "li").agg(
        F.max(F.when(F.col("li") == F.col("lj"), F.col("d"))).alias("a"),
        F.min(F.when(F.col("li") != F.col("lj"), F.col("d"))).alias("b"),
    )
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy(F.col("li").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("silhouette"))


def inertia_of_labels(points: DataFrame) -> DataFrame:
    """Sum of squared distances from the label's centroid."""
    flat = points.select("label", F.posexplode("v").alias("d", "x"))
    per = flat.groupBy("label", "d").agg(
        F.count("*").alias("n"), (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / F.count("*")).alias("ss")
    )
    return per.groupBy("label").agg(F.max("n").alias("n"), F.round(F.sum("ss"), 4).alias("inertia"))


def lloyd_step(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """Members and inertia after one assignment to the seeds (``label``, ``v``); ties go to the least label."""
    s = seeds.select(F.col("label").alias("cluster"), F.col("v").alias("c"))
    square = F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    near = points.crossJoin(F.broadcast(s)).groupBy("id").agg(F.min(F.struct(square.alias("d"), "cluster")).alias("b"))
    return near.groupBy(F.col("b.cluster").alias("cluster")).agg(
        F.count("*").alias("n"), F.round(F.sum("b.d"), 4).alias("inertia")
    )


def profile(rows: DataFrame) -> DataFrame:
    """Mean of ``x`` for each ``cluster`` and ``feature``."""
    return rows.groupBy("cluster", "feature").agg(F.round(F.avg("x"), 6).alias("mean"))


def profile_variance(profiles: DataFrame, top: int) -> DataFrame:
    """The features whose profile varies most between clusters."""
    spread = profiles.groupBy("feature").agg(F.round(F.var_samp("mean"), 8).alias("variance"))
    ranked = spread.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "feature")).cast("long"))
    return ranked.where(F.col("rank") <= top)


def top_features(profiles: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` strongest features of each cluster as text."""
    order = Window.partitionBy("cluster").orderBy(F.desc("mean"), "feature")
    kept = profiles.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return kept.groupBy("cluster").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "feature"))), lambda x: x["feature"].cast("string")), ", ").alias("top")
    )


def padded(ranked: DataFrame, n: int) -> DataFrame:
    """``rank`` 1 to ``n`` and ``feature``, null where there are fewer."""
    places = ranked.sparkSession.range(1, n + 1).withColumnRenamed("id", "rank")
    return places.join(F.broadcast(ranked.where(F.col("rank") <= n)), "rank", "left")


def summary(patterns: DataFrame, features: DataFrame, assigned: DataFrame, top: int = 3) -> DataFrame:
    """Clusters of each focal class: scenes, share of the class, and the strongest co-classes with their means.

    ``patterns`` and ``features`` as for :func:`presence_patterns`; ``assigned`` has
    ``focal_class``, ``pattern``, 0-based ``cluster``, and ``k`` and ``silhouette``, which are
    the same in all rows of a class.
    """
    listed = features.groupBy("focal_class").agg(F.sort_array(F.collect_set("feature")).alias("f"))
    rows = assigned.join(patterns, ["focal_class", "pattern"]).join(listed, "focal_class")
    cluster = (F.col("cluster") + 1).cast("long").alias("cluster")
    sizes = rows.groupBy("focal_class", cluster).agg(
        F.sum("n").alias("n_scenes"), F.first("k").cast("long").alias("k"), F.round(F.first("silhouette"), 3).alias("silhouette")
    )
    total = F.sum("n_scenes").over(Window.partitionBy("focal_class"))
    sizes = sizes.withColumn("pct_of_class", F.round(100.0 * F.col("n_scenes") / total, 1))
    bits = rows.select("focal_class", cluster, "n", F.posexplode("f").alias("i", "feature"), "pattern")
    on = F.sum(F.when(F.expr("substr(pattern, i + 1, 1) = '1'"), F.col("n")).otherwise(0)) / F.sum("n")
    means = bits.groupBy("focal_class", "cluster", "feature").agg(on.alias("mean"))
    strongest = F.row_number().over(Window.partitionBy("focal_class", "cluster").orderBy(F.desc("mean"), "feature"))
    means = means.withColumn("r", strongest).where(F.col("r") <= top)
    named = F.transform(F.sort_array(F.collect_list(F.struct("r", "feature", "mean"))), lambda x: F.format_string("%s=%.2f", x["feature"], F.round(x["mean"], 2)))
    tops = means.groupBy("focal_class", "cluster").agg(F.array_join(named, ", ").alias("top_co_classes"))
    return sizes.join(tops, ["focal_class", "cluster"]).select(
        "focal_class", "cluster", "n_scenes", "pct_of_class", "top_co_classes", "silhouette", "k"
    )


def cluster_sizes(rows: DataFrame) -> DataFrame:
    """Clusters by size, named C1, C2, …, with their share."""
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each cluster
    name = F.concat(F.lit("C"), F.row_number().over(Window.orderBy(F.desc("n"), "cluster")).cast("string"))
    return sizes.select("cluster", "n", name.alias("name"), F.round(100.0 * F.col("n") / total, 6).alias("pct"))

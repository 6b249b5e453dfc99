"""Named queries in rounds: cleaned and aligned clouds, filled depth, k-means over all points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import cooccurrence, depthfill, kmeans, lift, neighbours, pointcloud, presence, selection, splits, subsets, suppression
from .plans import tables as T
from .plans.stages import shared_folder, written
from .queries import _GREEDY, _PIX, TYPES, _detections, assigned, ctes, query
from .sources import annotations, scene_source
from .streaming import cooccurrence as streamed

# -- clouds ------------------------------------------------------------------------

NEAR, RATIO = 20, 2.0
_CLOUD = f"""SELECT strftime(l_shipdate, '%Y-%m') AS frame, l_orderkey, l_linenumber, row_number() OVER () AS rid, (u - 365) * z / 529.5 AS x, -((v - 265) * z / 529.5) AS y, z
    FROM (SELECT *, depth_raw / 10000.0 AS z FROM ({_PIX.replace(' FROM lineitem', ', l_shipdate FROM lineitem')})) WHERE z > 0"""
_MEANS = f"""WITH p AS MATERIALIZED ({_CLOUD}),
    near AS (SELECT a.rid, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), {NEAR}) AS d FROM p AS a JOIN p AS b ON a.frame = b.frame AND a.rid <> b.rid GROUP BY a.rid),
    m AS (SELECT p.*, list_avg(d) AS mean FROM p LEFT JOIN near USING (rid)),
    c AS (SELECT frame, avg(mean) + {RATIO} * coalesce(stddev_samp(mean), 0) AS cut FROM m GROUP BY frame) """


def _frames(spark, sf):
    """Back-projected pixels, a cloud for each month of shipping."""
    pixels = T.pixels(spark, sf, "l_shipdate").withColumn("frame", F.date_format("l_shipdate", "yyyy-MM"))
    return pointcloud.back_project(pointcloud.decode_depth(pixels), 529.5, 529.5, 365.0, 265.0).select("frame", "l_orderkey", "l_linenumber", "x", "y", "z")


@query(_MEANS + "SELECT frame, l_orderkey, l_linenumber, round(mean, 6) AS mean_distance, coalesce(mean > cut, false) AS outlier FROM m JOIN c USING (frame)")
def cloud_outliers(spark, sf):
    judged = neighbours.outliers(_frames(spark, sf), NEAR, RATIO, "frame")
    return judged.select("frame", "l_orderkey", "l_linenumber", F.round("mean_distance", 6).alias("mean_distance"), "outlier")


@query(_MEANS + "SELECT frame, count(*) AS n, count(*) FILTER (mean <= cut) AS kept, round(any_value(cut), 6) AS cut FROM m JOIN c USING (frame) GROUP BY frame")
def cloud_outlier_summary(spark, sf):
    judged = neighbours.outliers(_frames(spark, sf), NEAR, RATIO, "frame")
    return judged.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(~F.col("outlier")).alias("kept"), F.round(F.max("cut"), 6).alias("cut"))


_VECTORS = "SELECT label AS cloud, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


def _cloud(spark, sf, first: int):
    e = [F.col("embedding")[first + i].cast("double").alias(c) for i, c in enumerate(neighbours.AXES)]
    return T.read(spark, sf, "embeddings").select(F.col("label").alias("cloud"), "vec_id", *e)


_SUMS = ", ".join(f"round(sum((a{c} - ma{c}) * (u{e} - mu{e})), 6) AS s{i}{j}" for i, c in enumerate("xyz") for j, e in enumerate("xyz"))


@query(f"""WITH s AS ({_VECTORS}), p AS (
    SELECT a.cloud, a.vec_id, a.e[1] AS ax, a.e[2] AS ay, a.e[3] AS az,
      arg_min([b.e[4], b.e[5], b.e[6]], {{'d': sqrt((a.e[1] - b.e[4]) * (a.e[1] - b.e[4]) + (a.e[2] - b.e[5]) * (a.e[2] - b.e[5]) + (a.e[3] - b.e[6]) * (a.e[3] - b.e[6])), 'x': b.e[4], 'y': b.e[5], 'z': b.e[6]}}) AS b
    FROM s AS a JOIN s AS b ON a.cloud = b.cloud GROUP BY a.cloud, a.vec_id, a.e),
    f AS (SELECT *, b[1] AS ux, b[2] AS uy, b[3] AS uz FROM p),
    c AS (SELECT *, {', '.join(f'avg({s}{c}) OVER (PARTITION BY cloud) AS m{s}{c}' for s in 'au' for c in 'xyz')} FROM f)
    SELECT cloud, count(*) AS pairs, {', '.join(f'round(any_value(m{s}{c}), 6) AS "{t}{c}"' for s, t in ('aa', 'ub') for c in 'xyz')}, {_SUMS},
      round(sqrt(avg((ax - ux) * (ax - ux) + (ay - uy) * (ay - uy) + (az - uz) * (az - uz))), 6) AS rmse FROM c GROUP BY cloud""")
def cloud_pair_sums(spark, sf):
    sums = neighbours.pair_sums(_cloud(spark, sf, 0), _cloud(spark, sf, 3))
    return sums.select("cloud", "pairs", *[F.round(c, 6).alias(c) for c in sums.columns[2:]])


@query("""SELECT label AS cloud, count(*) AS n, round(cos(0.004 * label), 6) AS r00, round(-sin(0.004 * label), 6) + 0.0 AS r01, round(sin(0.004 * label), 6) AS r10, round(cos(0.004 * label), 6) AS r11, 1.0::DOUBLE AS r22,
    round(CAST(0.001 * label AS DOUBLE), 6) AS tx, -0.002::DOUBLE AS ty, 0.003::DOUBLE AS tz FROM embeddings GROUP BY label""")
def cloud_alignment(spark, sf):
    """Each label's cloud, and the same under a motion that depends on the label: alignment finds the motion again."""
    source = _cloud(spark, sf, 0)
    a = F.col("cloud") * 0.004
    target = source.select(
        "cloud", (F.cos(a) * F.col("x") - F.sin(a) * F.col("y") + F.col("cloud") * 0.001).alias("x"),
        (F.sin(a) * F.col("x") + F.cos(a) * F.col("y") - 0.002).alias("y"), (F.col("z") + 0.003).alias("z"),
    )
    found = neighbours.align(source, target)
    sizes = source.groupBy(F.col("cloud").alias("c")).agg(F.count("*").alias("n"))
    shown = [(F.round(c, 6) + 0.0).alias(c) for c in ("r00", "r01", "r10", "r11", "r22", "tx", "ty", "tz")]
    return found.join(sizes, F.expr("cloud = c")).select("cloud", "n", *shown)


# -- depth ---------------------------------------------------------------------------

_RADIUS, _LEAST, _ROUNDS = 1, 5, 16
_RASTER = """SELECT l_linenumber AS image, l_partkey % 73 AS u, l_suppkey % 53 AS v, CASE WHEN min(CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE 1 END) = 1 THEN CAST(min(l_quantity * 1000 + l_linenumber) AS DOUBLE) END AS d,
    max(round(l_extendedprice) % 256) AS g, 0 AS round FROM lineitem GROUP BY ALL"""


def _fill_round(i: int) -> str:
    w = "exp(-(a * a + b * b) / (2 * 1.5 * 1.5)) * exp(-((h.g - q.g) * (h.g - q.g)) / (2 * 90.0 * 90.0))"
    return f"""f{i} AS MATERIALIZED (SELECT h.image, h.u, h.v, sum({w} * q.d) / sum({w}) AS d FROM r{i - 1} AS h, range(-1, 2) AS x(a), range(-1, 2) AS y(b), r{i - 1} AS q
      WHERE h.d IS NULL AND q.image = h.image AND q.u = h.u + a AND q.v = h.v + b AND q.d IS NOT NULL GROUP BY ALL HAVING count(*) >= {_LEAST}),
    r{i} AS MATERIALIZED (SELECT r.image, r.u, r.v, coalesce(r.d, f.d) AS d, r.g, CASE WHEN r.d IS NULL AND f.d IS NOT NULL THEN {i} ELSE r.round END AS round
      FROM r{i - 1} AS r LEFT JOIN f{i} AS f USING (image, u, v))"""


@query(f"WITH r0 AS MATERIALIZED ({_RASTER}), " + ", ".join(_fill_round(i) for i in range(1, _ROUNDS)) + f"""
    SELECT image, u, v, round(d, 3) AS depth, CAST(CASE WHEN d IS NULL THEN -1 ELSE round END AS INTEGER) AS round FROM r{_ROUNDS - 1}""")
def depth_fill(spark, sf):
    """A raster for each line number, a tenth as fine as the pixels; a hole needs five known neighbours. Round -1: it stays."""
    rows = T.read(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("image"), (F.col("l_partkey") % 73).alias("u"), (F.col("l_suppkey") % 53).alias("v"),
        F.when(F.col("l_partkey") % 7 == 0, 0.0).otherwise(F.col("l_quantity") * 1000 + F.col("l_linenumber")).alias("d"),
        (F.round("l_extendedprice") % 256).alias("g"),
    )
    filled = depthfill.fill(depthfill.raster(rows, "image", "u", "v", "d", "g"), _RADIUS, 1.5, 90.0, _LEAST, 32)
    return filled.select("image", "u", "v", F.round("d", 3).alias("depth"), F.coalesce("round", F.lit(-1)).alias("round"))


# -- k-means ---------------------------------------------------------------------------

_KS = [2, 3, 5, 8]


def _points(spark, sf):
    """All embeddings once for each k: a fit is a k."""
    k = F.explode(F.array(*[F.lit(k).cast("long") for k in _KS])).alias("fit")
    return T.vectors(spark, sf).select(k, F.col("id"), F.lit(1.0).alias("w"), "v")


def _lloyd_round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT p.fit, p.id, any_value(p.v) AS v, min({{'d': list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 'c': c.cluster}}) AS best FROM pts AS p JOIN c{i} AS c USING (fit) GROUP BY p.fit, p.id),
    c{i + 1} AS MATERIALIZED (SELECT c.fit, c.cluster, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN (SELECT fit, cluster, list(x ORDER BY i) AS v FROM (SELECT fit, best.c AS cluster, i, avg(v[i]) AS x FROM a{i}, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY ALL) AS m USING (fit, cluster))"""


@query(f"""WITH pts AS MATERIALIZED (SELECT CAST(k AS BIGINT) AS fit, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings, unnest({_KS}) AS t(k)),
    c0 AS MATERIALIZED (SELECT fit, row_number() OVER (PARTITION BY fit ORDER BY id) - 1 AS cluster, v FROM pts QUALIFY cluster < fit), {_lloyd_round(0)}, {_lloyd_round(1)}, {_lloyd_round(2)},
    last AS (SELECT p.fit, p.id, min({{'d': list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 'c': c.cluster}}) AS best FROM pts AS p JOIN c3 AS c USING (fit) GROUP BY p.fit, p.id)
    SELECT fit, best.c AS cluster, CAST(count(*) AS DOUBLE) AS n, round(sum(best.d), 4) AS inertia FROM last GROUP BY ALL""")
def lloyd_three_rounds(spark, sf):
    """Three rounds from the vectors of the least ids, for all k at once."""
    points = _points(spark, sf)
    first = T.vectors(spark, sf).orderBy("id").limit(max(_KS)).groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("s"))
    ks = spark.createDataFrame([(k,) for k in _KS], "fit long")
    begun = ks.crossJoin(first).select("fit", F.posexplode(F.slice("s", 1, F.col("fit").cast("int"))).alias("cluster", "x"))
    centres = begun.select("fit", F.col("cluster").cast("long").alias("cluster"), F.col("x.v").alias("v"))
    near = kmeans.assigned(points, kmeans.lloyd(points, centres, 3, -1.0))
    return near.groupBy("fit", "cluster").agg(F.sum("w").alias("n"), F.round(F.sum("d"), 4).alias("inertia"))


@query(None)
def kmeans_all_points(spark, sf):
    """Fits of all embeddings for several k, seeded in rounds and moved until they stand still."""
    points = _points(spark, sf)
    ks = spark.createDataFrame([(k, k) for k in _KS], "fit long, k int")
    centres = kmeans.kmeans(points, ks)
    rounds = centres.groupBy("fit").agg(F.max("rounds").alias("rounds"))
    found = kmeans.scores(points, centres).join(rounds, "fit")
    return found.select("fit", "k", "n", F.round("inertia", 4).alias("inertia"), "rounds")


# -- other ways to known results ---------------------------------------------------------


@query(ctes("gram") + "SELECT * FROM gram")
def gram_bit_sliced(spark, sf):
    return cooccurrence.gram_sliced(T.basket(spark, sf))


_SHARES = {f"p{round(100 * s):02d}": s for s in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}


@query("SELECT p_brand, count(l_extendedprice) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {s}), 6) AS {c}" for c, s in _SHARES.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def percentiles_by_rank(spark, sf):
    rows = T.read(spark, sf, "lineitem").join(T.read(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    found = selection.percentiles(rows, "p_brand", "l_extendedprice", list(_SHARES.values()))
    return found.select("p_brand", "n", *[F.round(f"p{i}", 6).alias(c) for i, c in enumerate(_SHARES)])


@query(ctes("swept", recursive=True) + "SELECT array_to_string(types, '|') AS types, min_survived, total_survived FROM swept JOIN perms USING (ordering) ORDER BY min_survived DESC, total_survived DESC, ordering LIMIT 1")
def best_ordering_by_subsets(spark, sf):
    found, scenes, stages = assigned(spark, sf)
    best = subsets.best_ordering(splits.stage_masks(found, scenes, stages), TYPES)
    return best.select(F.array_join("types", "|").alias("types"), "min_survived", "total_survived")


@query(None)
def best_ordering_of_months(spark, sf):
    """Twelve stages, of 479,001,600 orders: scenes by the month of their order, three classes a month."""
    found = written(T.basket(spark, sf), "basket")
    months = [f"{m:02d}" for m in range(1, 13)]
    scenes = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("scene"), F.date_format("o_orderdate", "MM").alias("scene_type"))
    order = presence.class_frequency(found, scenes)
    stages = written(splits.assign_balanced(written(lift.lift(found, scenes), "lifts"), order, months, 3), "stages")
    best = subsets.best_ordering(splits.stage_masks(found, scenes, stages), months)
    return best.select(F.array_join("types", "|").alias("types"), "min_survived", "total_survived")


@query(ctes("masks", "stage_bits", recursive=True) + """, m AS MATERIALIZED (SELECT s.stage_idx AS i, mask, n FROM masks JOIN stage_bits s USING (scene_type)),
    cut AS (SELECT c, s AS i, 1 + bit_count(c & ((1 << (s - 1)) - 1)) AS part FROM range(16) AS a(c), range(1, 6) AS b(s)),
    ends AS (SELECT c, part, min(i) AS a, max(i) AS b FROM cut GROUP BY c, part),
    kept AS (SELECT c, part, a, b, CAST(coalesce((SELECT sum(n) FROM m WHERE i BETWEEN a AND b), 0) AS BIGINT) AS total, CAST(coalesce((SELECT sum(n) FROM m WHERE i BETWEEN a AND b AND mask >> b = 0), 0) AS BIGINT) AS survived FROM ends),
    best AS (SELECT c FROM kept GROUP BY c HAVING min(survived) >= (SELECT count(*) // 50 FROM orders) ORDER BY count(*) DESC, sum(survived) DESC, list(b ORDER BY part) LIMIT 1)
    SELECT CAST(part AS BIGINT) AS part, (SELECT string_agg(scene_type, '|' ORDER BY stage_idx) FROM stage_bits WHERE stage_idx BETWEEN a AND b) AS types, total, survived FROM kept JOIN best USING (c)""")
def merged_stages(spark, sf):
    """Neighbouring stages put together until each keeps a fiftieth of the scenes."""
    found, scenes, stages = assigned(spark, sf)
    merged = subsets.best_merge(splits.stage_masks(found, scenes, stages), TYPES, scenes.count() // 50)
    return merged.select("part", F.array_join("types", "|").alias("types"), "total", "survived")


@query(_GREEDY)
def nms_rounds(spark, sf):
    rows = pointcloud.score_labels(_detections(spark, sf), "logits").where("score > 0.01")
    rows = rows.select("vec_id", "batch", "label", "score", "cx", "cy", "cz", "w", "h", "l")
    kept = suppression.suppress(rows, ["batch", "label"], box_id="vec_id")
    return kept.select("vec_id", "batch", "label", *[F.round(c, 5).alias(c) for c in ("score", "cx", "cy", "cz", "w", "h", "l")])


@query("""WITH b AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS scene, event_type AS class FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL), f AS (SELECT class, count(*) AS f FROM b GROUP BY class),
    p AS (SELECT x.class AS class_i, y.class AS class_j, count(*) AS n FROM b x JOIN b y ON x.scene = y.scene AND x.class < y.class GROUP BY ALL)
    SELECT class_i, class_j, n, round(CAST(n AS DOUBLE) / (u.f + v.f - n), 6) AS jaccard FROM p JOIN f u ON u.class = class_i JOIN f v ON v.class = class_j""")
def streamed_cooccurrence(spark, sf):
    """The events as a stream of ten batches, about a tenth of them again at the end: pair counts from the classes held by scene."""
    folder = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    scene = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    rows = T.read(spark, sf, "events").where("user_id is not null and ts is not null")
    rows = rows.select(scene.alias("scene"), F.col("event_type").alias("class"), F.pmod(F.xxhash64("event_id"), F.lit(10)).alias("tenth"))
    files = 1 + rows.count() // 5_000_000  # of a batch
    again = rows.where("tenth = 0").select("scene", "class").repartition(files)
    for part in (rows.select("scene", "class").repartition(10 * files), again):
        part.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("scene string, class string").option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    streamed.keep_counts(stream, folder).awaitTermination()
    alone, pairs = streamed.counts(spark, folder)
    f_i, f_j = (alone.select(F.col("class").alias(f"c_{x}"), F.col("f").alias(f"f_{x}")) for x in "ij")
    both = pairs.join(f_i, F.expr("class_i = c_i")).join(f_j, F.expr("class_j = c_j"))
    share = F.round(F.col("n").cast("double") / (F.col("f_i") + F.col("f_j") - F.col("n")), 6)
    return both.select("class_i", "class_j", "n", share.alias("jaccard"))


# -- scene folders ---------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, list(DISTINCT lower(event_type)) AS c FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
    t AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'unknown' WHEN n >= 2 THEN 'busy' ELSE 'calm' END AS scene_type, unnest(c) AS class FROM s)
    SELECT scene_type, class, count(*) AS n_scenes FROM t GROUP BY ALL""")
def scene_folder_scan(spark, sf):
    """A folder for each user's day, with an annotation and, but for every fifth user, a label, in archives; read back by the scene source."""
    root = f"{shared_folder(spark)}/scenes-{uuid.uuid4().hex}"
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("scene_path")
    rows = T.read(spark, sf, "events").where("user_id is not null and ts is not null and event_type is not null")
    days = rows.groupBy(path, "user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("event_type")).alias("c"))
    objects = F.to_json(F.struct(F.transform("c", lambda x: F.struct(F.concat(x, F.lit("1 ")).alias("name"))).alias("objects")))
    labels = F.when(F.col("n") >= 2, "busy\n").otherwise(" calm")
    file = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    own = F.when(F.expr("user_id % 5 <> 0"), file("label", labels))
    files = days.select("scene_path", F.explode(F.array_compact(F.array(file("annotation_2d", objects), own))).alias("f"))
    scene_source.write_scenes(files.select("scene_path", "f.kind", "f.value"), root, packed=True)
    scene_source.register(spark)
    read = lambda kind: spark.read.format("scenes").load(root).where(F.col("kind") == kind)
    scenes = read("annotation_2d").withColumn("v", F.try_parse_json("value"))
    typed = annotations.with_labels(scenes, read("label").select("scene_path", "value"))
    found = annotations.names_2d(scenes).distinct()
    return found.join(typed, "scene_path").groupBy("scene_type", "class").agg(F.count("*").alias("n_scenes"))

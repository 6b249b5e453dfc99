"""Registry of the scene-analytics queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import labels as L
from .operators import checks, cluster, cooccurrence, lift, pointcloud, presence, spatial, splits
from .plans import catalogue
from .plans import tables as T
from .plans.stages import written

QUERIES: dict = {}
EXCLUDED = ["Brand#1", "Brand#2", "Brand#3"]
TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None):
    """Register a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return register


def ctes(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named common table expressions and those they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " "


NEEDS = {
    "freq": ("basket",), "pairs": ("basket",), "jac": ("pairs", "freq"), "sym": ("jac",), "gram": ("basket",),
    "lifts": ("basket", "typed"), "ranked_lifts": ("lifts",), "decisive": ("ranked_lifts", "freq"),
    "choices": ("ranked_lifts", "decisive"), "fold": ("choices",), "assigned": ("fold",), "masks": ("basket", "typed", "assigned"),
    "rooms": ("objs",), "edges": ("rooms",), "perms": (), "swept": ("perms", "masks", "stage_bits"), "surv": ("basket", "typed", "assigned", "stage_bits"),
    "freq_stages": ("freq",), "freq_masks": ("basket", "typed", "freq_stages"), "gap_steps": ("gap_lit",),
}

_TYPE_ROWS = ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(TYPES))
CTE = {
    "basket": "SELECT DISTINCT l_orderkey AS scene, p_brand AS class FROM lineitem JOIN part ON l_partkey = p_partkey",
    "typed": "SELECT o_orderkey AS scene, o_orderpriority AS scene_type FROM orders",
    "freq": "SELECT class, count(*) AS f, row_number() OVER (ORDER BY count(*) DESC, class) AS rank FROM basket GROUP BY class",
    "pairs": "SELECT a.class AS class_i, b.class AS class_j, count(*) AS n FROM basket a JOIN basket b ON a.scene = b.scene AND a.class < b.class GROUP BY ALL",
    "jac": "SELECT class_i, class_j, n, round(CAST(n AS DOUBLE) / (a.f + b.f - n), 6) AS jaccard FROM pairs JOIN freq a ON a.class = class_i JOIN freq b ON b.class = class_j",
    "sym": "SELECT class_i, class_j, jaccard FROM jac UNION ALL SELECT class_j, class_i, jaccard FROM jac",
    "gram": "SELECT a.class AS class_i, b.class AS class_j, count(*) AS n FROM basket a JOIN basket b ON a.scene = b.scene GROUP BY ALL",
    "lifts": """SELECT g.class, g.scene_type, coalesce(c.n, 0) AS n_scenes, round(coalesce(c.n, 0) / CAST(g.m AS DOUBLE), 6) AS freq_in_type,
        round(g.f / CAST(g.s AS DOUBLE), 6) AS overall_freq, round((coalesce(c.n, 0) / CAST(g.m AS DOUBLE)) / (g.f / CAST(g.s AS DOUBLE)), 4) AS lift
        FROM (SELECT * FROM (SELECT class, count(*) AS f FROM basket JOIN typed USING (scene) GROUP BY class), (SELECT scene_type, count(*) AS m FROM typed GROUP BY scene_type), (SELECT count(*) AS s FROM typed)) AS g
        LEFT JOIN (SELECT class, scene_type, count(*) AS n FROM basket JOIN typed USING (scene) GROUP BY ALL) AS c USING (class, scene_type)""",
    "ranked_lifts": "SELECT *, row_number() OVER (PARTITION BY class ORDER BY lift DESC, scene_type) AS r FROM lifts",
    "decisive": """SELECT class, best, second, decisiveness, row_number() OVER (ORDER BY decisiveness DESC, rank) AS position FROM (
        SELECT class, max(lift) FILTER (r = 1) AS best, max(lift) FILTER (r = 2) AS second, round(max(lift) FILTER (r = 1) - max(lift) FILTER (r = 2), 4) AS decisiveness FROM ranked_lifts GROUP BY class) JOIN freq USING (class)""",
    "choices": f"SELECT class, position, list(idx ORDER BY r) AS wants FROM ranked_lifts JOIN decisive USING (class) JOIN (VALUES {_TYPE_ROWS}) AS t(scene_type, idx) USING (scene_type) GROUP BY class, position",
    "fold": """SELECT CAST(0 AS BIGINT) AS position, [5, 5, 5, 5, 5] AS room, '' AS class, 0 AS spot
        UNION ALL SELECT position, list_transform(room, lambda r, i: r - CASE WHEN i = spot THEN 1 ELSE 0 END), class, spot FROM (
        SELECT c.position, f.room, c.class, list_filter(c.wants, lambda w: f.room[w] > 0)[1] AS spot FROM fold f JOIN choices c ON c.position = f.position + 1)""",
    "assigned": f"SELECT class, scene_type, position, CAST(idx AS BIGINT) AS stage_idx FROM fold JOIN (VALUES {_TYPE_ROWS}) AS t(scene_type, idx) ON idx = spot WHERE position > 0",
    "stage_bits": f"SELECT scene_type, CAST(idx AS BIGINT) AS stage_idx FROM (VALUES {_TYPE_ROWS}) AS t(scene_type, idx)",
    "masks": """SELECT scene_type, mask, count(*) AS n FROM (SELECT scene, t.scene_type, coalesce(bit_or(CAST(1 AS BIGINT) << CAST(a.stage_idx - 1 AS BIGINT)), 0) AS mask
        FROM typed t LEFT JOIN basket USING (scene) LEFT JOIN assigned a USING (class) GROUP BY scene, t.scene_type) GROUP BY ALL""",
    "surv": """SELECT s.stage_idx, t.scene_type, t.scene, coalesce(string_agg(b.class, '|' ORDER BY a.position), '') AS classes_present
        FROM typed t JOIN stage_bits s USING (scene_type) LEFT JOIN basket b USING (scene) LEFT JOIN assigned a USING (class)
        GROUP BY ALL HAVING coalesce(max(a.stage_idx), 0) <= s.stage_idx""",
    "perms": f"""SELECT row_number() OVER (ORDER BY p) AS ordering, p AS types FROM (SELECT [a.t, b.t, c.t, d.t, e.t] AS p FROM {', '.join(f"(SELECT unnest({TYPES!r}) AS t) AS {x}" for x in 'abcde')}
        WHERE len(list_distinct([a.t, b.t, c.t, d.t, e.t])) = 5)""",
    "swept": """SELECT ordering, min(survived) AS min_survived, CAST(sum(survived) AS BIGINT) AS total_survived FROM (
        SELECT ordering, scene_type, CAST(coalesce(sum(n) FILTER (mask & future = 0), 0) AS BIGINT) AS survived FROM (
        SELECT p.ordering, p.types[i] AS scene_type, CAST(coalesce((SELECT sum(CAST(1 AS BIGINT) << CAST(s.stage_idx - 1 AS BIGINT)) FROM stage_bits s WHERE list_position(p.types, s.scene_type) > i), 0) AS BIGINT) AS future
        FROM perms p, unnest(range(1, 6)) AS r(i)) JOIN masks USING (scene_type) GROUP BY ALL) GROUP BY ordering""",
    "freq_stages": "SELECT class, CAST((rank - 1) // 5 + 1 AS BIGINT) AS stage_idx, rank AS position FROM freq",
    "freq_masks": """SELECT mask, count(*) AS n FROM (SELECT scene, coalesce(bit_or(CAST(1 AS BIGINT) << CAST(a.stage_idx - 1 AS BIGINT)), 0) AS mask
        FROM typed t LEFT JOIN basket USING (scene) LEFT JOIN freq_stages a USING (class) GROUP BY scene) GROUP BY ALL""",
    "objs": """SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
        abs(CAST(embedding[4] AS DOUBLE)) AS w, abs(CAST(embedding[5] AS DOUBLE)) AS h, abs(CAST(embedding[6] AS DOUBLE)) AS d FROM embeddings""",
    "rooms": "SELECT label, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1, max(y) AS floor_y, avg(x) AS mx, avg(z) AS mz FROM objs GROUP BY label",
    "edges": """SELECT label, x0 AS ax, z0 AS az, x1 AS bx, z0 AS bz FROM rooms UNION ALL SELECT label, x1, z0, x1, z1 FROM rooms
        UNION ALL SELECT label, x1, z1, x0, z1 FROM rooms UNION ALL SELECT label, x0, z1, x0, z0 FROM rooms""",
    "vecs": "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "gap_lit": "SELECT * FROM (VALUES {rows}) AS t(focal_class, k, gap, sk, log_w)",
    "gap_steps": "SELECT *, round(lead(gap - sk) OVER (PARTITION BY focal_class ORDER BY k), 6) AS bound FROM gap_lit",
}
#: Fits for the queries on the Gap rule: class, k, log inertia, log inertias of three null references.
FITS = [
    ("chair", 2, 5.10, (5.18, 5.22, 5.20)), ("chair", 3, 4.80, (4.98, 5.02, 5.00)), ("chair", 4, 4.62, (4.81, 4.85, 4.83)),
    ("chair", 5, 4.55, (4.71, 4.74, 4.70)), ("desk", 2, 3.90, (3.95, 3.97, 3.96)), ("desk", 3, 3.60, (3.79, 3.81, 3.80)),
    ("desk", 4, 3.20, (3.69, 3.71, 3.70)), ("sofa", 2, 4.00, (4.41, 4.43, 4.39)), ("sofa", 3, 3.95, (4.20, 4.22, 4.21)),
]
_FIT_ROWS = ", ".join(f"('{c}', {k}, {w}, {n})" for c, k, w, ns in FITS for n in ns)
CTE["gap_lit"] = f"""SELECT focal_class, k, round(avg(nw) - max(w), 6) AS gap, round(stddev_pop(nw) * sqrt(1 + 1.0 / count(*)), 6) AS sk, round(max(w), 6) AS log_w
    FROM (SELECT focal_class, CAST(k AS BIGINT) AS k, CAST(w AS DOUBLE) AS w, CAST(nw AS DOUBLE) AS nw FROM (VALUES {_FIT_ROWS}) AS t(focal_class, k, w, nw)) GROUP BY focal_class, k"""
CURVE = [("chair", 2, 0.31), ("chair", 3, 0.44), ("chair", 4, 0.44), ("desk", 2, 0.52), ("desk", 3, 0.40), ("sofa", 2, 0.20), ("sofa", 3, 0.25)]
_CURVE_ROWS = ", ".join(f"('{c}', {k}, {s})" for c, k, s in CURVE)


def assigned(spark, sf_dir):
    """Scenes, presence, and the balanced assignment of the classes to the five types."""
    found, scenes = written(T.basket(spark, sf_dir), "basket"), T.scenes(spark, sf_dir)
    order = presence.class_frequency(found, scenes)
    lifts = written(lift.lift(found, scenes), "lifts")
    return found, scenes, written(splits.assign_balanced(lifts, order, TYPES, 5), "stages")


def stage_types(spark):
    """The types in their default order."""
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(TYPES)], "scene_type string, stage_idx long")


def frequency_stages(spark, sf_dir):
    """Five classes to a stage, by descending frequency."""
    found, scenes = T.basket(spark, sf_dir), T.scenes(spark, sf_dir)
    ranked = presence.class_frequency(found, scenes)
    stage = (F.floor((F.col("rank") - 1) / 5) + 1).cast("long")
    return found, scenes, ranked.select("class", stage.alias("stage_idx"), F.col("rank").alias("position"))


# -- frequency ---------------------------------------------------------------


@query(ctes("basket", "freq") + "SELECT rank, class, f AS scene_frequency, round(100.0 * f / (SELECT count(*) FROM orders), 6) AS pct_of_scenes FROM freq")
def class_frequency(spark, sf):
    return presence.class_frequency(T.basket(spark, sf), T.scenes(spark, sf))


@query(ctes("freq") + "SELECT row_number() OVER (ORDER BY rank) AS rank, class, f AS scene_frequency, round(100.0 * f / (SELECT count(*) FROM orders), 6) AS pct_of_scenes FROM freq WHERE class NOT IN ('Brand#1', 'Brand#2', 'Brand#3') QUALIFY row_number() OVER (ORDER BY rank) <= 20")
def class_frequency_topn_excluding(spark, sf):
    return presence.top_classes(presence.class_frequency(T.basket(spark, sf), T.scenes(spark, sf)), 20, EXCLUDED)


@query("""SELECT count(*) AS n_scenes, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_empty,
    (SELECT count(DISTINCT p_brand) FROM part) AS n_classes, count(DISTINCT o_orderpriority) AS n_types FROM orders""")
def scan_counters(spark, sf):
    orders = T.scenes(spark, sf)
    held = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene")).distinct().withColumn("has", F.lit(True))
    brands = T.read(spark, sf, "part").agg(F.count_distinct("p_brand").alias("n_classes"))
    counts = orders.join(held, "scene", "left").agg(
        F.count("*").alias("n_scenes"), F.count_if(F.col("has").isNull()).alias("n_empty"), F.count_distinct("scene_type").alias("n_types")
    )
    return counts.crossJoin(brands).select("n_scenes", "n_empty", "n_classes", "n_types")


_SYN = ", ".join(f"('{v}', '{c}')" for v, c in L.synonym_rows())


@query(f"""WITH raw AS (SELECT DISTINCT p_name AS raw FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT '  ' || regexp_extract(p_name, '[^ ]+$') || 'Chair' || p_size || ' ' FROM part
    UNION SELECT unnest(['Couch', 'sofachair', 'chair12', '123', 'lamp3', 'gizmo7', 'chair 1', 'notebook', 'Books2', 'Cushions '])),
    syn(variant, canonical) AS (VALUES {_SYN}),
    cut AS (SELECT raw, lower(trim(raw)) AS name, regexp_extract(lower(trim(raw)), '^(.+?)[0-9]+$', 1) AS base FROM raw)
    SELECT raw, coalesce(a.canonical, CASE WHEN base <> '' THEN coalesce(b.canonical, base) END, name) AS class FROM cut LEFT JOIN syn a ON a.variant = name LEFT JOIN syn b ON b.variant = base""")
def normalise_labels(spark, sf):
    part = T.read(spark, sf, "part")
    made = F.concat(F.lit("  "), F.regexp_extract("p_name", "[^ ]+$", 0), F.lit("Chair"), F.col("p_size").cast("string"), F.lit(" "))
    more = ["Couch", "sofachair", "chair12", "123", "lamp3", "gizmo7", "chair 1", "notebook", "Books2", "Cushions "]
    raw = part.select(F.col("p_name").alias("raw")).union(part.select("p_brand")).union(part.select(made))
    raw = raw.union(spark.createDataFrame([(x,) for x in more], "raw string")).distinct()
    return raw.select("raw", L.normalise(F.col("raw")).alias("class"))


@query("SELECT split_part(p_type || ':' || p_brand, ':', 1) AS head, count(*) AS n FROM part GROUP BY ALL")
def attribute_suffix_strip(spark, sf):
    label = F.concat_ws(":", "p_type", "p_brand")
    return T.read(spark, sf, "part").groupBy(L.without_suffix(label).alias("head")).agg(F.count("*").alias("n"))


@query(f"SELECT scene_type AS raw, 'Stage ' || idx || ' – ' || array_to_string(list_transform(string_split(replace(replace(lower(scene_type), '-', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, len(list_distinct(string_split('a|b|a|' || idx, '|'))) AS n_parts FROM (VALUES {_TYPE_ROWS}) AS t(scene_type, idx)")
def stage_titles(spark, sf):
    rows = stage_types(spark)
    name = F.replace(F.col("scene_type"), F.lit("-"), F.lit("_"))
    parts = L.split_set(F.concat(F.lit("a|b|a|"), F.col("stage_idx").cast("string")))
    return rows.select(F.col("scene_type").alias("raw"), L.stage_title(F.col("stage_idx"), name).alias("title"), F.size(parts).cast("long").alias("n_parts"))


@query("SELECT n AS class, count(DISTINCT event_id) AS n FROM (SELECT event_id, json_extract_string(props, '$.k') AS n FROM events) WHERE n IS NOT NULL GROUP BY ALL")
def json_attribute_frequency(spark, sf):
    rows = T.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("class"))
    return rows.where("class is not null").distinct().groupBy("class").agg(F.count("*").alias("n"))


# -- co-occurrence -------------------------------------------------------------


@query(ctes("pairs") + "SELECT * FROM pairs")
def cooccurrence_pairs(spark, sf):
    return cooccurrence.pair_counts(T.basket(spark, sf))


@query(ctes("pairs") + """, cls AS (SELECT DISTINCT class FROM basket), s AS (SELECT * FROM pairs UNION ALL SELECT class_j, class_i, n FROM pairs)
    SELECT a.class AS class_i, b.class AS class_j, coalesce(n, 0) AS n FROM cls a CROSS JOIN cls b LEFT JOIN s ON class_i = a.class AND class_j = b.class""")
def cooccurrence_matrix_full(spark, sf):
    return cooccurrence.full_matrix(T.basket(spark, sf))


@query(ctes("jac") + "SELECT * FROM jac")
def cooccurrence_jaccard(spark, sf):
    return cooccurrence.jaccard(T.basket(spark, sf))


@query(ctes("gram") + "SELECT * FROM gram")
def gram_matrix(spark, sf):
    return cooccurrence.gram(T.basket(spark, sf))


@query(ctes("pairs", "freq") + ", s AS (SELECT * FROM pairs UNION ALL SELECT class_j, class_i, n FROM pairs) SELECT class_i, class_j, round(n / CAST(f AS DOUBLE), 6) AS p FROM s JOIN freq ON class = class_i")
def conditional_probability(spark, sf):
    return cooccurrence.conditional(T.basket(spark, sf))


@query("""WITH b AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS scene, event_type AS class FROM events), f AS (SELECT class, count(*) AS f FROM b GROUP BY class),
    p AS (SELECT x.class AS class_i, y.class AS class_j, count(*) AS n FROM b x JOIN b y ON x.scene = y.scene AND x.class < y.class GROUP BY ALL)
    SELECT class_i, class_j, n, round(CAST(n AS DOUBLE) / (u.f + v.f - n), 6) AS jaccard FROM p JOIN f u ON u.class = class_i JOIN f v ON v.class = class_j""")
def user_day_cooccurrence(spark, sf):
    return cooccurrence.jaccard(T.user_days(spark, sf))


@query(ctes("pairs", "gram") + "SELECT g.class_i, g.class_j, coalesce(p.n, 0) AS algo1_count, g.n AS algo2_count, coalesce(p.n, 0) - g.n AS discrepancy FROM gram g LEFT JOIN pairs p USING (class_i, class_j) WHERE g.class_i < g.class_j")
def cooccurrence_two_algorithms(spark, sf):
    return checks.two_algorithms(T.basket(spark, sf))


@query(ctes("pairs", "gram") + "SELECT max(abs(d)) AS max_discrepancy, count(*) FILTER (d <> 0) AS mismatches, CAST(count(*) AS BIGINT) AS cells FROM (SELECT coalesce(p.n, 0) - g.n AS d FROM gram g LEFT JOIN pairs p USING (class_i, class_j) WHERE g.class_i < g.class_j)")
def discrepancy_summary(spark, sf):
    d = F.col("discrepancy")
    return checks.two_algorithms(T.basket(spark, sf)).agg(
        F.max(F.abs(d)).alias("max_discrepancy"), F.count_if(d != 0).alias("mismatches"), F.count("*").alias("cells")
    )


@query(ctes("gram") + "SELECT 'symmetry' AS check_name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM (SELECT a.n FROM gram a LEFT JOIN gram b ON a.class_i = b.class_j AND a.class_j = b.class_i WHERE a.n IS DISTINCT FROM b.n)")
def symmetry_check(spark, sf):
    wrong = checks.asymmetric_cells(cooccurrence.gram(T.basket(spark, sf)))
    return wrong.agg(checks.result(F.count("*") == 0).alias("result")).select(F.lit("symmetry").alias("check_name"), "result")


@query(ctes("freq", "gram") + "SELECT f.class, f AS frequency, g.n AS diagonal, CASE WHEN abs(g.n - f) <= 1 THEN 'PASS' ELSE 'FAIL' END AS result FROM freq f LEFT JOIN gram g ON g.class_i = f.class AND g.class_j = f.class")
def diagonal_check(spark, sf):
    return checks.diagonal_deviation(T.basket(spark, sf))


@query(ctes("jac") + """SELECT 'jaccard_range' AS check_name, CASE WHEN min(jaccard) >= 0 AND max(jaccard) <= 1 THEN 'PASS' ELSE 'FAIL' END AS result FROM jac
    UNION ALL SELECT 'scene_count', CASE WHEN count(*) BETWEEN 100 AND 10000000 THEN 'PASS' ELSE 'FAIL' END FROM orders
    UNION ALL SELECT 'unknown_pair', CASE WHEN max(jaccard) > 0.1 THEN 'PASS' WHEN max(jaccard) <= 0.1 THEN 'FAIL' ELSE 'SKIP' END FROM jac WHERE class_i = 'Brand#0'""")
def range_checks(spark, sf):
    jac = cooccurrence.jaccard(T.basket(spark, sf))
    one = jac.agg(checks.result((F.min("jaccard") >= 0) & (F.max("jaccard") <= 1)).alias("result")).select(F.lit("jaccard_range").alias("check_name"), "result")
    two = T.scenes(spark, sf).agg(checks.result(F.count("*").between(100, 10_000_000)).alias("result")).select(F.lit("scene_count").alias("check_name"), "result")
    three = jac.where("class_i = 'Brand#0'").agg(checks.result(F.max("jaccard") > 0.1).alias("result")).select(F.lit("unknown_pair").alias("check_name"), "result")
    return one.unionByName(two).unionByName(three)


@query(ctes("basket") + "SELECT scene, " + ", ".join(f"""CAST(max(CASE WHEN class = 'Brand#{i}' THEN 1 ELSE 0 END) AS BIGINT) AS "Brand#{i}\"""" for i in range(11, 16)) + " FROM basket WHERE class IN (" + ", ".join(f"'Brand#{i}'" for i in range(11, 16)) + ") GROUP BY scene")
def presence_matrix_pivot(spark, sf):
    return presence.incidence(T.basket(spark, sf), [f"Brand#{i}" for i in range(11, 16)])


@query(ctes("sym", "freq") + """SELECT class_i AS focal_class, count(*) AS n_features, string_agg(class_j, '|' ORDER BY class_j) AS features, f AS n_scenes
    FROM sym JOIN freq ON class = class_i WHERE jaccard >= 0.075 GROUP BY class_i, f HAVING count(*) >= 2 AND f >= 80""")
def feature_selection_by_jaccard(spark, sf):
    return cooccurrence.co_features(T.basket(spark, sf), 0.075, 80, 2).select("focal_class", "n_features", "features", "n_scenes")


_GRID = [round(0.02 * i, 2) for i in range(16)]


@query(ctes("sym") + f"SELECT class_i AS focal_class, CAST(t AS DOUBLE) AS threshold, count(*) FILTER (jaccard >= CAST(t AS DOUBLE)) AS n_features FROM sym, unnest({_GRID}) AS g(t) GROUP BY ALL")
def threshold_feature_curve(spark, sf):
    return cooccurrence.threshold_curve(T.basket(spark, sf), _GRID)


# -- lift and splits -----------------------------------------------------------


@query(ctes("lifts") + "SELECT * FROM lifts")
def lift_by_type(spark, sf):
    return lift.lift(T.basket(spark, sf), T.scenes(spark, sf))


@query("""WITH d AS (SELECT doc_id, lang, source FROM documents), n AS (SELECT count(*) AS s FROM d), l AS (SELECT lang, count(*) AS m FROM d GROUP BY lang), c AS (SELECT source, count(*) AS f FROM d GROUP BY source)
    SELECT source AS class, lang AS scene_type, count(d.doc_id) AS n_scenes, round(count(d.doc_id) / CAST(m AS DOUBLE), 6) AS freq_in_type, round(f / CAST(s AS DOUBLE), 6) AS overall_freq,
    round((count(d.doc_id) / CAST(m AS DOUBLE)) / (f / CAST(s AS DOUBLE)), 4) AS lift FROM c CROSS JOIN l CROSS JOIN n LEFT JOIN d USING (source, lang) GROUP BY source, lang, m, f, s""")
def lift_source_by_lang(spark, sf):
    docs = T.read(spark, sf, "documents")
    found = presence.presence(docs, "doc_id", "source")
    return lift.lift(found, docs.select(F.col("doc_id").alias("scene"), F.col("lang").alias("scene_type")))


@query(ctes("lifts") + "SELECT class, " + ", ".join(f"max(lift) FILTER (scene_type = '{t}') AS lift_{i + 1}" for i, t in enumerate(TYPES)) + " FROM lifts GROUP BY class")
def lift_pivot_table(spark, sf):
    return lift.pivot(lift.lift(T.basket(spark, sf), T.scenes(spark, sf)), TYPES, [f"lift_{i + 1}" for i in range(5)])


@query(ctes("decisive") + "SELECT * FROM decisive")
def decisiveness_ranking(spark, sf):
    found, scenes = T.basket(spark, sf), T.scenes(spark, sf)
    return lift.decisiveness(lift.lift(found, scenes), presence.class_frequency(found, scenes))


@query(ctes("assigned", recursive=True) + "SELECT * FROM assigned")
def greedy_stage_assignment(spark, sf):
    return assigned(spark, sf)[2]


_LOSS = "round(100.0 * (1 - CAST(survived AS DOUBLE) / total), 4) AS pct_lost, survived >= 50 AS viable"


@query(ctes("masks", "stage_bits", recursive=True) + f""", r AS (SELECT stage_idx, scene_type, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (mask >> stage_idx = 0), 0) AS BIGINT) AS survived
    FROM masks JOIN stage_bits USING (scene_type) GROUP BY ALL) SELECT *, {_LOSS} FROM r""")
def strict_filter_by_type(spark, sf):
    found, scenes, stages = assigned(spark, sf)
    return splits.strict_by_type(splits.stage_masks(found, scenes, stages), stage_types(spark))


@query(ctes("freq_masks") + f""", r AS (SELECT CAST(s AS BIGINT) AS stage_idx, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (mask >> (s - 1) = 1), 0) AS BIGINT) AS survived
    FROM freq_masks, unnest(range(1, 6)) AS k(s) WHERE (mask >> (s - 1)) & 1 = 1 GROUP BY s) SELECT *, {_LOSS} FROM r""")
def strict_filter_by_presence(spark, sf):
    found, scenes, stages = frequency_stages(spark, sf)
    return splits.strict_by_presence(splits.stage_masks(found, scenes, stages), 5)


@query(ctes("assigned", recursive=True) + """, s AS (SELECT DISTINCT stage_idx FROM assigned) SELECT s.stage_idx, (SELECT string_agg(class, '|' ORDER BY class) FROM assigned a WHERE a.stage_idx = s.stage_idx) AS classes,
    coalesce((SELECT string_agg(class, '|' ORDER BY class) FROM assigned a WHERE a.stage_idx > s.stage_idx), '') AS future FROM s""")
def future_class_sets(spark, sf):
    return splits.future_classes(assigned(spark, sf)[2])


@query(ctes("surv", recursive=True) + "SELECT * FROM surv")
def surviving_scenes(spark, sf):
    found, scenes, stages = assigned(spark, sf)
    return splits.surviving_scenes(found, scenes, stages, stage_types(spark))


@query(ctes("perms") + "SELECT ordering, array_to_string(types, '|') AS types FROM perms")
def stage_orderings(spark, sf):
    return splits.orderings(spark, TYPES).select("ordering", F.array_join("types", "|").alias("types"))


def _swept(spark, sf):
    found, scenes, stages = assigned(spark, sf)
    return splits.sweep(splits.stage_masks(found, scenes, stages), splits.orderings(spark, TYPES), TYPES)


@query(ctes("swept", recursive=True) + "SELECT * FROM swept")
def ordering_sweep(spark, sf):
    return _swept(spark, sf)


@query(ctes("swept", recursive=True) + "SELECT ordering, array_to_string(types, '|') AS types, min_survived, total_survived FROM swept JOIN perms USING (ordering) ORDER BY min_survived DESC, total_survived DESC, ordering LIMIT 1")
def best_ordering(spark, sf):
    best = splits.best_ordering(_swept(spark, sf))
    return best.join(splits.orderings(spark, TYPES), "ordering").select("ordering", F.array_join("types", "|").alias("types"), "min_survived", "total_survived")


_BEST = ctes("swept", recursive=True) + """, b AS (SELECT types FROM swept JOIN perms USING (ordering) ORDER BY min_survived DESC, total_survived DESC, ordering LIMIT 1),
    pos AS (SELECT s.scene_type, s.stage_idx AS default_stage, CAST(list_position(b.types, s.scene_type) AS BIGINT) AS best_stage FROM stage_bits s, b),
    fut AS (SELECT p.scene_type, p.default_stage, p.best_stage,
      CAST(coalesce((SELECT sum(CAST(1 AS BIGINT) << (q.default_stage - 1)) FROM pos q WHERE q.default_stage > p.default_stage), 0) AS BIGINT) AS f0,
      CAST(coalesce((SELECT sum(CAST(1 AS BIGINT) << (q.default_stage - 1)) FROM pos q WHERE q.best_stage > p.best_stage), 0) AS BIGINT) AS f1 FROM pos p)
    SELECT scene_type, default_stage, best_stage, CAST(coalesce(sum(n) FILTER (mask & f0 = 0), 0) AS BIGINT) AS default_survived, CAST(coalesce(sum(n) FILTER (mask & f1 = 0), 0) AS BIGINT) AS best_survived,
    CAST(coalesce(sum(n) FILTER (mask & f1 = 0), 0) - coalesce(sum(n) FILTER (mask & f0 = 0), 0) AS BIGINT) AS delta, default_stage <> best_stage AS moved FROM fut JOIN masks USING (scene_type) GROUP BY ALL"""


@query(_BEST)
def best_vs_default(spark, sf):
    found, scenes, stages = assigned(spark, sf)
    masks = splits.stage_masks(found, scenes, stages)
    orders = splits.orderings(spark, TYPES)
    best = splits.best_ordering(splits.sweep(masks, orders, TYPES)).select("ordering")
    at = stage_types(spark).withColumnRenamed("stage_idx", "default_stage")
    spot = best.join(orders, "ordering").select(F.posexplode("types").alias("i", "scene_type"))
    place = at.join(spot.select("scene_type", (F.col("i") + 1).cast("long").alias("best_stage")), "scene_type")
    other = place.select(F.col("default_stage").alias("d"), F.col("best_stage").alias("b"))
    bit = F.expr("shiftleft(1L, cast(d - 1 as int))")
    future = place.crossJoin(F.broadcast(other)).groupBy("scene_type", "default_stage", "best_stage").agg(
        F.sum(F.when(F.col("d") > F.col("default_stage"), bit).otherwise(0)).alias("f0"), F.sum(F.when(F.col("b") > F.col("best_stage"), bit).otherwise(0)).alias("f1")
    )
    left = lambda f: F.sum(F.when(F.expr(f"mask & {f} = 0"), F.col("n")).otherwise(0))
    out = masks.join(F.broadcast(future), "scene_type").groupBy("scene_type", "default_stage", "best_stage").agg(
        left("f0").alias("default_survived"), left("f1").alias("best_survived")
    )
    return out.withColumn("delta", F.col("best_survived") - F.col("default_survived")).withColumn("moved", F.col("default_stage") != F.col("best_stage"))


_UNION = """, u AS (SELECT 'v2-' || stage_idx AS split, scene FROM surv UNION ALL
    SELECT 'v1-' || max(f.stage_idx), b.scene FROM basket b JOIN freq_stages f USING (class) GROUP BY b.scene)"""


def _union(spark, sf):
    found, scenes, stages = assigned(spark, sf)
    two = splits.surviving_scenes(found, scenes, stages, stage_types(spark)).select(F.concat(F.lit("v2-"), F.col("stage_idx").cast("string")).alias("split"), "scene")
    found, _, by_freq = frequency_stages(spark, sf)
    last = found.join(by_freq, "class").groupBy("scene").agg(F.max("stage_idx").alias("s"))
    return two.unionByName(last.select(F.concat(F.lit("v1-"), F.col("s").cast("string")).alias("split"), "scene"))


@query(ctes("surv", "freq_stages", recursive=True) + _UNION + " SELECT split, count(*) AS n FROM u WHERE split LIKE 'v1%' GROUP BY split UNION ALL SELECT 'all', count(*) FROM u")
def split_union_tagged(spark, sf):
    u = _union(spark, sf)
    one = u.where(F.col("split").startswith("v1")).groupBy("split").agg(F.count("*").alias("n"))
    return one.unionByName(u.agg(F.count("*").alias("n")).select(F.lit("all").alias("split"), "n"))


@query(ctes("surv", "freq_stages", recursive=True) + _UNION + " SELECT substr(split, 1, 2) AS split, CAST(count(*) - count(DISTINCT scene) AS BIGINT) AS duplicates FROM u GROUP BY 1")
def split_no_duplicates(spark, sf):
    u = _union(spark, sf).withColumn("split", F.substring("split", 1, 2))
    copies = checks.in_two_stages(u).dropDuplicates(["split", "scene"]).groupBy("split").agg(F.sum(F.col("copies") - 1).alias("d"))
    return u.select("split").distinct().join(copies, "split", "left").select("split", F.coalesce("d", F.lit(0)).alias("duplicates"))


@query(ctes("assigned", "freq", recursive=True) + """, h AS (SELECT class, count(*) AS n FROM (SELECT class FROM assigned WHERE class <> 'Brand#7' UNION ALL SELECT 'Brand#8' UNION ALL SELECT 'Brand#99') GROUP BY class)
    SELECT coalesce(f.class, h.class) AS class, coalesce(n, 0) AS n_stages, CASE WHEN f.class IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicated' ELSE 'ok' END AS status FROM freq f FULL JOIN h USING (class)""")
def split_class_coverage(spark, sf):
    found, _, stages = assigned(spark, sf)
    held = stages.select("class").where("class <> 'Brand#7'").union(spark.createDataFrame([("Brand#8",), ("Brand#99",)], "class string"))
    return checks.coverage(found.select("class").distinct(), held)


@query(ctes("freq_masks") + "SELECT 5 AS stage_idx, CAST(sum(n) FILTER ((mask >> 4) & 1 = 1) AS BIGINT) AS total, CAST(sum(n) FILTER (mask >> 4 = 1) AS BIGINT) AS survived, CASE WHEN sum(n) FILTER ((mask >> 4) & 1 = 1) = sum(n) FILTER (mask >> 4 = 1) THEN 'PASS' ELSE 'FAIL' END AS result FROM freq_masks")
def last_stage_lossless(spark, sf):
    found, scenes, stages = frequency_stages(spark, sf)
    out = splits.strict_by_presence(splits.stage_masks(found, scenes, stages), 5).where("stage_idx = 5")
    return out.select(F.col("stage_idx").cast("int").alias("stage_idx"), "total", "survived", checks.result(F.col("total") == F.col("survived")).alias("result"))


@query(ctes("surv", recursive=True) + """SELECT s.stage_idx, s.scene, count(*) FILTER (a.stage_idx = s.stage_idx) AS own_hits, count(*) FILTER (a.stage_idx > s.stage_idx) AS future_hits
    FROM surv s LEFT JOIN basket USING (scene) LEFT JOIN assigned a USING (class) GROUP BY ALL""")
def sampled_filter_check(spark, sf):
    found, scenes, stages = assigned(spark, sf)
    return checks.filter_holds(splits.surviving_scenes(found, scenes, stages, stage_types(spark)), stages)


_SPLIT_ROWS = ", ".join(f"('{s}', {i}, '{label}', '{c}', {k})" for s, i, label, c, k in catalogue.split_rows())


@query(f"""SELECT split, CAST(stage_idx AS BIGINT) AS stage_idx, label AS stage_label, string_agg(class, '|' ORDER BY position) AS classes, count(*) AS n
    FROM (VALUES {_SPLIT_ROWS}) AS t(split, stage_idx, label, class, position) GROUP BY ALL""")
def split_catalogue(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("position", "class")))
    grouped = catalogue.split_table(spark).groupBy("split", "stage_idx", "stage_label").agg(rows.alias("r"))
    names = F.array_join(F.transform("r", lambda x: x["class"]), "|")
    return grouped.select("split", "stage_idx", "stage_label", names.alias("classes"), F.size("r").cast("long").alias("n"))


@query(ctes("freq_masks") + """, r AS (SELECT CAST(s AS BIGINT) AS stage_idx, CAST(coalesce(sum(n) FILTER (mask >> (s - 1) = 1), 0) AS BIGINT) AS survived FROM freq_masks, unnest(range(1, 4)) AS k(s) GROUP BY s)
    SELECT stage_idx, CAST(old AS BIGINT) AS survived_old, survived AS survived_new, CAST(survived - old AS BIGINT) AS delta FROM r JOIN (VALUES (1, 442), (2, 2727), (3, 6808)) AS v(stage_idx, old) USING (stage_idx)""")
def survival_delta(spark, sf):
    found, scenes, stages = frequency_stages(spark, sf)
    new = splits.strict_by_presence(splits.stage_masks(found, scenes, stages), 5).select("stage_idx", F.col("survived").alias("survived_new"))
    old = spark.createDataFrame([(i, n) for i, _, n, _ in catalogue.SEMANTIC_3_SURVIVAL], "stage_idx long, survived_old long")
    return new.join(F.broadcast(old), "stage_idx").withColumn("delta", F.col("survived_new") - F.col("survived_old"))


# -- robust statistics -----------------------------------------------------------


@query("SELECT event_type, count(*) AS n, count(value) AS n_with_value, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr_value FROM events GROUP BY event_type")
def robust_summary(spark, sf):
    return T.read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_with_value"), *spatial.robust("value", "value"))


_P = lambda shares: ", ".join(f"round(quantile_cont(value, {s}), 6) AS p{round(100 * s):02d}" for s in shares)
_SIX, _NINE = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99], [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query(f"SELECT event_type, {_P(_SIX)} FROM events GROUP BY event_type ORDER BY p50")
def percentile_table(spark, sf):
    return T.read(spark, sf, "events").groupBy("event_type").agg(*spatial.percentiles("value", _SIX)).orderBy("p50")


@query(f"SELECT {_P(_NINE)} FROM events")
def global_percentiles(spark, sf):
    return T.read(spark, sf, "events").agg(*spatial.percentiles("value", _NINE))


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (l_extendedprice < 20000) AS below, round(100.0 * count(*) FILTER (l_extendedprice < 20000) / count(*), 6) AS pct_below FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def fraction_below(spark, sf):
    rows = T.read(spark, sf, "lineitem").join(T.read(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    below = F.count_if(F.col("l_extendedprice") < 20000)
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), below.alias("below"), F.round(100.0 * below / F.count("*"), 6).alias("pct_below"))


@query("SELECT event_type, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_positive FROM events GROUP BY event_type")
def boolean_rate(spark, sf):
    return T.read(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 0).cast("int")) * 100, 6).alias("pct_positive"))


@query("""WITH s AS (SELECT p_brand, round(100.0 * count(*) FILTER (l_discount < 0.05) / count(*), 6) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
    SELECT CASE WHEN rate > 46 THEN 'high' WHEN rate < 45 THEN 'low' ELSE 'mixed' END AS band, count(*) AS n, string_agg(p_brand, ', ' ORDER BY p_brand) AS brands FROM s GROUP BY band""")
def band_classification(spark, sf):
    rows = T.read(spark, sf, "lineitem").join(T.read(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    rate = rows.groupBy("p_brand").agg(F.round(100.0 * F.count_if(F.col("l_discount") < 0.05) / F.count("*"), 6).alias("rate"))
    band = F.when(F.col("rate") > 46, "high").when(F.col("rate") < 45, "low").otherwise("mixed")
    return rate.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("p_brand")), ", ").alias("brands"))


@query("""SELECT event_type, CAST(least(floor((v - 0) / (200.0 / 64)), 63) AS BIGINT) AS bin, count(*) AS n FROM (SELECT event_type, least(greatest(value, 0.0), 200.0) AS v FROM events) GROUP BY ALL""")
def histogram_fixed(spark, sf):
    rows = T.read(spark, sf, "events").withColumn("v", G.clip(F.col("value"), 0.0, 200.0))
    return rows.groupBy("event_type", G.fixed_bin(F.col("v"), 0.0, 200.0, 64).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 80)), 79) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1""")
def histogram_auto(spark, sf):
    rows = T.read(spark, sf, "lineitem").select("l_quantity")
    bounds = rows.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    place = F.least(F.floor((F.col("l_quantity") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 80)), F.lit(79)).cast("long")
    return rows.crossJoin(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand) SELECT p_brand, round(m, 6) AS median_price, 'least' AS end_of FROM m QUALIFY row_number() OVER (ORDER BY m, p_brand) <= 3
    UNION ALL SELECT p_brand, round(m, 6), 'most' FROM m QUALIFY row_number() OVER (ORDER BY m DESC, p_brand) <= 3""")
def smallest_and_largest(spark, sf):
    m = T.read(spark, sf, "part").groupBy("p_brand").agg(F.median("p_retailprice").alias("m"))
    ends = [m.orderBy(o, "p_brand").limit(3).withColumn("end_of", F.lit(e)) for o, e in ((F.asc("m"), "least"), (F.desc("m"), "most"))]
    return ends[0].union(ends[1]).select("p_brand", F.round("m", 6).alias("median_price"), "end_of")


@query(f"SELECT event_type, {_P([0.05, 0.25, 0.5, 0.75, 0.95])} FROM (SELECT event_type, least(greatest(value, 0.0), 100.0) AS value FROM events) GROUP BY event_type")
def boxplot_stats(spark, sf):
    rows = T.read(spark, sf, "events").withColumn("value", G.clip(F.col("value"), 0.0, 100.0))
    return rows.groupBy("event_type").agg(*spatial.percentiles("value", [0.05, 0.25, 0.5, 0.75, 0.95]))


@query("WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo + 1e-6), 6) AS scaled FROM lineitem, b")
def minmax_normalise(spark, sf):
    rows = T.read(spark, sf, "lineitem")
    bounds = rows.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    scaled = (F.col("l_quantity") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(1e-6))
    return rows.crossJoin(F.broadcast(bounds)).select("l_orderkey", "l_linenumber", F.round(scaled, 6).alias("scaled"))


# -- geometry ------------------------------------------------------------------


@query(ctes("rooms") + "SELECT label, round(x0, 6) AS x0, round(x1, 6) AS x1, round(mx, 6) AS cx, round(mz, 6) AS cz, round(greatest((x1 - x0) / 2, 0.1), 6) AS half_w, round(greatest((z1 - z0) / 2, 0.1), 6) AS half_d, round(floor_y, 6) AS floor_y FROM rooms")
def room_polygon(spark, sf):
    found = T.objects(spark, sf)
    mean = found.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("z").alias("cz"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return T.rooms(found).join(mean, "label").select(
        "label", r("x0", "x0"), r("x1", "x1"), r("cx", "cx"), r("cz", "cz"),
        r(G.half_extent(F.col("xs")), "half_w"), r(G.half_extent(F.col("zs")), "half_d"), r("floor_y", "floor_y"),
    )


_SEG = """CASE WHEN (bx - ax) * (bx - ax) + (bz - az) * (bz - az) < 1e-12 THEN sqrt(power(px - ax, 2) + power(pz - az, 2)) ELSE
    sqrt(power(px - (ax + least(1.0, greatest(0.0, ((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)))) * (bx - ax)), 2)
       + power(pz - (az + least(1.0, greatest(0.0, ((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / ((bx - ax) * (bx - ax) + (bz - az) * (bz - az)))) * (bz - az)), 2)) END"""


@query(f"WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS pz, CAST(embedding[3] AS DOUBLE) AS ax, CAST(embedding[4] AS DOUBLE) AS az, CAST(embedding[5] AS DOUBLE) AS bx, CAST(embedding[6] AS DOUBLE) AS bz FROM embeddings) SELECT vec_id, round({_SEG}, 6) AS distance FROM p")
def point_segment_distance(spark, sf):
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    return T.read(spark, sf, "embeddings").select("vec_id", F.round(G.point_segment_distance(*e), 6).alias("distance"))


@query(ctes("edges", "objs") + f"SELECT vec_id, round(min({_SEG}), 6) AS dist_to_wall FROM (SELECT vec_id, x AS px, z AS pz, ax, az, bx, bz FROM objs JOIN edges USING (label)) GROUP BY vec_id")
def nearest_wall_distance(spark, sf):
    found = T.objects(spark, sf)
    walls = found.join(T.rooms(found).select("label", "xs", "zs"), "label")
    return walls.select("vec_id", F.round(G.polygon_distance(F.col("x"), F.col("z"), F.col("xs"), F.col("zs")), 6).alias("dist_to_wall"))


@query(ctes("edges", "objs") + f"SELECT vec_id, round(min({_SEG}), 6) AS edge_dist FROM (SELECT vec_id, x + sx * w / 2 AS px, z + sz * d / 2 AS pz, ax, az, bx, bz FROM objs JOIN edges USING (label), unnest([-1, 1]) AS s(sx), unnest([-1, 1]) AS t(sz) WHERE w > 0 AND d > 0) GROUP BY vec_id")
def nearest_edge_distance(spark, sf):
    found = T.objects(spark, sf)
    walls = found.where("w > 0 and d > 0").join(T.rooms(found).select("label", "xs", "zs"), "label")
    c = [F.col(x) for x in ("x", "z", "w", "d", "xs", "zs")]
    return walls.select("vec_id", F.round(G.nearest_corner_distance(*c), 6).alias("edge_dist"))


@query(ctes("rooms") + "SELECT vec_id, round(floor_y - (y + h / 2), 6) AS bottom_above_floor, floor_y - (y + h / 2) < 0.15 AS on_floor FROM objs JOIN rooms USING (label)")
def floor_features(spark, sf):
    found = T.objects(spark, sf)
    above = F.col("floor_y") - (F.col("y") + F.col("h") / 2)
    rows = found.join(T.rooms(found).select("label", "floor_y"), "label")
    return rows.select("vec_id", F.round(above, 6).alias("bottom_above_floor"), (above < spatial.ON_FLOOR).alias("on_floor"))


_NORM = "(x - mx) / greatest((x1 - x0) / 2, 0.1) AS nx, (z - mz) / greatest((z1 - z0) / 2, 0.1) AS nz"


def _normalised(spark, sf):
    found = T.objects(spark, sf)
    mean = found.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"))
    rows = found.join(T.rooms(found), "label").join(mean, "label")
    nx, nz = (F.col("x") - F.col("mx")) / G.half_extent(F.col("xs")), (F.col("z") - F.col("mz")) / G.half_extent(F.col("zs"))
    return rows.select("vec_id", "label", F.round(nx, 6).alias("norm_cx"), F.round(nz, 6).alias("norm_cz"))


@query(ctes("rooms") + f"SELECT vec_id, round(nx, 6) AS norm_cx, round(nz, 6) AS norm_cz FROM (SELECT vec_id, {_NORM} FROM objs JOIN rooms USING (label)) WHERE round(nx, 6) BETWEEN -1 AND 1 AND round(nz, 6) BETWEEN -1 AND 1")
def normalised_coordinates(spark, sf):
    return _normalised(spark, sf).where("norm_cx between -1 and 1 and norm_cz between -1 and 1").select("vec_id", "norm_cx", "norm_cz")


@query(ctes("objs") + "SELECT CAST(label AS BIGINT) AS label, least(count(*), 20) AS n_sampled FROM objs GROUP BY label QUALIFY row_number() OVER (ORDER BY count(*) DESC, label) <= 6")
def top_categories_normalised(spark, sf):
    rows = _normalised(spark, sf)
    top = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(6)
    sample = spatial.stable_sample(rows.join(F.broadcast(top.select("label")), "label"), "vec_id", 20, per="label")
    return sample.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n_sampled"))


@query(ctes("rooms") + "SELECT vec_id, label, round(floor_y - (y + h / 2), 6) AS above FROM objs JOIN rooms USING (label) WHERE y + h / 2 > floor_y ORDER BY above, vec_id LIMIT 10")
def negative_offset_examples(spark, sf):
    found = T.objects(spark, sf)
    above = F.col("floor_y") - (F.col("y") + F.col("h") / 2)
    rows = found.join(T.rooms(found).select("label", "floor_y"), "label").where(above < 0)
    return rows.select("vec_id", "label", F.round(above, 6).alias("above")).orderBy("above", "vec_id").limit(10)


# -- clustering ------------------------------------------------------------------


@query(ctes("vecs") + """, d AS (SELECT a.id AS i, a.label AS li, b.label AS lj, avg(list_distance(a.v, b.v)) AS d FROM vecs a JOIN vecs b ON a.id <> b.id GROUP BY ALL),
    s AS (SELECT i, li, max(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM d GROUP BY i, li)
    SELECT li AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY li""")
def silhouette_by_label(spark, sf):
    return cluster.silhouette_of_labels(T.vectors(spark, sf))


@query(ctes("vecs") + ", c AS (SELECT label, d, avg(v[d]) AS m FROM vecs, unnest(range(1, 65)) AS r(d) GROUP BY label, d) SELECT label, count(DISTINCT id) AS n, round(sum(power(v[d] - m, 2)), 4) AS inertia FROM vecs JOIN c USING (label) GROUP BY label")
def inertia_by_label(spark, sf):
    return cluster.inertia_of_labels(T.vectors(spark, sf))


@query(ctes("vecs") + """, s AS (SELECT label AS cluster, arg_min(v, id) AS c FROM vecs GROUP BY label), a AS (SELECT id, cluster, list_distance(v, c) AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), cluster) AS r FROM vecs, s)
    SELECT cluster, count(*) AS n, round(sum(d * d), 4) AS inertia FROM a WHERE r = 1 GROUP BY cluster""")
def lloyd_step(spark, sf):
    points = T.vectors(spark, sf)
    seeds = points.groupBy("label").agg(F.min_by("v", "id").alias("v"))
    return cluster.lloyd_step(points, seeds)


_PROFILE = ", pr AS (SELECT label AS cluster, d - 1 AS feature, round(avg(CASE WHEN v[d] > 0 THEN 1.0 ELSE 0.0 END), 6) AS mean FROM vecs, unnest(range(1, 65)) AS r(d) GROUP BY label, d)"


def _profile(spark, sf):
    rows = T.vectors(spark, sf).select(F.col("label").alias("cluster"), F.posexplode("v").alias("feature", "x"))
    return cluster.profile(rows.select("cluster", F.col("feature").cast("long").alias("feature"), (F.col("x") > 0).cast("int").alias("x")))


@query(ctes("vecs") + _PROFILE + " SELECT * FROM pr")
def cluster_profile(spark, sf):
    return _profile(spark, sf)


@query(ctes("vecs") + _PROFILE + ", s AS (SELECT feature, round(var_samp(mean), 8) AS variance FROM pr GROUP BY feature) SELECT feature, variance, row_number() OVER (ORDER BY variance DESC, feature) AS rank FROM s QUALIFY rank <= 10")
def cluster_profile_variance(spark, sf):
    return cluster.profile_variance(_profile(spark, sf), 10)


@query(ctes("vecs") + _PROFILE + ", k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, feature) AS r FROM pr) SELECT cluster, string_agg(CAST(feature AS VARCHAR), ', ' ORDER BY r) AS top FROM k WHERE r <= 3 GROUP BY cluster")
def cluster_top3(spark, sf):
    return cluster.top_features(_profile(spark, sf), 3)


@query("SELECT label AS cluster, count(*) AS n, 'C' || row_number() OVER (ORDER BY count(*) DESC, label) AS name, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf):
    return cluster.cluster_sizes(T.vectors(spark, sf).select(F.col("label").alias("cluster")))


def _gaps(spark):
    rows = [(c, k, 0, w) for c, k, w, _ in FITS] + [(c, k, i + 1, n) for c, k, _, ns in FITS for i, n in enumerate(ns)]
    return cluster.gap_table(spark.createDataFrame(rows, "focal_class string, k long, draw int, log_w double"))


@query(ctes("gap_steps") + "SELECT focal_class, coalesce(min(k) FILTER (gap >= bound), arg_max(k, gap * 1000 - k * 1e-9)) AS best_k FROM gap_steps GROUP BY focal_class")
def gap_one_se_rule(spark, sf):
    return cluster.best_k(_gaps(spark))


@query(ctes("gap_steps") + "SELECT focal_class, k, gap, sk, log_w, bound, coalesce(gap >= bound, false) AS fires FROM gap_steps")
def gap_diagnostic_steps(spark, sf):
    return cluster.one_se_steps(_gaps(spark))


@query(f"SELECT focal_class, CAST(k AS BIGINT) AS best_k, CAST(s AS DOUBLE) AS silhouette FROM (VALUES {_CURVE_ROWS}) AS t(focal_class, k, s) QUALIFY row_number() OVER (PARTITION BY focal_class ORDER BY s DESC, k) = 1")
def argmax_k(spark, sf):
    return cluster.argmax_silhouette(spark.createDataFrame(CURVE, "focal_class string, k long, silhouette double"))


@query(ctes("gap_steps") + f""", n AS (SELECT focal_class, coalesce(min(k) FILTER (gap >= bound), arg_max(k, gap)) AS k_new FROM gap_steps WHERE focal_class <> 'sofa' GROUP BY focal_class),
    o AS (SELECT focal_class, CAST(k AS BIGINT) AS k_old FROM (VALUES {_CURVE_ROWS}) AS t(focal_class, k, s) QUALIFY row_number() OVER (PARTITION BY focal_class ORDER BY s DESC, k) = 1)
    SELECT focal_class, CAST(k_old AS DOUBLE) AS k_old, CAST(k_new AS DOUBLE) AS k_new, CAST(k_new - k_old AS DOUBLE) AS delta, k_new IS DISTINCT FROM k_old AS changed FROM o FULL JOIN n USING (focal_class)""")
def version_comparison(spark, sf):
    old = cluster.argmax_silhouette(spark.createDataFrame(CURVE, "focal_class string, k long, silhouette double"))
    out = cluster.version_comparison(old, cluster.best_k(_gaps(spark).where("focal_class <> 'sofa'")))
    return out.withColumns({c: F.col(c).cast("double") for c in ("k_old", "k_new", "delta")})


def _features(spark, sf, threshold: float):
    edges = cooccurrence.symmetric(cooccurrence.jaccard(T.user_days(spark, sf)), "jaccard").where(F.col("jaccard") >= threshold)
    return edges.select(F.col("class_i").alias("focal_class"), F.col("class_j").alias("feature"))


def _patterns(spark, sf, threshold: float):
    return cluster.presence_patterns(T.user_days(spark, sf), _features(spark, sf, threshold))


_KS = list(range(2, 11))


@query(None)
def kmeans_inertia_curve(spark, sf):
    fitted = cluster.fits(_patterns(spark, sf, 0.1), _KS)
    return fitted.select("focal_class", "k", F.round("log_w", 6).alias("log_w"), F.round("silhouette", 6).alias("silhouette"))


@query(None)
def gap_statistic(spark, sf):
    gaps = written(cluster.gap_table(cluster.fits(written(_patterns(spark, sf, 0.1), "patterns"), list(range(2, 11)), draws=20)), "gaps")
    return cluster.one_se_steps(gaps).join(cluster.best_k(gaps), "focal_class")


@query(None)
def cluster_summary(spark, sf):
    patterns = _patterns(spark, sf, 0.1)
    fitted = cluster.fits(patterns, _KS)
    chosen = cluster.argmax_silhouette(fitted.where("silhouette is not null"))
    return cluster.summary(patterns, _features(spark, sf, 0.1), cluster.assignments(fitted, chosen))


@query(None)
def threshold_sweep(spark, sf):
    out = None
    for t in (0.10, 0.11, 0.12, 0.13, 0.14, 0.15, 0.16, 0.18, 0.20):
        fitted = cluster.fits(_patterns(spark, sf, t), [2, 3, 4, 5])
        best = cluster.argmax_silhouette(fitted.where("silhouette is not null"))
        row = best.agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("mean"), F.round(F.median("silhouette"), 6).alias("median"), F.round(F.min("silhouette"), 6).alias("min"))
        wide = _features(spark, sf, t).groupBy("focal_class").agg(F.count("*").alias("f")).where("f >= 2")
        row = row.crossJoin(wide.agg(F.round(F.avg("f"), 1).alias("mean_features"))).select(F.lit(t).alias("threshold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(None)
def threshold_sensitivity(spark, sf):
    """The most frequent class at thresholds from 0 to 0.30, as far as two features are left."""
    found = T.user_days(spark, sf)
    focal = found.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(1).select("class")
    edges = cooccurrence.symmetric(cooccurrence.jaccard(found), "jaccard").withColumnRenamed("class_i", "class")
    grid = F.explode(F.array(*[F.lit(t) for t in _GRID])).alias("threshold")
    kept = edges.join(F.broadcast(focal), "class", "left_semi").select("class", "class_j", "jaccard", grid).where("jaccard >= threshold")
    cases = kept.select(F.concat("class", F.lit("@"), F.col("threshold").cast("string")).alias("focal_class"), "class", "threshold", F.col("class_j").alias("feature"))
    sizes = cases.groupBy("focal_class", "class", "threshold").agg(F.count("*").alias("n_features")).where("n_features >= 2")
    features = cases.join(sizes.select("focal_class"), "focal_class", "left_semi")
    fitted = cluster.fits(cluster.presence_patterns(found, features), [2, 3, 4, 5])
    best = cluster.argmax_silhouette(fitted.where("silhouette is not null"))
    return sizes.join(best, "focal_class").select("threshold", F.col("class").alias("focal_class"), "n_features", "best_k", F.round("silhouette", 4).alias("silhouette"))


# -- point clouds and detections -----------------------------------------------------

_PIX = """SELECT l_orderkey, l_linenumber, l_partkey % 730 AS u, l_suppkey % 530 AS v, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000 + l_linenumber END AS depth_raw,
    CASE WHEN l_partkey % 14 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000 END AS depth_filled FROM lineitem"""


@query(f"SELECT l_orderkey, l_linenumber, round(depth_raw / 10000.0, 4) AS depth_m, depth_raw = 0 AS is_hole, depth_raw = 0 AND depth_filled > 0 AS is_filled, round(CASE WHEN depth_raw = 0 THEN depth_filled / 10000.0 ELSE 0 END, 4) AS inpainted_m FROM ({_PIX})")
def depth_decode(spark, sf):
    return pointcloud.decode_depth(T.pixels(spark, sf)).select("l_orderkey", "l_linenumber", F.round("depth_m", 4).alias("depth_m"), "is_hole", "is_filled", F.round("inpainted_m", 4).alias("inpainted_m"))


@query(f"SELECT l_linenumber, count(*) AS n_pixels, round(count(*) FILTER (depth_raw <> 0) / CAST(count(*) AS DOUBLE), 6) AS valid, round(count(*) FILTER (depth_raw = 0) / CAST(count(*) AS DOUBLE), 6) AS holes, round(count(*) FILTER (depth_raw = 0 AND depth_filled > 0) / CAST(count(*) AS DOUBLE), 6) AS filled FROM ({_PIX}) GROUP BY l_linenumber")
def hole_mask_coverage(spark, sf):
    return pointcloud.coverage(pointcloud.decode_depth(T.pixels(spark, sf)), "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber, round((u - 365) * z / 529.5, 6) AS x, round(-((v - 265) * z / 529.5), 6) AS y, round(z, 6) AS z FROM (SELECT *, depth_raw / 10000.0 AS z FROM ({_PIX})) WHERE z > 0")
def back_projection(spark, sf):
    points = pointcloud.back_project(pointcloud.decode_depth(T.pixels(spark, sf)), 529.5, 529.5, 365.0, 265.0)
    return points.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


@query("SELECT l_shipdate, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE (r - 1) % 8 = 0")
def stride_sample(spark, sf):
    rows = T.read(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return pointcloud.stride_sample(rows, ["l_orderkey", "l_linenumber"], 8, ["l_shipdate"])


_VOX = "SELECT CAST(trunc(l_quantity / 5) AS BIGINT) AS vx, CAST(trunc(l_discount * 100 / 5) AS BIGINT) AS vy, CAST(trunc(l_tax * 100 / 5) AS BIGINT) AS vz, l_extendedprice FROM lineitem"


def _points(spark, sf):
    return T.read(spark, sf, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("dx"), (F.col("l_tax") * 100).alias("tx"), "l_extendedprice")


@query(f"SELECT vx, vy, vz, count(*) AS n, round(avg(l_extendedprice), 4) AS l_extendedprice FROM ({_VOX}) GROUP BY ALL")
def voxel_mean(spark, sf):
    return pointcloud.voxel_means(_points(spark, sf), ("l_quantity", "dx", "tx"), ["l_extendedprice"], 5.0)


@query(f", ".join(["WITH v AS (SELECT DISTINCT vx, vy, vz FROM (" + _VOX + "))", "m AS (SELECT greatest(max(vx), max(vy), max(vz)) + 1 AS m FROM v)"]) + " SELECT vx * m * m + vy * m + vz AS flat, (vx * m * m + vy * m + vz) // (m * m) AS vx, ((vx * m * m + vy * m + vz) % (m * m)) // m AS vy, (vx * m * m + vy * m + vz) % m AS vz FROM v, m")
def voxel_flat_key(spark, sf):
    v = pointcloud.voxel_means(_points(spark, sf), ("l_quantity", "dx", "tx"), [], 5.0).select("vx", "vy", "vz")
    m = v.agg((F.greatest(F.max("vx"), F.max("vy"), F.max("vz")) + 1).alias("m"))
    flat = v.crossJoin(F.broadcast(m)).select(pointcloud.flat_key(F.col("vx"), F.col("vy"), F.col("vz"), F.col("m")).alias("flat"), "m")
    return flat.select("flat", F.expr("flat div (m * m)").alias("vx"), F.expr("(flat % (m * m)) div m").alias("vy"), F.expr("flat % m").alias("vz"))


@query(f"SELECT DISTINCT CAST(l AS INTEGER) AS level, vx >> CAST(l AS BIGINT) AS vx, vy >> CAST(l AS BIGINT) AS vy, vz >> CAST(l AS BIGINT) AS vz FROM ({_VOX}), unnest(range(0, 4)) AS r(l)")
def voxel_levels(spark, sf):
    v = pointcloud.voxel_means(_points(spark, sf), ("l_quantity", "dx", "tx"), [], 5.0).select("vx", "vy", "vz")
    return pointcloud.coarser(v, 4)


@query("""WITH f AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings WHERE label > 0), d AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE label = 0)
    SELECT vec_id, round(f.x + d.x, 6) AS x FROM f JOIN d ON d.k = f.r % (SELECT count(*) FROM d)""")
def pyramid_merge(spark, sf):
    rows = T.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    merged = pointcloud.merge_levels(rows.where("label > 0").drop("label"), rows.where("label = 0").drop("label"), "vec_id", "x")
    return merged.select("vec_id", F.round("x", 6).alias("x"))


def _detections(spark, sf):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = T.read(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("batch"), *[(F.col("vec_id") % m).alias(v) for v, m in (("vx", 50), ("vy", 40), ("vz", 30))],
        *[e(i).alias(f"d{i}") for i in range(6)], F.transform(F.slice("embedding", 7, 10), lambda x: x.cast("double") * 10).alias("logits"),
    )
    return pointcloud.decode_boxes(rows)


@query("SELECT vec_id, round(vec_id % 50 * 0.02 + embedding[1], 5) AS cx, round(vec_id % 40 * 0.02 + embedding[2], 5) AS cy, round(vec_id % 30 * 0.02 + embedding[3], 5) AS cz, round(exp(CAST(embedding[4] AS DOUBLE)), 5) AS w, round(exp(CAST(embedding[5] AS DOUBLE)), 5) AS h, round(exp(CAST(embedding[6] AS DOUBLE)), 5) AS l FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def box_decode(spark, sf):
    return _detections(spark, sf).select("vec_id", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "cz", "w", "h", "l")])


_SCORED = "SELECT vec_id, label AS batch, list_transform(CAST(embedding[7:16] AS DOUBLE[]), lambda x: 1 / (1 + exp(-x * 10))) AS s FROM embeddings"


@query(f"SELECT vec_id, round(list_max(s), 6) AS score, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS label FROM ({_SCORED}) WHERE list_max(s) > 0.9")
def score_argmax_threshold(spark, sf):
    return pointcloud.score_labels(_detections(spark, sf), "logits").where("score > 0.9").select("vec_id", F.round("score", 6).alias("score"), "label")


@query(f"SELECT batch, count(*) AS n, CAST(greatest(1, count(*) // 20) AS BIGINT) AS kept FROM ({_SCORED}) WHERE list_max(s) > 0.01 GROUP BY batch")
def nms_simulated_count(spark, sf):
    rows = pointcloud.score_labels(_detections(spark, sf), "logits").where("score > 0.01")
    return rows.groupBy("batch").agg(F.count("*").alias("n")).withColumn("kept", pointcloud.simulated_survivors(F.col("n")))


@query(f"SELECT level, count(*) AS n FROM (SELECT list_position(s, list_max(s)) - 1 AS label FROM ({_SCORED})) JOIN (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(pointcloud.LABEL_TO_LEVEL))}) AS t(label, lv) USING (label), (SELECT 1) AS one(o), LATERAL (SELECT CAST(lv AS BIGINT) AS level) GROUP BY level")
def level_routing(spark, sf):
    rows = pointcloud.score_labels(_detections(spark, sf), "logits")
    return rows.join(F.broadcast(pointcloud.level_table(spark)), "label").groupBy("level").agg(F.count("*").alias("n"))


_GREEDY = f"""WITH RECURSIVE s AS ({_SCORED}),
    e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    b AS (SELECT vec_id, batch, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS label, list_max(s) AS score, vec_id % 50 * 0.02 + v[1] AS cx, vec_id % 40 * 0.02 + v[2] AS cy, vec_id % 30 * 0.02 + v[3] AS cz,
      exp(v[4]) AS w, exp(v[5]) AS h, exp(v[6]) AS l FROM s JOIN e USING (vec_id) WHERE list_max(s) > 0.01),
    o AS (SELECT *, row_number() OVER (PARTITION BY batch, label ORDER BY score DESC, cx, cy, cz) AS r,
      struct_pack(id := vec_id, x0 := cx - w / 2, x1 := cx + w / 2, y0 := cy - h / 2, y1 := cy + h / 2, z0 := cz - l / 2, z1 := cz + l / 2) AS box FROM b),
    fold AS (SELECT batch, label, CAST(1 AS BIGINT) AS r, [box] AS kept FROM o WHERE r = 1
      UNION ALL SELECT f.batch, f.label, o.r, CASE WHEN len(list_filter(f.kept, lambda k: {{both}} / greatest((k.x1 - k.x0) * (k.y1 - k.y0) * (k.z1 - k.z0) + (box.x1 - box.x0) * (box.y1 - box.y0) * (box.z1 - box.z0) - {{both}}, 1e-12) > 0.25)) > 0
        THEN f.kept ELSE list_append(f.kept, box) END FROM fold f JOIN o ON o.batch = f.batch AND o.label = f.label AND o.r = f.r + 1),
    last AS (SELECT batch, label, max_by(kept, r) AS kept FROM fold GROUP BY batch, label),
    k AS (SELECT batch, label, unnest(kept).id AS vec_id FROM last)
    SELECT vec_id, batch, label, round(score, 5) AS score, {{rounded}} FROM k JOIN b USING (vec_id, batch, label)""".format(
    both="(greatest(0, least(k.x1, box.x1) - greatest(k.x0, box.x0)) * greatest(0, least(k.y1, box.y1) - greatest(k.y0, box.y0)) * greatest(0, least(k.z1, box.z1) - greatest(k.z0, box.z0)))",
    rounded=", ".join(f"round({c}, 5) AS {c}" for c in ("cx", "cy", "cz", "w", "h", "l")),
)


@query(_GREEDY)
def nms_greedy(spark, sf):
    rows = pointcloud.score_labels(_detections(spark, sf), "logits").where("score > 0.01")
    kept = pointcloud.suppress(rows.select("vec_id", "batch", "label", "score", "cx", "cy", "cz", "w", "h", "l"), ["batch", "label"])
    return kept.select("vec_id", "batch", "label", *[F.round(c, 5).alias(c) for c in ("score", "cx", "cy", "cz", "w", "h", "l")])


_UNIT = "CAST('0x' || substr(md5('0/{}/' || id), 1, 8) AS BIGINT) / 4294967296.0"


@query("SELECT CAST(trunc(x / 0.02) AS BIGINT) AS vx, CAST(trunc(y / 0.02) AS BIGINT) AS vy, CAST(trunc(z / 0.02) AS BIGINT) AS vz, count(*) AS n, round(avg(r), 4) AS r, round(avg(g), 4) AS g, round(avg(b), 4) AS b FROM (SELECT "
    + ", ".join(f"{_UNIT.format(i)}{' * 6.0' if i < 3 else ''} AS {c}" for i, c in enumerate("xyzrgb")) + " FROM range(50000) AS t(id)) GROUP BY ALL")
def synthetic_voxels(spark, sf):
    return pointcloud.voxel_means(pointcloud.synthetic_cloud(spark), ("x", "y", "z"), ["r", "g", "b"])

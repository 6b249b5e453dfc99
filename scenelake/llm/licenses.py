"""License scans with DataFrame functions only.

Each file gives units: its whole text, and each of its lines (its headers). A
unit and a template are vectors of words: ``1 + ln(times)`` by the inverse
document frequency over all lines; their likeness is the cosine. A unit belongs
to the likest template from ``THRESHOLD`` up. A file whose whole text does, or
whose name is that of a licence file and one of whose lines does, is a licence
file and speaks for its directory. A file's licence is that of its own likest
unit; a file without one inherits from the nearest directory above it that has
one.

Words that no template holds have no document frequency of their own; they weigh
as words never seen. One reading of the texts gives the lines that hold each word
of the templates. With these counts, a file is looked at again if it holds so much
of a template's weight as the threshold takes; so is each of its units, if its words
of templates could outweigh the others by then.

Licence texts and standard headers (``license_texts``) are templates too. Files
that could hold one, or a notice, are also cut into windows of ``SIZES``
consecutive lines with words. Texts are compared with lines, windows and the
whole text, notices with windows. These weights count the words of texts and
notices alike; a window speaks for its directory as a line does.

Defined results:
- null and empty texts have no units, and inherit;
- a null path has no directory and inherits nothing;
- ties go to the first template by name, and to the first licence file by path;
- rows that repeat a path are each scanned, and stand as one file by their best;
- an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import os
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, small

THRESHOLD = 0.6

# Short notices of well-known licences.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Files whose windows are one task's work.
FILES = 200
#: Lines of a window.
SIZES = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
#: Names of licence files, without regard to case.
FILE_NAMES = r"(?i)^(un)?licen[cs]e([-._].*)?$|^copying([-._].*)?$|^notice([-._].*)?$"


def _words(text):
    """The words of a text, with repeats."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _among(words: str, vocabulary: list[str]):
    """The words of an array that are in a vocabulary, as an expression; the names of words have no quotes."""
    listed = ", ".join(f"'{w}'" for w in vocabulary)
    return F.expr(f"filter({words}, w -> w in ({listed}))")


def license_texts() -> tuple[tuple[str, str], ...]:
    """Names and texts of the licences and headers in the folder of texts."""
    found = []
    for file in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, file), encoding="utf-8") as f:
            found.append((file.removesuffix(".txt").removesuffix(".header"), f.read()))
    return tuple(found)


class Templates:
    """Notices and texts: how often they hold their words, by the expression that cuts files into words."""

    def __init__(self, spark: SparkSession, notices, texts):
        listed = [(i, name, i < len(notices), text) for i, (name, text) in enumerate((*notices, *texts))]
        known = spark.createDataFrame(listed, "id int, name string, notice boolean, text string")
        known = known.select("id", "name", "notice", _words("text").alias("words")).collect()
        self.known = [(r.id, r.name, r.notice, Counter(r.words)) for r in known]
        self.vocabulary = sorted({w for *_, words in self.known for w in words})
        self.of_notices = sorted({w for _, _, notice, words in self.known if notice for w in words})


def _likely(vocabulary: list[str], w2: dict[str, float], unseen2: float, threshold: float) -> str:
    """Whether an array of words ``x`` could reach the threshold, as an SQL expression.

    Its words of the vocabulary, the rare and the common ones apart, weigh most
    if each comes as often as the other (``(1 + ln n)^2`` is concave), the others
    least if each comes once; they must hold the square of the threshold of all.
    """
    rare = [w for w in vocabulary if w2[w] * 8 > unseen2]
    common = [w for w in vocabulary if w2[w] * 8 <= unseen2]
    top = lambda words: max((w2[w] for w in words), default=0.0)
    among = lambda words: "w in (" + ", ".join(f"'{w}'" for w in words) + ")" if words else "false"
    most = lambda c, words: f"{top(words)}D * if(size({c}) = 0, 0D, size(array_distinct({c})) * power(1 + ln(size({c}) / size(array_distinct({c}))), 2))"
    held = f"({most('s.r', rare)} + {most('s.c', common)})"
    parts = f"filter(x, w -> {among(rare)}) as r, filter(x, w -> {among(common)}) as c, array_distinct(filter(x, w -> not ({among(vocabulary)}))) as o"
    return f"exists(array(struct({parts})), s -> {held} > 0 and {held} >= {threshold * threshold}D * ({held} + size(s.o) * {unseen2}D) - 1e-6)"


def _held(rows: DataFrame, templates: Templates) -> DataFrame:
    """What a single reading of the texts gives for each file.

    ``path``, ``th`` (hash of the text), ``total`` (lines with words) and ``seen``
    (the templates' words, once for each line that holds them).
    """
    keyed = rows.where("text is not null").select("path", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("cut"))
    lines = F.transform("cut", lambda x: F.array_distinct(_words(x)))
    # No condition stands on the lines, as it would be pushed below and cut the text twice.
    keyed = keyed.select("path", "th", lines.alias("lines"))
    total = F.size(F.filter("lines", lambda x: F.size(x) > 0)).cast("long")
    keyed = keyed.select("path", "th", total.alias("total"), F.flatten("lines").alias("flat"))
    return keyed.select("path", "th", "total", _among("flat", templates.vocabulary).alias("seen"))


def _square(total: int, n: int) -> float:
    """The squared inverse document frequency of a word that ``n`` of ``total`` lines hold."""
    return (math.log((1 + total) / (1 + n)) + 1) ** 2


def _times(n: int) -> float:
    """The weight of a word that a unit holds ``n`` times, before its document frequency."""
    return 1 + math.log(n)


def _best(spark: SparkSession, units: DataFrame, templates: list[tuple], w2: dict[str, float], unseen2: float, threshold: float) -> DataFrame:
    """``unit`` and ``best`` of the units that are like a template.

    ``units``: ``unit`` (a key of what follows), ``kind`` and ``words``. Equal units are scored once.
    """
    sets = units.groupBy("unit").agg(F.first("kind").alias("kind"), F.first("words").alias("words"))
    counted = sets.select("unit", "kind", F.explode("words").alias("term")).groupBy("unit", "kind", "term")
    counted = counted.agg((1 + F.log(F.count("*"))).alias("times"))
    idf = F.broadcast(spark.createDataFrame(sorted(w2.items()), "term string, w2 double"))
    weighed = counted.join(idf, "term", "left")
    square = F.col("times") * F.col("times") * F.coalesce("w2", F.lit(unseen2))
    norms = weighed.groupBy("unit").agg(F.sum(square).alias("norm2"), F.count("*").alias("n"))
    terms = []
    for i, name, notice, words in templates:
        squares = [_times(n) ** 2 * w2[w] for w, n in words.items()]
        # A unit holds the square of the threshold of the template's weight, so as many words as that takes.
        least = threshold * threshold * sum(squares) / max(squares, default=1.0) - 1e-6
        terms += [(i, name, notice, sum(squares), least, w, _times(n)) for w, n in words.items()]
    terms = spark.createDataFrame(terms, "id int, name string, notice boolean, template2 double, least double, term string, t_times double")
    # Lines and whole texts have met the notices by themselves.
    pairs = weighed.where("w2 is not null").join(norms, "unit").join(F.broadcast(terms), "term")
    pairs = pairs.where((F.col("n") >= F.col("least")) & (~F.col("notice") | F.col("kind").isin("window", "notice", "notice-whole")))
    dots = pairs.groupBy("unit", "id", "name", "norm2", "template2").agg(F.sum(F.col("times") * F.col("t_times") * F.col("w2")).alias("dot"))
    score = F.round(F.col("dot") / F.sqrt(F.col("norm2") * F.col("template2")), 6)
    best = dots.withColumn("score", score).where(F.col("score") >= threshold)
    return best.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("back"), "name")).alias("best"))


def _chosen(rows: DataFrame, held: DataFrame, templates: Templates, w2: dict[str, float], threshold: float) -> DataFrame:
    """``path`` and ``lines`` (arrays of words) of the files that hold enough of a template, each text of a path once."""
    spark = rows.sparkSession
    # A file must hold the square of the threshold of a template's weight, so half of that in the heavier words.
    heavy = []
    for i, _, _, words in templates.known:
        square = {w: _times(n) ** 2 * w2[w] for w, n in words.items()}
        half, light = threshold * threshold * sum(square.values()) / 2, 0.0
        for w in sorted(words, key=lambda w: (square[w], w)):
            light += square[w]
            if light > half:
                heavy.append((w, i, square[w], half))
    heavy = spark.createDataFrame(heavy, "term string, id int, w2 double, half double")
    shared = held.select("path", "th", F.explode(F.array_distinct("seen")).alias("term")).join(F.broadcast(heavy), "term")
    shared = shared.groupBy("path", "th", "id").agg(F.sum("w2").alias("w2"), F.first("half").alias("half"))
    likely = materialize(shared.where("w2 >= half - 1e-6").select("path", "th").distinct(), "license-files")
    keyed = rows.where("text is not null").withColumn("th", F.xxhash64("text"))
    kept = keyed.alias("k").join(small(likely).alias("l"), F.expr("k.path <=> l.path and k.th = l.th"), "left_semi")
    lines = F.filter(F.transform(F.split("text", "\n"), _words), lambda x: F.size(x) > 0)
    return materialize(kept.dropDuplicates(["path", "th"]).select("path", lines.alias("lines")), "license-lines")


def _units(chosen: DataFrame, groups: list, likely: str) -> DataFrame:
    """``path``, ``kind``, ``words`` and ``unit`` (a key of these two) of the units that could reach the threshold."""
    units = chosen.select("path", F.explode(F.concat(*groups)).alias("u")).select("path", "u.kind", F.col("u.words").alias("x"))
    units = units.where(F.expr(likely)).withColumnRenamed("x", "words")
    return units.withColumn("unit", F.xxhash64("kind", F.array_sort("words")))


def scan(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
    texts=None,
) -> DataFrame:
    """``path``, ``own_license``, ``own_score``, ``license`` and ``from_dir`` (null unless inherited), one row for each path."""
    spark = files.sparkSession
    known = Templates(spark, templates, license_texts() if texts is None else texts)
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    unit = lambda words, kind: F.struct(words.alias("words"), F.lit(kind).alias("kind"))
    single = lambda kinds: [F.transform("lines", lambda x: unit(x, kinds[0])), F.array(unit(F.flatten("lines"), kinds[1]))]
    none = F.expr("cast(array() as array<struct<words:array<string>,kind:string>>)")
    windows = []
    for size in SIZES:
        starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - size + 1, F.lit(1)))
        of_size = F.transform(starts, lambda i: unit(F.flatten(F.slice("lines", i, size)), "window"))  # noqa: B023
        windows.append(F.when(F.size("lines") >= size, of_size).otherwise(none))
    with scratch():
        held = materialize(_held(rows, known), "license-words")
        total = held.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        # A row for each term of the templates.
        counts = {r.term: r["count"] for r in held.select(F.explode("seen").alias("term")).groupBy("term").count().collect()}
        w2 = {w: _square(total, counts.get(w, 0)) for w in known.vocabulary}
        unseen2 = _square(total, 0)
        chosen = _chosen(rows, held, known, w2, threshold)
        dealt = chosen.repartition(max(1, chosen.count() // FILES))
        # Lines and whole texts meet the notices under the weights of the notices' words alone.
        of_notices = {w: w2[w] for w in known.of_notices}
        own = materialize(_units(dealt, single(("notice", "notice-whole")), _likely(known.of_notices, w2, unseen2, threshold)), "license-units")
        best = _best(spark, own, [t for t in known.known if t[2]], of_notices, unseen2, threshold)
        found = own.join(best, "unit")
        wide = materialize(_units(dealt, [*single(("line", "whole")), *windows], _likely(known.vocabulary, w2, unseen2, threshold)), "license-windows")
        best = _best(spark, wide, known.known, w2, unseen2, threshold)
        found = found.unionByName(wide.join(best, "unit")).select("path", F.col("kind").endswith("whole").alias("whole"), "best")
        own = found.groupBy("path").agg(F.min("best").alias("own"), F.max("whole").alias("whole"))
        own = materialize(own, "license-own", keep=True)
    everyone = rows.select("path").distinct()
    everyone = everyone.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), ""))
    return _inherit(everyone, own)


def _inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """Give files without a licence that of the nearest directory above."""
    speaks = own.where(F.col("whole") | F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAMES))
    speaks = speaks.where("path is not null").withColumn(
        "dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    )
    of_dir = speaks.groupBy("dir").agg(F.min(F.struct("path", F.col("own.name").alias("name"))).alias("said"))
    of_dir = of_dir.select(F.col("dir").alias("above"), F.col("said.name").alias("dir_license"))
    # Every directory with the directories above it, itself first.
    dirs = files.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select(
        "dir",
        F.posexplode(
            F.concat(
                F.array(F.lit("")),
                F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(
                    F.transform(parts, lambda x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
                ),
            )
        ).alias("depth", "above"),
    )
    nearest = (
        above.join(of_dir, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("near"))
    )
    out = files.join(own.select(F.col("path").alias("own_path"), "own"), F.expr("path <=> own_path"), "left")
    out = out.join(nearest, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "path",
        F.col("own.name").alias("own_license"),
        (-F.col("own.back")).alias("own_score"),
        F.when(has, F.col("own.name")).otherwise(F.col("near.dir_license")).alias("license"),
        F.when(~has, F.col("near.above")).alias("from_dir"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the licence of every whole document, whose path is source/lang/id."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = scan(documents.select(path.alias("path"), "text"))
    return found.select(
        F.expr("try_cast(substring_index(path, '/', -1) as long)").alias("doc_id"), "path",
        "own_license",
        "own_score",
        "license",
        "from_dir",
    )


_VALUES = ", ".join(f"('{name}', '{notice}')" for name, notice in TEMPLATES)
OP10_SQL = (
    r"""
WITH templates(name, notice) AS (VALUES """
    + _VALUES
    + r"""),
terms AS (
  SELECT name, unnest(string_split_regex(lower(notice), '[^\p{L}\p{N}]+')) AS term FROM templates),
real_terms AS (SELECT name, term, 1 + ln(count(*)) AS times FROM terms WHERE term <> '' GROUP BY ALL),
files AS (
  SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || doc_id AS path,
    coalesce(source, '-') || '/' || coalesce(lang, '-') AS dir, coalesce(source, '-') AS up, text FROM documents),
units AS (
  SELECT row_number() OVER () AS unit, path, whole, w FROM (
    SELECT path, whole, list_filter(string_split_regex(lower(u), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM (
      SELECT path, false AS whole, unnest(string_split(text, chr(10))) AS u FROM files
      UNION ALL SELECT path, true, text FROM files WHERE text IS NOT NULL))
  WHERE len(w) > 0),
unit_words AS (SELECT unit, term, 1 + ln(count(*)) AS times FROM (SELECT unit, unnest(w) AS term FROM units) GROUP BY ALL),
totals AS (SELECT count(*) AS n FROM units WHERE NOT whole),
df AS (
  SELECT t.term, count(u.unit) AS df FROM (SELECT DISTINCT term FROM real_terms) AS t
  LEFT JOIN (SELECT x.unit, x.term FROM unit_words AS x JOIN units USING (unit) WHERE NOT whole) AS u USING (term) GROUP BY t.term),
idf AS (SELECT term, power(ln((1.0 + n) / (1.0 + df)) + 1, 2) AS w2 FROM df, totals),
unseen AS (SELECT power(ln(1.0 + n) + 1, 2) AS w2 FROM totals),
norms AS (
  SELECT x.unit, sum(times * times * coalesce(i.w2, unseen.w2)) AS norm2 FROM unit_words AS x LEFT JOIN idf AS i USING (term), unseen GROUP BY x.unit),
template_norms AS (SELECT name, sum(times * times * w2) AS template2 FROM real_terms JOIN idf USING (term) GROUP BY name),
dots AS (
  SELECT x.unit, t.name, sum(x.times * t.times * i.w2) AS dot FROM unit_words AS x JOIN real_terms AS t USING (term) JOIN idf AS i USING (term) GROUP BY x.unit, t.name),
scored AS (
  SELECT unit, name, round(dot / sqrt(norm2 * template2), 6) AS score FROM dots JOIN norms USING (unit) JOIN template_norms USING (name)),
own AS (
  SELECT path, name, score, bool_or(whole) OVER (PARTITION BY path) AS whole,
    row_number() OVER (PARTITION BY path ORDER BY score DESC, name) AS r
  FROM scored JOIN units USING (unit) WHERE score >= 0.6),
best AS (SELECT path, name, score, whole FROM own WHERE r = 1),
of_dir AS (
  SELECT dir, arg_min(name, path) AS name FROM best JOIN files USING (path) WHERE whole GROUP BY dir)
SELECT f.doc_id, f.path, b.name AS own_license, b.score AS own_score, coalesce(b.name, d.name) AS license,
  CASE WHEN b.name IS NULL AND d.name IS NOT NULL THEN f.dir END AS from_dir
FROM files AS f LEFT JOIN best AS b USING (path) LEFT JOIN of_dir AS d USING (dir)
"""
)

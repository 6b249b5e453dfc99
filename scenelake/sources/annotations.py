"""Readers of annotated-scene folders, and of tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import normalise, without_suffix
from ..operators.spatial import OBJECTS

CLASSES_CSV = "rank int, class string, scene_frequency bigint, pct_of_scenes double"


def scene_path(file_path: Column, levels: int) -> Column:
    """The folder ``levels`` above a file."""
    parts = F.split(file_path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - levels), "/")


def scene_name(path: Column) -> Column:
    """The last part of a folder; not unique, so never a join key by itself."""
    return F.substring_index(path, "/", -1)


def text_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``file_path`` and ``value`` of all files of one name below a folder."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    return files.select(F.col("_metadata.file_path").alias("file_path"), "value")


def documents(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """``scene_path``, ``scene_name``, ``value`` and ``v`` (null if malformed) of ``<scene>/<folder>/index.json``."""
    files = text_files(spark, root, "index.json").where(F.col("file_path").endswith(f"/{folder}/index.json"))
    path = scene_path(F.col("file_path"), 2)
    return files.select(
        path.alias("scene_path"), scene_name(path).alias("scene_name"), "value", F.try_parse_json("value").alias("v")
    )


def counters(read: DataFrame) -> DataFrame:
    """Parsed files, parse errors, and parsed files without objects."""
    objects = F.try_variant_get("v", "$.objects", "array<variant>")
    return read.agg(
        F.count_if(F.col("v").isNotNull()).alias("n_parsed"),
        F.count_if(F.col("v").isNull()).alias("n_errors"),
        F.count_if(F.col("v").isNotNull() & (F.coalesce(F.size(objects), F.lit(0)) <= 0)).alias("n_empty"),
    )


def names_2d(read: DataFrame) -> DataFrame:
    """``scene_path`` and canonical ``class`` of each named object; names that are no text are skipped."""
    objects = F.explode(F.try_variant_get("v", "$.objects", "array<variant>")).alias("o")
    name = F.try_variant_get("o", "$.name", "variant")
    rows = read.where("v is not null").select("scene_path", objects).where("o is not null")
    rows = rows.where(F.schema_of_variant(name) == "STRING")
    raw = F.try_variant_get("o", "$.name", "string")
    return rows.where(F.regexp_replace(raw, r"(?U)\s", "") != "").select("scene_path", normalise(raw).alias("class"))


def join_layouts(main: DataFrame, layout: DataFrame) -> DataFrame:
    """``scene``, ``scene_path``, ``annotation`` and ``layout`` of parsed files (``scene_path``, ``value``, ``v``)."""
    typed = lambda d: d.where("v is not null").select("scene_path", F.from_json("value", OBJECTS).alias("x"))
    rows = typed(main).withColumnRenamed("x", "annotation").join(typed(layout).withColumnRenamed("x", "layout"), "scene_path", "left")
    return rows.select(scene_name(F.col("scene_path")).alias("scene"), "scene_path", "annotation", "layout")


def scenes_3d(spark: SparkSession, root: str) -> DataFrame:
    """``scene`` (folder name), ``scene_path``, ``annotation`` and ``layout`` (null if missing or malformed)."""
    return join_layouts(documents(spark, root, "annotation3Dfinal"), documents(spark, root, "annotation3Dlayout"))


def category_3d(raw: Column) -> Column:
    """The canonical label of a 3-D name, less what follows a colon."""
    return normalise(without_suffix(raw))


def with_labels(scenes: DataFrame, files: DataFrame) -> DataFrame:
    """``scene_path`` and ``scene_type`` of ``scenes`` by label files (``scene_path``, ``value``); "unknown" without one."""
    label = F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("t")
    joined = scenes.select("scene_path").join(files.select("scene_path", label), "scene_path", "left")
    return joined.select("scene_path", F.coalesce("t", F.lit("unknown")).alias("scene_type"), F.col("t").isNull().alias("missing"))


def scene_labels(spark: SparkSession, root: str, scenes: DataFrame) -> DataFrame:
    """``scene_path`` and ``scene_type`` of ``scenes``; "unknown" where there is no label file."""
    files = text_files(spark, root, "scene.txt").select(scene_path(F.col("file_path"), 1).alias("scene_path"), "value")
    return with_labels(scenes, files).drop("missing")


def missing_labels(labelled: DataFrame) -> DataFrame:
    """Scenes of each type, and how many of them had no label file."""
    return labelled.groupBy("scene_type").agg(F.count("*").alias("n_scenes"), F.count_if("missing").alias("n_missing"))


def last_path_by_name(scenes: DataFrame) -> DataFrame:
    """One folder for each scene name, the last by path."""
    return scenes.groupBy(scene_name(F.col("scene_path")).alias("scene")).agg(F.max("scene_path").alias("scene_path"))


def parse_intrinsics(files: DataFrame) -> DataFrame:
    """``scene_path``, ``fx``, ``cx``, ``fy``, ``cy`` of ``scene_path`` and the text ``value``."""
    v = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    at = lambda i: F.get(v, F.lit(i)).cast("double")
    return files.select("scene_path", at(0).alias("fx"), at(2).alias("cx"), at(4).alias("fy"), at(5).alias("cy"))


def intrinsics(spark: SparkSession, root: str) -> DataFrame:
    """The parsed ``intrinsics.txt`` of every scene."""
    files = text_files(spark, root, "intrinsics.txt")
    return parse_intrinsics(files.select(scene_path(F.col("file_path"), 1).alias("scene_path"), "value"))


def csv(spark: SparkSession, path: str, schema: str = CLASSES_CSV) -> DataFrame:
    """A CSV file with a header and a stated schema."""
    return spark.read.csv(path, header=True, schema=schema)


def matrix_csv(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """A labelled square matrix as ``class_i``, ``class_j`` and its value."""
    wide = spark.read.csv(path, header=True)
    first, *rest = wide.columns
    return wide.withColumnRenamed(first, "class_i").unpivot("class_i", rest, "class_j", value).withColumn(
        value, F.col(value).cast("double")
    )

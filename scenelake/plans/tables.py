"""The test tables as inputs of the operators.

A scene is an order, its classes the brands of its parts, its type the order's
priority; a room is a label of the embeddings, an object one embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.presence import presence


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene``, ``class``: order and brand."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return presence(items.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene``, ``scene_type``: order and priority."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_orderpriority").alias("scene_type"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene``, ``class``: a user's day and the types of its events."""
    day = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return presence(read(spark, sf_dir, "events").withColumn("scene", day), "scene", "event_type")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with centre (x, y, z), extents (w, h, d), and their room."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", "label", e(0).alias("x"), e(1).alias("y"), e(2).alias("z"),
        F.abs(e(3)).alias("w"), F.abs(e(4)).alias("h"), F.abs(e(5)).alias("d"),
    )


def rooms(found: DataFrame) -> DataFrame:
    """Each label's rectangle as a polygon, and its floor."""
    box = found.groupBy("label").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.max("y").alias("floor_y")
    )
    return box.withColumn("xs", F.array("x0", "x1", "x1", "x0")).withColumn("zs", F.array("z0", "z0", "z1", "z1"))


def vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """``id``, ``label``, ``v``."""
    v = F.transform(F.slice("embedding", 1, dims), lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", v.alias("v"))


def pixels(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Depth pixels made of line items: u, v, raw and filled depth, and columns ``more``."""
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *more,
        (F.col("l_partkey") % 730).alias("u"),
        (F.col("l_suppkey") % 530).alias("v"),
        F.when(F.col("l_partkey") % 7 == 0, 0).otherwise(F.col("l_quantity").cast("long") * 1000 + F.col("l_linenumber")).cast("long").alias("depth_raw"),
        F.when(F.col("l_partkey") % 14 == 0, 0).otherwise(F.col("l_quantity").cast("long") * 1000).cast("long").alias("depth_filled"),
    )

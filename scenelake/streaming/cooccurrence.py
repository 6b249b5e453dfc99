"""Co-occurrence kept up to date from a stream: classes held by scene, pair deltas, sums.

Of each batch the classes that are new to their scenes are kept, a folder a batch, with
those that the scene held before; they give a delta for each new class and for each
pair that it completes. So repeated rows add nothing, and late rows are rows like any
other, as nothing kept has a time. Deltas are summed before they are written, a folder
a batch as well, and a batch that runs again reads the batches before it and replaces
its own folders; frequencies and pairs are the sums of the folders.

A batch joins its scenes with all that is held, by a shuffle that spills where memory
ends; so batches should not be much smaller than what a scan of the held classes is worth.

Defined results:
- rows with a null scene or class are left out;
- what is kept of a scene grows with its classes, not with its rows;
- no batch, or batches without new classes, give no rows or no deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A class alone has no partner: ``class_j`` is null.
DELTAS = "class_i string, class_j string, n long"
#: A scene's classes before a batch and those that the batch added.
HELD = "scene {}, old array<string>, fresh array<string>, batch long"


def grown(batch: DataFrame, held: DataFrame | None) -> DataFrame:
    """``scene``, ``old`` and ``fresh`` classes of the scenes to which a batch of ``scene`` and ``class`` adds classes.

    ``held``: ``scene`` and ``class`` of the batches before.
    """
    rows = batch.where("scene is not null and class is not null")
    sets = rows.groupBy("scene").agg(F.collect_set(F.col("class").cast("string")).alias("now"))
    if held is None:
        return sets.select("scene", F.array().cast("array<string>").alias("old"), F.sort_array("now").alias("fresh"))
    before = held.groupBy("scene").agg(F.collect_set("class").alias("had"))
    old = F.coalesce("had", F.array().cast("array<string>"))
    both = sets.join(before, "scene", "left").select("scene", old.alias("old"), F.sort_array(F.array_except("now", old)).alias("fresh"))
    return both.where(F.size("fresh") > 0)


def deltas(added: DataFrame) -> DataFrame:
    """The summed deltas of the rows of :func:`grown`."""
    cell = lambda x, y: F.struct(x.alias("class_i"), y.alias("class_j"))
    alone = F.transform("fresh", lambda x: cell(x, F.lit(None).cast("string")))
    known = F.flatten(F.transform("fresh", lambda x: F.transform("old", lambda y: cell(F.least(x, y), F.greatest(x, y)))))
    new = F.flatten(F.transform("fresh", lambda x: F.transform(F.filter("fresh", lambda y: x < y), lambda y: cell(x, y))))
    return added.select(F.inline(F.concat(alone, known, new))).groupBy("class_i", "class_j").agg(F.count("*").alias("n"))


def keep_counts(stream: DataFrame, folder: str, **trigger):
    """Start a query that adds each batch's classes under ``folder``/held and its deltas under ``folder``/deltas; its checkpoint is in ``folder``/state."""
    kept = HELD.format(stream.schema["scene"].dataType.simpleString())

    def add(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read.schema(kept)
        held = read.parquet(f"{folder}/held").where(F.col("batch") < number).select("scene", F.explode("fresh").alias("class")) if number else None
        grown(batch, held).write.mode("overwrite").parquet(f"{folder}/held/batch={number}")
        added = read.parquet(f"{folder}/held").where(F.col("batch") == number)
        deltas(added).write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")

    writer = stream.writeStream.foreachBatch(add).outputMode("append")
    return writer.option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start()


def counts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Frequencies (``class``, ``f``) and pairs (``class_i``, ``class_j``, ``n``) so far."""
    deltas = spark.read.schema(DELTAS + ", batch long").parquet(f"{folder}/deltas")
    summed = deltas.groupBy("class_i", "class_j").agg(F.sum("n").alias("n"))
    alone = summed.where("class_j is null").select(F.col("class_i").alias("class"), F.col("n").alias("f"))
    return alone, summed.where("class_j is not null")

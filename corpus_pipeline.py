"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Toxic documents go; of passages that repeat, the first document keeps the lines;
of each group of near copies the document with the least id stays; documents
that hold a benchmark window go; what is left is encoded and decoded.

Defined results:
- all columns of the documents go through all stages but the last, whatever
  their names; the last gives ``doc_id``, ``lang``, ``source``, ``token_ids`` and
  the digests, and leaves ``n_chars`` and further columns out;
- null and empty texts are neither toxic, repeated, copies nor contaminated, and
  are encoded as no token;
- a null id is an id like any other in the first two stages; a row with a null id
  never stands for a group of copies that has another id;
- rows that repeat an id and a text are one document: the first of them in the
  order of their other columns as JSON stays; rows that share an id with
  different texts are documents of their own, in one group the first by a hash of
  its text;
- an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import bpe, decontamination, jaccard, lines, toxicity
from scenelake.llm.common import discard, materialize, scratch, small


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a model trained on the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later runs of repeated lines.

    ``n_chars`` follows the text. A document of which no line with a word is
    left, as all of them stand in earlier documents, goes.
    """
    kept = lines.dedup_lines(docs, added=("__lines", "__removed"))
    kept = kept.where((F.col("__removed") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    changed = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the least id."""
    # Rows are told apart by id and text; null ids come last, as they stand for no other.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.withColumn("__key", key)
    found = jaccard.components(keyed, "__key")
    stays = F.max(F.col("__key").eqNullSafe(F.col("component_id"))).alias("__stays")
    ids = found.groupBy(F.col("__key").alias("__id")).agg(stays, (F.count("*") > 1).alias("__twice"))
    ids = materialize(ids.where("not __stays or __twice"), "pipeline-copies")
    named = F.col("__key") == F.col("__id")
    kept = keyed.join(small(ids), named, "left_anti").select(*docs.columns)
    twice = ids.where("__stays")
    if not twice.isEmpty():
        kept = kept.unionByName(_one_of_each(keyed.join(small(twice), named, "left_semi").select(*docs.columns)))
    return kept


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Of the rows that repeat an id and a text, the first by their other columns as JSON."""
    others = F.struct(*[c for c in rows.columns if c not in ("doc_id", "text")], F.lit(1).alias("__one"))
    first = rows.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias("__rest"))
    return first.select("doc_id", "text", "__rest.*").select(*rows.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, ["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The toxicity model is no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents table; the tables between go when they have been read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", keep=True)
        discard(docs)
        docs = after
    return docs

"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from training; false for a null id."""
    return F.coalesce(crc_mod(id_col, modulus) == remainder, F.lit(False))


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label_col: str,
    modulus: int,
    remainder: int,
    bound: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = (),
) -> DataFrame:
    """``text``, ``label``, ``fold`` (0 or 1) and ``meta`` (doubles) of the training rows.

    They belong to at most ``bound`` labels outside the held-out fold.

    The labels are taken in the order of a hash of their id, so the sample is
    the same however the tables are partitioned. At most ``bound`` ids are
    broadcast. Rows with a null id or label are no training rows.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
        .where("__id is not null and label in (0, 1)")
        .where(~held_out("__id", modulus, remainder))
        .orderBy(F.xxhash64("__id"), "__id", "label")
        .limit(bound)
    )
    rows = documents.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.array(*[F.col(c).cast("double") for c in meta_cols]).cast("array<double>").alias("meta"),
    )
    return rows.join(F.broadcast(chosen), "__id").select(
        "text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "meta"
    )

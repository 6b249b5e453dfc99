"""Label canonicalisation as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical labels and their variants.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "sofa": ("couch", "sofachair", "sofas", "couches"),
    "chair": ("armchair", "chairs"),
    "shelf": ("shelves", "bookshelf", "bookshelves", "shelve", "bookshelve"),
    "counter": ("countertop", "countertops"),
    "desk": ("desktable",),
    "cabinet": ("cupboard", "cupboards", "cabinets", "filingcabinet", "filecabinet", "storagecabinet"),
    "monitor": ("computermonitor", "pcmonitor", "monitors"),
    "pillow": ("pillows", "cushion", "cushions", "throwpillow", "throwpillows"),
    "curtain": ("curtains", "windowcurtain"),
    "book": ("books",),
    "lamp": ("tablelamp", "desklamp", "floorlamp", "nightlamp", "walllamp"),
    "window": ("windows",),
    "blinds": ("blind", "windowblinds", "windowblind"),
    "bottle": ("bottles",),
    "bag": ("bags",),
    "mirror": ("mirrors",),
    "door": ("doors",),
    "table": ("tables",),
    "bed": ("beds",),
    "box": ("boxes",),
}


def synonym_rows(synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> list[tuple[str, str]]:
    """(variant, canonical) pairs; a canonical label is a variant of itself."""
    return [(v, c) for c, variants in synonyms.items() for v in (c, *variants)]


def synonym_table(spark: SparkSession, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """The synonyms as a dimension table."""
    return spark.createDataFrame(synonym_rows(synonyms), "variant string, canonical string")


def strip_unicode(label: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(label, r"(?U)^\s+|\s+$", "")


def without_suffix(label: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(label, ":", 1)


def digit_base(label: Column) -> Column:
    """The label without its trailing digits; empty where there are none to strip."""
    return F.regexp_extract(label, r"(?Us)^(.+?)\d+$", 1)


def normalise(label: Column, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> Column:
    """Trim and lower, map synonyms, else strip trailing digits and map again."""
    name = F.lower(strip_unicode(label))
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(synonym_rows(synonyms))])
    base = digit_base(name)
    found = F.try_element_at(table, name)
    return F.coalesce(found, F.when(base != "", F.coalesce(F.try_element_at(table, base), base)), name)


def stage_title(index: Column, name: Column) -> Column:
    """``Stage i – Name`` with underscores as spaces."""
    return F.concat(F.lit("Stage "), index.cast("string"), F.lit(" – "), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def split_set(joined: Column) -> Column:
    """The parts of a ``|``-joined list; none for null or empty text."""
    return F.when(F.coalesce(joined, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(joined, r"\|"))
    )


def compatible(text: Column) -> Column:
    """Compatibility decomposition (NFKD), for the text of reports; no built-in function does it."""
    import pandas as pd

    def decompose(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKD")

    return F.pandas_udf(decompose, "string")(text)


def fold_dashes(text: Column) -> Column:
    """Unicode dashes as hyphens, runs of them as one."""
    return F.regexp_replace(F.translate(text, "‐‑‒–—―−", "-------"), "-+", "-")


def two_decimals(value: Column) -> Column:
    """A number with two decimals, N/A for null."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.2f", F.round(value, 2)))


def thousands(value: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(value, 0)


def signed(value: Column) -> Column:
    """A number with its sign and four decimals."""
    return F.format_string("%+.4f", F.round(value, 4))


def percent(share: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.concat(F.format_string("%.1f", F.round(share * 100, 1)), F.lit("%"))

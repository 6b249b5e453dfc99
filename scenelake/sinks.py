"""Writers of result tables and of small text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` gives one file, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def square_matrix(cells: DataFrame, value: str, classes: list[str], digits: int | None = None) -> DataFrame:
    """Long cells (``class_i``, ``class_j``, value) as one column for each class, in the given order."""
    cell = F.first(value) if digits is None else F.round(F.first(value), digits)
    wide = cells.where(F.col("class_i").isin(classes)).groupBy("class_i").pivot("class_j", classes).agg(cell)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class_i"))
    return wide.fillna(0, classes).orderBy(place)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; ``limit`` bounds what the driver takes."""
    rows = df.limit(limit).collect()
    text = lambda x: "N/A" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(text, r)) + " |" for r in rows])


def report(title: str, sections: list[tuple[str, DataFrame]]) -> str:
    """A Markdown report of titled tables."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections)]) + "\n"


def stamped(checks: DataFrame) -> DataFrame:
    """Check rows with the time of the run as their first column."""
    return checks.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("run_timestamp"), "*")

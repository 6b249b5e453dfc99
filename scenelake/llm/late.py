"""Late arrivals into day partitions: deletion vectors, and rewriting of the days they touch.

A layout holds one row of each id, the latest to arrive, as Parquet files of a
stated number of rows under ``day=D/file_no=F``; the rows of a day are sorted by
event time and id over its files. Late rows come in four steps:

1. their ids are joined to the stored ids and ``_metadata.row_index``; a stored
   row that a later one replaces is an outgoing position of its file. All of them
   are the layout's deletion vectors, a row a position;
2. the affected days are those where a late row will stand or a position goes out;
3. these days' files are read, their positions masked, and the sorted rows left are
   merged with the sorted late ones: ranges of (day, time, id) are exchanged,
   sorted and written, and a row's number in its day is its position in its range
   plus the rows of the day in the ranges before;
4. the days' files are replaced by overwriting partitions dynamically, and files
   that a day no longer needs go. Other files are not touched.

No step brings a day, an id's rows or a file list of the rows' size to one task or
to the driver: ids are reduced by partial aggregates, days are cut into ranges,
joins of rows are sort-merge joins, and what is broadcast or collected has a row
for a file or for a day of a range. One task streams each file it writes.

Defined results:
- a null event time is day -1; a null arrival counts as late and as the earliest;
  null ids are one id, first in the order of a day's times;
- of rows with one id and one arrival the one whose columns have the greatest hash
  stays, so repeated rows are one; a late row replaces a stored one of the same
  arrival by the same rule;
- texts may have any length; an empty table is a folder without data files;
- all columns of the rows are stored, in order; the partition columns are named
  ``day`` and ``file_no``, with underscores behind them where a column has that name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType, TimestampNTZType

from .common import discard, map_batches, materialize, scratch, shared_root, small

DAY = 86_400_000_000
#: The query's layout: a file holds 1 + rows // FILES rows; rows that arrived before CUT (2024-03-20) are early.
FILES, CUT = 1100, 19_802 * DAY


def micros(column: Column, of) -> Column:
    """Microseconds since 1970 in UTC, of a time with or without a zone, whatever the session's zone."""
    if not isinstance(of, TimestampNTZType):
        return F.unix_micros(column)
    clock = F.hour(column).cast("long") * 3600 + F.minute(column).cast("long") * 60
    second = (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
    return F.unix_date(column.cast("date")).cast("long") * DAY + clock * 1_000_000 + second


@dataclass(frozen=True)
class Layout:
    """Where the files are, and the roles of the columns of ``schema``."""

    path: str
    schema: StructType
    per_file: int
    id: str = "sale_id"
    event: str = "sold_at"
    arrived: str = "arrived_at"

    def _free(self, name: str) -> str:
        while name.lower() in {c.lower() for c in self.schema.names}:
            name += "_"
        return name

    @cached_property
    def day(self) -> str:
        return self._free("day")

    @cached_property
    def file_no(self) -> str:
        return self._free("file_no")

    @cached_property
    def names(self) -> list[str]:
        """The columns under names that cannot clash."""
        return [f"c{i}" for i in range(len(self.schema))]

    def plain(self, rows: DataFrame) -> DataFrame:
        """The rows under plain names, with their ``day``."""
        named = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(self.schema.names, self.names)])
        return named.withColumn("day", self.day_of(self.name(self.event)))

    def name(self, column: str) -> str:
        return self.names[self.schema.names.index(column)]

    def micros(self, column: str) -> Column:
        """Microseconds of a column in plain rows."""
        return micros(F.col(self.name(column)), self.schema[column].dataType)

    def day_of(self, name: str) -> Column:
        """Whole days since 1970 in UTC, -1 for a null time."""
        kind = self.schema[self.event].dataType
        if isinstance(kind, TimestampNTZType):
            day = F.unix_date(F.col(name).cast("date"))
        else:
            m = micros(F.col(name), kind)
            day = F.call_function("div", m - F.pmod(m, F.lit(DAY)), F.lit(DAY))
        return F.coalesce(day.cast("long"), F.lit(-1).cast("long"))

    def stored(self, spark: SparkSession) -> DataFrame:
        """The stored rows under plain names, with ``day``, ``file_no``, ``path`` and ``pos``."""
        keys = [StructField(self.day, LongType()), StructField(self.file_no, LongType())]
        rows = spark.read.schema(StructType(list(self.schema.fields) + keys)).parquet(self.path)
        return rows.select(
            *[F.col(f"`{c}`").alias(n) for c, n in zip(self.schema.names, self.names)],
            F.col(self.day).alias("day"),
            F.col(self.file_no).alias("file_no"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.row_index").alias("pos"),
        )

    def age(self) -> Column:
        """What the latest row of an id has the greatest of: arrival, then a hash of all columns."""
        hashed = [F.to_json(n) if isinstance(f.dataType, MapType) else F.col(n) for n, f in zip(self.names, self.schema)]
        return F.struct(F.col(self.name(self.arrived)).alias("a"), F.xxhash64(*hashed).alias("h"))

    def latest(self, rows: DataFrame) -> DataFrame:
        """The latest row of each id, of plain rows."""
        last = F.max_by(F.struct("day", *self.names), self.age()).alias("row")
        return rows.groupBy(F.col(self.name(self.id)).alias("id")).agg(last).select("row.*")

    def write(self, rows: DataFrame, mode: str) -> None:
        """Write plain rows, one an id, as the files of their days; ``overwrite`` replaces only partitions that have rows."""
        order = ["day", self.name(self.event), self.name(self.id)]
        ranges = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order), "late-ranges")
        placed = ranges.select("*", F.col("_metadata.file_name").alias("range"), F.col("_metadata.row_index").alias("place"))
        # A row for each day of a range: the place it begins at, and the day's rows in the ranges before.
        begins = placed.groupBy("day", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        of_task = F.regexp_extract("range", r"^part-(\d+)", 1).cast("long")
        before = Window.partitionBy("day").orderBy(of_task, "range").rowsBetween(Window.unboundedPreceding, -1)
        begins = begins.select(
            F.col("day").alias("b_day"), F.col("range").alias("b_range"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
        )
        begins = small(materialize(begins, "late-begins"))
        ranked = placed.join(begins, F.expr("day = b_day and range = b_range"))
        number = F.expr(f"(place + shift) div {self.per_file}").alias("file_no")
        files = ranked.select("day", number, *self.names).repartition("day", "file_no")
        files = files.sortWithinPartitions("day", "file_no", *order[1:])
        back = [F.col(n).alias(c) for n, c in zip(self.names, self.schema.names)]
        files = files.select(*back, F.col("day").alias(self.day), F.col("file_no").alias(self.file_no))
        writer = files.write.mode(mode).partitionBy(self.day, self.file_no)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)


def write_layout(layout: Layout, rows: DataFrame) -> None:
    """The layout of the latest row of each id, in a new folder."""
    with scratch():
        layout.write(layout.latest(layout.plain(rows)), "append")


def deletion_vectors(layout: Layout, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Late rows that come in (plain, one an id), and the stored positions that go out: ``day``, ``file_no``, ``pos``."""
    spark = late.sparkSession
    came = layout.latest(layout.plain(late))
    key = layout.name(layout.id)
    stored = layout.stored(spark).select(F.col(key).alias("s_id"), layout.age().alias("s_age"), F.col("day").alias("s_day"), "file_no", "pos")
    # A merge join: neither side has a bound, and ids are unique on both.
    met = came.withColumn("age", layout.age()).hint("merge").join(stored.hint("merge"), F.col(key).eqNullSafe(F.col("s_id")), "left")
    met = met.where(F.col("s_day").isNull() | (F.col("age") > F.col("s_age")))
    met = materialize(met.select("day", *layout.names, "s_day", "file_no", "pos"), "late-met")
    gone = met.where("s_day is not null").select(F.col("s_day").alias("day"), "file_no", "pos")
    return met.select("day", *layout.names), gone


def overwrite_late(layout: Layout, late: DataFrame) -> DataFrame:
    """Bring late rows into a stored layout; gives the ``day`` of all days that have been rewritten."""
    spark = late.sparkSession
    with scratch():
        came, gone = deletion_vectors(layout, late)
        days = materialize(came.select("day").union(gone.select("day")).distinct(), "late-days", keep=True)
        touched = small(days.select(F.col("day").alias("t_day")))
        held = layout.stored(spark).join(touched, F.expr("day = t_day"), "left_semi")
        before = materialize(held.select("path").distinct(), "late-before")
        masked = held.hint("merge").join(gone.hint("merge"), ["day", "file_no", "pos"], "left_anti")
        layout.write(masked.select("day", *layout.names).unionByName(came), "overwrite")
        # Files of before that no new one has replaced, as their day has fewer files now; a row a file.
        left = layout.stored(spark).select("path").distinct().join(before, "path", "left_semi")
        _delete(spark, [r.path for r in left.collect()])
    return days


def _delete(spark: SparkSession, files: list[str]) -> None:
    """Delete files, and the folders that are empty without them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in files:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        system = where.getFileSystem(conf)
        system.delete(where.getParent(), True)
        if not system.listStatus(where.getParent().getParent()):
            system.delete(where.getParent().getParent(), False)


def digests(layout: Layout, spark: SparkSession) -> DataFrame:
    """``day``, ``file_no`` and ``ids_sha256`` of each stored file, streamed in file order."""
    rows = layout.stored(spark)
    text = F.coalesce(F.col(layout.name(layout.id)).cast("string"), F.lit("")).alias("id")
    ordered = rows.select("day", "file_no", text, "pos").repartition("day", "file_no").sortWithinPartitions("day", "file_no", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["day", "file_no", "ids_sha256"])

        for batch in batches:
            days, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *((days[1:] != days[:-1]) | (numbers[1:] != numbers[:-1])).nonzero()[0] + 1, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                text = ",".join(batch.column(2).slice(a, b - a).to_pylist()).encode()
                if key != (days[a], numbers[a]):
                    if key is not None:
                        yield done()
                    key, state = (days[a], numbers[a]), hashlib.sha256()
                    state.update(text)
                else:
                    state.update(b"," + text)
        if key is not None:
            yield done()

    return map_batches(ordered, run, "day long, file_no long, ids_sha256 string")


def files_of(layout: Layout, spark: SparkSession, before: DataFrame) -> DataFrame:
    """A row for each stored file: what it holds, and whether ``before`` (``path``) lacks it."""
    rows = layout.stored(spark)
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(layout.name(layout.id)), layout.micros(layout.event), layout.micros(layout.arrived))])
    cents = F.coalesce(F.floor(100 * F.col(layout.name("total")) + 0.5), F.lit(0))
    sums = rows.groupBy("day", "file_no", "path").agg(F.count("*").alias("n_rows"), F.sum(cents).alias("cents"), F.sum(F.crc32(text.cast("binary"))).alias("rows_crc"))
    known = before.select(F.col("path").alias("b_path"))
    joined = sums.join(digests(layout, spark), ["day", "file_no"]).join(known, F.col("path") == F.col("b_path"), "left")
    names = [] if rows.isEmpty() else [c for c in spark.read.parquet(layout.path).columns if c not in (layout.day, layout.file_no)]
    return joined.select(
        "day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(",".join(names)).alias("columns"), "ids_sha256",
        F.col("b_path").isNull().alias("rewritten"),
    )


def with_copies(sales: DataFrame) -> DataFrame:
    """``sales``, and the later versions of a third of the rows of every fourth day."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    layout = Layout("", sales.schema, 1)
    changed = {
        "total": F.col("total") + 1,
        "sold_at": F.col("sold_at") + F.make_dt_interval((h % 2).cast("int")),
        "arrived_at": F.col("arrived_at") + F.make_dt_interval((1 + h % 97).cast("int")),
    }
    again = sales.where((h % 3 == 0) & (layout.day_of("sold_at") % 4 == 0))
    return sales.union(again.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in sales.columns]))


def op12_late_overwrite(spark, sf_dir: str) -> DataFrame:
    """Query: the files of the layout of all ``sales``, after the late ones have come into that of the early ones."""
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    layout = Layout(f"{shared_root(spark)}/sales-layout-{uuid.uuid4().hex}", sales.schema, 1 + sales.count() // FILES)
    rows = with_copies(sales)
    early = F.coalesce(micros(F.col("arrived_at"), sales.schema["arrived_at"].dataType) < CUT, F.lit(False))
    with scratch():
        write_layout(layout, rows.where(early))
        before = materialize(layout.stored(spark).select("path").distinct(), "late-start")
        discard(overwrite_late(layout, rows.where(~early)))
        return materialize(files_of(layout, spark, before), "late-layout", keep=True)

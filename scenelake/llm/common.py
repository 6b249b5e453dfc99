"""Helpers shared by the corpus operators: intermediate tables and row plumbing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Temporary folders of local sessions that name no shared one, by application.
_temporary: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where a local session names none, a temporary folder serves for as long as
    the driver runs; its settings stay as they are.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _temporary.get(context.applicationId)
        if root is None:
            root = _temporary[context.applicationId] = tempfile.mkdtemp(prefix="scenelake-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Run a block under other values of settings; afterwards the session has its own again."""
    names = {"cleanup": _CLEANUP, "rows": _ROWS}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: The tables of the open scopes, the innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end of a block, the tables that operators have written in it.

    What the block has made must be written or read to its end by then.
    """
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for df in made:
            discard(df)


def lean() -> None:
    """Let this process give freed memory back to the system at once.

    Workers live on between tasks, so what their allocators keep adds up beside
    the JVM. Arrow takes its buffers from the C library, which maps blocks of a
    megabyte and more one by one; elsewhere than on Linux nothing changes.
    """
    if not _lean:
        _lean.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        if sys.platform == "linux":
            library = ctypes.CDLL(None)
            library.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            _lean.append(library.malloc_trim)
    if len(_lean) > 1:
        _lean[1](0)


#: Whether this process is lean, and how it gives memory back.
_lean: list = []


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in workers that keep no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from function(batches)
        lean()

    return df.mapInArrow(run, schema)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows, from a copy of the session in which Python gets few rows at once.

    Rows hold whole texts, so batches of the default length are large. The
    setting counts when the plan runs, which may be long after this call; the
    caller's session keeps its own.
    """
    spark = df.sparkSession
    if spark.conf.get(_ROWS, None) is not None:
        return df
    copy = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set(_ROWS, "1000")
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(rows, copy)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, so a lost executor costs one re-read. The shuffle
    files of the write go as soon as it is done. Python gets a tenth of the
    default rows at once, as rows hold whole texts. The table goes by
    :func:`discard`, or with the innermost :func:`scratch` unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, cleanup="true", rows="1000"):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scenelake_path = path
    if _scopes and not keep:
        _scopes[-1].append(back)
    return back


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`materialize` wrote."""
    path = getattr(df, "_scenelake_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a table that is sent to all executors, at most.
SMALL = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` (``SMALL``) narrow rows; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= (SMALL if rows is None else rows) else df


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def map_text(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    schema: str,
    function: Callable[[], Callable[[list], list[pa.Array]]],
    most: int = 1 << 20,
) -> DataFrame:
    """Run a batch function over one text column, keeping other columns as they are.

    ``function()`` is called once in each task and gives the batch function,
    which takes the list of texts (``None`` for null) and returns one Arrow
    array for each field of ``schema``. Batches are cut to about ``most`` bytes of text,
    so a run of very long texts does not pile up in a worker. Kept columns may
    have any names; an added column that is named like one of them gets ``_new``.
    """
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(keep))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("__text"))
    kept = narrow.drop("__text").schema
    added = spark.createDataFrame([], schema).schema
    out_schema = type(kept)(list(kept.fields) + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function()
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("__text"), most):
                texts = part.column(part.num_columns - 1).to_pylist()
                arrays = work(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(part.num_columns - 1)] + arrays,
                    names=out_schema.names,
                )

    return in_small_batches(map_batches(narrow, run, out_schema)).toDF(*keep, *beside(keep, added.names))


def beside(keep: list[str], added: list[str]) -> list[str]:
    """Names for added columns: one that is named like a kept column gets ``_new``."""
    return [f"{c}_new" if c in keep else c for c in added]


def slices(batch: pa.RecordBatch, index: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of one text column, a row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)

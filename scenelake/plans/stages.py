"""Intermediate tables of jobs that run in rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions that name no shared one, by application.
_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a local session names none, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _temporary.get(context.applicationId)
        if root is None:
            root = _temporary[context.applicationId] = tempfile.mkdtemp(prefix="scenelake-rounds-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scenelake_written = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` gave."""
    for df in tables:
        path = getattr(df, "_scenelake_written", None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a table that is sent to all executors, at most.
SENT = 200_000


def sent_if_few(df: DataFrame, rows: int = SENT) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` narrow rows; a larger one is shuffled."""
    return df.hint("broadcast") if df.count() <= rows else df

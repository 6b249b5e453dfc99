import os
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from scenelake.llm import common

_ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
before = {{k: spark.conf.get(k, None) for k in (common._ROWS, common._CLEANUP)}} if (common := __import__("scenelake.llm.common", fromlist=["x"])) else None
from scenelake.llm import jaccard, lines
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")], "doc_id long, text string")
assert sorted(map(tuple, jaccard.components(docs).collect())) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]
assert lines.dedup_lines(docs, min_words=3).where("n_removed = 1").count() == 1
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert before == {{k: spark.conf.get(k, None) for k in before}}
print("ROOT", common.shared_root(spark))
"""


def test_a_session_without_a_shared_folder(tmp_path):
    """A local session that names no folder works, keeps its settings, and leaves nothing behind."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", _ALONE.format(repo=repo)], env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    root = said.stdout.split("ROOT ")[1].strip()
    assert not os.path.exists(root)


def files_of(df):
    return common.shared_root(df.sparkSession).removeprefix("file:") + "/" + df._scenelake_path.rsplit("/", 1)[1]


def test_tables_go_with_their_scope(spark):
    with common.scratch():
        outer = common.materialize(spark.range(3), "outer")
        with common.scratch():
            inner = common.materialize(spark.range(4), "inner")
            kept = common.materialize(spark.range(5), "kept", keep=True)
            assert inner.count() == 4 and os.path.exists(files_of(inner))
        assert not os.path.exists(files_of(inner)) and outer.count() == 3 and kept.count() == 5
    assert not os.path.exists(files_of(outer))
    common.discard(kept)
    assert not os.path.exists(files_of(kept))


def test_settings_come_back(spark):
    assert spark.conf.get(common._ROWS, None) is None
    spark.conf.set(common._CLEANUP, "false")
    try:
        common.materialize(spark.range(2), "one")
        assert spark.conf.get(common._ROWS, None) is None and spark.conf.get(common._CLEANUP) == "false"
    finally:
        spark.conf.unset(common._CLEANUP)


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "c", "", "d" * 9])], names=["t"])
    assert [p.num_rows for p in common.slices(batch, 0, 20)] == [2, 1, 3]
    assert sum(p.num_rows for p in common.slices(batch, 0, 1)) == 6


def test_small_tables_are_sent_and_large_ones_are_not(spark):
    plan = lambda df: df.join(common.small(spark.range(10), 5), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan(spark.range(1000))
    assert "broadcast" in spark.range(1000).join(common.small(spark.range(3), 5), "id")._jdf.queryExecution().optimizedPlan().toString()


def test_python_gets_few_rows_at_once_and_the_session_keeps_its_settings(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    df = spark.range(5000).coalesce(1).mapInArrow(sizes, "n long")
    assert [r.n for r in df.collect()] == [5000]
    small = common.in_small_batches(df)
    assert [r.n for r in small.where("n > 0").collect()] == [1000] * 5
    assert small.join(spark.range(1001), small.n == F.col("id")).count() == 5
    assert [r.n for r in df.collect()] == [5000] and spark.conf.get(common._ROWS, None) is None

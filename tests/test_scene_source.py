"""The scene source: what it reads, and what its filters keep from being opened."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains, StringStartsWith

from scenelake.sources import scene_source as S


@pytest.fixture(scope="module")
def root(tmp_path_factory, spark):
    S.register(spark)
    base = tmp_path_factory.mktemp("scenes")
    for scene, files in {
        "kv1/a/s1": {"scene.txt": b"office", "annotation2Dfinal/index.json": b"{}"},
        "kv1/a/s2": {"annotation2Dfinal/index.json": b"\xff[", "annotation3Dlayout/index.json": b""},
        "kv1/b": {"intrinsics.txt": b"1 2", "other.txt": b"no", "annotation2Dfinal/more/scene.txt": b"no"},
        "kv2": {"scene.txt": "café".encode()},
        "xt": {"readme": b"no"},
    }.items():
        for name, content in files.items():
            path = base / scene / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
    return str(base)


ALL = {
    ("kv1/a/s1", "label", "office"), ("kv1/a/s1", "annotation_2d", "{}"), ("kv1/a/s2", "annotation_2d", "�["), ("kv1/a/s2", "layout", ""),
    ("kv1/b", "intrinsics", "1 2"), ("kv2", "label", "café"),
}


def rows(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("parts", [1, 2, 64])
def test_all_files_of_known_kinds(spark, root, parts):
    df = spark.read.format("scenes").option("partitions", parts).load(root)
    assert rows(df) == ALL and rows(spark.read.format("scenes").load("file:" + root)) == ALL
    assert df.rdd.getNumPartitions() == min(parts, 3)


def test_filters_give_the_same_rows_as_spark(spark, root):
    df = spark.read.format("scenes").load(root)
    for test in ("kind = 'label'", "kind in ('label', 'layout')", "scene_path = 'kv1/a/s2'", "scene_path like 'kv1/a%'", "scene_path > 'kv1/a/s1'",
                 "scene_path <= 'kv1/b' and kind <> 'layout'", "scene_path >= 'kv1/a/s2' and scene_path < 'kv2'", "value like '%c%'"):
        kept = spark.createDataFrame([*ALL], S.SCHEMA).where(test)
        assert rows(df.where(test)) == rows(kept), test


def test_pushed_filters_skip_folders_and_kinds(root):
    reader = S.SceneReader(root, 8)
    other = StringContains(("value",), "x")
    assert list(reader.pushFilters([EqualTo(("kind",), "label"), StringStartsWith(("scene_path",), "kv1/a"), other])) == [other]
    assert [(p.first, p.last) for p in reader.partitions()] == [("kv1", "kv1")]
    seen = []
    real = S.opened

    class Watched:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            if name == "open_input_stream":
                return lambda file: (seen.append(file), self.system.open_input_stream(file))[1]
            return getattr(self.system, name)

    S.opened = lambda path: (lambda s, p: (Watched(s), p))(*real(path))
    try:
        assert [r for p in reader.partitions() for r in reader.read(p)] == [("kv1/a/s1", "label", "office")]
    finally:
        S.opened = real
    assert seen == [f"{root}/kv1/a/s1/scene.txt"]
    reader = S.SceneReader(root, 8)
    assert list(reader.pushFilters([In(("kind",), ("layout", "nothing")), GreaterThan(("scene_path",), "kv1/b"), LessThanOrEqual(("scene_path",), "kv2")])) == []
    assert [r for p in reader.partitions() for r in reader.read(p)] == []


def test_written_scenes_come_back(spark, tmp_path):
    S.register(spark)
    files = spark.range(40).select(F.concat(F.lit("u"), (F.col("id") % 7).cast("string"), F.lit("/s"), F.col("id").cast("string")).alias("scene_path"), F.lit("label").alias("kind"), F.col("id").cast("string").alias("value"))
    S.write_scenes(files, str(tmp_path))
    assert rows(spark.read.format("scenes").load(str(tmp_path))) == {tuple(r) for r in files.collect()}
    (tmp_path / "empty").mkdir()
    assert rows(spark.read.format("scenes").load(str(tmp_path / "empty"))) == set()


def test_packed_scenes_come_back_with_few_files(spark, tmp_path, monkeypatch):
    S.register(spark)
    monkeypatch.setattr(S, "PACKED", 7)
    scene = F.concat(F.lit("u"), (F.col("id") % 7).cast("string"), F.lit("/s"), F.col("id").cast("string"))
    kind = F.when(F.col("id") % 2 == 0, "label").otherwise("annotation_2d")
    files = spark.range(0, 90, 1, 3).select(scene.alias("scene_path"), kind.alias("kind"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("value"))
    S.write_scenes(files, str(tmp_path), packed=True)
    S.write_scenes(files, str(tmp_path), packed=True)  # as a task that runs again
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 3 * 5
    want = {(r.scene_path, r.kind, r.value or "") for r in files.collect()}
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "scene.txt").write_text("folder")
    df = spark.read.format("scenes").option("partitions", 4).load(str(tmp_path))
    assert rows(df) == want | {("more", "label", "folder")}
    for test in ("kind = 'label'", "scene_path like 'u3/%'", "scene_path >= 'u5' and kind = 'annotation_2d'"):
        again = spark.read.format("scenes").load(str(tmp_path)).where(test)
        assert rows(again) == rows(spark.createDataFrame([*want, ("more", "label", "folder")], S.SCHEMA).where(test)), test


def test_entries_of_an_archive_are_judged_as_files(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("scene.txt", "a/annotation2Dfinal/more/scene.txt", "a/other.txt", "a/b/annotation2Dfinal/index.json", "a/scene.txt"):
            z.writestr(name, name)
    reader = S.SceneReader(str(tmp_path), 8)
    found = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[:2] for r in found) == [("a", "label"), ("a/b", "annotation_2d")]

"""Scene folders as a data source: ``spark.read.format("scenes").load(root)``.

Rows: ``scene_path`` (below the root), ``kind`` and the file's text ``value``. A
partition is a range of the root's folders, which its task lists and reads; the
driver lists the top level only. The root may also hold ZIP archives of scene
folders, which take no block of the file system for each small file; a partition is
then some of the archives, of whose entries only those of the kinds asked for are
unpacked. Filters on ``kind`` keep files of other kinds from
being opened, those on ``scene_path`` keep folders from being listed; filters of
other forms are left to Spark.

Defined results:
- kinds are the names in ``KINDS``; other files are not read;
- a folder is a scene if it holds a file of some kind, at any depth;
- files are read as UTF-8, wrong bytes replaced; empty files give empty texts;
- an empty root gives no rows, a missing one an error;
- an archive's entries are files below the root, the last of one name counts; scenes
  that folders and archives both hold are read from both.

Spark keeps pushed filters with the loaded frame: where one plan needs files of
different kinds, load the source once for each.

The root is a path of a file system that all executors mount, or a URI of one that
Arrow opens (``file:``, ``hdfs:``, ``s3:``).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

#: Kind -> the file's path below its scene.
KINDS = {
    "annotation_2d": "annotation2Dfinal/index.json",
    "annotation_3d": "annotation3Dfinal/index.json",
    "layout": "annotation3Dlayout/index.json",
    "label": "scene.txt",
    "intrinsics": "intrinsics.txt",
}
SCHEMA = "scene_path string, kind string, value string"
#: Files of an archive that is written, at most; its directory is held in memory.
PACKED = 20_000


@dataclass
class Folders(InputPartition):
    """Folders of the root from ``first`` to ``last``, in the order of their names."""

    first: str
    last: str


@dataclass
class Archives(InputPartition):
    """Archives of the root."""

    names: list[str]


def opened(root: str):
    """The file system and the path of a root."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else "file://" + root[5:])
    return fs.LocalFileSystem(), root


class SceneReader(DataSourceReader):
    """Reads ranges of folders under the filters that Spark pushes."""

    def __init__(self, root: str, parts: int):
        self.root, self.parts = root.rstrip("/"), parts
        self.kinds: set[str] = set(KINDS)
        #: Tests of scene paths: (operator, text).
        self.tests: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters on kind and path, hand the others back."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "^"}
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("kind",) and isinstance(f, EqualTo):
                self.kinds &= {f.value}
            elif column == ("kind",) and isinstance(f, In):
                self.kinds &= set(f.value)
            elif column == ("scene_path",) and type(f) in signs:
                self.tests.append((signs[type(f)], f.value))
            else:
                yield f

    def _may(self, path: str) -> bool:
        """Whether a folder may hold scenes that pass: its paths begin with ``path``."""
        for sign, text in self.tests:
            if sign in "=^" and not (text.startswith(path) or path.startswith(text) and (sign == "^" or path == text)):
                return False
            if sign in (">", ">=") and path < text and not text.startswith(path):
                return False
            if sign in ("<", "<=") and path > text:
                return False
        return True

    def _passes(self, scene: str) -> bool:
        """Whether a scene's path passes all tests."""
        by = {"=": scene.__eq__, "^": scene.startswith, ">": scene.__gt__, ">=": scene.__ge__, "<": scene.__lt__, "<=": scene.__le__}
        return all(by[sign](text) for sign, text in self.tests)

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of about as many folders each."""
        from pyarrow import fs

        system, path = opened(self.root)
        found = system.get_file_info(fs.FileSelector(path))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and self._may(f.base_name))
        size = max(1, -(-len(names) // self.parts))
        cuts = [names[i : i + size] for i in range(0, len(names), size)]
        packed = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".zip"))
        dealt = [packed[i :: self.parts] for i in range(min(self.parts, len(packed)))]
        return [*[Folders(c[0], c[-1]) for c in cuts], *map(Archives, dealt)] or [Folders("1", "0")]

    def _unpacked(self, partition: Archives) -> Iterator[tuple[str, str, str]]:
        """The rows of some archives, an entry at a time."""
        system, path = opened(self.root)
        ends = {f"/{KINDS[k]}": k for k in sorted(self.kinds)}
        own = {v.split("/")[0] for v in KINDS.values()}
        for name in partition.names:
            with system.open_input_file(f"{path}/{name}") as file, zipfile.ZipFile(io.BufferedReader(file, 1 << 16)) as archive:
                for entry in archive.NameToInfo.values():
                    end = next((e for e in ends if entry.filename.endswith(e)), None)
                    scene = entry.filename[: -len(end)] if end else ""
                    if scene and own.isdisjoint(scene.split("/")) and self._passes(scene):
                        yield scene, ends[end], archive.read(entry).decode("utf-8", "replace")

    def read(self, partition: Folders | Archives) -> Iterator[tuple[str, str, str]]:
        """The rows of a range, a folder at a time, or of archives."""
        from pyarrow import fs

        if isinstance(partition, Archives):
            yield from self._unpacked(partition)
            return
        system, path = opened(self.root)
        waiting = [f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory]
        waiting = sorted(n for n in waiting if partition.first <= n <= partition.last and self._may(n))[::-1]
        inside = {k: v.split("/") for k, v in KINDS.items()}
        while waiting:
            scene = waiting.pop()
            found = {f.base_name: f.type for f in system.get_file_info(fs.FileSelector(f"{path}/{scene}"))}
            if self._passes(scene):
                for kind in sorted(self.kinds):
                    file = f"{path}/{scene}/{'/'.join(inside[kind])}"
                    if inside[kind][0] in found and system.get_file_info(file).type == fs.FileType.File:
                        with system.open_input_stream(file) as stream:
                            yield scene, kind, stream.read().decode("utf-8", "replace")
            own = {parts[0] for parts in inside.values()}
            below = [n for n, t in found.items() if t == fs.FileType.Directory and n not in own]
            waiting += sorted((f"{scene}/{n}" for n in below if self._may(f"{scene}/{n}")), reverse=True)


class SceneSource(DataSource):
    """The source named ``scenes``; option ``partitions`` is how many ranges there are at most (64)."""

    @classmethod
    def name(cls) -> str:
        return "scenes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SceneReader:
        return SceneReader(self.options["path"], int(self.options.get("partitions", 64)))


def register(spark: SparkSession) -> None:
    """Make ``scenes`` known to a session, and let it push filters into sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneSource)


def write_scenes(files, root: str, packed: bool = False) -> None:
    """Write rows of ``scene_path``, ``kind`` and ``value`` as the files of scene folders, each task its own rows.

    ``packed``: into archives of at most ``PACKED`` files, named by task, so that a task
    that runs again replaces its own.
    """

    def run(rows) -> None:
        system, path = opened(root)
        for r in rows:
            file = f"{path}/{r.scene_path}/{KINDS[r.kind]}"
            system.create_dir(file.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(file) as stream:
                stream.write((r.value or "").encode())

    def pack(rows) -> None:
        system, path = opened(root)
        system.create_dir(path, recursive=True)
        task, archive, stream = TaskContext.get().partitionId(), None, None
        for i, r in enumerate(rows):
            if i % PACKED == 0:
                if archive is not None:
                    archive.close(), stream.close()
                stream = io.BufferedWriter(system.open_output_stream(f"{path}/{task:06d}-{i // PACKED:06d}.zip"), 1 << 20)
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
            archive.writestr(zipfile.ZipInfo(f"{r.scene_path}/{KINDS[r.kind]}"), (r.value or "").encode(), zipfile.ZIP_DEFLATED)
        if archive is not None:
            archive.close(), stream.close()

    files.select("scene_path", "kind", "value").foreachPartition(pack if packed else run)

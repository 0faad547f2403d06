"""Listing files of a tree in tasks, with image sizes from the files' beginnings.

``file_tree`` is a Python data source. The driver sees the names below the
roots only, and hands out one partition a folder there; each task lists its
folder to any depth. Of a file nothing is read, or, for ``sizes``, its header.
"""

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from annotary.sources.images import header_size
from annotary.sources.tail import file_system

_ROWS = 5000


def _hidden(path):
    """Whether a name in the path below the root begins with ``.`` or ``_``; Spark's file sources skip those."""
    return "/." in f"/{path}" or "/_" in f"/{path}"


class Folder(InputPartition):
    def __init__(self, path, deep):
        self.path, self.deep = path, deep


class FileTreeReader(DataSourceReader):
    def __init__(self, options, names):
        self.roots = options["roots"].split("\n")
        self.names = names

    def partitions(self):
        parts = []
        for root in self.roots:
            system, path = file_system(root)
            parts.append(Folder(root, False))
            for info in system.get_file_info(fs.FileSelector(path)):
                if info.type == fs.FileType.Directory and not _hidden(f"/{info.base_name}"):
                    parts.append(Folder(f"{root.rstrip('/')}/{info.base_name}", True))
        return parts

    def read(self, partition):
        system, path = file_system(partition.path)
        rows = []
        for info in system.get_file_info(fs.FileSelector(path, recursive=partition.deep)):
            if info.type == fs.FileType.File and not _hidden(info.path[len(path) :]):
                row = {"path": info.path, "length": info.size}
                if "width" in self.names:
                    row["width"], row["height"] = self._size(system, info.path)
                rows.append(row)
                if len(rows) == _ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _size(system, path):
        with system.open_input_file(path) as file:
            return header_size(lambda n: file.read_at(n, 0))

    def _batch(self, rows):
        types = {"path": pa.string(), "length": pa.int64(), "width": pa.int32(), "height": pa.int32()}
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], types[n]) for n in self.names})


class FileTree(DataSource):
    """Options: ``roots`` (one a line) and ``sizes`` (``true`` adds width and height)."""

    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        sizes = self.options.get("sizes", "false").lower() == "true"
        return "path string, length long" + (", width int, height int" if sizes else "")

    def reader(self, schema):
        return FileTreeReader(self.options, schema.fieldNames())


def list_tree(spark: SparkSession, roots, sizes=False) -> DataFrame:
    """``(path, length)`` of every file below ``roots``, with ``sizes`` also ``(width, height)`` of PNG and JPEG files.

    As ``images.list_files``, for trees whose file names do not fit the driver; empty files are listed too.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(roots="\n".join(roots), sizes=str(sizes).lower()).load()

"""Growing text files as a stream: complete lines only, each once.

``line_tail`` is a Python data source. Its offset is one number per file, where
the last complete line ends; a half-written last line is held back until its
end has arrived. New bytes are dealt in ranges over tasks, in wider ones if there are many, and a line belongs
to the range it begins in, so one long log does not wait for one task.
"""

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from annotary import schemas

RANGE_BYTES = 64 << 20
MOST_RANGES = 256  # wider ranges follow, up to RANGE_BYTES
_STEP = 1 << 20
_SCHEMA = "path string, byte_offset long, value string"


def file_system(path):
    """``(file system, path in it)`` of a URI or a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class LineRange(InputPartition):
    def __init__(self, path, begin, end, stop):
        self.path, self.begin, self.end, self.stop = path, begin, end, stop


def complete_until(system, path, begin, size):
    """Where the last complete line between ``begin`` and ``size`` ends; only the end of the file is read."""
    with system.open_input_file(path) as file:
        end = size
        while end > begin:
            start = max(begin, end - _STEP)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return begin


def lines_of(system, part):
    """``(byte offset, bytes)`` of the lines that begin in ``part``; those of ``stop`` onwards are not read."""
    with system.open_input_file(part.path) as file:
        at, rest = part.begin, b""
        file.seek(at)
        if part.begin:  # the line that runs into this range belongs to the one before
            file.seek(part.begin - 1)
            at, rest = part.begin - 1, None
        while True:
            block = file.read(min(_STEP, max(0, part.stop - file.tell())))
            if not block:
                return
            if rest is None:
                cut = block.find(b"\n")
                at += len(block) if cut < 0 else cut + 1
                if cut < 0:
                    continue
                block, rest = block[cut + 1 :], b""
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                if at >= part.end:
                    return
                yield at, line
                at += len(line) + 1
            if at >= part.end:
                return


class LineTailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.system, self.root = file_system(options["path"])
        self.suffix = options.get("suffix", ".jsonl")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.known = {}  # path: (size, end of its complete lines)

    def initialOffset(self):
        return {"files": {}}

    def latestOffset(self):
        for info in self.system.get_file_info(fs.FileSelector(self.root, recursive=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            size, end = self.known.get(info.path, (0, 0))
            if info.size < size:  # replaced by a new file
                size, end = 0, 0
            if info.size > size:
                self.known[info.path] = (info.size, complete_until(self.system, info.path, end, info.size))
        return {"files": {path: end for path, (_, end) in self.known.items()}}

    def partitions(self, start, end):
        fresh = []
        for path, stop in end["files"].items():
            begin = start["files"].get(path, 0)
            fresh.append((path, 0 if begin > stop else begin, stop))
        even = -(-sum(stop - begin for _, begin, stop in fresh) // MOST_RANGES)
        step = max(self.range_bytes, min(RANGE_BYTES, even))
        return [LineRange(path, at, min(stop, at + step), stop) for path, begin, stop in fresh for at in range(begin, stop, step)]

    def read(self, partition):
        rows, size = [], 0
        for at, line in lines_of(self.system, partition):
            rows.append((at, line))
            size += len(line)
            if size > _STEP or len(rows) >= 10_000:
                yield self._batch(partition.path, rows)
                rows, size = [], 0
        if rows:
            yield self._batch(partition.path, rows)

    @staticmethod
    def _batch(path, rows):
        return pa.RecordBatch.from_pydict(
            {
                "path": pa.array([path] * len(rows), pa.string()),
                "byte_offset": pa.array([at for at, _ in rows], pa.int64()),
                "value": pa.array([line.decode("utf-8", "replace") for _, line in rows], pa.string()),
            }
        )


class LineTail(DataSource):
    """Options: ``path`` (a folder, read to any depth), ``suffix`` of the files, ``rangeBytes`` of a task."""

    @classmethod
    def name(cls):
        return "line_tail"

    def schema(self):
        return _SCHEMA

    def streamReader(self, schema):
        return LineTailReader(self.options)


def tail_lines(spark: SparkSession, root, **options) -> DataFrame:
    """Stream of ``(path, byte_offset, value)``: each complete line of the growing files below ``root`` once."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").options(**options).load(root)


def tail_events(spark: SparkSession, root, **options) -> DataFrame:
    """Stream of run events from logs that grow: campaign, run, the event's fields and ``line`` (its byte offset).

    Lines that hold no event are left out, as in batch.
    """
    event = F.from_json("value", schemas.RUN_EVENT)
    return (
        tail_lines(spark, root, **options)
        .select(
            F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1).alias("campaign"),
            F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2).alias("run"),
            F.col("byte_offset").alias("line"),
            event.alias("event"),
        )
        .filter(F.col("event.type").isNotNull())
        .select("campaign", "run", "line", "event.*")
    )

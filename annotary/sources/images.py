"""Image files: listing, header sizes and a decodability test, in one read."""

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.checks import CorpusError, require_empty

HEADER_BYTES = 1 << 15
SCAN_SCHEMA = "path string, width int, height int, readable boolean"
_PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# JPEG start-of-frame markers carry the size; C4, C8 and CC mean other things.
_JPEG_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def plain_path(col):
    """Local paths without scheme, so they equal the paths in the records."""
    return F.regexp_replace(col, r"^file:/+", "/")


def _png(data):
    """Size, and whether all image data inflates to the announced amount."""
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    interlaced = data[28]
    inflate, pixels, at = zlib.decompressobj(), 0, 8
    try:
        while at + 12 <= len(data):
            size = struct.unpack(">I", data[at : at + 4])[0]
            kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
            if len(data) < at + 12 + size:
                return width, height, False
            if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
                return width, height, False
            if kind == b"IDAT":
                pixels += len(inflate.decompress(body))
            at += 12 + size
    except zlib.error:
        return width, height, False
    row = 1 + (width * depth * _PNG_CHANNELS.get(colour, 1) + 7) // 8
    return width, height, pixels > 0 if interlaced else pixels >= row * height


def _jpeg(data):
    """Size, and whether an end marker follows the scan data."""
    at, size = 2, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in _JPEG_FRAMES and at + 9 <= len(data):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            size = (width, height)
        if marker == 0xDA:
            break
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if size is None:
        return None, None, False
    return (*size, data.rfind(b"\xff\xd9") > at)


def header_size(read):
    """``(width, height)`` from the beginning of PNG or JPEG bytes, or nulls.

    ``read(n)`` gives the first n bytes, or all there are; more are asked for
    only while a JPEG's leading segments go on.
    """
    n = HEADER_BYTES
    while True:
        data = read(n)
        try:
            if data[:8] == _PNG_MAGIC and data[12:16] == b"IHDR":
                return struct.unpack(">II", data[16:24])
            if data[:2] != b"\xff\xd8":
                return None, None
            width, height, _ = _jpeg(data)
        except (struct.error, IndexError):
            width = height = None
        if width is not None or len(data) < n:
            return width, height
        n *= 8


def inspect_image(data):
    """``(width, height, readable)`` of PNG or JPEG bytes."""
    try:
        if data[:8] == _PNG_MAGIC and data[12:16] == b"IHDR":
            return _png(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except (struct.error, IndexError):
        pass
    return None, None, False


def _inspect_batches(batches):
    for batch in batches:
        rows = [(path, *inspect_image(bytes(data))) for path, data in zip(batch["path"], batch["content"])]
        out = pd.DataFrame(rows, columns=["path", "width", "height", "readable"])
        yield out.astype({"width": "Int32", "height": "Int32"})


def _binary(spark, roots):
    roots = [roots] if isinstance(roots, str) else list(roots)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)


def list_files(spark: SparkSession, roots) -> DataFrame:
    """Paths below ``roots``; contents are pruned and never read."""
    return _binary(spark, roots).select(plain_path(F.col("path")).alias("path"))


def scan_images(spark: SparkSession, roots, decode=False) -> DataFrame:
    """``(path, width, height, readable)`` of every file, one read of the bytes.

    The built-in test covers cut files: checksums and data length for PNG, the
    end marker for JPEG. ``decode`` adds Spark's own decoder on top, which
    rejects some files damaged in the middle too; a damaged file with a sound
    end can pass both.
    """
    found = (
        _binary(spark, roots)
        .select(plain_path(F.col("path")).alias("path"), "content")
        .mapInPandas(_inspect_batches, SCAN_SCHEMA)
    )
    if not decode:
        return found
    roots = [roots] if isinstance(roots, str) else list(roots)
    decoded = (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("recursiveFileLookup", True)
        .load(roots)
        .filter(F.col("image.width") > 0)
        .select(plain_path(F.col("image.origin")).alias("path"), F.lit(True).alias("_ok"))
    )
    return (
        found.join(decoded, "path", "left")
        .withColumn("readable", F.col("readable") & F.coalesce("_ok", F.lit(False)))
        .drop("_ok")
    )


def split_readable(records: DataFrame, scan: DataFrame):
    """``(kept, dropped)`` records; a file without any scan row is dropped too."""
    good = scan.filter("readable").select(F.col("path").alias("file_path")).distinct()
    return records.join(good, "file_path", "left_semi"), records.join(good, "file_path", "left_anti")


def corruption_counters(dropped: DataFrame) -> DataFrame:
    """Per source: images dropped and the instances lost with them."""
    return dropped.groupBy("source").agg(
        F.count(F.lit(1)).alias("corrupted_images"),
        F.sum(F.size("instances")).cast("long").alias("corrupted_instances"),
    )


def require_files(records: DataFrame, files: DataFrame) -> None:
    """Every annotated image must exist."""
    missing = records.select("file_path").join(
        files.select(F.col("path").alias("file_path")), "file_path", "left_anti"
    )
    require_empty(missing, "annotated image missing on disk", CorpusError)


def first_existing(names: DataFrame, files: DataFrame, roots) -> DataFrame:
    """Path of each ``file_name`` below the first root that has it, else null."""
    ranked = None
    for rank, root in reversed(list(enumerate(roots))):
        test = F.col("path").startswith(root.rstrip("/") + "/")
        ranked = F.when(test, rank) if ranked is None else F.when(test, rank).otherwise(ranked)
    found = (
        files.withColumn("_rank", ranked)
        .filter(F.col("_rank").isNotNull())
        .groupBy(F.substring_index("path", "/", -1).alias("file_name"))
        .agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))
    )
    return names.join(found, "file_name", "left")

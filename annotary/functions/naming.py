"""Identifiers, time stamps and labels as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the corpora for equal results.
TIMESTAMP_PREFIX = r"(?s)^(\d{8}_\d{6}).*$"
TIMESTAMP_FORMATS = ("ddMMyyyy_HHmmss", "yyyyMMdd_HHmmss")
THUMBNAIL_PREFIX = "Thumbnail"


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def stem(path) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def image_key(source, path) -> Column:
    """Stable id: ``<source>/<file name without extension>``."""
    return F.concat(_col(source), F.lit("/"), stem(path))


def parent_dir(path) -> Column:
    return F.regexp_replace(_col(path), r"/[^/]+$", "")


def timestamp_group(file_name) -> Column:
    """Leading time stamp of a file name, else the whole name."""
    return F.regexp_replace(_col(file_name), TIMESTAMP_PREFIX, "$1")


# What a date of each format can look like: parsing is only tried on these,
# since a failed parse costs far more than a pattern.
_DAY, _MONTH, _CLOCK = r"(0[1-9]|[12]\d|3[01])", r"(0[1-9]|1[0-2])", r"_([01]\d|2[0-3])[0-5]\d[0-5]\d$"
_DATE_SHAPES = (rf"^{_DAY}{_MONTH}\d{{4}}{_CLOCK}", rf"^\d{{4}}{_MONTH}{_DAY}{_CLOCK}")


def group_micros(group_id) -> Column:
    """Device clock of a time-stamped id in microseconds since 1970.

    Day-first form before year-first, null when neither is a real date. The
    clock has no zone and is only ever compared with itself, so it is read as
    UTC whatever the session zone.
    """
    gid = _col(group_id)
    stamped = F.concat(gid, F.lit("Z"))
    return F.coalesce(
        *[
            F.when(gid.rlike(shape), F.unix_micros(F.try_to_timestamp(stamped, F.lit(f"{fmt}X"))))
            for fmt, shape in zip(TIMESTAMP_FORMATS, _DATE_SHAPES)
        ]
    )


def seeded_hash(seed, key) -> Column:
    """First 8 bytes of SHA-256 of ``"<seed>:<key>"`` as 16 hex digits.

    Fixed-width lower-case hex sorts exactly like the unsigned integer.
    """
    text = F.concat(F.lit(f"{seed}:"), _col(key).cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def bucket_label(lo, hi) -> Column:
    """``4+``, ``2`` or ``2-5`` for a possibly open-ended count range."""
    lo, hi = _col(lo), _col(hi)
    low = lo.cast("string")
    return (
        F.when(lo.isNull(), F.lit(None).cast("string"))
        .when(hi.isNull(), F.concat(low, F.lit("+")))
        .when(lo == hi, low)
        .otherwise(F.concat(low, F.lit("-"), hi.cast("string")))
    )


def bucket_array_label(bucket) -> Column:
    """Label of a ``[lo, hi]`` array; null or empty means no bucket."""
    bucket = _col(bucket)
    return F.when(
        F.size(F.coalesce(bucket, F.array().cast("array<int>"))) > 0,
        bucket_label(F.get(bucket, 0), F.get(bucket, 1)),
    )


def run_key(point, seed, lo=None, hi=None) -> Column:
    """``n<point>[_density<bucket>]_seed<seed>``; a null point reads ``full``."""
    parts = [F.lit("n"), F.coalesce(_col(point).cast("string"), F.lit("full"))]
    if lo is not None:
        label = bucket_label(lo, hi)
        parts.append(
            F.when(label.isNull(), F.lit("")).otherwise(F.concat(F.lit("_density"), label))
        )
    return F.concat(*parts, F.lit("_seed"), _col(seed).cast("string"))


def duration_text(seconds) -> Column:
    """``1 j 02 h 03 min``; days only when there are any, negatives read 0."""
    total = F.greatest(F.lit(0), F.floor(_col(seconds))).cast("long")
    days = F.floor(total / 86400).cast("long")
    hours = F.floor((total % 86400) / 3600).cast("long")
    minutes = F.floor((total % 3600) / 60).cast("long")
    clock = F.format_string("%02d h %02d min", hours, minutes)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit(" j "), clock)).otherwise(clock)

"""Names, ids, times and sizes given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inches per unit, named paper sizes in inches, accepted photo endings.
MM_PER_INCH = 25.4
UNITS = {"in": 1.0, "mm": 1 / MM_PER_INCH, "cm": 10 / MM_PER_INCH}
NAMED_SIZES = {"letter": (8.5, 11.0), "a4": (210 / MM_PER_INCH, 297 / MM_PER_INCH), "a3": (297 / MM_PER_INCH, 420 / MM_PER_INCH)}
PHOTO_ENDINGS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
_NUMBER = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
SIZE_PATTERN = rf"^{_NUMBER}\s*x\s*{_NUMBER}\s*(in|mm|cm)$"
LENGTH_PATTERN = rf"^{_NUMBER}\s*(in|mm|cm)$"
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TIME_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
TIME_OUT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _unit(text: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, inches in UNITS.items():
        out = F.when(text == name, F.lit(inches)).otherwise(out)
    return out


def page_size(text: Column) -> Column:
    """Page size text as ``struct<a_in, b_in>``; null when it cannot be read or a side is not positive."""
    t = F.lower(F.trim(text))
    a = F.regexp_extract(t, SIZE_PATTERN, 1).try_cast("double")
    b = F.regexp_extract(t, SIZE_PATTERN, 2).try_cast("double")
    unit = _unit(F.regexp_extract(t, SIZE_PATTERN, 3))
    pair = lambda x, y: F.struct(x.alias("a_in"), y.alias("b_in"))
    out = F.when((a > 0) & (b > 0) & unit.isNotNull(), pair(a * unit, b * unit))
    for name, (x, y) in NAMED_SIZES.items():
        out = F.when(t == name, pair(F.lit(x), F.lit(y))).otherwise(out)
    return out


def length_inches(text: Column) -> Column:
    """A length such as ``3mm`` in inches, zero allowed; null when it cannot be read."""
    t = F.lower(F.trim(text))
    return F.regexp_extract(t, LENGTH_PATTERN, 1).try_cast("double") * _unit(F.regexp_extract(t, LENGTH_PATTERN, 2))


def natural_key(name: Column) -> Column:
    """Sort key that puts ``page-2`` before ``page-10``: runs of digits as numbers, before text, without case."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)
    digits = lambda p: p.rlike("^[0-9]+$")
    return F.transform(
        parts,
        lambda p: F.struct(F.when(digits(p), 0).otherwise(1).alias("kind"), F.when(digits(p), p.try_cast("decimal(38,0)")).otherwise(F.lit(0)).alias("number"), F.when(digits(p), "").otherwise(F.lower(p)).alias("text")),
    )


def slug(name: Column) -> Column:
    """A file-safe form of a name."""
    s = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "-"), "^[-.]+|[-.]+$", "")
    return F.when(s == "", "page").otherwise(s)


def stem(index: Column, name: Column) -> Column:
    """Output name of a page: its padded number and its slug. Numbers over 999 keep their digits."""
    n = index.cast("string")
    return F.concat(F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")), F.lit("-"), slug(name))


def is_photo(file_name: Column) -> Column:
    ending = F.lower(F.regexp_extract(file_name, r"(\.[^.]+)$", 1))
    return ending.isin(*PHOTO_ENDINGS) & ~file_name.startswith(".")


def canonical_id(text: Column) -> Column:
    """A UUID in lower case; null for anything else."""
    return F.when(F.lower(text).rlike(UUID_PATTERN), F.lower(text))


def utc_time(text: Column) -> Column:
    """A client's ISO 8601 time in UTC with milliseconds; null for anything else."""
    whole = F.regexp_replace(text, r"(\.[0-9]{1,6})[0-9]*", "$1")
    return F.when(text.rlike(TIME_PATTERN), F.date_format(F.try_to_timestamp(whole), TIME_OUT))


def is_jpeg_start(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 2)) == "FFD8"


def content_key(*fields: Column) -> Column:
    """Hash of named values as JSON; give the fields sorted by name so that equal inputs give equal keys."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def general_number(value: Column) -> Column:
    """A number without trailing zeros, at most six significant decimals."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")

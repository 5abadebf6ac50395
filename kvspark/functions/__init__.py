"""Column functions: sizes of records and files, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bytes of a record's header, of a file's header and of its footer.
RECORD_HEADER, FILE_HEADER, FILE_FOOTER = 9, 20, 32


def varlen(n: Column) -> Column:
    """Bytes of a base-128 length."""
    out = F.lit(5)
    for k in (4, 3, 2, 1):
        out = F.when(n < (1 << 7 * k), F.lit(k)).otherwise(out)
    return out.cast("long")


def record_size(key: Column, value: Column) -> Column:
    """Bytes of an uncompressed record: header, and key and value with their lengths."""
    k, v = F.octet_length(key).cast("long"), F.octet_length(value).cast("long")
    return F.lit(RECORD_HEADER) + varlen(k) + k + varlen(v) + v


def file_size(record_bytes: Column) -> Column:
    return F.lit(FILE_HEADER + FILE_FOOTER) + record_bytes


def padded_size(size: Column, block: int) -> Column:
    """size rounded up to whole blocks."""
    return (F.ceil(size / F.lit(block)) * block).cast("long") if block else size


def discardable_ratio(size: Column, live: Column) -> Column:
    """Share of a file's record bytes that nothing points to; 0 of an empty file."""
    return F.when(size == 0, F.lit(0.0)).otherwise(1 - live / F.nullif(size - (FILE_HEADER + FILE_FOOTER), F.lit(0)))


def ratio_bucket(ratio: Column, epsilon: float = 1e-9) -> Column:
    """LE0, LE20, LE50, LE80 or LE100; what is above 1 counts with the last."""
    out = F.lit("LE100")
    for name, most in (("LE80", 0.8), ("LE50", 0.5), ("LE20", 0.2)):
        out = F.when(ratio <= most, F.lit(name)).otherwise(out)
    return F.when(ratio < epsilon, F.lit("LE0")).otherwise(out)


def property_name(name: Column) -> tuple[Column, Column]:
    """A property's base name and the number that it ends in, or null."""
    return F.regexp_extract(name, r"^(.*?)(\d*)$", 1), F.regexp_extract(name, r"(\d*)$", 1).try_cast("int")

"""Identity by content: canonical JSON, digests and short ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Column) -> Column:
    """Compact JSON text. Structs must list their fields in alphabetical order; nulls are kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    """`sha256:` and the hex digest of a string's UTF-8 bytes or of a binary."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def short_id(prefix: str, text: Column, length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def set_digest(values: Column) -> Column:
    """The digest of an array of strings as a set: order and repeats don't matter."""
    return digest(canonical(F.array_sort(F.array_distinct(values))))


def utc_text(at: Column) -> Column:
    """A timestamp as UTC text of second precision; null stays null."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_code(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z 0-9 . _ - as one dash, none of -._ at the ends."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-")
    return F.btrim(dashed, F.lit("-._"))

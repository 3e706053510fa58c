"""Numeric, date, array, map and label functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SECTION_LABELS


def clamp(c: Column) -> Column:
    """0 to 1; what is no number is 0; NaN stays NaN."""
    x = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-6))


def context_chars(tokens: int, chars_per_token: float = 3.5, safety: float = 0.75) -> int:
    n = int(tokens * chars_per_token * safety)
    return n if n > 0 else 8000


def iso_timestamp(c: Column) -> Column:
    """ISO 8601 as UTC; without a zone it is UTC; null where it is none."""
    s = F.trim(c)
    zoned = s.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, s).otherwise(F.concat(s, F.lit("Z"))))


def epoch_timestamp(c: Column) -> Column:
    """Seconds or, from 12 digits on, milliseconds."""
    return F.when(F.length(F.abs(c).cast("string")) >= 12, F.timestamp_millis(c)).otherwise(F.timestamp_seconds(c))


def year_of(c: Column) -> Column:
    return F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int")


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")


def text_list(c: Column) -> Column:
    """Trimmed non-empty entries, first of equals, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def pad(c: Column, n: int, fill: str = "") -> Column:
    """Exactly n entries: cut, or filled up."""
    return F.concat(F.slice(c, 1, n), F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(c), F.lit(0))))


def overlap_of_larger(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def small_map(c: Column, entries: int, chars: int = 512) -> Column:
    """At most so many non-empty entries, values cut to chars."""
    kept = F.filter(F.map_entries(c), lambda e: (F.trim(e["key"]) != "") & e["value"].isNotNull() & (F.trim(e["value"]) != ""))
    return F.map_from_entries(F.transform(F.slice(kept, 1, entries), lambda e: F.struct(F.trim(e["key"]), F.substring(F.trim(e["value"]), 1, chars))))


def section_label(c: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x.isin(*SECTION_LABELS), x).otherwise("unknown")


def one_of(c: Column, domain: tuple[str, ...], default: str) -> Column:
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x.isin(*domain), x).otherwise(default)


def table_preview(columns: Column, data: Column, rows: int = 5, cells: int = 8) -> Column:
    """struct of the first rows and columns as text, with the totals."""
    return F.struct(
        F.slice(columns, 1, cells).alias("columns"), F.transform(F.slice(data, 1, rows), lambda r: F.transform(F.slice(r, 1, cells), lambda x: F.coalesce(x.cast("string"), F.lit("")))).alias("rows"),
        F.size(data).alias("total_rows"), F.size(columns).alias("total_columns"),
    )


def coverage_line(name: Column, expected: Column, missing: Column) -> Column:
    """One line on what of the expected is missing."""
    return F.when(expected == 0, F.concat(name, F.lit(": none expected"))).when(F.size(missing) == 0, F.concat(name, F.lit(": complete"))).otherwise(F.concat(name, F.lit(": missing "), F.array_join(F.slice(missing, 1, 8), ", ")))

"""Casts that never change a value: what does not fit becomes NULL and is judged later."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import java_pattern, kind, spark_type, swapped


def strict_int(text: Column, declared: str = "INTEGER") -> Column:
    """Digits with an optional sign, nothing else."""
    t = F.trim(text)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast(spark_type(declared)))


def whole_number(number: Column, declared: str = "INTEGER") -> Column:
    """A numeric value that has no fraction."""
    return F.when(number == F.floor(number), number.try_cast(spark_type(declared)))


def lossless_decimal(value: Column, declared: str) -> Column:
    """A decimal that has not been rounded to fit its scale."""
    d = F.trim(value.cast("string")).try_cast(spark_type(declared))
    return F.when(F.trim(value.cast("string")).try_cast("double") == d.cast("double"), d)


def parse_time(text: Column, formats: list[str]) -> Column:
    """The first format that reads the text."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(java_pattern(f))).cast("timestamp_ntz") for f in formats])


def readings(text: Column, formats: list[str]) -> Column:
    """All different readings under the formats and their day/month twins."""
    every = list(dict.fromkeys([*formats, *filter(None, map(swapped, formats))]))
    t = F.trim(text)
    found = [F.try_to_timestamp(t, F.lit(java_pattern(f))).cast("timestamp_ntz") for f in every]
    return F.array_distinct(F.array_compact(F.array(*found)))


def ambiguous(text: Column, formats: list[str]) -> Column:
    return F.size(readings(text, formats)) > 1


def shift_zone(ts: Column, source: str, reporting: str) -> Column:
    """Local time of one zone as local time of another; in an overlap the later offset counts."""
    if source == reporting:
        return ts
    plain = F.convert_timezone(F.lit(source), F.lit(reporting), ts)
    # an hour that comes twice: an hour more still maps to the same local hour plus none
    later = plain + F.expr("INTERVAL 1 HOUR")
    back = F.convert_timezone(F.lit(reporting), F.lit(source), later)
    return F.when(back == ts, later).otherwise(plain)


def typed(raw: Column, declared: str, formats: list[str] | None = None, is_text: bool = True, trim: bool = False) -> Column:
    """``raw`` as its declared type, NULL where it does not fit."""
    k = kind(declared)
    if k == "text":
        s = raw.cast("string")
        return F.trim(s) if trim else s
    if k == "integer":
        return strict_int(raw, declared) if is_text else whole_number(raw, declared)
    if k == "decimal":
        return lossless_decimal(raw, declared)
    if k in ("date", "timestamp") and is_text and formats:
        return parse_time(raw, formats).cast(spark_type(declared))
    return raw.try_cast(spark_type(declared))

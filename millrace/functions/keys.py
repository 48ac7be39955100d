"""Surrogate keys, content hashes and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical(c: Column, spark_type: str) -> Column:
    """The text that stands for a key value."""
    if spark_type == "string":
        return F.trim(c)
    if spark_type.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if spark_type == "date":
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def _packed(cols: list[tuple[Column, str]]) -> Column:
    return F.to_json(F.struct(*[canonical(c, t).alias(f"k{i}") for i, (c, t) in enumerate(cols)]), _KEEP_NULLS)


def surrogate_key(cols: list[tuple[Column, str]], salt: str | None = None) -> Column:
    """md5 over the JSON of the canonical key columns; salted where a key column is masked."""
    text = _packed(cols)
    return F.md5(text if salt is None else F.concat(F.lit(salt), text))


def content_hash(cols: list[Column]) -> Column:
    """Equal for rows with equal values, NULLs included."""
    return F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), _KEEP_NULLS))


def mask(c: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt), c.cast("string")))


def raw_json(cols: dict[str, Column], hidden: set[str], salt: str) -> Column:
    """The row as JSON, with the values of hidden columns hashed."""
    shown = [(mask(c, salt) if n in hidden else c.cast("string")).alias(n) for n, c in cols.items()]
    return F.to_json(F.struct(*shown), _KEEP_NULLS)

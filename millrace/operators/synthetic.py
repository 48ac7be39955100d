"""Planted faults and their score: which were found, with the right reason, and what was blamed without cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plant(rows: DataFrame, key: str, faults: dict[str, tuple[str, Column]], every: int = 50, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Rows with faults, and the truth (key, reason).

    ``faults``: reason to (column, faulty value); a row takes at most one, chosen by a hash of its key, so that the same
    input always gets the same faults.
    """
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(every * len(faults)))
    out, truth = rows, None
    for k, (reason, (column, value)) in enumerate(sorted(faults.items())):
        hit = slot == k
        out = out.withColumn(column, F.when(hit, value).otherwise(F.col(column)))
        truth = F.when(hit, F.lit(reason)) if truth is None else truth.when(hit, F.lit(reason))
    marked = rows.select(F.col(key), truth.alias("planted")).where(F.col("planted").isNotNull())
    return out, marked


def score(truth: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """(verdict, planted, reason, n): found, wrong_reason, missed, false_positive."""
    t = truth.select(F.col(key).alias("k"), "planted")
    d = dead.select(F.col(key).alias("k"), "reason").distinct()
    met = t.join(d, "k", "full")
    verdict = (
        F.when(F.col("planted").isNull(), "false_positive")
        .when(F.col("reason").isNull(), "missed")
        .when(F.col("planted") == F.col("reason"), "found")
        .otherwise("wrong_reason")
    )
    return met.groupBy(verdict.alias("verdict"), "planted", "reason").agg(F.count("*").alias("n"))

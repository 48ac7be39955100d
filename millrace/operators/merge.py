"""Merging a batch of finished rows into a published table: one plan gives the new table, one the counts.

Parquet tables cannot be changed in place, so a merge reads version N and the caller writes version N + 1
(sources.store).  Target and batch meet once, in a full join on the surrogate key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.specs import Entity


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("_sk"), F.struct("*").alias(name))


def _newer(spec: Entity) -> Column:
    """Whether the batch's row is newer; equal versions are not."""
    f, t = F.col(f"f.{spec.version}"), F.col(f"t.{spec.version}")
    return F.coalesce((f > t) | (t.isNull() & f.isNotNull()), F.lit(False))


def _partition_filter(target: DataFrame, touched: DataFrame, spec: Entity) -> DataFrame:
    keys = touched.select("_src", *spec.partition).distinct()
    on = reduce(lambda a, b: a & b, [target[c].eqNullSafe(keys[c]) for c in ["_src", *spec.partition]])
    return target.join(keys, on, "left_anti")


def classify(
    target: DataFrame, batch: DataFrame, spec: Entity, present: DataFrame | None = None, feeds: list[str] | None = None
) -> DataFrame:
    """_sk, t, f and ``action`` of every key of either side, from one full join.

    snapshot_diff: ``present`` are the keys that the snapshot holds in any state, rejected ones too (default the batch); ``feeds`` are the
    sources that it speaks for (default those of ``present``).
    """
    new, known = F.col("t").isNull() & F.col("f").isNotNull(), F.col("t").isNotNull() & F.col("f").isNotNull()
    right = _side(batch, "f")
    if spec.strategy == "append":
        action = F.when(new, "inserted").when(known, "already_present")
    elif spec.strategy == "upsert_by_version":
        action = F.when(new, "inserted").when(known & _newer(spec), "updated").when(known, "stale")
    elif spec.strategy == "cdc_apply":
        gone = F.col("f._is_deleted")
        action = (
            F.when(new & gone, "stale")
            .when(new, "inserted")
            .when(known & ~_newer(spec), "stale")
            .when(known & gone, "deleted")
            .when(known, "updated")
        )
    elif spec.strategy == "snapshot_diff":
        keys = batch if present is None else present
        if feeds is None:
            feeds = [r._src for r in keys.select("_src").distinct().collect()]  # one per source of the batch
        # keys of the snapshot without a row of the batch; grouped by what the join needs, so they are not shuffled twice
        kind = right.schema["f"].dataType
        marks = keys.select("_sk", F.lit(None).cast(kind).alias("f"))
        right = right.unionByName(marks).groupBy("_sk").agg(F.first("f", ignorenulls=True).alias("f"), F.lit(True).alias("_seen"))
        absent = F.col("f").isNull() & F.col("_seen").isNull() & F.col("t._src").isin(*feeds) & ~F.col("t._is_deleted")
        action = (
            F.when(new, "inserted")
            .when(known & F.col("t._is_deleted"), "reactivated")
            .when(known & (F.col("t._row_hash") != F.col("f._row_hash")), "updated")
            .when(known, "unchanged")
            .when(absent, "deleted")
        )
    else:
        raise ValueError(f"{spec.strategy} does not merge by key")
    df = _side(target, "t").join(right, "_sk", "full")
    return df.withColumn("action", F.coalesce(action, F.lit("untouched"))).where("t is not null or f is not null")


def staged(
    target: DataFrame, batch: DataFrame, spec: Entity, touched: DataFrame | None = None, feeds: list[str] | None = None
) -> DataFrame:
    """The table after the batch, with ``_action``: how each row got there.

    ``touched``: for partition_replace all outcome rows of the batch (their partitions are replaced even if nothing
    survived), for snapshot_diff the keys present.
    """
    batch = batch.select(*target.columns)
    if spec.strategy == "partition_replace":
        kept = _partition_filter(target, batch if touched is None else touched, spec)
        return kept.withColumn("_action", F.lit("untouched")).unionByName(batch.withColumn("_action", F.lit("inserted")))
    df = classify(target, batch, spec, touched, feeds)
    taken = F.col("action").isin("inserted", "updated", "reactivated")
    df = df.where(~(F.col("t").isNull() & (F.col("action") == "stale")))
    row = F.when(taken, F.col("f")).otherwise(F.col("t"))
    out = []
    for c in target.columns:
        value = row.getField(c)
        if c == "_is_deleted":
            value = F.when(F.col("action") == "deleted", True).otherwise(value)
        elif spec.strategy == "cdc_apply" and c == spec.version:
            # a delete keeps the last values but moves the sequence on
            value = F.when(F.col("action") == "deleted", F.col(f"f.{c}")).otherwise(value)
        out.append(value.alias(c))
    return df.select(*out, F.col("action").alias("_action"))


def apply(
    target: DataFrame, batch: DataFrame, spec: Entity, touched: DataFrame | None = None, feeds: list[str] | None = None
) -> DataFrame:
    """The table after the batch."""
    return staged(target, batch, spec, touched, feeds).drop("_action")


def ignored_deletes(target: DataFrame, batch: DataFrame, spec: Entity) -> dict[str, int]:
    """Deletes of keys that the table does not have, as a term; they leave no row behind."""
    if spec.strategy != "cdc_apply":
        return {}
    return {"stale": batch.where("_is_deleted").join(target.select("_sk"), "_sk", "left_anti").count()}


def terms(target: DataFrame, batch: DataFrame, spec: Entity, touched: DataFrame | None = None) -> DataFrame:
    """(action, n) of a merge; inserted minus removed is the change in rows."""
    if spec.strategy == "partition_replace":
        kept = _partition_filter(target, batch if touched is None else touched, spec)
        removed = target.agg(F.count("*").alias("a")).crossJoin(kept.agg(F.count("*").alias("b")))  # one row each
        gone = removed.select(F.lit("removed").alias("action"), (F.col("a") - F.col("b")).alias("n"))
        return batch.agg(F.count("*").alias("n")).select(F.lit("inserted").alias("action"), "n").unionByName(gone)
    df = classify(target, batch, spec, touched)
    return df.where("action <> 'untouched'").groupBy("action").agg(F.count("*").alias("n"))


def withdraw(target: DataFrame, outcome: DataFrame, batch: DataFrame, spec: Entity) -> DataFrame:
    """Soft-deletes stored rows whose newest delivery was rejected (reject_key), unless the stored one is newer."""
    rejected = outcome.where("_key_ok AND _rank_all = 1 AND _outcome = 'dead_letter'")
    rejected = rejected.join(batch.select("_sk"), "_sk", "left_anti")
    version = [F.col(spec.version).alias("_v")] if spec.version else [F.lit(None).alias("_v")]
    hit = target.join(rejected.select("_sk", *version, F.lit(True).alias("_w")), "_sk", "left")
    older = F.lit(True) if not spec.version else F.coalesce(F.col("_v") >= F.col(spec.version), F.lit(True))
    gone = F.coalesce(F.col("_w") & older & ~F.col("_is_deleted"), F.lit(False))
    out = [(F.col(c) | gone).alias(c) if c == "_is_deleted" else F.col(c) for c in target.columns]
    return hit.select(*out, *([gone.alias("_withdrawn")] if "_action" in target.columns else []))

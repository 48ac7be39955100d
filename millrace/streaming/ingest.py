"""Structured Streaming front ends: tumbling metrics and change data applied batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import silver, warehouse
from ..operators.checks import demand
from ..plans.specs import Entity
from ..sources.store import Table


def tumbling(events: DataFrame, time: str, size: str, late: str, keys: list[str], **aggregates) -> DataFrame:
    """Aggregates per window and key; rows later than ``late`` are dropped, state is bounded by it."""
    w = F.window(F.col(time), size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggregates)


def apply_changes(
    spark: SparkSession, folder: str, schema: StructType, spec: Entity, table: Table, checkpoint: str, references: dict | None = None
) -> StreamingQuery:
    """Files of change data into a versioned table; a micro-batch goes the way of any other batch, proofs and dead letters included.

    A micro-batch that is run again after a crash merges to the same table: a change that is not newer is stale, an appended key is
    there already, a replaced partition is replaced by the same rows.
    """
    references = references or {}
    demand(warehouse.reference_proofs(spec, references))

    def one(rows: DataFrame, batch: int) -> None:
        landed = rows.count()
        if landed:
            named = silver.with_provenance(rows, spec.name, str(batch), order=rows.columns)
            built = silver.build(named, spec, references).persist()
            try:
                where = f"{table.root}_dead_letters/_src={spec.name}/_batch={batch}"
                warehouse._run_batch(spark, spec, built, landed, spec.name, table, None, where, None)
            finally:
                built.unpersist()

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

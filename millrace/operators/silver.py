"""From landed rows to published ones: typed, judged, ranked, finished.  Every stage is DataFrame to DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import casts, keys
from ..functions.fragments import column, holds
from ..plans.specs import Entity, Field

#: Classes of fields whose raw values may leave in dead letters.
OPEN = ("open", "public", "internal")
PROVENANCE = ["_src", "_batch_id", "_batch_version", "_source_file", "_row_number"]


def with_provenance(df: DataFrame, source: str, batch: str = "full", version: int = 1, order: list[str] | None = None) -> DataFrame:
    """Adds what is missing of the provenance columns.

    Scans number rows as they stand in their file (sources.scan).  Rows without a number get a hash of their ``order``
    columns (default: all): no meaning, but the same in every run and without a shuffle; rows that share it are equal there.
    """
    new = {"_src": F.lit(source), "_batch_id": F.lit(batch), "_batch_version": F.lit(version), "_source_file": F.lit(source)}
    df = df.withColumns({c: v for c, v in new.items() if c not in df.columns})
    if "_row_number" not in df.columns:
        values = [F.col(f"`{c}`") for c in (order or [c for c in df.columns if c not in new])]
        df = df.withColumn("_row_number", F.pmod(F.xxhash64(*values), F.lit((1 << 62) - 1)))
    return df


def latest_versions(df: DataFrame) -> DataFrame:
    """Rows of the newest version of each batch; versions are aggregated before they meet the rows."""
    newest = df.groupBy("_batch_id").agg(F.max("_batch_version").alias("_batch_version"))
    return df.join(newest, ["_batch_id", "_batch_version"])


def _split_columns(spec: Entity) -> list[str]:
    return sorted({col for f in spec.fields for _, col, _ in f.structural_in if col})


def _structural(f: Field) -> Column:
    """Whether NULL is expected: by the field's predicate, by its source, or by its source and the value of a split column."""
    cases = [holds(f.structural)] if f.structural else []
    for source, col, value in f.structural_in:
        here = F.col("_src") == source
        cases.append(here if col is None else here & F.coalesce(F.col(f"_split__{col}") == value, F.lit(False)))
    return reduce(lambda a, b: a | b, cases, F.lit(False))


def _is_text(rows: DataFrame, value: Column) -> bool:
    """What an expression gives, from its analysis."""
    return rows.select(value.alias("x")).dtypes[0][1] == "string"


def typed(rows: DataFrame, spec: Entity) -> DataFrame:
    """Raw and typed values side by side, with key, content hash and the delete mark."""
    kinds = dict(rows.dtypes)
    out: list[Column] = [F.col(c) for c in PROVENANCE if c in rows.columns]
    for f in spec.fields:
        raw = column(f.expression, rows.columns) if f.expression else F.lit(None).cast("string")
        is_text = f.expression is None or kinds.get(f.expression) == "string" or f.expression not in kinds and _is_text(rows, raw)
        value = casts.typed(raw, f.type, list(f.formats), is_text, trim=f.key)
        if f.zone and f.spark_type == "timestamp_ntz":
            value = casts.shift_zone(value, f.zone, spec.reporting_zone)
        out += [raw.alias(f"_raw__{f.name}"), value.cast(f.spark_type).alias(f.name)]
        if f.formats:
            out.append(F.coalesce(casts.ambiguous(raw, list(f.formats)), F.lit(False)).alias(f"_amb__{f.name}"))
        if f.allowed:
            bad = raw.isNotNull() & ~F.trim(raw.cast("string")).isin(*f.allowed)
            out.append(F.coalesce(bad, F.lit(False)).alias(f"_dom__{f.name}"))
    out += [F.col(f"`{c}`").cast("string").alias(f"_split__{c}") for c in _split_columns(spec)]
    if spec.op:
        out.append(F.trim(column(spec.op, rows.columns).cast("string")).alias("_op"))
    df = rows.select(*out)
    masked = any(f.mask != "keep" for f in spec.keys)
    ok = reduce(lambda a, b: a & b, [F.col(f.name).isNotNull() for f in spec.keys])
    deletes = [o for o, what in spec.ops if what == "delete"]
    return df.withColumns(
        {
            "_sk": keys.surrogate_key([(F.col(f.name), f.spark_type) for f in spec.keys], spec.salt if masked else None),
            "_content": keys.content_hash([F.col(f.name) for f in spec.fields]),
            "_key_ok": ok,
            "_is_del": F.coalesce(F.col("_op").isin(*deletes), F.lit(False)) if spec.op else F.lit(False),
        }
    )


def look_up(rows: DataFrame, spec: Entity, references: dict[str, DataFrame]) -> DataFrame:
    """Left joins with published references; Spark broadcasts those it finds small."""
    for lk in spec.lookups:
        ref = references[lk.table]
        if "_is_deleted" in ref.columns:
            ref = ref.where("NOT _is_deleted")
        mine = [F.col(b).alias(f"_on{k}") for k, (_, b) in enumerate(lk.on)]
        ref = ref.select(*mine, *[F.col(c).alias(f"{lk.name}_{c}") for c in lk.columns], F.lit(True).alias(f"_hit__{lk.name}"))
        own = [keys.mask(F.col(a), spec.salt) if a in lk.hashed else F.col(a) for a, _ in lk.on]
        on = reduce(lambda a, b: a & b, [x == ref[f"_on{k}"] for k, x in enumerate(own)])
        rows = rows.join(ref, on, "left").drop(*[f"_on{k}" for k in range(len(lk.on))])
    return rows


def duplicate_reference_keys(reference: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that a reference has more than once (a lookup on it would multiply rows)."""
    return reference.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def reasons(spec: Entity) -> list[tuple[str, Column]]:
    """(reason, condition) in order of precedence; the first that holds is the row's reason."""
    alive = ~F.col("_is_del")
    lost = lambda f: F.col(f"_raw__{f.name}").isNotNull() & F.col(f.name).isNull()
    found = [(f"cast_{f.name}", lost(f)) for f in spec.keys]
    found.append(("null_key", ~F.col("_key_ok")))
    if spec.op:
        found.append(("unknown_op", F.col("_op").isNull() | ~F.col("_op").isin(*[o for o, _ in spec.ops])))
    others = [f for f in spec.fields if not f.key]
    found += [(f"cast_{f.name}", lost(f)) for f in others]
    found += [(f"ambiguous_date_{f.name}", F.col(f"_amb__{f.name}")) for f in spec.fields if f.formats and f.ambiguous == "reject"]
    found += [(f"null_{f.name}", alive & F.col(f.name).isNull() & ~_structural(f)) for f in others if f.null_policy == "drop"]
    found += [(f"domain_{f.name}", alive & F.col(f"_dom__{f.name}")) for f in spec.fields if f.allowed]
    found += [(name, alive & holds(p)) for name, p in spec.hard_rejects]
    for lk in spec.lookups:
        if lk.missing == "reject":
            mine = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a, _ in lk.on])
            found.append((f"missing_{lk.name}", alive & mine & F.col(f"_hit__{lk.name}").isNull()))
    return found


def _first_of(named: list[tuple[str, Column]]) -> Column:
    out = None
    for name, condition in named:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def judged(rows: DataFrame, spec: Entity, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """One reject reason, one anomaly and one hard-reject tag per row (NULL: none)."""
    df = look_up(rows, spec, references or {})
    alive = ~F.col("_is_del")
    return df.withColumns(
        {
            "_reason": _first_of(reasons(spec)),
            "_anomaly": _first_of([(n, alive & holds(p)) for n, p in spec.anomalies]),
            "_hard": _first_of([(n, alive & holds(p)) for n, p in spec.hard_rejects]),
        }
    )


def survivor_order(spec: Entity) -> list[Column]:
    """Declared tiebreakers, then the newest delivery; NULLs last whatever the direction."""
    declared = [F.col(c).desc_nulls_last() if o == "desc" else F.col(c).asc_nulls_last() for c, o in spec.tiebreakers]
    newest = [F.col(c).desc_nulls_last() for c in ("_batch_version", "_source_file", "_row_number")]
    return [*declared, *newest]


def outcome(rows: DataFrame, spec: Entity) -> DataFrame:
    """survivor, duplicate or dead_letter for every row, with the dead letter's reason.

    One window over the key serves both ranks and the key's acceptance, so rows are shuffled once.  Rows without a
    valid key never compete; they are spread evenly instead of meeting under one key.
    """
    alone = F.concat(F.lit("!"), F.monotonically_increasing_id().cast("string"))
    spread = F.when(F.col("_key_ok"), F.col("_sk")).otherwise(alone)
    df = rows.withColumn("_group", spread).withColumn("_good", F.col("_key_ok") & F.col("_reason").isNull())
    w = Window.partitionBy("_group").orderBy(*survivor_order(spec))
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns(
        {
            "_rank_all": F.row_number().over(w),
            "_goods": F.sum(F.col("_good").cast("int")).over(before),
            "_newest_good": F.first("_good").over(before),
        }
    )
    # by the time the first good row comes, whether the newest was good is known from the same ordered pass
    accepted = F.lit(True) if spec.accept == "keep_last_good" else F.col("_newest_good")
    survives = F.col("_good") & (F.col("_goods") == 1) & accepted
    result = F.when(survives, "survivor").when(F.col("_good") & accepted, "duplicate").otherwise("dead_letter")
    why = F.when(result == "dead_letter", F.coalesce("_reason", F.when(F.col("_key_ok"), "key_rejected").otherwise("null_key")))
    return df.withColumns({"_outcome": result, "_dl_reason": why}).drop("_group", "_good", "_goods", "_newest_good")


def finished(rows: DataFrame, spec: Entity, loaded_at: str | None = None) -> DataFrame:
    """Survivors as they are published: imputed, flagged, masked, hashed."""
    df = rows.where(F.col("_outcome") == "survivor")
    for f in spec.fields:
        if f.null_policy == "impute":
            gap = F.col(f.name).isNull() & ~_structural(f) & ~F.col("_is_del")
            df = df.withColumn(f"is_{f.name}_imputed", gap)
            df = df.withColumn(f.name, F.when(F.col(f"is_{f.name}_imputed"), column(f.impute, []).cast(f.spark_type)).otherwise(F.col(f.name)))
    flags = [holds(p).alias(n) for n, p in spec.flags]
    shown = [(keys.mask(F.col(f.name), spec.salt) if f.mask == "hash" else F.col(f.name)).alias(f.name) for f in spec.published]
    imputed = [F.col(f"is_{f.name}_imputed") for f in spec.fields if f.null_policy == "impute"]
    joined = [F.col(f"{lk.name}_{c}") for lk in spec.lookups for c in lk.columns]
    meta = [F.col(c) for c in PROVENANCE if c in rows.columns]
    stamp = F.lit(loaded_at).cast("timestamp_ntz")
    df = df.select("_sk", *shown, *imputed, *joined, *flags, *meta, stamp.alias("_loaded_at"), F.col("_is_del").alias("_is_deleted"))
    values = [c for c in df.columns if c != "_sk" and c not in PROVENANCE and c != "_loaded_at"]
    return df.withColumn("_row_hash", keys.content_hash([F.col(c) for c in values]))


def dead_letters(rows: DataFrame, spec: Entity, hidden: set[str] | None = None) -> DataFrame:
    """Rejected rows in one fixed shape, raw values as JSON.

    Values of masked fields and of all fields that are not classified as open are hashed.
    """
    raw = {f.name: F.col(f"_raw__{f.name}") for f in spec.fields}
    closed = {f.name for f in spec.fields if f.mask != "keep" or f.classification not in OPEN}
    body = keys.raw_json(raw, closed if hidden is None else hidden, spec.salt)
    return rows.where(F.col("_outcome") == "dead_letter").select(
        F.lit(spec.name).alias("entity"), *PROVENANCE, "_sk", F.col("_dl_reason").alias("reason"), F.col("_anomaly").alias("anomaly"), body.alias("raw_row")
    )


def counters(rows: DataFrame) -> DataFrame:
    """All outcome counts in one pass."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    o = F.col("_outcome")
    return rows.agg(
        F.count("*").alias("rows_in"),
        n(o == "survivor").alias("survivors"),
        n(o == "duplicate").alias("duplicates"),
        n(o == "dead_letter").alias("dead_letters"),
        n(~F.col("_key_ok")).alias("bad_keys"),
        n(F.col("_anomaly").isNotNull()).alias("anomalies"),
        n(F.col("_anomaly").isNotNull() & (o == "survivor")).alias("anomalies_kept"),
        n(F.col("_anomaly").isNotNull() & F.col("_hard").isNotNull()).alias("conflicts"),
        n(F.col("_is_del")).alias("deletes"),
        n((o == "survivor") & F.col("_reason").startswith("cast_")).alias("cast_losses"),
    )


def ties(rows: DataFrame, spec: Entity) -> DataFrame:
    """Keys whose rows differ in content though the declared tiebreakers do not tell them apart."""
    order = [c for c, _ in spec.tiebreakers]
    return rows.where("_key_ok").groupBy("_sk", *order).agg(F.countDistinct("_content").alias("contents")).where("contents > 1")


def reason_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("_outcome = 'dead_letter'").groupBy(F.col("_dl_reason").alias("reason")).agg(F.count("*").alias("n"))


def build(rows: DataFrame, spec: Entity, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """typed, judged and ranked rows; callers persist the result when they take more than one thing from it."""
    return outcome(judged(typed(rows, spec), spec, references), spec)

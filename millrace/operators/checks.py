"""Proofs as rows: how much was looked at, how much of it was bad, and whether that stops the work."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.specs import Entity


class Proof(NamedTuple):
    """A proof that looked at nothing has proven nothing."""

    id: str
    evaluated: int
    bad: int
    note: str = ""
    fatal: bool = True

    @property
    def holds(self) -> bool:
        return self.evaluated > 0 and self.bad == 0


class CheckFailed(RuntimeError):
    """Proofs that did not hold; what they were about is as it was before."""

    def __init__(self, proofs: Iterable[Proof]):
        self.proofs = list(proofs)
        super().__init__("; ".join(f"{p.id}: {p.note or f'{p.bad} of {p.evaluated}'}" for p in self.proofs))


def demand(proofs: list[Proof]) -> list[Proof]:
    """The proofs, if every fatal one holds."""
    bad = [p for p in proofs if p.fatal and not p.holds]
    if bad:
        raise CheckFailed(bad)
    return proofs


def _off(got: int, want: int) -> int:
    return abs((got or 0) - (want or 0))


def batch_proofs(
    spec: Entity, landed: int, count, batch: DataFrame, before: int, expected_before: int | None, staged: DataFrame, unseen: dict[str, int], ties: int, dead: int
) -> tuple[list[Proof], dict[str, int]]:
    """Proofs of one batch on the version as it was written, and the merge's terms.

    ``landed`` is counted on the batch before any lookup, ``count`` on its outcome; ``unseen`` are terms that leave no trace on a row.
    """
    keys = [f.name for f in spec.keys if f.mask != "drop"]
    null_key = F.lit(False)
    for k in keys:
        null_key |= F.col(k).isNull()
    if "_withdrawn" not in staged.columns:
        staged = staged.withColumn("_withdrawn", F.lit(False))
    by = staged.groupBy("_action").agg(
        F.count("*").alias("n"), F.count_if(null_key).alias("null_keys"), F.count_if("_withdrawn").alias("withdrawn")
    )
    found = by.collect()  # one row per kind of outcome
    n = {r._action: r.n for r in found}
    after = sum(n.values())
    if spec.strategy == "partition_replace":
        n = {"inserted": n.get("inserted", 0), "removed": before - n.get("untouched", 0)}
        outcomes = n["inserted"]
    else:
        n.pop("untouched", None)
        n |= {k: n.get(k, 0) + v for k, v in unseen.items()}
        outcomes = sum(v for k, v in n.items() if not (k == "deleted" and spec.strategy == "snapshot_diff"))
    change = n.get("inserted", 0) - n.get("removed", 0)
    n["withdrawn"] = sum(r.withdrawn for r in found)
    doubles = staged.groupBy("_sk").count().where("count > 1").limit(1).count()
    back = 0
    if spec.version and spec.strategy in ("upsert_by_version", "cdc_apply"):
        now = staged.select("_sk", F.col(spec.version).alias("_now"))
        back = batch.select("_sk", spec.version).join(now, "_sk").where(F.col(spec.version) > F.col("_now")).limit(1).count()
    done, some = count.survivors + count.duplicates + count.dead_letters, max(after, 1)
    share = 100.0 * count.dead_letters / max(count.rows_in, 1)
    proofs = [
        Proof("row_law", landed, _off(landed, done), f"{landed} landed, {done} accounted for"),
        Proof("one_outcome_per_survivor", max(count.survivors, 1), _off(count.survivors, outcomes), f"{count.survivors} survivors, {outcomes} merge outcomes"),
        Proof("table_change", some, _off(after - before, change), f"{before} to {after}, expected {change:+d}"),
        Proof("untouched_since", 1, 0 if expected_before is None else _off(before, expected_before), f"{before} rows, the last batch left {expected_before}"),
        Proof("dead_letters_kept", 1, _off(dead, count.dead_letters), f"{count.dead_letters} rejected, {dead} written"),
        Proof("ties_separated", count.rows_in, ties),
        Proof("one_row_per_key", some, doubles),
        Proof("no_cast_loss", count.rows_in, count.cast_losses),
        Proof("no_null_key", some, sum(r.null_keys for r in found)),
        Proof("anomaly_or_reject", count.rows_in, count.conflicts),
        Proof("anomalies_kept", 1, 0, f"{count.anomalies_kept} of {count.anomalies}", fatal=False),
        Proof("within_tolerance", count.rows_in, int(share > spec.tolerance), f"{share:.2f} % rejected, {spec.tolerance} % allowed"),
        Proof("only_forward", max(count.survivors, 1), back),
    ]
    return proofs, {k: v for k, v in n.items() if v}

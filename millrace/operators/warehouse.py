"""Building an entity's table batch by batch: what is pending, when history is replayed, commit after proof."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fragments import Refused, validate
from ..plans.specs import Entity
from ..sources.files import Files
from ..sources.store import Table
from . import checks, merge, silver
from .checks import CheckFailed, Proof, demand


def build_order(entities: Iterable[Entity]) -> list[Entity]:
    """Entities after the ones they look up; raises ValueError on a cycle."""
    left = {e.name: e for e in entities}
    done: list[Entity] = []
    while left:
        ready = [e for e in left.values() if not any(lk.table in left and lk.table != e.name for lk in e.lookups)]
        if not ready:
            raise ValueError(f"lookups form a cycle: {', '.join(sorted(left))}")
        for e in sorted(ready, key=lambda e: e.name):
            done.append(left.pop(e.name))
    return done


def signature(spec: Entity, references: dict[str, int] | None = None) -> str:
    """Changes when the declaration or a reference's version does."""
    return hashlib.md5(repr((spec, sorted((references or {}).items()))).encode()).hexdigest()


class History:
    """Batches merged so far and the rows they left, in a JSON file that is written after the table's commit."""

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, path
        text = files.read(path)
        self.state = json.loads(text) if text else {"signature": None, "batches": [], "rows": None}

    def save(self) -> None:
        self.files.write(self.path, json.dumps(self.state, indent=1))


def batches_of(bronze: DataFrame, order: Callable = lambda b: b) -> list[tuple[str, str, int]]:
    """(source, batch, newest version) in batch order; one row per batch comes to the driver."""
    newest = bronze.groupBy("_src", "_batch_id").agg(F.max("_batch_version").alias("v")).collect()
    return sorted(((r._src, r._batch_id, r.v) for r in newest), key=lambda x: (order(x[1]), x[0]))


def plan(spec: Entity, found: list[tuple[str, str, int]], history: History, sign: str, order: Callable = lambda b: b):
    """(replay, batches to run).

    History is replayed in order when the declaration or a reference changed, when a batch was delivered anew (unless
    partitions are replaced anyway), or when a snapshot arrives that is older than one already merged.
    """
    seen = {(s, b): v for s, b, v in map(tuple, history.state["batches"])}
    new = [x for x in found if seen.get(x[:2], 0) < x[2]]
    changed = bool(seen) and history.state["signature"] != sign
    again = any(x[:2] in seen for x in new) and spec.strategy != "partition_replace"
    late = spec.strategy == "snapshot_diff" and any(
        order(b) < order(c) for s, b, _ in new for t, c in seen if s == t
    )
    replay = changed or again or late
    return replay, found if replay else new


def declaration_problems(spark: SparkSession, spec: Entity, bronze: DataFrame, references: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a declaration, its fragments included; empty if nothing is."""
    found = spec.problems()
    source, own = dict(bronze.dtypes), {f.name: f.spark_type for f in spec.fields}
    for lk in spec.lookups:
        if lk.table not in references:
            found.append(f"lookup {lk.name}: no table {lk.table}")
            continue
        kinds = dict(references[lk.table].dtypes)
        found += [f"lookup {lk.name}: no column {c}" for c in [*lk.columns, *(b for _, b in lk.on)] if c not in kinds]
        own |= {f"{lk.name}_{c}": kinds[c] for c in lk.columns if c in kinds}
    tries = [(f.name, f.expression, source, False) for f in spec.fields if f.expression]
    tries += [(f.name, f.impute, {}, False) for f in spec.fields if f.impute is not None]
    tries += [(f.name, f.structural, own, True) for f in spec.fields if f.structural]
    tries += [(n, p, own, True) for n, p in [*spec.hard_rejects, *spec.anomalies, *spec.flags]]
    tries += [("operation", spec.op, source, False)] if spec.op else []
    for name, fragment, scope, predicate in tries:
        try:
            validate(spark, fragment, scope or {"_": "int"}, predicate)
        except Refused as e:
            found.append(f"{name}: {e}")
    return found


def reference_proofs(spec: Entity, references: dict[str, DataFrame]) -> list[Proof]:
    """A lookup's key must be unique, or it would multiply rows."""
    found = []
    for lk in spec.lookups:
        ref = references[lk.table]
        ref = ref.where("NOT _is_deleted") if "_is_deleted" in ref.columns else ref
        twice = silver.duplicate_reference_keys(ref, [b for _, b in lk.on]).count()
        found.append(Proof(f"reference_unique_{lk.name}", 1, twice, f"{twice} keys of {lk.table} come more than once"))
    return found


def _run_batch(
    spark: SparkSession, spec: Entity, rows: DataFrame, landed: int, source: str, table: Table, expected: int | None, dead_to: str, loaded_at: str | None
) -> dict:
    """One judged batch into the table: the next version is written once, proven as written, and then made visible."""
    done = silver.finished(rows, spec, loaded_at).persist()
    try:
        target = table.read() if table.version else spark.createDataFrame([], done.schema)
        touched = rows if spec.strategy == "partition_replace" else rows.where("_key_ok")
        ignored = merge.ignored_deletes(target, done, spec)
        more = spec.accept != "reject_key" and table.version and not table.many_parts
        if more and spec.strategy == "append":  # of the table, its keys are read and nothing is written again
            mine = done.select(*target.columns)
            fresh = mine.join(target.select("_sk"), "_sk", "left_anti").select(*target.columns).withColumn("_action", F.lit("inserted"))
            version, written = table.stage_more(fresh)
            ignored = {"already_present": mine.join(target.select("_sk"), "_sk", "left_semi").count()}
        elif more and spec.strategy == "partition_replace":
            fresh = done.select(*target.columns).withColumn("_action", F.lit("inserted"))
            version, written = table.stage_more(fresh, touched.select("_src", *spec.partition))
        else:
            after = merge.staged(target, done, spec, touched, [source])
            if spec.accept == "reject_key":
                after = merge.withdraw(after, rows, done, spec)
            version, written = table.stage(after)
        count = silver.counters(rows).first()
        dead = silver.dead_letters(rows, spec)
        dead.write.mode("overwrite").parquet(dead_to)
        kept = spark.read.schema(dead.schema).parquet(dead_to).count()
        ties = silver.ties(rows, spec).limit(1).count()
        proofs, terms = checks.batch_proofs(spec, landed, count, done, target.count(), expected, written, ignored, ties, kept)
        try:
            demand(proofs)
        except CheckFailed:
            table.files.delete(dead_to)
            raise
        table.release(version)
        reasons = {r.reason: r.n for r in silver.reason_histogram(rows).collect()}
        return count.asDict() | {"merge": terms, "reasons": reasons, "rows_after": written.count(), "proofs": [p.id for p in proofs]}
    finally:
        done.unpersist()


def build(
    spark: SparkSession,
    spec: Entity,
    bronze: DataFrame,
    root: str,
    references: dict[str, DataFrame] | None = None,
    versions: dict[str, int] | None = None,
    order: Callable = lambda b: b,
    loaded_at: str | None = None,
) -> list[dict]:
    """Merges pending batches into ``root``/table and writes dead letters beside it; returns a report per batch.

    A batch becomes visible after its proofs hold; a failed one raises CheckFailed and leaves the table as it was.
    """
    references = references or {}
    wrong = declaration_problems(spark, spec, bronze, references)
    if wrong:
        raise ValueError("; ".join(wrong))
    live, files = Table(spark, f"{root}/table"), Files(spark)
    with live.lease():
        history = History(files, f"{root}/history.json")
        sign = signature(spec, versions)
        replay, todo = plan(spec, batches_of(bronze, order), history, sign, order)
        table = live
        if todo:
            demand(reference_proofs(spec, references))
        if replay:  # history is rebuilt aside and swapped in when it is whole
            files.delete(f"{root}/replay")
            table = Table(spark, f"{root}/replay")
            history.state |= {"batches": [], "rows": 0}
        history.state["signature"] = sign
        report = []
        for source, batch, version in todo:
            mine = (F.col("_src") == source) & (F.col("_batch_id") == batch) & (F.col("_batch_version") == version)
            scope = bronze.where(mine)
            rows = silver.build(scope, spec, references).persist()
            try:
                where = f"{root}/dead_letters/_src={source}/_batch={batch}"
                got = _run_batch(spark, spec, rows, scope.count(), source, table, history.state["rows"], where, loaded_at)
            finally:
                rows.unpersist()
            report.append({"source": source, "batch": batch, "version": version, "replayed": replay} | got)
            others = [x for x in history.state["batches"] if tuple(x[:2]) != (source, batch)]
            history.state |= {"batches": [*others, [source, batch, version]], "rows": got["rows_after"]}
            if not replay:
                history.save()
        if replay:
            live.commit(table.read())
            files.delete(f"{root}/replay")
            history.save()
        if live.version and history.state["rows"] is not None:
            now = live.read().count()
            demand([Proof("ledger_rows", 1, abs(now - history.state["rows"]), f"{now} rows, ledger {history.state['rows']}")])
    return report


def export_dead_letters(spark: SparkSession, root: str, to: str) -> None:
    """All dead letters as one ordered CSV folder."""
    dead = spark.read.option("basePath", f"{root}/dead_letters").parquet(f"{root}/dead_letters/*/*")
    dead.orderBy("entity", "_src", "_batch_id", "_row_number").write.mode("overwrite").option("header", True).csv(to)


def lineage(entities: Iterable[Entity], cards: Iterable = ()) -> str:
    """A mermaid graph of sources, entities, lookups and tables."""
    lines = ["graph LR"]
    for e in entities:
        lines.append(f"  bronze_{e.name} --> silver_{e.name}")
        lines += [f"  silver_{lk.table} -. {lk.name} .-> silver_{e.name}" for lk in e.lookups]
    lines += [f"  silver_{entity} --> {card.table}" for entity, card in cards]
    return "\n".join(lines)


#: Fixed shapes of secrets: key blocks, access keys and tokens of public services.
_SECRETS = [
    re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    re.compile(r"\bAKIA[0-9A-Z]{16}\b"),
    re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    re.compile(r"(?i)\b(?:password|passwd|secret|token|api[_-]?key|account[_-]?key)\s*[:=]\s*['\"]?[^\s'\"]{8,}"),
    re.compile(r"(?i)\bbearer\s+[a-z0-9._~+/-]{16,}"),
]
#: Query parameters that carry a signature.
_SIGNED = {"sig", "signature", "x-amz-signature", "x-goog-signature", "access_token", "token"}


def _url_secret(url: str) -> bool:
    """User and password before the host, or a signature among the parameters."""
    try:
        parts = urlsplit(url)
        return bool(parts.username and parts.password) or any(k.lower() in _SIGNED and len(v) >= 8 for k, v in parse_qsl(parts.query))
    except ValueError:
        return False


def has_secret(text: str) -> bool:
    return any(p.search(text) for p in _SECRETS) or any(_url_secret(u) for u in re.findall(r"\w+://[^\s'\"<>]+", text))

"""Declarations: sources, entities and metric cards; YAML values are read as strings only."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.types import kind, spark_type

STRATEGIES = ("append", "upsert_by_version", "partition_replace", "cdc_apply", "snapshot_diff")


@dataclass(frozen=True)
class Field:
    """A column of an entity.

    ``source`` is an expression over the source's columns (None: never supplied); ``null_policy`` is keep, drop or
    impute; ``structural`` is a predicate under which NULL is expected, ``structural_in`` are (source, column, value) where it is (column None:
    in the whole source); ``mask`` is keep, hash or drop; ``classification`` says whether raw values may be shown (open, public, internal).
    """

    name: str
    type: str = "VARCHAR"
    source: str | None = ""
    key: bool = False
    formats: tuple[str, ...] = ()
    zone: str | None = None
    null_policy: str = "keep"
    impute: str | None = None
    structural: str | None = None
    structural_in: tuple[tuple[str, str | None, str | None], ...] = ()
    allowed: tuple[str, ...] = ()
    ambiguous: str = "prefer_first"
    mask: str = "keep"
    classification: str = ""

    @property
    def expression(self) -> str | None:
        return self.name if self.source == "" else self.source

    @property
    def spark_type(self) -> str:
        return spark_type(self.type)


@dataclass(frozen=True)
class Lookup:
    name: str
    table: str
    on: tuple[tuple[str, str], ...]
    columns: tuple[str, ...]
    missing: str = "keep_null"
    hashed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]
    tiebreakers: tuple[tuple[str, str], ...] = ()
    hard_rejects: tuple[tuple[str, str], ...] = ()
    anomalies: tuple[tuple[str, str], ...] = ()
    flags: tuple[tuple[str, str], ...] = ()
    lookups: tuple[Lookup, ...] = ()
    accept: str = "keep_last_good"
    strategy: str = "append"
    version: str | None = None
    partition: tuple[str, ...] = ()
    op: str | None = None
    ops: tuple[tuple[str, str], ...] = (("I", "upsert"), ("U", "upsert"), ("D", "delete"))
    reporting_zone: str = "UTC"
    salt: str = ""
    #: Percent of a batch's rows that may be rejected.
    tolerance: float = 100.0

    @property
    def keys(self) -> list[Field]:
        return [f for f in self.fields if f.key]

    @property
    def published(self) -> list[Field]:
        return [f for f in self.fields if f.mask != "drop"]

    def problems(self) -> list[str]:
        """What makes the declaration meaningless, in words; empty if nothing does."""
        names, found = [f.name for f in self.fields], []
        if len(set(names)) < len(names):
            found.append("a column is declared twice")
        if not self.keys:
            found.append("no key column")
        if self.strategy not in STRATEGIES:
            found.append(f"unknown strategy {self.strategy}")
        if self.strategy in ("upsert_by_version", "cdc_apply") and self.version not in names:
            found.append(f"{self.strategy} needs a version column")
        if self.strategy == "partition_replace" and not self.partition:
            found.append("partition_replace needs partition columns")
        if self.strategy == "cdc_apply" and self.op is None:
            found.append("cdc_apply needs an operation column")
        for c, order in self.tiebreakers:
            if c not in names:
                found.append(f"tiebreaker {c} is no column")
            if order not in ("asc", "desc"):
                found.append(f"tiebreaker order {order}")
        for f in self.fields:
            if f.null_policy not in ("keep", "drop", "impute"):
                found.append(f"{f.name}: null policy {f.null_policy}")
            if f.null_policy == "impute" and f.impute is None:
                found.append(f"{f.name}: nothing to impute")
            if f.key and f.null_policy == "impute":
                found.append(f"{f.name}: a key cannot be imputed")
            if kind(f.type) in ("date", "timestamp") and f.source and not f.formats:
                found.append(f"{f.name}: no date format")
            if f.ambiguous not in ("prefer_first", "reject"):
                found.append(f"{f.name}: ambiguous dates {f.ambiguous}")
            if f.mask not in ("keep", "hash", "drop"):
                found.append(f"{f.name}: mask {f.mask}")
            if f.mask == "hash" and not self.salt:
                found.append(f"{f.name}: a hash mask needs a salt")
        published = {f.name for f in self.published}
        found += [f"{c} is part of a partition and not published" for c in self.partition if c not in published]
        if self.version in names and self.version not in published:
            found.append("the version column is not published")
        if self.strategy != "cdc_apply" and self.op is not None:
            found.append("an operation column without cdc_apply")
        for lk in self.lookups:
            if lk.missing not in ("keep_null", "reject"):
                found.append(f"lookup {lk.name}: missing {lk.missing}")
            found += [f"lookup {lk.name}: {a} is no column" for a, _ in lk.on if a not in names]
        if self.accept not in ("keep_last_good", "reject_key"):
            found.append(f"accept {self.accept}")
        if not 0 <= self.tolerance <= 100:
            found.append("tolerance is no percentage")
        return found


@dataclass(frozen=True)
class Measure:
    """kind: sum, count, distinct, ratio or average; ``column`` where it needs one.

    Proofs: values lie in ``low`` to ``high``; ``golden`` are (key columns and texts, value or None) computed by hand; per grain key the
    measure (a ratio's denominator) and what ``excluded_by`` leaves out add up to the ``control`` (count, sum:c or distinct:c);
    at most ``max_excluded`` percent of the rows are left out.
    """

    name: str
    kind: str
    column: str | None = None
    where: str = "TRUE"
    denominator: str = "TRUE"
    denominator_kind: str = "count"
    denominator_column: str | None = None
    scale: int = 1
    precision: int = 2
    zero: str = "null"
    low: float | None = None
    high: float | None = None
    golden: tuple[tuple[tuple[tuple[str, str], ...], float | None], ...] = ()
    control: str | None = None
    excluded_by: str | None = None
    max_excluded: float = 100.0
    additivity: str = "additive"
    unit: str = ""

    @property
    def divided(self) -> bool:
        return self.kind in ("ratio", "average")


@dataclass(frozen=True)
class Card:
    """``include`` and ``exclude`` name the values in and out of a ratio's population, column by column."""

    table: str
    measures: tuple[Measure, ...]
    grain: tuple[str, ...] = ()
    time: str | None = None
    bucket: str = "day"
    filters: str = "TRUE"
    include: tuple[tuple[str, tuple[str, ...]], ...] = ()
    exclude: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def problems(self) -> list[str]:
        """What makes the declaration meaningless, in words; empty if nothing does."""
        found = []
        if len({m.name for m in self.measures}) < len(self.measures):
            found.append("a measure is declared twice")
        if not self.grain and not self.time:
            found.append("no grain")
        for m in self.measures:
            if m.kind not in ("sum", "count", "distinct", "ratio", "average"):
                found.append(f"{m.name}: unknown kind {m.kind}")
            if m.kind in ("sum", "distinct", "average") and m.column is None:
                found.append(f"{m.name}: {m.kind} needs a column")
            if m.zero not in ("null", "zero", "omit"):
                found.append(f"{m.name}: zero denominator {m.zero}")
            if m.additivity not in ("additive", "semi_additive", "non_additive"):
                found.append(f"{m.name}: additivity {m.additivity}")
            if m.kind == "distinct" and m.additivity == "additive":
                found.append(f"{m.name}: distinct counts do not add up")
            if m.low is not None and m.high is not None and m.low > m.high:
                found.append(f"{m.name}: empty range")
        return found


def load_yaml(text: str) -> dict:
    """A YAML mapping whose scalars stay strings (NO, 010 and 1.10 keep their spelling)."""
    import yaml

    return yaml.load(text, Loader=yaml.BaseLoader) or {}

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import gold, silver, warehouse
from millrace.operators.checks import CheckFailed
from millrace.plans.specs import Card, Entity, Field, Lookup, Measure
from millrace.sources import scan
from millrace.sources.store import Busy, Table, current, manifest_of, publish

PROD = Entity("prod", (Field("sku", key=True), Field("price", "DECIMAL(10,2)")), strategy="snapshot_diff")


def feed(spark, batches):
    rows = [(s, p, b, v) for (b, v), items in batches.items() for s, p in items]
    df = spark.createDataFrame(rows, "sku string, price string, _batch_id string, _batch_version int")
    return silver.with_provenance(df, "prod", order=["sku"])


def state(spark, root):
    return {(r.sku, r._is_deleted) for r in Table(spark, f"{root}/table").read().collect()}


def test_late_snapshot_replays_history(spark, tmp_path):
    root = str(tmp_path / "w")
    first = {("2024-01-01", 1): [("A", "1"), ("B", "2"), ("C", "3")], ("2024-01-02", 1): [("A", "1.5"), ("C", "3")]}
    got = warehouse.build(spark, PROD, feed(spark, first), root)
    assert [r["batch"] for r in got] == ["2024-01-01", "2024-01-02"] and not got[0]["replayed"]
    assert warehouse.build(spark, PROD, feed(spark, first), root) == []
    assert state(spark, root) == {("A", False), ("B", True), ("C", False)}
    late = first | {("2023-12-31", 1): [("Z", "9")]}
    got = warehouse.build(spark, PROD, feed(spark, late), root)
    assert len(got) == 3 and got[0]["replayed"]
    assert state(spark, root) == {("A", False), ("B", True), ("C", False), ("Z", True)}
    again = late | {("2024-01-02", 2): [("B", "2")]}
    got = warehouse.build(spark, PROD, feed(spark, again), root)
    assert got[0]["replayed"] and state(spark, root) == {("A", True), ("B", False), ("C", True), ("Z", True)}


def fault(spark, tmp_path, monkeypatch, spec=PROD, rows=None, patch=None, **how):
    """The ids of the proofs that fail when the second batch is built with a planted fault."""
    root = str(tmp_path / "w")
    first = {("1", 1): [("A", "1"), ("B", "2")]}
    warehouse.build(spark, spec, feed(spark, first), root)
    before = state(spark, root)
    for name, f in (patch or {}).items():
        module, _, attribute = name.rpartition(".")
        monkeypatch.setattr(getattr(warehouse, module), attribute, f)
    with pytest.raises(CheckFailed) as e:
        warehouse.build(spark, spec, feed(spark, first | {("2", 1): rows or [("A", "1"), ("C", "3")]}), root, **how)
    assert state(spark, root) == before
    return {p.id for p in e.value.proofs}


def upsert(**more):
    return Entity("acct", (Field("sku", key=True), Field("price", "INTEGER")), strategy="upsert_by_version", version="price", **more)


def test_each_proof_catches_its_fault(spark, tmp_path, monkeypatch):
    staged, finished, dead = warehouse.merge.staged, silver.finished, silver.dead_letters
    look_up, outcome = silver.look_up, silver.outcome
    cases = {
        # a lookup that multiplies rows
        "row_law": dict(patch={"silver.look_up": lambda r, *a: look_up(r, *a).crossJoin(spark.createDataFrame([("x",), ("y",)], "_z string"))}),
        # a survivor that gets lost on the way to the merge
        "one_outcome_per_survivor": dict(patch={"silver.finished": lambda r, *a: finished(r, *a).where("sku <> 'C'")}),
        # a row that vanishes in the merge
        "table_change": dict(patch={"merge.staged": lambda *a: staged(*a).where("NOT (sku = 'B' AND _action <> 'x')")}),
        # the same key twice
        "one_row_per_key": dict(patch={"merge.staged": lambda *a: (lambda d: d.unionByName(d.where("sku = 'C'")))(staged(*a))}),
        # a key that gets blank
        "no_null_key": dict(patch={"merge.staged": lambda *a: staged(*a).withColumn("sku", F.when(F.col("sku") != "C", F.col("sku")))}),
        # rejected rows that are not written
        "dead_letters_kept": dict(rows=[("C", "x")], patch={"silver.dead_letters": lambda r, *a: dead(r, *a).limit(0)}),
        # too many rejected rows
        "within_tolerance": dict(spec=Entity(**(PROD.__dict__ | {"tolerance": 10.0})), rows=[("C", "x"), ("D", "1")]),
        # versions of a key that nothing tells apart
        "ties_separated": dict(rows=[("C", "1"), ("C", "2")]),
        # a survivor whose value was lost in a cast
        "no_cast_loss": dict(patch={"silver.build": lambda r, *a: outcome(silver.judged(silver.typed(r, *a[:1]), *a), *a[:1]).withColumn("_reason", F.lit("cast_price"))}),
        # an older version that replaces a newer one
        "only_forward": dict(spec=upsert(), rows=[("A", "7")], patch={"merge._newer": lambda spec: F.lit(False)}),
        # a rule that calls a row valid and one that rejects it
        "anomaly_or_reject": dict(
            spec=Entity(**(PROD.__dict__ | {"anomalies": (("dear", "price > 50"),), "hard_rejects": (("too_dear", "price > 60"),)})), rows=[("C", "70")]
        ),
    }
    for name, how in cases.items():
        with monkeypatch.context() as m:
            found = fault(spark, tmp_path / name, m, **how)
        assert name in found, (name, found)
        # what is lost or doubled also shows in the counts; nothing else may fail
        assert found <= {name, "table_change", "one_outcome_per_survivor", "row_law"}, (name, found)


def test_table_changed_by_others(spark, tmp_path):
    root = str(tmp_path / "w")
    warehouse.build(spark, PROD, feed(spark, {("1", 1): [("A", "1"), ("B", "2")]}), root)
    t = Table(spark, f"{root}/table")
    t.commit(t.read().where("sku = 'A'"))
    with pytest.raises(CheckFailed) as e:
        warehouse.build(spark, PROD, feed(spark, {("1", 1): [("A", "1"), ("B", "2")], ("2", 1): [("A", "1")]}), root)
    assert {p.id for p in e.value.proofs} == {"untouched_since"}
    with pytest.raises(CheckFailed, match="ledger_rows"):
        warehouse.build(spark, PROD, feed(spark, {("1", 1): [("A", "1"), ("B", "2")]}), root)


def test_repeated_reference_keys_stop_the_build(spark, tmp_path):
    zones = spark.createDataFrame([("A", "x"), ("A", "y")], "code string, title string")
    spec = Entity("z", PROD.fields, lookups=(Lookup("z", "zones", (("sku", "code"),), ("title",)),))
    with pytest.raises(CheckFailed, match="reference_unique_z"):
        warehouse.build(spark, spec, feed(spark, {("1", 1): [("A", "1")]}), str(tmp_path / "w"), {"zones": zones})


@pytest.mark.parametrize(
    "more, words",
    [
        ({"hard_rejects": (("r", "price > (SELECT 1)"),)}, "r: "),
        ({"flags": (("f", "price + 1"),)}, "must be boolean"),
        ({"anomalies": (("a", "nothere > 1"),)}, "unknown column nothere"),
        ({"fields": (*PROD.fields, Field("x", source="read_csv('y')"))}, "read_csv is not allowed"),
        ({"lookups": (Lookup("l", "none", (("sku", "k"),), ("t",)),)}, "no table none"),
        ({"strategy": "upsert_by_version"}, "needs a version"),
    ],
)
def test_bad_declarations_are_refused(spark, tmp_path, more, words):
    spec = Entity(**(PROD.__dict__ | more))
    with pytest.raises(ValueError, match=words):
        warehouse.build(spark, spec, feed(spark, {("1", 1): [("A", "1")]}), str(tmp_path / "w"))


@pytest.mark.parametrize("strategy", ["append", "partition_replace"])
def test_batches_write_their_own_rows_only(spark, tmp_path, strategy, monkeypatch):
    spec = Entity("e", (Field("sku", key=True), Field("price", "DECIMAL(10,2)")), strategy=strategy, partition=("price",) if strategy != "append" else ())
    batches = {("1", 1): [("A", "1"), ("B", "2")], ("2", 1): [("A" if strategy == "append" else "C", "1"), ("D", "3")], ("3", 1): [("E", "1"), ("F", "x")]}
    reports, states = [], []
    for most in (16, 1):  # in parts, and every version whole
        monkeypatch.setattr("millrace.sources.store.MOST_PARTS", most)
        root = str(tmp_path / f"w{most}")
        reports.append([(r["merge"], r["rows_after"]) for r in warehouse.build(spark, spec, feed(spark, batches), root)])
        states.append(state(spark, root))
        parts = Table(spark, f"{root}/table")._state()["parts"]
        assert len(parts) == (3 if most == 16 else 1)
    assert reports[0] == reports[1] and states[0] == states[1]
    want = {"A", "B", "D", "E"} if strategy == "append" else {"B", "D", "E"}
    assert {k for k, _ in states[0]} == want


def test_one_writer_at_a_time(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    with t.lease():
        with pytest.raises(Busy):
            with Table(spark, t.root).lease():
                pass
    with t.lease(), t.lease(hours=0):  # left by a crash, as far as the second can tell
        pass


def test_withdrawn_rows_are_counted(spark, tmp_path):
    spec = Entity("acct", PROD.fields, tiebreakers=(("price", "desc"),), accept="reject_key", hard_rejects=(("high", "price > 10"),))
    root = str(tmp_path / "w")
    got = warehouse.build(spark, spec, feed(spark, {("1", 1): [("A", "1"), ("B", "2")], ("2", 1): [("A", "11")]}), root)
    assert got[1]["merge"] == {"withdrawn": 1} and got[1]["reasons"] == {"high": 1}
    assert state(spark, root) == {("A", True), ("B", False)}


def test_files_to_snapshot(spark, tmp_path):
    """Files through gates into a table, a card and a published snapshot."""
    for day, text in (("2024-01-01", "sku,price,kind\nA,1.50,x\nB,2.00,y\nD,oops,y\n"), ("2024-01-02", "sku,price,kind\nA,3.00,x\nC,4.25,z\nbad\n")):
        (tmp_path / f"s_{day}.csv").write_text(text)
    source = scan.Source("s", f"{tmp_path}/s_{{batch}}.csv", {"sku": "VARCHAR", "price": "DECIMAL(10,2)", "kind": "VARCHAR"})
    ledger, store = scan.Ledger(spark, f"{tmp_path}/ledger.json"), f"{tmp_path}/bronze"
    assert [r["rejects"] for r in scan.ingest(spark, source, store, ledger)] == [0, 1]
    kind = Field("kind", classification="open", structural_in=(("s", None, None),), null_policy="drop")
    spec = Entity("sale", (Field("sku", key=True), Field("price", "DECIMAL(10,2)"), kind), strategy="snapshot_diff")
    report = warehouse.build(spark, spec, scan.bronze(spark, store, source), f"{tmp_path}/sale")
    assert [r["merge"] for r in report] == [{"inserted": 2}, {"updated": 1, "deleted": 1, "inserted": 1}]
    assert report[0]["reasons"] == {"cast_price": 1}
    sales = Table(spark, f"{tmp_path}/sale/table").read()
    share = Measure("share", "ratio", where="price > 4", scale=100, low=0, high=100, control="count", golden=(((("kind", "x"),), 0.0),))
    total = Measure("total", "sum", "price", low=0, control="sum:price", golden=(((("kind", "z"),), 4.25), ((("kind", "q"),), 0)))
    card = Card("by_kind", (share, total), grain=("kind",), include=(("kind", ("x", "z")),))
    got = gold.build(spark, [(card, sales)], f"{tmp_path}/gold")
    assert got["headlines"] == {"by_kind.share": 50.0, "by_kind.total": 7.25}
    by_kind = Table(spark, f"{tmp_path}/gold/by_kind")
    publish({"by_kind": by_kind.read()}, f"{tmp_path}/pub", "one", got["headlines"])
    shown = current(spark, f"{tmp_path}/pub")["by_kind"]
    for m, how in ((share, "ratio"), (total, "sum")):
        assert round(float(gold.kpi(shown, m.name, how, m.scale).first().value), 2) == manifest_of(spark, f"{tmp_path}/pub")["headlines"][f"by_kind.{m.name}"]
    faults = {
        "range_total": Measure("total", "sum", "price", high=4), "golden_total": Measure("total", "sum", "price", golden=(((("kind", "z"),), 4.0),)),
        "control_total": Measure("total", "sum", "price", where="kind = 'x'", control="sum:price"),
        "excluded_total": Measure("total", "sum", "price", where="kind = 'x'", control="sum:price", excluded_by="kind <> 'x'", max_excluded=10),
        "classified_share": Measure("share", "ratio", where="price > 4"),
    }
    for name, m in faults.items():
        include = (("kind", ("x",)),) if m.kind == "ratio" else ()
        with pytest.raises(CheckFailed) as e:
            gold.build(spark, [(Card("by_kind", (m,), grain=("kind",), include=include), sales)], f"{tmp_path}/gold")
        assert {p.id for p in e.value.proofs} == {name}
        assert by_kind.version == 1
    with pytest.raises(ValueError, match="needs a column"):
        gold.build(spark, [(Card("t", (Measure("x", "sum"),), grain=("kind",)), sales)], f"{tmp_path}/gold")


def test_dead_letters_are_exported(spark, tmp_path):
    root = str(tmp_path / "w")
    warehouse.build(spark, PROD, feed(spark, {("1", 1): [("A", "1"), ("B", "1.999"), (None, "2")]}), root)
    warehouse.export_dead_letters(spark, root, f"{tmp_path}/csv")
    got = spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()
    assert sorted(r.reason for r in got) == ["cast_price", "null_key"]


def test_serving():
    now = dt.datetime(2024, 1, 3, 12)
    assert gold.freshness("replay", now)[0] == "replay" and gold.freshness("event", now)[0] == "stale"
    assert gold.freshness("load", now, 24, dt.datetime(2024, 1, 1))[0] == "stale" and gold.freshness("load", now, 80, dt.datetime(2024, 1, 1))[0] == "fresh"
    assert gold.freshness("event", now, 24, newest=dt.date(2024, 1, 2))[0] == "fresh" and gold.freshness("event", now, 24, newest=dt.date(2024, 1, 1))[0] == "stale"
    assert [gold.formatted(*a) for a in ((1234.5, "currency:eur"), (12.345, "percent", 1), (None,), (1234.0, "", 0))] == ["EUR 1,234.50", "12.3%", "—", "1,234"]


def test_order_and_secrets():
    a = Entity("a", (Field("k", key=True),), lookups=(Lookup("l", "b", (("k", "k"),), ()),))
    b = Entity("b", (Field("k", key=True),))
    assert [e.name for e in warehouse.build_order([a, b])] == ["b", "a"]
    with pytest.raises(ValueError):
        warehouse.build_order([a, Entity("b", b.fields, lookups=(Lookup("l", "a", (("k", "k"),), ()),))])
    for text in ("password = hunter2hunter2", "http://me:pass@host/x", "see https://h/x?Signature=abcdefgh12 now", "Authorization: Bearer abcdefghijklmnop123"):
        assert warehouse.has_secret(text)
    for text in ("the password policy", "https://host/a?b=c", "mail to a:b@c", "bearer of news"):
        assert not warehouse.has_secret(text)
    assert "silver_b -. l .-> silver_a" in warehouse.lineage([a, b])

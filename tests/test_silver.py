import pytest
from pyspark.sql import functions as F

from millrace.operators import checks, gold, merge, silver
from millrace.operators.checks import Proof
from millrace.operators.synthetic import plant, score
from millrace.plans.specs import Card, Entity, Field, Lookup, Measure, load_yaml

ENTITY = Entity(
    "s1",
    (
        Field("id", key=True),
        Field("amount", "DECIMAL(10,2)", null_policy="drop"),
        Field("qty", "INTEGER", null_policy="impute", impute="0"),
        Field("day", "DATE", formats=("%Y-%m-%d", "%d/%m/%Y"), ambiguous="reject"),
        Field("region", allowed=("NA", "EMEA")),
        Field("secret", mask="hash"),
    ),
    tiebreakers=(("amount", "desc"),),
    hard_rejects=(("negative", "amount < 0"),),
    lookups=(Lookup("z", "zones", (("region", "code"),), ("title",), "reject"),),
    salt="s",
)


def built(spark, rows, spec=ENTITY):
    df = spark.createDataFrame(rows, "id string, amount string, qty string, day string, region string, secret string")
    zones = spark.createDataFrame([("NA", "North"), ("EMEA", "East")], "code string, title string")
    return silver.build(silver.with_provenance(df, "s", order=["id", "amount"]), spec, {"zones": zones})


def test_reasons_in_order_and_survivors(spark):
    rows = [
        ("a", "1.00", "2", "2024-01-13", "NA", "x"),
        ("a ", "2.00", None, "2024-01-13", "NA", "x"),
        ("b", "3.149", "3.7", "2024-01-13", "XX", "x"),
        ("c", "1", "3.7", "2024-01-13", "NA", "x"),
        (None, "1", "1", "2024-01-13", "NA", "x"),
        ("d", "1", "1", "02/03/2024", "NA", "x"),
        ("e", None, "1", None, "NA", "x"),
        ("f", "1", "1", None, "XX", "x"),
        ("g", "-1", "1", None, "NA", "x"),
        ("h", "1", "1", None, None, "x"),
    ]
    b = built(spark, rows)
    got = {(r.id, r["_raw__amount"]): (r._outcome, r._dl_reason) for r in b.collect()}
    assert got[("a", "2.00")] == ("survivor", None) and got[("a", "1.00")] == ("duplicate", None)
    why = {k[0]: v[1] for k, v in got.items() if v[0] == "dead_letter"}
    assert why == {
        "b": "cast_amount", "c": "cast_qty", None: "null_key", "d": "ambiguous_date_day", "e": "null_amount", "f": "domain_region",
        "g": "negative",
    }
    done = {r.id: r for r in silver.finished(b, ENTITY).collect()}
    assert set(done) == {"a", "h"} and done["a"].qty == 0 and done["a"].is_qty_imputed and done["a"].z_title == "North"
    assert done["a"].secret not in (None, "x")
    c = silver.counters(b).first()
    assert (c.rows_in, c.survivors, c.duplicates, c.dead_letters) == (10, 2, 1, 7)
    dead = silver.dead_letters(b, ENTITY).collect()
    assert len(dead) == 7 and all('"secret":"x"' not in r.raw_row for r in dead)


def test_empty_batch(spark):
    assert built(spark, []).count() == 0


ACCT = lambda **k: Entity("acct", (Field("id", key=True), Field("version", "INTEGER"), Field("plan")), **k)


def run(spark, spec, batches, schema):
    target, log = None, []
    for name, rows in batches:
        df = silver.with_provenance(spark.createDataFrame(rows, schema), "s", name, order=["id"])
        b = silver.build(df, spec)
        done = silver.finished(b, spec)
        if target is None:
            target = spark.createDataFrame([], done.schema)
        after = merge.staged(target, done, spec)
        count, ties, ignored = silver.counters(b).first(), silver.ties(b, spec).count(), merge.ignored_deletes(target, done, spec)
        proofs, terms = checks.batch_proofs(spec, len(rows), count, done, target.count(), None, after, ignored, ties, count.dead_letters)
        checks.demand(proofs)
        assert {x.action: x.n for x in merge.terms(target, done, spec).collect() if x.n} == terms
        log.append(terms)
        after = after.drop("_action")
        target = spark.createDataFrame(after.collect(), after.schema)
    return target, log


def test_upsert_by_version_whatever_the_order(spark):
    spec = ACCT(strategy="upsert_by_version", version="version", tiebreakers=(("version", "desc"),))
    batches = [
        ("b1", [("A", "1", "basic"), ("B", "1", "basic")]),
        ("b2", [("A", "2", "pro"), ("B", "0", "legacy"), ("A", "2", "pro")]),
        ("b0", [("A", "0", "trial"), ("C", "1", "basic")]),
    ]
    t, log = run(spark, spec, batches, "id string, version string, plan string")
    assert {(r.id, r.version, r.plan) for r in t.collect()} == {("A", 2, "pro"), ("B", 1, "basic"), ("C", 1, "basic")}
    assert log[1] == {"updated": 1, "stale": 1}


def test_cdc(spark):
    spec = Entity("cust", (Field("id", key=True), Field("seq", "INTEGER"), Field("name")), strategy="cdc_apply", version="seq", op="op")
    batches = [
        ("b1", [("A", "I", "1", "Ann"), ("B", "I", "2", "Bob")]),
        ("b2", [("A", " U ", "3", "Annie"), ("B", "D", "4", None), ("Z", "D", "9", None)]),
        ("b0", [("B", "U", "3", "Bobby")]),
    ]
    t, _ = run(spark, spec, batches, "id string, op string, seq string, name string")
    assert {(r.id, r.name, r.seq, r._is_deleted) for r in t.collect()} == {("A", "Annie", 3, False), ("B", "Bob", 4, True)}


def test_snapshots(spark):
    spec = Entity("prod", (Field("id", key=True), Field("price", "DECIMAL(10,2)")), strategy="snapshot_diff")
    batches = [
        ("1", [("A", "1"), ("B", "2"), ("C", "3")]),
        ("2", [("A", "1.5"), ("C", "3")]),
        ("3", [("A", "1.5"), ("B", "2")]),
    ]
    t, log = run(spark, spec, batches, "id string, price string")
    assert {(r.id, r._is_deleted) for r in t.collect()} == {("A", False), ("B", False), ("C", True)}
    assert log[2] == {"unchanged": 1, "reactivated": 1, "deleted": 1}


def test_append_and_partitions(spark):
    spec = Entity("evt", (Field("id", key=True), Field("kind")), strategy="append")
    t, log = run(spark, spec, [("b1", [("e1", "x"), ("e2", "x")]), ("b2", [("e2", "y"), ("e3", "y")])], "id string, kind string")
    assert {(r.id, r.kind) for r in t.collect()} == {("e1", "x"), ("e2", "x"), ("e3", "y")}
    assert log[1] == {"inserted": 1, "already_present": 1}
    spec = Entity("evt", (Field("id", key=True), Field("kind")), strategy="partition_replace", partition=("kind",))
    t, _ = run(spark, spec, [("b1", [("e1", "x"), ("e2", "y")]), ("b2", [("e3", "x")])], "id string, kind string")
    assert {r.id for r in t.collect()} == {"e2", "e3"}


def test_planted_faults_are_found(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.lit("5").alias("amount"), F.lit("1").alias("qty"), F.lit("2024-01-13").alias("day"),
        F.lit("NA").alias("region"), F.lit("x").alias("secret"),
    )
    faulty, truth = plant(rows, "id", {"domain_region": ("region", F.lit("??")), "cast_amount": ("amount", F.lit("5,0"))})
    zones = spark.createDataFrame([("NA", "North")], "code string, title string")
    b = silver.build(silver.with_provenance(faulty, "s", order=["id"]), ENTITY, {"zones": zones})
    dead = b.where("_outcome = 'dead_letter'").select("id", F.col("_dl_reason").alias("reason"))
    got = {r.verdict: r.n for r in score(truth, dead, "id").groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    assert set(got) == {"found"} and got["found"] == truth.count() > 0


def test_specs():
    assert load_yaml("a: NO\nb: 010\nc: 1.10") == {"a": "NO", "b": "010", "c": "1.10"}
    assert Entity("x", (Field("a"),), strategy="nope").problems() == ["no key column", "unknown strategy nope"]
    assert ENTITY.problems() == []


def test_cards(spark):
    df = spark.createDataFrame(
        [("a", 10, "y"), ("a", 30, "n"), ("b", 5, "n"), (None, 7, "y")], "g string, v int, ok string"
    )
    card = Card("t", (Measure("rate", "ratio", where="ok = 'y'", scale=100), Measure("avg", "average", "v")), grain=("g",))
    got = {r.g: (r.rate, r.avg, r.avg__num, r.avg__den) for r in gold.table(df, card).collect()}
    assert got == {"a": (50.0, 20.0, 40, 2), "b": (0.0, 5.0, 5, 1), None: (100.0, 7.0, 7, 1)}
    want = spark.createDataFrame([("a", 50.0), ("b", 1.0)], "g string, expected double")
    assert [r.g for r in gold.golden(gold.table(df, card), want, ["g"], "rate").collect()] == ["b"]
    with pytest.raises(ValueError):
        gold.bucket(F.col("x"), "decade")


def test_vacuous_proofs_fail():
    assert not Proof("x", 0, 0).holds and Proof("x", 1, 0).holds
    with pytest.raises(checks.CheckFailed):
        checks.demand([Proof("x", 0, 0)])
    assert checks.demand([Proof("x", 0, 0, fatal=False)])


def test_structural_nulls_by_source_and_value(spark):
    spec = Entity(
        "e",
        (Field("id", key=True), Field("part"), Field("fee", "DECIMAL(10,2)", null_policy="drop", structural_in=(("green", None, None), ("yellow", "part", "p")))),
    )
    df = spark.createDataFrame([("1", "p", None), ("2", "q", None), ("3", "q", "1")], "id string, part string, fee string")
    for source, want in (("green", {"1", "2", "3"}), ("yellow", {"1", "3"}), ("blue", {"3"})):
        b = silver.build(silver.with_provenance(df, source, order=["id"]), spec)
        assert {r.id for r in silver.finished(b, spec).collect()} == want


def test_raw_values_leave_only_where_they_may(spark):
    spec = Entity("e", (Field("id", key=True, classification="open"), Field("mail"), Field("n", "INTEGER", classification="pii")), salt="s")
    df = silver.with_provenance(spark.createDataFrame([("1", "a@b.c", "x")], "id string, mail string, n string"), "s", order=["id"])
    raw = silver.dead_letters(silver.build(df, spec), spec).first().raw_row
    assert '"id":"1"' in raw and "a@b.c" not in raw and '"n":"x"' not in raw


def test_populations(spark):
    df = spark.createDataFrame([("a", 10, "y"), ("a", 30, "n"), ("b", 5, "n"), ("c", 1, "z")], "g string, v int, ok string")
    card = Card("t", (Measure("avg", "average", "v", where="ok = 'y'"),), grain=("g",), filters="ok <> 'z'")
    assert {(r.g, r.avg) for r in gold.table(df, card).collect()} == {("a", 10.0), ("b", None)}
    card = Card("t", (Measure("n", "count"), Measure("r", "ratio", where="v > 9")), grain=("g",), include=(("ok", ("y",)),))
    assert {(r.g, r.n, r.r__num, r.r__den) for r in gold.table(df, card).collect()} == {("a", 2, 1, 1), ("b", 1, 0, 0), ("c", 1, 0, 0)}
    dated = spark.createDataFrame([("2024-01-01", "x", 5), ("2024-01-02", "x", 3), ("2024-01-02", "y", 4)], "period string, k string, n int")
    assert {(r.k, r.n) for r in gold.chart(dated, "k", "n", additivity="semi_additive").collect()} == {("x", 3), ("y", 4)}
    assert {r.period: (r.x, r.y) for r in gold.chart(dated, "period", "n", "k", additivity="semi_additive").collect()} == {"2024-01-01": (5, None), "2024-01-02": (3, 4)}
    assert tuple(gold.date_bounds([dated, dated.drop("period")]).first()) == ("2024-01-01", "2024-01-02")

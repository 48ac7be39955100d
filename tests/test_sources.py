import datetime as dt
import io
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.plans.specs import Entity, Field
from millrace.sources import scan
from millrace.sources.store import Table, current, publish
from millrace.streaming.ingest import apply_changes, tumbling


def source(tmp, **k):
    return scan.Source("s", f"{tmp}/s_{{batch}}.csv", {"id": "VARCHAR", "n": "INTEGER"}, **k)


def write(tmp, batch, text, encoding="utf-8"):
    (tmp / f"s_{batch}.csv").write_bytes(text.encode(encoding))


def test_landing_rejects_and_row_numbers(spark, tmp_path):
    write(tmp_path, "1", 'id,n\r\na,1\r\n"b ""q""\nc",2\r\n\r\nbad,1,2,3\r\nx,-\r\n')
    got = scan.land(spark, source(tmp_path, null_tokens=("-",)), "1", 1, str(tmp_path / "s_1.csv"))
    rows = sorted(got.rows.collect(), key=lambda r: r._row_number)
    assert [(r.id, r.n, r._row_number) for r in rows] == [("a", "1", 1), ('b "q"\nc', "2", 2), ("x", None, 3)]
    assert got.n_rejects == 1 and [r.error for r in got.rejects.collect()] == ["too_many_columns"]
    got.release()
    write(tmp_path, "2", "n,id\n1,a\n   \n2\n3,c\n")  # another order, a line of spaces, a short record
    got = scan.land(spark, source(tmp_path), "2", 1, str(tmp_path / "s_2.csv"))
    assert [(r.id, r.n) for r in got.rows.orderBy("_row_number").collect()] == [("a", "1"), ("c", "3")] and got.n_rejects == 1


def test_large_files_are_read_in_parts(spark, tmp_path):
    lines = [f"k{k},{k}" for k in range(20_000)]
    write(tmp_path, "1", "id,n\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = scan.land(spark, source(tmp_path, multiline=False), "1", 1, str(tmp_path / "s_1.csv"))
        assert got.rows.rdd.getNumPartitions() > 3
        assert [(r.n, r._row_number) for r in got.rows.orderBy("_row_number").collect()] == [(str(k), k + 1) for k in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_what_is_turned_away_is_kept(spark, tmp_path):
    led, store = scan.Ledger(spark, f"{tmp_path}/ledger.json"), f"{tmp_path}/store"
    write(tmp_path, "1", "id,n\na,1\nb,1,2,3\nc\n")
    write(tmp_path, "2", "id,n\n")
    s = source(tmp_path)
    assert [r["status"] for r in scan.ingest(spark, s, store, led)] == ["landed", "rejected"]
    assert [(r.batch, r.file, r.reason) for r in scan.rejected_files(spark, store).collect()] == [("2", "s_2.csv", "zero_rows")]
    assert sorted((r.batch, r.error, r.record) for r in scan.parse_rejects(spark, store, s).collect()) == [
        ("1", "missing_columns", "c"), ("1", "too_many_columns", "b,1,2,3")
    ]
    assert scan.ingest(spark, s, store, led, only="../x")[0]["reason"] == "bad_batch_id"
    assert scan.ingest(spark, s, store, led, only="77")[0]["reason"] == "file_not_found"
    assert scan.sample(spark, s, str(tmp_path / "s_1.csv")).columns == ["id", "n"]


def test_urls_and_first_types(spark, tmp_path):
    led, store = scan.Ledger(spark, f"{tmp_path}/ledger.json"), f"{tmp_path}/store"
    s = scan.Source("web", "http://host/{batch}.csv", {"id": "VARCHAR"}, connector="http_file")
    assert scan.ingest(spark, s, store, led)[0]["reason"] == "batch_required"
    got = scan.ingest(spark, s, store, led, only="b1", opener=lambda r: io.BytesIO(b"id\nx\ny\n"))
    assert got[0]["status"] == "landed" and got[0]["rows"] == 2 and scan.bronze(spark, store, s).count() == 2
    for k, kind in enumerate(("int", "bigint", "string")):
        spark.range(3).select(F.col("id").cast(kind).alias("v")).coalesce(1).write.parquet(f"{tmp_path}/p{k}")
        part = next(f for f in os.listdir(f"{tmp_path}/p{k}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/p{k}/{part}", f"{tmp_path}/t_{k}.parquet")
    s = scan.Source("t", f"{tmp_path}/t_{{batch}}.parquet", {"other": "INTEGER"}, "parquet")
    got = scan.ingest(spark, s, store, led)
    assert [r["status"] for r in got] == ["landed", "landed", "rejected"] and got[2]["reason"] == "type_change"


def test_ledger_and_redelivery(spark, tmp_path):
    led, store = scan.Ledger(spark, f"{tmp_path}/ledger.json"), f"{tmp_path}/store"
    write(tmp_path, "2", "id,n\na,1\n")
    s = source(tmp_path)
    assert scan.ingest(spark, s, store, led)[0]["status"] == "landed"
    assert scan.ingest(spark, s, store, scan.Ledger(spark, led.path))[0]["status"] == "skipped"
    write(tmp_path, "2", "id,n\na,9\n")
    assert scan.ingest(spark, s, store, scan.Ledger(spark, led.path))[0]["version"] == 2
    write(tmp_path, "2", "id,n\na,8\n")
    assert scan.ingest(spark, source(tmp_path, redelivery="reject"), store, scan.Ledger(spark, led.path))[0]["reason"] == "redelivery_rejected"
    assert scan.bronze(spark, store, s).count() == 2


@pytest.mark.parametrize(
    "text, more, reason",
    [
        ("id\na\n", {"required": ("id", "n")}, "missing_required_columns"),
        ("id,n,z\na,1,2\n", {"additive": "reject"}, "unexpected_columns"),
        ("id,n\n", {}, "zero_rows"),
        ("id,n\na,1\n", {"min_rows": 2}, "volume_out_of_bounds"),
        ("id,n\na,1\n", {"max_age_days": 3, "batch_format": "%Y-%m-%d"}, "stale_batch"),
        ("id,n\na,1\n", {"max_age_days": 3, "batch_format": "%d"}, "bad_batch_token"),
        ("id,n\na,1\n", {"max_age_days": 3, "freshness_column": "n", "freshness_formats": ("%Y-%m-%d",)}, "freshness_unknown"),
    ],
)
def test_gates(spark, tmp_path, text, more, reason):
    write(tmp_path, "2024-01-01", text)
    with pytest.raises(scan.Rejected) as e:
        scan.land(spark, source(tmp_path, **more), "2024-01-01", 1, str(tmp_path / "s_2024-01-01.csv"), dt.date(2024, 6, 1))
    assert e.value.reason == reason


def test_other_formats(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"a","n":1}\n{"id":"b","n":2,"z":"q"}\n')
    s = scan.Source("j", f"{tmp_path}/x.jsonl", {"id": "VARCHAR", "n": "INTEGER"}, "jsonl")
    got = scan.land(spark, s, "full", 1, s.location)
    assert got.n_rows == 2 and got.extra_columns == ["z"] and dict(got.rows.dtypes)["n"] == "string"
    spark.range(5).select(F.col("id"), F.col("id").cast("int").alias("n")).coalesce(1).write.parquet(f"{tmp_path}/p")
    part = next(f"{tmp_path}/p/{f}" for f in os.listdir(f"{tmp_path}/p") if f.endswith(".parquet"))
    s = scan.Source("p", part, {"id": "BIGINT", "n": "INTEGER"}, "parquet")
    rows = scan.land(spark, s, "full", 1, part).rows.collect()
    assert [r._row_number for r in sorted(rows, key=lambda r: r.id)] == [1, 2, 3, 4, 5]
    with pytest.raises(scan.Rejected):
        scan.gate_types(scan.Source("p", part, {"id": "INTEGER", "n": "INTEGER"}, "parquet"), {"id": "bigint"})


def test_batches_in_date_order_and_fetch(spark, tmp_path):
    for b in ("31-01-2024", "01-02-2024"):
        write(tmp_path, b, "id,n\n")
    assert [b for b, _ in scan.discover(spark, source(tmp_path, batch_format="%d-%m-%Y"))] == ["31-01-2024", "01-02-2024"]
    tries = []

    def opener(_):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")
        return io.BytesIO(b"ok")

    scan.fetch("http://x/y", f"{tmp_path}/y", base=0, opener=opener)
    assert len(tries) == 3 and open(f"{tmp_path}/y").read() == "ok"
    assert scan.group_files(["d/a_1.csv", "d/a_2.csv", "d/b.csv"]) == {"d/a_{batch}.csv": ["d/a_1.csv", "d/a_2.csv"], "d/b.csv": ["d/b.csv"]}


def test_versions_and_snapshots(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.commit(spark.range(3))
    t.commit(t.read().union(spark.range(1)))
    assert t.version == 2 and t.read().count() == 4
    t = Table(spark, f"{tmp_path}/parts")
    rows = lambda p, ids: spark.createDataFrame([(i, p) for i in ids], "id long, p string")
    t.commit(rows("a", [1, 2]).union(rows("b", [3])))
    state, seen = t.stage_more(rows("a", [9]).withColumn("_action", F.lit("inserted")), rows("a", [1]).select("p"))
    assert t.read().count() == 3  # not visible yet
    assert sorted((r.id, r._action) for r in seen.collect()) == [(3, "untouched"), (9, "inserted")]
    t.release(state)
    t.release(t.stage_more(rows("c", [5]))[0])
    assert sorted(r.id for r in t.read().collect()) == [3, 5, 9] and t.read().columns == ["id", "p"]
    for k in range(4):
        t.commit(t.read())
    assert t.version == 7 and {x for x in os.listdir(t.root) if x.startswith("v") and not x.endswith((".gone", ".json"))} == {"v5", "v6", "v7"}
    publish({"g": spark.range(2)}, f"{tmp_path}/pub", "s1")
    assert current(spark, f"{tmp_path}/pub")["g"].count() == 2
    part = next(f for f in os.listdir(f"{tmp_path}/pub/s1/g") if f.endswith(".parquet"))
    with open(f"{tmp_path}/pub/s1/g/{part}", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        current(spark, f"{tmp_path}/pub")


def test_streams(spark, tmp_path):
    rows = [("A", "1", "x"), ("B", "1", "y")]
    spark.createDataFrame(rows, "id string, v string, plan string").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spec = Entity("acct", (Field("id", key=True), Field("v", "INTEGER"), Field("plan")), strategy="upsert_by_version", version="v")
    schema, table = spark.read.parquet(f"{tmp_path}/in/1").schema, Table(spark, f"{tmp_path}/t")
    go = lambda: apply_changes(spark, f"{tmp_path}/in/*", schema, spec, table, f"{tmp_path}/cp").awaitTermination()
    go()
    spark.createDataFrame([("A", "2", "z")], "id string, v string, plan string").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    go()
    assert {(r.id, r.plan) for r in table.read().collect()} == {("A", "z"), ("B", "y")}
    (tmp_path / "none").mkdir()
    events = spark.readStream.schema("ts timestamp_ntz, n int").parquet(f"{tmp_path}/none")
    out = tumbling(events.select(F.col("ts").cast("timestamp_ltz").alias("ts"), "n"), "ts", "5 minutes", "10 minutes", [], total=F.sum("n"))
    assert out.isStreaming and out.columns == ["window_start", "total"]


def test_profiles(spark):
    df = spark.createDataFrame([("1", "Y"), ("2", "N"), ("3", None)], "a string, b string")
    assert profile.propose_type(df, "a") == "BIGINT" and profile.propose_type(df, "b") == "VARCHAR"
    assert profile.propose_types(df) == {"a": "BIGINT", "b": "VARCHAR"}
    wide = spark.range(50).selectExpr(*[f"id % {k + 2} c{k}" for k in range(11)], "id late", "' ' blank")
    assert {r["columns"] for r in profile.key_candidates(wide).collect()} >= {"late"}
    assert profile.key_check(wide, [["blank"]]).first().empty_keys == 50 and profile.key_candidates(wide.limit(0)).count() == 0
    assert profile.content_hash(wide).first() == profile.content_hash(wide.orderBy(F.desc("late"))).first() != profile.content_hash(wide.limit(49)).first()
    got = {r.column_name: r for r in profile.columns(df).collect()}
    assert got["b"].nulls == 1 and got["a"].distinct_values == 3


def test_exact_counts_copy_no_rows(spark):
    df = spark.createDataFrame([(0.0, "", None), (-0.0, "a", None), (None, "a", None), (0.0, " ", None)], "x double, `y.z` string, n string")
    found, keys = profile.columns(df, exact=True), profile.key_check(df, [["y.z"], ["x", "y.z"]])
    for q in (found, keys):  # several distinct counts in one aggregate would group a copy of the rows for each
        assert "Expand" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("x", 1, 0, 1, 3, 4), ("y.z", 0, 1, 3, 0, 1), ("n", 4, 0, 0, None, None)]
    assert [tuple(r) for r in keys.collect()] == [("y.z", 4, 3, 2), ("x,y.z", 4, 4, 3)]
    for exact in (True, False):
        assert {tuple(r)[1:] for r in profile.columns(df.limit(0), exact=exact).collect()} == {(0, 0, 0, None, None)}
    assert tuple(profile.key_check(df.limit(0), [["x"]]).first()) == ("x", 0, 0, 0)

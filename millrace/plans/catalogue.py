"""The engine's named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, fragments, keys
from ..operators import gold, merge, profile, silver
from ..sources import scan
from .specs import Card, Entity, Field, Lookup, Measure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


# ---- projections, casts, filters ------------------------------------------------------------------------------


@query(
    "scan_project_filter",
    "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem "
    "WHERE l_returnflag = 'R' AND l_quantity > 30",
)
def _(spark, d):
    rows = read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 30")
    return rows.select("l_orderkey", "l_linenumber", money("l_extendedprice").alias("price"))


@query(
    "strict_int_cast",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN ' ' || CAST(l_partkey AS VARCHAR) || ' '
         WHEN l_linenumber % 3 = 1 THEN CAST(l_partkey AS VARCHAR) || '.5' ELSE '+' || CAST(l_partkey AS VARCHAR) END AS raw FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN CAST(replace(trim(raw), '+', '') AS BIGINT) END AS part
    FROM t""",
)
def _(spark, d):
    p, k = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 3
    raw = F.when(k == 0, F.concat(F.lit(" "), p, F.lit(" "))).when(k == 1, F.concat(p, F.lit(".5"))).otherwise(F.concat(F.lit("+"), p))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", casts.strict_int(raw, "BIGINT").alias("part"))


@query(
    "lossless_decimal_cast",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS DECIMAL(10,2)) END AS quantity FROM lineitem""",
)
def _(spark, d):
    # every second value gets a third decimal, which a scale of 2 would round away
    q = F.col("l_quantity").cast("int").cast("string")
    raw = F.concat(q, F.when(F.col("l_linenumber") % 2 == 1, ".50").otherwise(".505"))
    value = casts.lossless_decimal(raw, "DECIMAL(10,2)") - F.lit("0.50").cast("decimal(10,2)")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.cast("decimal(10,2)").alias("quantity"))


_DATES = ["%Y-%m-%d", "%d/%m/%Y", "%b %d %Y"]
_DATE_SQL = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%b %d %Y') ELSE 'soon' END"""


def _date_text():
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    return (
        F.when(k == 0, F.date_format(o, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(o, "dd/MM/yyyy"))
        .when(k == 2, F.date_format(o, "MMM dd yyyy"))
        .otherwise("soon")
    )


@query(
    "multi_format_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_day FROM orders",
)
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", casts.parse_time(_date_text(), _DATES).cast("date").alias("order_day"))


@query(
    "date_ambiguity",
    f"""WITH t AS (SELECT o_orderkey, {_DATE_SQL} AS raw FROM orders) SELECT o_orderkey, len(list_distinct([TRY_STRPTIME(raw, '%Y-%m-%d'),
    TRY_STRPTIME(raw, '%d/%m/%Y'), TRY_STRPTIME(raw, '%b %d %Y'), TRY_STRPTIME(raw, '%m/%d/%Y')])) > 1 AS ambiguous FROM t""",
)
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", casts.ambiguous(_date_text(), _DATES).alias("ambiguous"))


@query(
    "iso_dates_unambiguous",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day, FALSE AS ambiguous FROM orders",
)
def _(spark, d):
    raw = F.date_format("o_orderdate", "yyyy-MM-dd")
    day, twins = casts.parse_time(raw, ["%Y-%m-%d"]).cast("date"), casts.ambiguous(raw, ["%Y-%m-%d", "%Y/%m/%d"])
    return read(spark, d, "orders").select("o_orderkey", day.alias("order_day"), twins.alias("ambiguous"))


@query("timezone_shift", "SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) AS utc FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", casts.shift_zone(F.col("ts"), "America/New_York", "UTC").alias("utc"))


@query(
    "surrogate_key",
    "SELECT c_custkey, md5(to_json(struct_pack(k0 := CAST(c_custkey AS VARCHAR), k1 := trim(c_name)))) AS sk FROM customer",
)
def _(spark, d):
    sk = keys.surrogate_key([(F.col("c_custkey"), "bigint"), (F.col("c_name"), "string")])
    return read(spark, d, "customer").select("c_custkey", sk.alias("sk"))


@query(
    "salted_key",
    "SELECT c_custkey, md5('pepper' || to_json(struct_pack(k0 := CAST(c_custkey AS VARCHAR), k1 := trim(c_name)))) AS sk FROM customer",
)
def _(spark, d):
    spec = Entity("c", (Field("k", "BIGINT", "c_custkey", key=True, mask="hash"), Field("n", source="c_name", key=True)), salt="pepper")
    rows = silver.typed(silver.with_provenance(read(spark, d, "customer"), "customer", order=["c_custkey"]), spec)
    return rows.select(F.col("k").alias("c_custkey"), F.col("_sk").alias("sk"))


@query("mask_hash", "SELECT c_custkey, md5('pepper' || c_name) AS name_hash FROM customer")
def _(spark, d):
    return read(spark, d, "customer").select("c_custkey", keys.mask(F.col("c_name"), "pepper").alias("name_hash"))


@query(
    "impute_with_flag",
    """SELECT event_id, CASE WHEN value < 10 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS amount,
    coalesce(value < 10, FALSE) AS is_amount_imputed, coalesce(event_type = 'purchase', FALSE) AS is_purchase FROM events""",
)
def _(spark, d):
    spec = Entity(
        "event",
        (
            Field("event_id", "BIGINT", key=True),
            Field("event_type"),
            Field("amount", "DECIMAL(18,2)", null_policy="impute", impute="0"),
        ),
        flags=(("is_purchase", "event_type = 'purchase'"),),
    )
    rows = read(spark, d, "events").select("event_id", "event_type", F.when(F.col("value") >= 10, money("value")).alias("amount"))
    rows = silver.with_provenance(rows, "events", order=["event_id"])
    done = silver.finished(silver.build(rows, spec), spec)
    return done.select("event_id", "amount", "is_amount_imputed", "is_purchase")


ORDERS = Entity(
    "orders",
    (
        Field("order_id", "BIGINT", "o_orderkey", key=True, classification="open"),
        Field("customer_id", "BIGINT", "o_custkey"),
        Field("status", "VARCHAR", "o_orderstatus", allowed=("F", "O")),
        Field("total", "DECIMAL(18,2)", "total", null_policy="drop"),
        Field("order_day", "DATE", "day", formats=("%Y-%m-%d",)),
    ),
    tiebreakers=(("total", "desc"),),
    hard_rejects=(("too_small", "total < 10000"),),
    anomalies=(("huge", "total > 400000"),),
    lookups=(Lookup("customer", "customer", (("customer_id", "c_custkey"),), ("c_mktsegment",), "reject"),),
)


def _orders_raw(spark, d) -> DataFrame:
    rows = read(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 11 != 0, money("o_totalprice").cast("string")).alias("total"),
        F.when(F.col("o_orderkey") % 13 == 0, "not a day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    return silver.with_provenance(rows, "orders", order=["o_orderkey"])


def _orders_built(spark, d) -> DataFrame:
    # customers of one segment are left out, so that lookups miss
    customers = read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return silver.build(_orders_raw(spark, d), ORDERS, {"customer": customers})


_JUDGED_SQL = """SELECT o.*, CASE WHEN o_orderkey % 13 = 0 THEN 'cast_order_day' WHEN o_orderkey % 11 = 0 THEN 'null_total'
    WHEN o_orderstatus NOT IN ('F','O') THEN 'domain_status' WHEN CAST(o_totalprice AS DECIMAL(18,2)) < 10000 THEN 'too_small'
    WHEN c.c_custkey IS NULL THEN 'missing_customer' END AS reason
    FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c.c_custkey = o.o_custkey"""


@query("judge_reasons", f"SELECT o_orderkey AS order_id, reason FROM ({_JUDGED_SQL})")
def _(spark, d):
    return _orders_built(spark, d).select("order_id", F.col("_reason").alias("reason"))


@query("reject_histogram", f"SELECT reason, COUNT(*) AS n FROM ({_JUDGED_SQL}) WHERE reason IS NOT NULL GROUP BY reason")
def _(spark, d):
    return silver.reason_histogram(_orders_built(spark, d))


@query(
    "outcome_counters",
    f"""SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (WHERE reason IS NULL) AS survivors, CAST(0 AS BIGINT) AS duplicates,
    COUNT(*) FILTER (WHERE reason IS NOT NULL) AS dead_letters, CAST(0 AS BIGINT) AS bad_keys,
    COUNT(*) FILTER (WHERE huge) AS anomalies, COUNT(*) FILTER (WHERE huge AND reason IS NULL) AS anomalies_kept,
    CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS deletes, CAST(0 AS BIGINT) AS cast_losses
    FROM (SELECT *, o_orderkey % 11 <> 0 AND CAST(o_totalprice AS DECIMAL(18,2)) > 400000 AS huge FROM ({_JUDGED_SQL}))""",
)
def _(spark, d):
    return silver.counters(_orders_built(spark, d))


@query(
    "dead_letter_rows",
    f"""SELECT 'orders' AS entity, o_orderkey AS order_id, reason FROM ({_JUDGED_SQL}) WHERE reason IS NOT NULL""",
)
def _(spark, d):
    dead = silver.dead_letters(_orders_built(spark, d), ORDERS)
    return dead.select("entity", F.get_json_object("raw_row", "$.order_id").cast("bigint").alias("order_id"), "reason")


@query(
    "anomaly_and_hard_tags",
    f"""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 <> 0 AND CAST(o_totalprice AS DECIMAL(18,2)) > 400000 THEN 'huge' END AS anomaly,
    CASE WHEN o_orderkey % 11 <> 0 AND CAST(o_totalprice AS DECIMAL(18,2)) < 10000 THEN 'too_small' END AS hard FROM orders""",
)
def _(spark, d):
    return _orders_built(spark, d).select("order_id", F.col("_anomaly").alias("anomaly"), F.col("_hard").alias("hard"))


@query(
    "domain_check",
    "SELECT o_orderkey, o_orderstatus NOT IN ('F','O') AS outside FROM orders",
)
def _(spark, d):
    return silver.typed(_orders_raw(spark, d), ORDERS).select(F.col("order_id").alias("o_orderkey"), F.col("_dom__status").alias("outside"))


@query(
    "structural_nulls_exempt",
    "SELECT COUNT(*) AS n FROM events WHERE NOT (value < 10 AND event_type <> 'view')",
)
def _(spark, d):
    spec = Entity(
        "event",
        (
            Field("event_id", "BIGINT", key=True),
            Field("event_type"),
            Field("amount", "DECIMAL(18,2)", null_policy="drop", structural="event_type = 'view'"),
        ),
    )
    rows = read(spark, d, "events").select("event_id", "event_type", F.when(F.col("value") >= 10, money("value")).alias("amount"))
    done = silver.finished(silver.build(silver.with_provenance(rows, "events", order=["event_id"]), spec), spec)
    return done.agg(F.count("*").alias("n"))


# ---- fragments --------------------------------------------------------------------------------------------------

#: Group to (table, key, fragments); the check runs the fragments as they are written.
_FRAGMENTS = {
    "operators": ("orders", "o_orderkey", {
        "power": "(o_orderkey % 7) ^ 3", "divide": "o_custkey / (o_orderkey % 5 + 1)", "whole": "-o_custkey // 7", "rest": "-o_orderkey % 5",
        "joined": "o_orderstatus || '/' || o_orderpriority", "alike": "o_orderpriority ~~* '%urg%'", "unlike": "o_orderpriority NOT LIKE '_-%!_%' ESCAPE '!'",
    }),
    "math": ("orders", "o_orderkey", {
        "rounded": "round(CAST(o_totalprice AS DECIMAL(18,2)), 1)", "log_10": "round(log(o_orderkey + 1), 6)", "natural": "round(ln(o_orderkey + 1), 6)",
        "root": "round(sqrt(o_custkey), 6)", "raised": "pow(o_orderkey % 10, 2)", "signed": "CAST(sign(o_custkey - 100) AS INTEGER)", "most": "greatest(o_orderkey, o_custkey, NULL)",
        "endless": "isinf(o_totalprice)", "modulo": "mod(o_orderkey, 6)",
    }),
    "null": ("events", "event_id", {"one": "coalesce(NULL, event_type)", "two": "nullif(event_type, 'view')", "three": "ifnull(nullif(user_id, 1), 0)"}),
    "string": ("customer", "c_custkey", {
        "glued": "concat(c_name, NULL, '-', c_custkey)", "first_hit": "regexp_replace(c_name, '([0-9])0*', '<\\1>')", "all_hits": "regexp_replace(c_name, '0', 'o', 'g')",
        "found": "regexp_extract(c_name, '[1-9][0-9]*')", "part": "split_part(c_name, '#', 2)", "padded": "lpad(c_mktsegment, 4, '*')", "cut": "substr(c_mktsegment, 0, 3)",
        "ends": "ends_with(c_mktsegment, 'Y')", "place": "CAST(strpos(c_name, '#') AS BIGINT)", "less": "left(c_mktsegment, -2)", "bytes": "CAST(strlen(c_name) AS BIGINT)", "digest": "md5(c_name)",
    }),
    "date": ("orders", "o_orderkey", {
        "weekday": "CAST(dayofweek(o_orderdate) AS BIGINT)", "iso": "CAST(extract(isodow FROM o_orderdate) AS BIGINT)", "week_start": "CAST(date_trunc('week', o_orderdate) AS DATE)",
        "months": "date_diff('month', o_orderdate, TIMESTAMP '2000-02-29 00:00:00')", "whole_years": "date_sub('year', o_orderdate, TIMESTAMP '2000-02-29 00:00:00')",
        "shown": "strftime(o_orderdate, '%d.%m.%Y')", "back": "CAST(try_strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d') AS DATE)",
        "later": "CAST(date_add(o_orderdate, INTERVAL 1 MONTH) AS DATE)", "seconds": "epoch(o_orderdate)", "month_end": "last_day(o_orderdate)",
    }),
    "list": ("orders", "o_orderkey", {"among": "list_contains(['F', 'P'], o_orderstatus)", "has": "list_has(list_value(1, 2, 3), o_orderkey % 5)", "size": "CAST(len([o_orderkey, 1]) AS BIGINT)"}),
}

for _group, (_table, _key, _texts) in _FRAGMENTS.items():

    @query(f"fragment_{_group}", f"SELECT {_key}, " + ", ".join(f"{x} AS {n}" for n, x in _texts.items()) + f" FROM {_table}")
    def _(spark, d, table=_table, key=_key, texts=_texts):
        rows = read(spark, d, table)
        return rows.select(key, *[fragments.column(x, rows.columns).alias(n) for n, x in texts.items()])


# ---- joins ----------------------------------------------------------------------------------------------------


@query(
    "lookup_left_keep_null",
    """SELECT o_orderkey AS order_id, c.c_mktsegment AS customer_c_mktsegment FROM orders o
    LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c.c_custkey = o.o_custkey""",
)
def _(spark, d):
    spec = Entity(
        "orders",
        (Field("order_id", "BIGINT", "o_orderkey", key=True), Field("customer_id", "BIGINT", "o_custkey")),
        lookups=(Lookup("customer", "customer", (("customer_id", "c_custkey"),), ("c_mktsegment",)),),
    )
    customers = read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    rows = silver.typed(_orders_raw(spark, d), spec)
    return silver.look_up(rows, spec, {"customer": customers}).select("order_id", "customer_c_mktsegment")


@query(
    "lookup_left_reject",
    f"SELECT COUNT(*) AS n FROM ({_JUDGED_SQL}) WHERE reason = 'missing_customer'",
)
def _(spark, d):
    return _orders_built(spark, d).where("_reason = 'missing_customer'").agg(F.count("*").alias("n"))


@query(
    "lookup_on_masked_key",
    "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey",
)
def _(spark, d):
    ref = read(spark, d, "customer").select(keys.mask(F.col("c_custkey"), "s").alias("c_custkey"), "c_mktsegment")
    spec = Entity(
        "orders",
        (Field("order_id", "BIGINT", "o_orderkey", key=True), Field("customer_id", "BIGINT", "o_custkey")),
        lookups=(Lookup("c", "customer", (("customer_id", "c_custkey"),), ("c_mktsegment",), hashed=("customer_id",)),),
        salt="s",
    )
    rows = silver.look_up(silver.typed(_orders_raw(spark, d), spec), spec, {"customer": ref})
    return rows.select(F.col("order_id").alias("o_orderkey"), F.col("c_c_mktsegment").alias("c_mktsegment"))


@query(
    "reference_uniqueness",
    "SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1",
)
def _(spark, d):
    return silver.duplicate_reference_keys(read(spark, d, "lineitem"), ["l_orderkey"])


# ---- survivors ------------------------------------------------------------------------------------------------

_EVENT = Entity(
    "user_state",
    (
        Field("user_id", "BIGINT", key=True),
        Field("event_id", "BIGINT"),
        Field("ts", "TIMESTAMP"),
        Field("amount", "DECIMAL(18,2)", "value", null_policy="drop"),
    ),
    tiebreakers=(("ts", "desc"), ("event_id", "desc")),
    hard_rejects=(("low", "amount < 20"),),
)
_RANKED_SQL = """SELECT user_id, event_id, good, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank_all,
    ROW_NUMBER() OVER (PARTITION BY user_id, good ORDER BY ts DESC, event_id DESC) AS rank_good
    FROM (SELECT *, CAST(value AS DECIMAL(18,2)) >= 20 AS good FROM events) WHERE user_id IS NOT NULL"""


def _events_built(spark, d, spec):
    rows = read(spark, d, "events").select("user_id", "event_id", "ts", money("value").alias("value"))
    return silver.build(silver.with_provenance(rows, "events", order=["event_id"]), spec)


@query("survivor_keep_last_good", f"SELECT user_id, event_id FROM ({_RANKED_SQL}) WHERE good AND rank_good = 1")
def _(spark, d):
    return silver.finished(_events_built(spark, d, _EVENT), _EVENT).select("user_id", "event_id")


@query("survivor_reject_key", f"SELECT user_id, event_id FROM ({_RANKED_SQL}) WHERE good AND rank_all = 1")
def _(spark, d):
    spec = Entity(**(_EVENT.__dict__ | {"accept": "reject_key"}))
    return silver.finished(_events_built(spark, d, spec), spec).select("user_id", "event_id")


@query(
    "latest_version",
    """SELECT event_id, _batch_id, _batch_version FROM (SELECT event_id, CAST(user_id % 7 AS VARCHAR) AS _batch_id,
    CAST(event_id % 3 + user_id % 2 AS INTEGER) AS _batch_version FROM events)
    QUALIFY _batch_version = MAX(_batch_version) OVER (PARTITION BY _batch_id)""",
)
def _(spark, d):
    rows = read(spark, d, "events").select(
        "event_id",
        (F.col("user_id") % 7).cast("string").alias("_batch_id"),
        (F.col("event_id") % 3 + F.col("user_id") % 2).cast("int").alias("_batch_version"),
    )
    return silver.latest_versions(rows).select("event_id", "_batch_id", "_batch_version")


@query(
    "tie_detection",
    """SELECT COUNT(*) AS tied FROM (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY l_orderkey, l_returnflag
    HAVING COUNT(DISTINCT (l_linenumber, l_partkey)) > 1)""",
)
def _(spark, d):
    spec = Entity(
        "flags",
        (
            Field("l_orderkey", "BIGINT", key=True),
            Field("l_returnflag"),
            Field("l_linenumber", "INTEGER"),
            Field("l_partkey", "BIGINT"),
        ),
        tiebreakers=(("l_returnflag", "asc"),),
    )
    rows = silver.with_provenance(read(spark, d, "lineitem"), "lineitem", order=["l_orderkey", "l_linenumber"])
    return silver.ties(silver.build(rows, spec), spec).agg(F.count("*").alias("tied"))


@query(
    "duplicate_keys",
    "SELECT CAST(SUM(n - 1) AS BIGINT) AS surplus FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey % 5 HAVING COUNT(*) > 1)",
)
def _(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 5).alias("p"))
    return profile.duplicate_rows(rows, ["l_orderkey", "p"])


# ---- merges ---------------------------------------------------------------------------------------------------


def _halves(spark, d, spec: Entity, second) -> tuple[DataFrame, DataFrame]:
    """A published table of orders up to a key, and a batch that overlaps it."""
    rows = read(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", money("o_totalprice").alias("total"), (F.col("o_orderkey") % 5).cast("int").alias("v"), F.lit("U").alias("op")
    )
    first = silver.with_provenance(rows.where("o_orderkey % 3 <> 0"), "orders", "b1", order=["o_orderkey"])
    later = silver.with_provenance(second(rows.where("o_orderkey % 2 = 0")), "orders", "b2", order=["o_orderkey"])
    done = [silver.finished(silver.build(x, spec), spec, "2024-01-01 00:00:00") for x in (first, later)]
    return done[0], done[1]


def _order_entity(strategy: str, **more) -> Entity:
    return Entity(
        "orders",
        (
            Field("order_id", "BIGINT", "o_orderkey", key=True),
            Field("status", "VARCHAR", "o_orderstatus"),
            Field("total", "DECIMAL(18,2)"),
            Field("v", "INTEGER"),
        ),
        strategy=strategy,
        **more,
    )


def _raised(df: DataFrame) -> DataFrame:
    """The second delivery: totals doubled, versions moved by -1, 0 or 1."""
    return df.withColumns(
        {
            "total": (F.col("total") * 2).cast("decimal(18,2)"),
            "v": (F.col("v") + F.col("o_orderkey") % 3 - 1).cast("int"),
            "op": F.when(F.col("o_orderkey") % 7 == 0, "D").otherwise("U"),
        }
    )


_T = "SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderkey % 5 AS v FROM orders WHERE o_orderkey % 3 <> 0"
_F = """SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DECIMAL(18,2)) AS total,
    o_orderkey % 5 + o_orderkey % 3 - 1 AS v, o_orderkey % 7 = 0 AS gone FROM orders WHERE o_orderkey % 2 = 0"""
_MET = f"SELECT coalesce(t.k, f.k) AS k, t.k AS tk, f.k AS fk, t.total AS tt, f.total AS ft, t.v AS tv, f.v AS fv, f.gone FROM ({_T}) t FULL JOIN ({_F}) f ON t.k = f.k"


@query(
    "merge_append",
    f"SELECT k AS order_id, CASE WHEN tk IS NOT NULL THEN tt ELSE ft END AS total FROM ({_MET})",
)
def _(spark, d):
    spec = _order_entity("append")
    t, f = _halves(spark, d, spec, _raised)
    return merge.apply(t, f, spec).select("order_id", "total")


@query(
    "merge_upsert",
    f"SELECT k AS order_id, CASE WHEN tk IS NULL OR fv > tv THEN ft ELSE tt END AS total FROM ({_MET})",
)
def _(spark, d):
    spec = _order_entity("upsert_by_version", version="v")
    t, f = _halves(spark, d, spec, _raised)
    return merge.apply(t, f, spec).select("order_id", "total")


@query(
    "merge_upsert_terms",
    f"""SELECT CASE WHEN tk IS NULL THEN 'inserted' WHEN fv > tv THEN 'updated' ELSE 'stale' END AS action, COUNT(*) AS n
    FROM ({_MET}) WHERE fk IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    spec = _order_entity("upsert_by_version", version="v")
    t, f = _halves(spark, d, spec, _raised)
    return merge.terms(t, f, spec)


@query(
    "merge_append_terms",
    f"SELECT CASE WHEN tk IS NULL THEN 'inserted' ELSE 'already_present' END AS action, COUNT(*) AS n FROM ({_MET}) WHERE fk IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    spec = _order_entity("append")
    t, f = _halves(spark, d, spec, _raised)
    return merge.terms(t, f, spec)


@query(
    "merge_cdc_terms",
    f"""SELECT CASE WHEN tk IS NULL AND gone THEN 'stale' WHEN tk IS NULL THEN 'inserted' WHEN fv <= tv THEN 'stale' WHEN gone THEN 'deleted' ELSE 'updated' END AS action,
    COUNT(*) AS n FROM ({_MET}) WHERE fk IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    spec = _order_entity("cdc_apply", version="v", op="op")
    t, f = _halves(spark, d, spec, _raised)
    return merge.terms(t, f, spec)


@query(
    "merge_snapshot_terms",
    f"""SELECT CASE WHEN fk IS NULL THEN 'deleted' WHEN tk IS NULL THEN 'inserted' ELSE 'updated' END AS action, COUNT(*) AS n FROM ({_MET}) GROUP BY 1""",
)
def _(spark, d):
    spec = _order_entity("snapshot_diff")
    t, f = _halves(spark, d, spec, _raised)
    return merge.terms(t, f, spec)


@query(
    "merge_partition_terms",
    f"""WITH f AS ({_F} AND o_orderstatus = 'F'), t AS ({_T} AND o_orderstatus = 'F')
    SELECT 'inserted' AS action, (SELECT COUNT(*) FROM f) AS n UNION ALL SELECT 'removed', (SELECT COUNT(*) FROM t)""",
)
def _(spark, d):
    spec = _order_entity("partition_replace", partition=("status",))
    t, f = _halves(spark, d, spec, lambda x: _raised(x).where("o_orderstatus = 'F'"))
    return merge.terms(t, f, spec)


@query(
    "merge_cdc",
    f"""SELECT k AS order_id, CASE WHEN tk IS NULL THEN ft WHEN fv > tv AND NOT gone THEN ft ELSE tt END AS total,
    coalesce(tk IS NOT NULL AND fv > tv AND gone, FALSE) AS is_deleted, CAST(CASE WHEN tk IS NULL OR fv > tv THEN fv ELSE tv END AS INTEGER) AS v
    FROM ({_MET}) WHERE NOT (tk IS NULL AND gone)""",
)
def _(spark, d):
    spec = _order_entity("cdc_apply", version="v", op="op")
    t, f = _halves(spark, d, spec, _raised)
    return merge.apply(t, f, spec).select("order_id", "total", F.col("_is_deleted").alias("is_deleted"), "v")


@query(
    "merge_snapshot_diff",
    f"SELECT k AS order_id, CASE WHEN fk IS NULL THEN tt ELSE ft END AS total, fk IS NULL AS is_deleted FROM ({_MET})",
)
def _(spark, d):
    spec = _order_entity("snapshot_diff")
    t, f = _halves(spark, d, spec, _raised)
    return merge.apply(t, f, spec).select("order_id", "total", F.col("_is_deleted").alias("is_deleted"))


@query(
    "merge_partition_replace",
    f"""WITH f AS ({_F} AND o_orderstatus = 'F'), t AS ({_T})
    SELECT k AS order_id, total FROM f UNION ALL SELECT k, total FROM t JOIN orders ON k = o_orderkey WHERE o_orderstatus <> 'F'""",
)
def _(spark, d):
    spec = _order_entity("partition_replace", partition=("status",))
    t, f = _halves(spark, d, spec, lambda x: _raised(x).where("o_orderstatus = 'F'"))
    return merge.apply(t, f, spec).select("order_id", "total")


@query(
    "withdraw_rejected",
    """SELECT o_orderkey AS order_id, o_orderkey % 2 = 0 AND CAST(o_totalprice AS DECIMAL(18,2)) < 100000 AS is_deleted
    FROM orders WHERE o_orderkey % 3 <> 0""",
)
def _(spark, d):
    spec = _order_entity("append", accept="reject_key", hard_rejects=(("small", "status = 'B2' AND total < 100000"),))
    rows = read(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", money("o_totalprice").alias("total"), (F.col("o_orderkey") % 5).cast("int").alias("v")
    )
    first = silver.with_provenance(rows.where("o_orderkey % 3 <> 0"), "orders", "b1", order=["o_orderkey"])
    later = rows.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("B2"))
    target = silver.finished(silver.build(first, spec), spec)
    built = silver.build(silver.with_provenance(later, "orders", "b2", order=["o_orderkey"]), spec)
    done = merge.withdraw(target, built, silver.finished(built, spec), spec)
    return done.select("order_id", F.col("_is_deleted").alias("is_deleted"))


# ---- gold -----------------------------------------------------------------------------------------------------


def _sales(spark, d) -> DataFrame:
    """Orders with their customer's segment, through the silver stages."""
    spec = Entity(
        "orders",
        (
            Field("order_id", "BIGINT", "o_orderkey", key=True),
            Field("customer_id", "BIGINT", "o_custkey"),
            Field("status", "VARCHAR", "o_orderstatus"),
            Field("priority", "VARCHAR", "o_orderpriority"),
            Field("total", "DECIMAL(18,2)"),
            Field("ordered", "TIMESTAMP", "o_orderdate"),
        ),
        lookups=(Lookup("customer", "customer", (("customer_id", "c_custkey"),), ("c_mktsegment",)),),
    )
    rows = read(spark, d, "orders").withColumn("total", money("o_totalprice"))
    rows = silver.with_provenance(rows, "orders", order=["o_orderkey"])
    customers = read(spark, d, "customer")
    done = silver.finished(silver.build(rows, spec, {"customer": customers}), spec)
    return done.withColumnRenamed("customer_c_mktsegment", "segment")


_SALES = """(SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_orderpriority AS priority,
    CAST(o_totalprice AS DECIMAL(18,2)) AS total, o_orderdate AS ordered, c_mktsegment AS segment
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def _card(*measures: Measure, **more) -> Card:
    return Card("t", measures, **more)


def _sum(c: str) -> str:
    return f"CAST({c} AS DECIMAL(28,2))"


@query(
    "gold_sum",
    f"SELECT segment, CAST(date_trunc('month', ordered) AS DATE) AS period, {_sum('SUM(total)')} AS revenue FROM {_SALES} GROUP BY ALL",
)
def _(spark, d):
    card = _card(Measure("revenue", "sum", "total"), grain=("segment",), time="ordered", bucket="month")
    return gold.table(_sales(spark, d), card).withColumn("revenue", F.col("revenue").cast("decimal(28,2)"))


@query(
    "gold_count",
    f"SELECT segment, COUNT(*) FILTER (WHERE status = 'F') AS finished FROM {_SALES} GROUP BY ALL HAVING COUNT(*) FILTER (WHERE status = 'F') > 0",
)
def _(spark, d):
    return gold.table(_sales(spark, d), _card(Measure("finished", "count", where="status = 'F'"), grain=("segment",)))


@query("gold_distinct", f"SELECT segment, COUNT(DISTINCT customer_id) AS buyers FROM {_SALES} GROUP BY ALL")
def _(spark, d):
    return gold.table(_sales(spark, d), _card(Measure("buyers", "distinct", "customer_id"), grain=("segment",)))


def _ratio(zero: str, grain=("segment",)) -> Card:
    return _card(
        Measure("rate", "ratio", where="status = 'F' AND priority = '1-URGENT'", denominator="priority = '1-URGENT' AND total > 300000", scale=100, precision=1, zero=zero),
        grain=grain,
        time="ordered",
    )


_RATIO = f"""SELECT segment, CAST(ordered AS DATE) AS period, COUNT(*) FILTER (WHERE status = 'F' AND priority = '1-URGENT') AS rate__num,
    COUNT(*) FILTER (WHERE priority = '1-URGENT' AND total > 300000) AS rate__den FROM {_SALES} GROUP BY ALL"""

for _zero, _value, _tail in (
    ("null", "ROUND(100.0 * rate__num / NULLIF(rate__den, 0), 1)", ""),
    ("zero", "COALESCE(ROUND(100.0 * rate__num / NULLIF(rate__den, 0), 1), 0)", ""),
    ("omit", "ROUND(100.0 * rate__num / NULLIF(rate__den, 0), 1)", "WHERE rate__den <> 0"),
):

    @query(
        f"gold_zero_denominator_{_zero}",
        f"SELECT segment, period, rate__num, rate__den, CAST({_value} AS DOUBLE) AS rate FROM ({_RATIO}) {_tail}",
    )
    def _(spark, d, zero=_zero):
        return gold.table(_sales(spark, d), _ratio(zero))


@query(
    "gold_ratio",
    f"""SELECT segment, COUNT(*) FILTER (WHERE status = 'F') AS share__num, COUNT(*) AS share__den,
    CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'F') / COUNT(*), 2) AS DOUBLE) AS share FROM {_SALES} GROUP BY ALL""",
)
def _(spark, d):
    return gold.table(_sales(spark, d), _card(Measure("share", "ratio", where="status = 'F'", scale=100), grain=("segment",)))


@query(
    "gold_average",
    f"""SELECT priority, {_sum('SUM(total)')} AS basket__num, COUNT(total) AS basket__den,
    CAST(ROUND(CAST(SUM(total) AS DOUBLE) / COUNT(total), 2) AS DOUBLE) AS basket FROM {_SALES} GROUP BY ALL""",
)
def _(spark, d):
    df = gold.table(_sales(spark, d), _card(Measure("basket", "average", "total"), grain=("priority",)))
    return df.withColumn("basket__num", F.col("basket__num").cast("decimal(28,2)"))


for _size, _expr in (
    ("day", "CAST(ordered AS DATE)"),
    ("week", "CAST(date_trunc('week', ordered) AS DATE)"),
    ("week_sunday", "CAST(date_trunc('week', CAST(ordered AS DATE) + 1) AS DATE) - 1"),
    ("month", "CAST(date_trunc('month', ordered) AS DATE)"),
    ("quarter", "CAST(date_trunc('quarter', ordered) AS DATE)"),
    ("year", "CAST(date_trunc('year', ordered) AS DATE)"),
):

    @query(f"gold_{_size}", f"SELECT {_expr} AS period, COUNT(*) AS n FROM {_SALES} GROUP BY ALL")
    def _(spark, d, size=_size):
        return gold.table(_sales(spark, d), _card(Measure("n", "count"), time="ordered", bucket=size))


@query(
    "gold_inclusion_list",
    f"""SELECT status, {_sum("SUM(total)")} AS revenue, COUNT(*) FILTER (WHERE priority = '1-URGENT' AND segment IN ('BUILDING', 'MACHINERY')) AS urgent__num,
    COUNT(*) FILTER (WHERE segment IN ('BUILDING', 'MACHINERY')) AS urgent__den,
    CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE priority = '1-URGENT' AND segment IN ('BUILDING', 'MACHINERY'))
      / NULLIF(COUNT(*) FILTER (WHERE segment IN ('BUILDING', 'MACHINERY')), 0), 2) AS DOUBLE) AS urgent FROM {_SALES} GROUP BY ALL""",
)
def _(spark, d):
    # the list binds the ratio's population, not the sum beside it
    urgent = Measure("urgent", "ratio", where="priority = '1-URGENT'", scale=100)
    card = _card(Measure("revenue", "sum", "total"), urgent, grain=("status",), include=(("segment", ("BUILDING", "MACHINERY")),))
    return gold.table(_sales(spark, d), card).withColumn("revenue", F.col("revenue").cast("decimal(28,2)"))


@query(
    "gold_average_population",
    f"""SELECT customer_id, {_sum("SUM(total) FILTER (WHERE total > 300000)")} AS basket__num, COUNT(total) FILTER (WHERE total > 300000) AS basket__den,
    CAST(ROUND(CAST(SUM(total) FILTER (WHERE total > 300000) AS DOUBLE) / NULLIF(COUNT(total) FILTER (WHERE total > 300000), 0), 2) AS DOUBLE) AS basket
    FROM {_SALES} WHERE status = 'F' GROUP BY customer_id""",
)
def _(spark, d):
    # a customer with orders that pass the card's filters stays, with a blank where none passes the average's own
    card = _card(Measure("basket", "average", "total", where="total > 300000"), grain=("customer_id",), filters="status = 'F'")
    return gold.table(_sales(spark, d), card).withColumn("basket__num", F.col("basket__num").cast("decimal(28,2)"))


# ---- proofs ---------------------------------------------------------------------------------------------------


@query(
    "reconcile_full_outer",
    f"""SELECT coalesce(a.segment, b.segment) AS segment, a.v AS gold_value, b.v AS control_value
    FROM (SELECT segment, COUNT(*) AS v FROM {_SALES} WHERE segment <> 'BUILDING' GROUP BY 1) a
    FULL JOIN (SELECT segment, COUNT(*) AS v FROM {_SALES} WHERE segment <> 'MACHINERY' GROUP BY 1) b ON a.segment IS NOT DISTINCT FROM b.segment
    WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)""",
)
def _(spark, d):
    sales = _sales(spark, d)
    by = lambda x: sales.where(F.col("segment") != x).groupBy("segment").agg(F.count("*").alias("value"))
    return gold.reconcile(by("BUILDING"), by("MACHINERY"), ["segment"])


@query("unclassified_values", "SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F','O')")
def _(spark, d):
    return gold.unclassified(read(spark, d, "orders"), "o_orderstatus", ["F", "O"])


@query(
    "excluded_share",
    "SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F','O') AND o_totalprice > 1000, FALSE)) AS excluded FROM orders",
)
def _(spark, d):
    card = _card(Measure("n", "count"), filters="o_totalprice > 1000", include=(("o_orderstatus", ("F", "O")),))
    return gold.excluded_share(read(spark, d, "orders"), card)


@query("grain_unique", "SELECT l_orderkey, l_partkey, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def _(spark, d):
    return gold.repeated_grain(read(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "range_check",
    "SELECT COUNT(o_totalprice) AS checked, COUNT(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) AS outside FROM orders",
)
def _(spark, d):
    return gold.out_of_range(read(spark, d, "orders"), "o_totalprice", 1000, 400000)


# ---- profiles -------------------------------------------------------------------------------------------------


def _profile_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{0}' AS column_name, COUNT(*) FILTER (WHERE {0} IS NULL) AS nulls, COUNT(*) FILTER (WHERE CAST({0} AS VARCHAR) = '') AS empties, COUNT(DISTINCT {0}) AS distinct_values, CAST(MIN(length(CAST({0} AS VARCHAR))) AS INTEGER) AS min_length, CAST(MAX(length(CAST({0} AS VARCHAR))) AS INTEGER) AS max_length FROM {1}"
    return " UNION ALL ".join(one.format(c, table) for c in columns)


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("profile_columns", _profile_sql("(SELECT * REPLACE (CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal) FROM customer)", _CUSTOMER))
def _(spark, d):
    return profile.columns(read(spark, d, "customer").withColumn("c_acctbal", money("c_acctbal")), exact=True)


@query(
    "profile_formats",
    f"""WITH t AS (SELECT {_DATE_SQL} AS raw FROM orders) SELECT '%Y-%m-%d' AS format, COUNT(TRY_STRPTIME(raw, '%Y-%m-%d')) AS parsed FROM t
    UNION ALL SELECT '%d/%m/%Y', COUNT(TRY_STRPTIME(raw, '%d/%m/%Y')) FROM t UNION ALL SELECT '%b %d %Y', COUNT(TRY_STRPTIME(raw, '%b %d %Y')) FROM t""",
)
def _(spark, d):
    return profile.formats(read(spark, d, "orders").select(_date_text().alias("raw")), "raw", _DATES)


@query(
    "profile_structural",
    """SELECT event_type AS split_value, COUNT(*) AS n, 'x' AS column_name, COUNT(*) AS nulls FROM events WHERE event_type = 'view'
    GROUP BY event_type HAVING COUNT(*) >= 20""",
)
def _(spark, d):
    rows = read(spark, d, "events").select("event_type", F.when(F.col("event_type") != "view", F.col("event_id")).alias("x"))
    return profile.structural_nulls(rows, "event_type")


@query("top_values", "SELECT CAST(o_custkey AS VARCHAR) AS value, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def _(spark, d):
    return profile.top_values(read(spark, d, "orders"), "o_custkey")


@query(
    "profile_castable",
    """SELECT MIN(TRY_CAST(x AS BIGINT)) AS lowest, MAX(TRY_CAST(x AS BIGINT)) AS highest, COUNT(*) FILTER (WHERE x IS NOT NULL AND TRY_CAST(x AS BIGINT) IS NULL) AS not_castable
    FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS x FROM customer)""",
)
def _(spark, d):
    k = F.col("c_custkey")
    return profile.castable(read(spark, d, "customer").select(F.when(k % 10 == 0, "n/a").otherwise(k.cast("string")).alias("x")), "x", "BIGINT")


@query("distinct_rows", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT * FROM events)")
def _(spark, d):
    return profile.distinct_rows(read(spark, d, "events"))


_ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()


def _key_sql(table: str, columns: list[str]) -> str:
    sets = [[c] for c in columns] + [[a, b] for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = "SELECT '{0}' AS \"columns\", COUNT(*) AS rows FROM {1} HAVING COUNT(DISTINCT ({0})) = COUNT(*) AND COUNT(*) FILTER (WHERE {2}) = 0"
    every = " UNION ALL ".join(one.format(",".join(s), table, " OR ".join(f"{c} IS NULL" for c in s)) for s in sets)
    return f"WITH k AS ({every}) SELECT * FROM k WHERE \"columns\" NOT LIKE '%,%' OR NOT EXISTS (SELECT 1 FROM k s WHERE list_contains(string_split(k.\"columns\", ','), s.\"columns\"))"


@query("key_candidates", _key_sql("orders", _ORDERS))
def _(spark, d):
    return profile.key_candidates(read(spark, d, "orders"))


@query(
    "key_check",
    """SELECT 'l_orderkey' AS "columns", COUNT(*) AS rows, COUNT(DISTINCT l_orderkey) AS distinct_keys, CAST(0 AS BIGINT) AS empty_keys FROM lineitem
    UNION ALL SELECT 'l_orderkey,l_linenumber', COUNT(*), COUNT(DISTINCT (l_orderkey, l_linenumber)), 0 FROM lineitem""",
)
def _(spark, d):
    return profile.key_check(read(spark, d, "lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"]])


@query("joined_values", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS joined FROM customer GROUP BY c_nationkey")
def _(spark, d):
    return profile.joined(read(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query(
    "table_content_hash",
    """SELECT COUNT(*) AS n, CAST(SUM(CAST('0x' || left(md5(concat_ws('|', coalesce(CAST(n_nationkey AS VARCHAR), '\\N'), coalesce(n_name, '\\N'),
    coalesce(CAST(n_regionkey AS VARCHAR), '\\N'))), 12) AS BIGINT)) AS DECIMAL(38,0)) AS digest FROM nation""",
)
def _(spark, d):
    return profile.content_hash(read(spark, d, "nation"))


@query("rows_not_in_other", "SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _(spark, d):
    mine, other = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), read(spark, d, "supplier").select("s_nationkey")
    return mine.exceptAll(other)


@query(
    "structural_whole_column",
    "SELECT CAST(NULL AS VARCHAR) AS split_value, COUNT(*) AS n, 'gone' AS column_name, COUNT(*) AS nulls FROM events HAVING COUNT(*) >= 20",
)
def _(spark, d):
    return profile.structural_nulls(read(spark, d, "events").select("event_id", F.lit(None).cast("string").alias("gone")))


@query("row_numbers", "SELECT c_custkey, row_number() OVER () AS _row_number FROM customer")
def _(spark, d):
    return scan.parquet_rows(spark, f"{d}/customer.parquet").select("c_custkey", "_row_number")


# ---- set operations and serving ---------------------------------------------------------------------------------


@query(
    "union_by_name",
    """SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""",
)
def _(spark, d):
    c = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query(
    "kpi_ratio",
    f"SELECT 100.0 * CAST(COUNT(*) FILTER (WHERE status = 'F') AS DOUBLE) / COUNT(*) AS value FROM {_SALES}",
)
def _(spark, d):
    card = _card(Measure("share", "ratio", where="status = 'F'", scale=100), grain=("segment",))
    return gold.kpi(gold.table(_sales(spark, d), card), "share", "ratio", 100)


@query(
    "kpi_last_period",
    f"SELECT CAST(COUNT(*) AS DOUBLE) AS value FROM {_SALES} WHERE date_trunc('month', ordered) = (SELECT MAX(date_trunc('month', o_orderdate)) FROM orders)",
)
def _(spark, d):
    card = _card(Measure("n", "count"), grain=("segment",), time="ordered", bucket="month")
    return gold.kpi(gold.table(_sales(spark, d), card), "n", "last")


@query(
    "chart_pivot",
    f"""SELECT CAST(date_trunc('year', ordered) AS DATE) AS period, COUNT(*) FILTER (WHERE status = 'F') AS "F",
    COUNT(*) FILTER (WHERE status = 'O') AS "O", COUNT(*) FILTER (WHERE status = 'P') AS "P" FROM {_SALES} GROUP BY 1""",
)
def _(spark, d):
    card = _card(Measure("n", "count"), grain=("status",), time="ordered", bucket="year")
    return gold.chart(gold.table(_sales(spark, d), card), "period", "n", "status")


@query(
    "frame_filter",
    f"""SELECT segment, CAST(date_trunc('month', ordered) AS DATE) AS period, COUNT(*) AS n FROM {_SALES}
    WHERE segment IN ('BUILDING') AND date_trunc('month', ordered) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY ALL""",
)
def _(spark, d):
    card = _card(Measure("n", "count"), grain=("segment",), time="ordered", bucket="month")
    return gold.frame(gold.table(_sales(spark, d), card), "period", "1996-01-01", "1996-12-31", {"segment": ["BUILDING"]})


@query("filter_values", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def _(spark, d):
    return gold.filter_values(read(spark, d, "customer"), "c_mktsegment")

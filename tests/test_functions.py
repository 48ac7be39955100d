import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import casts, keys
from millrace.functions.types import java_pattern, kind, spark_type, swapped, widens


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_strict_integers(spark):
    raw = [("7",), (" +12 ",), ("3.7",), ("",), (None,), ("99999999999",), ("1e3",)]
    assert one(spark, casts.strict_int(F.col("x")), raw, "x string") == [7, 12, None, None, None, None, None]


def test_decimals_are_never_rounded(spark):
    raw = [("3.14",), ("3.149",), ("-2",), ("x",), (None,)]
    got = one(spark, casts.lossless_decimal(F.col("x"), "DECIMAL(10,2)").cast("string"), raw, "x string")
    assert got == ["3.14", None, "-2.00", None, None]


def test_first_format_wins_and_twins_are_ambiguous(spark):
    f = ["%Y-%m-%d", "%d/%m/%Y", "%b %d %Y"]
    raw = [("2024-03-04",), ("3/4/2024",), ("25/12/2024",), ("Jan 05 2024",), (" 2024-02-30 ",), ("4/4/2024",)]
    days = one(spark, casts.parse_time(F.col("x"), f).cast("date"), raw, "x string")
    assert days == [dt.date(2024, 3, 4), dt.date(2024, 4, 3), dt.date(2024, 12, 25), dt.date(2024, 1, 5), None, dt.date(2024, 4, 4)]
    assert one(spark, casts.ambiguous(F.col("x"), f), raw, "x string") == [False, True, False, False, False, False]
    assert [swapped(x) for x in ("%m/%d/%Y", "%d.%m.%y %H:%M", "%Y-%m-%d", "%d%m%Y", "%b %d %Y")] == ["%d/%m/%Y", "%m.%d.%y %H:%M", None, None, None]


def test_zone_overlap_takes_the_later_offset(spark):
    raw = [("2024-11-03 01:30:00",), ("2024-07-01 12:00:00",), ("2024-03-10 02:30:00",)]
    got = one(spark, casts.shift_zone(F.col("x").cast("timestamp_ntz"), "America/New_York", "UTC").cast("string"), raw, "x string")
    assert got[:2] == ["2024-11-03 06:30:00", "2024-07-01 16:00:00"]


def test_frozen_keys(spark):
    rows = [("EVT-1", 7, "2024-01-02", "2024-01-02 03:04:05"), ("  EVT-1 ", 7, "2024-01-02", "2024-01-02 03:04:05"), (None,) * 4]
    df = spark.createDataFrame(rows, "id string, n int, d string, t string")
    df = df.select("id", "n", F.col("d").cast("date").alias("d"), F.col("t").cast("timestamp_ntz").alias("t"))
    sk = keys.surrogate_key([(F.col("id"), "string"), (F.col("n"), "int"), (F.col("d"), "date"), (F.col("t"), "timestamp_ntz")])
    got = [r[0] for r in df.select(sk).collect()]
    assert got[0] == got[1] and got[0].startswith("c2619b1e") and got[2].startswith("589e8a96")


def test_patterns_and_types():
    assert java_pattern("%d/%m/%Y") == "d/M/y"
    assert java_pattern("%Y%m%d") == "yyyyMMdd"
    assert java_pattern("%Y-%m-%dT%H:%M:%S.%f") == "y-M-d'T'H:m:s[.SSSSSS]"
    with pytest.raises(ValueError):
        java_pattern("%Q")
    assert spark_type("numeric(10, 2)") == "decimal(10,2)" and kind("HUGEINT") == "integer"
    assert widens("int", "bigint") and not widens("string", "int") and not widens("bigint", "int")

"""Counts-only profiles, each in a single pass over its table; exact distinct counts take one grouping for each."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import parse_time
from ..functions.types import spark_type


def _long(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The single row of per-column measures ``<column>|<name>`` as one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}|{n}`").alias(n) for n in names]) for c in columns])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def _groups(df: DataFrame, names: list[str], **measures) -> DataFrame:
    """The different rows of some columns as ``k0``, ``k1``, ..., how often each occurs as ``n``, and measures of them.

    A grouping for each set of columns holds its own keys only; several distinct counts in one aggregate copy every row for each count
    and group the copies by all columns and measures at once.
    """
    keys = [f"k{i}" for i in range(len(names))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keys)])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[m.alias(name) for name, m in measures.items()])


def _rows_where(condition):
    """The number of rows in the groups that meet a condition; 0 if there are none."""
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _exact_column(df: DataFrame, column: str) -> DataFrame:
    value, length = F.col("k0"), F.length(F.col("k0").cast("string"))
    return _groups(df, [column], low=F.min(length), high=F.max(length)).agg(
        F.lit(column).alias("column_name"),
        _rows_where(value.isNull()).alias("nulls"),
        _rows_where(value.cast("string") == "").alias("empties"),
        F.count(value).alias("distinct_values"),
        F.min("low").alias("min_length"),
        F.max("high").alias("max_length"),
    )


def columns(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: nulls, empty strings, distinct values, shortest and longest text.

    Distinct values are estimated in the same pass; ``exact`` ones read the table once for every column, and only that column of it.
    """
    if exact:
        return reduce(DataFrame.unionByName, [_exact_column(df, c) for c in df.columns])
    measures = []
    for c in df.columns:
        text = F.col(f"`{c}`").cast("string")
        measures += [
            F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}|nulls"),
            F.count_if(text == "").alias(f"{c}|empties"),
            F.approx_count_distinct(F.col(f"`{c}`")).alias(f"{c}|distinct_values"),
            F.min(F.length(text)).alias(f"{c}|min_length"),
            F.max(F.length(text)).alias(f"{c}|max_length"),
        ]
    return _long(df.agg(*measures), df.columns, ["nulls", "empties", "distinct_values", "min_length", "max_length"])


def formats(df: DataFrame, column: str, candidates: list[str]) -> DataFrame:
    """How many values each date format reads."""
    counts = df.agg(*[F.count(parse_time(F.col(column), [f])).alias(f"f{k}") for k, f in enumerate(candidates)])
    rows = F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"f{k}").alias("parsed")) for k, f in enumerate(candidates)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def castable(df: DataFrame, column: str, declared: str) -> DataFrame:
    value = F.trim(F.col(column).cast("string")).try_cast(spark_type(declared))
    lost = F.col(column).isNotNull() & value.isNull()
    return df.agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.sum(lost.cast("long")).alias("not_castable"))


def structural_nulls(df: DataFrame, split: str | None = None, least_rows: int = 20, share: float = 0.999) -> DataFrame:
    """(split_value, n, column_name, nulls) where a column is (nearly) always NULL for one value of ``split``, or without one in the whole table."""
    others = [c for c in df.columns if c != split]
    value = F.lit(None).cast("string") if split is None else F.col(f"`{split}`").cast("string")
    by = df.groupBy(value.alias("split_value")).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in others]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in others])
    long = by.where(F.col("n") >= least_rows).select("split_value", "n", F.explode(rows).alias("r"))
    return long.select("split_value", "n", "r.*").where(F.col("nulls") >= share * F.col("n"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def duplicate_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct().agg(F.count("*").alias("n"))


def _empty(df: DataFrame, names: list[str]):
    """Whether any of the columns is NULL or a blank text."""
    kinds, some = dict(df.dtypes), F.lit(False)
    for c in names:
        col = F.col(f"`{c}`")
        some |= col.isNull() | (F.trim(col) == "" if kinds[c] == "string" else F.lit(False))
    return F.coalesce(some, F.lit(True))


def key_check(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(columns, rows, distinct_keys, empty_keys) of the given sets of columns, exactly and by a grouping for each."""

    def check(names: list[str]) -> DataFrame:
        groups = _groups(df, names)
        return groups.agg(
            F.lit(",".join(names)).alias("columns"),
            _rows_where(F.lit(True)).alias("rows"),
            F.count("*").alias("distinct_keys"),
            _rows_where(_empty(groups, groups.columns[: len(names)])).alias("empty_keys"),
        )

    return reduce(DataFrame.unionByName, [check(s) for s in sets])


def key_candidates(df: DataFrame, pairs_of: int = 12, rsd: float = 0.02) -> DataFrame:
    """(columns, rows) of every single column and pair that is a key: no value twice, none empty.

    One pass estimates the distinct values of all columns and of the pairs of the ``pairs_of`` columns with most of them; only sets
    that may be keys by that are looked at exactly, one by one.  A pair that holds a key of one column is not listed.
    """
    estimate = lambda s: F.approx_count_distinct(F.struct(*[f"`{c}`" for c in s]), rsd)
    singles = [[c] for c in df.columns]
    first = df.agg(F.count("*"), *[estimate(s) for s in singles], *[F.count_if(_empty(df, s)) for s in singles]).first()
    rows, n = first[0], len(singles)
    guess, empty = dict(zip(df.columns, first[1 : n + 1])), dict(zip(df.columns, first[n + 1 :]))
    least = rows * (1 - 4 * rsd)
    able = [c for c in df.columns if not empty[c]]
    # each is one grouping with a partial aggregate; several distinct counts at once would copy every row for each
    unique = lambda names: not df.groupBy(*[F.col(f"`{c}`") for c in names]).count().where("count > 1").limit(1).count()
    keys = [[c] for c in able if rows and guess[c] >= least and unique([c])]
    alone = {k[0] for k in keys}
    wide = set(sorted((c for c in able if c not in alone), key=lambda c: (-guess[c], c))[:pairs_of])
    pairs = [[a, b] for a, b in combinations([c for c in df.columns if c in wide], 2) if guess[a] * guess[b] >= least]
    if rows and pairs:
        seen = df.agg(*[estimate(p) for p in pairs]).first()
        keys += [p for p, g in zip(pairs, seen) if g >= least and unique(p)]
    return df.sparkSession.createDataFrame([(",".join(k), rows) for k in keys], "columns string, rows long")


def joined(df: DataFrame, by: list[str], column: str, between: str = "; ") -> DataFrame:
    """The different values of a column per group, in order, as one text."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), between).alias("joined"))


def content_hash(df: DataFrame) -> DataFrame:
    """(n, digest) of a table: equal for the same rows in any order."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in df.columns]))
    number = F.conv(F.left(row, F.lit(12)), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def propose_types(df: DataFrame, formats_: list[str] | None = None) -> dict[str, str]:
    """The narrowest declared type that every non-empty value of each column fits, from one pass; flags and codes stay text."""
    dates, measures = formats_ or ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S"], []
    for k, c in enumerate(df.columns):
        text = F.trim(F.col(f"`{c}`").cast("string"))
        full = F.when(text != "", text)
        measures += [
            F.count(full).alias(f"n{k}"),
            F.count(F.when(full.rlike(r"^[+-]?(0|[1-9]\d{0,17})$"), 1)).alias(f"ints{k}"),
            F.count(F.when(full.rlike(r"^[+-]?\d{1,16}(\.\d{1,2})?$") & ~full.rlike(r"^[+-]?0\d"), 1)).alias(f"decs{k}"),
            F.count(full.try_cast("double")).alias(f"nums{k}"),
            F.count(parse_time(full, dates)).alias(f"times{k}"),
            F.count(F.when(full.rlike(r"\d:\d"), 1)).alias(f"clocks{k}"),
        ]
    row = df.agg(*measures).first()

    def narrowest(k: int) -> str:
        n, ints, decs, nums, times, clocks = (row[f"{x}{k}"] for x in ("n", "ints", "decs", "nums", "times", "clocks"))
        if not n:
            return "VARCHAR"
        if ints == n:
            return "BIGINT"
        if decs == n:
            return "DECIMAL(18,2)"
        if times == n:
            return "TIMESTAMP" if clocks else "DATE"
        return "DOUBLE" if nums == n and not ints else "VARCHAR"

    return {c: narrowest(k) for k, c in enumerate(df.columns)}


def propose_type(df: DataFrame, column: str, formats_: list[str] | None = None) -> str:
    return propose_types(df.select(F.col(f"`{column}`").alias("x")), formats_)["x"]

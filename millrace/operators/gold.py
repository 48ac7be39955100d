"""Metric cards as aggregate tables, and the checks that prove them."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fragments import holds
from ..plans.specs import Card, Measure
from ..sources.store import Table
from .checks import Proof, demand


def bucket(c: Column, size: str) -> Column:
    """The first day of the bucket; weeks start on Monday, ``week_sunday`` on Sunday."""
    d = c.cast("date")
    if size == "day":
        return d
    if size == "week_sunday":
        return F.date_sub(F.trunc(F.date_add(d, 1), "week"), 1)
    if size in ("week", "month", "quarter", "year"):
        return F.trunc(d, size)
    raise ValueError(f"unknown bucket {size}")


def _included(card: Card) -> Column:
    """Whether a row's values are on the inclusion lists."""
    inside = [F.coalesce(F.col(c).cast("string").isin(*values), F.lit(False)) for c, values in card.include]
    return reduce(lambda a, b: a & b, inside, F.lit(True))


def _aggregate(kind: str, column: str | None, where: Column) -> Column:
    value = F.when(where, F.lit(1) if column is None else F.col(column))
    if kind == "sum":
        return F.sum(value)
    if kind == "distinct":
        return F.countDistinct(value)
    return F.count(value)


def _parts(card: Card, m: Measure) -> dict[str, Column]:
    """A measure's aggregates; only a ratio's population is bound by the inclusion lists."""
    rows = holds(card.filters)
    mine = rows & holds(m.where)
    if m.kind == "ratio":
        # the numerator's rows are counted or summed as the denominator's are, unless it names a column
        kind, inside = "sum" if m.column else m.denominator_kind, _included(card)
        return {
            f"{m.name}__num": _aggregate(kind, m.column or m.denominator_column, mine & inside),
            f"{m.name}__den": _aggregate(m.denominator_kind, m.denominator_column, rows & inside & holds(m.denominator)),
        }
    if m.kind == "average":
        column = m.denominator_column or m.column
        kind = "distinct" if m.denominator_kind == "distinct" else "count"
        return {f"{m.name}__num": _aggregate("sum", m.column, mine), f"{m.name}__den": _aggregate(kind, column, mine)}
    return {m.name: _aggregate(m.kind, m.column, mine)}


def _grain(card: Card) -> list[Column]:
    grain = [F.col(c) for c in card.grain]
    return [*grain, bucket(F.col(card.time), card.bucket).alias("period")] if card.time else grain


def grain_of(card: Card) -> list[str]:
    return [*card.grain, *(["period"] if card.time else [])]


def _alive(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("_is_deleted")) if "_is_deleted" in rows.columns else rows


def table(rows: DataFrame, card: Card) -> DataFrame:
    """One row per grain and bucket with every measure; ratios and averages publish their parts.

    A group stays if a measure has a qualifying row in it: one that passes the card's filters and, unless the measure is a ratio or an
    average, its own.
    """
    cols: dict[str, Column] = {}
    for m in card.measures:
        cols |= _parts(card, m)
        qualifies = holds(card.filters) if m.divided else holds(card.filters) & holds(m.where)
        cols[f"_rows__{m.name}"] = F.count(F.when(qualifies, 1))
    df = _alive(rows).groupBy(*_grain(card)).agg(*[c.alias(n) for n, c in cols.items()])
    keep = []
    for m in card.measures:
        here = F.col(f"_rows__{m.name}") > 0
        if m.divided:
            den = F.coalesce(F.col(f"{m.name}__den"), F.lit(0))
            if m.zero == "omit":
                here &= den != 0
            quotient = F.round(
                m.scale * F.col(f"{m.name}__num").cast("double") / F.when(den != 0, den.cast("double")), m.precision
            )
            df = df.withColumn(m.name, F.when(den == 0, F.lit(0.0)).otherwise(quotient) if m.zero == "zero" else quotient)
        elif m.kind == "sum":
            df = df.withColumn(m.name, F.round(m.name, m.precision))
        keep.append(here)
    df = df.where(reduce(lambda a, b: a | b, keep))
    return df.drop(*[c for c in df.columns if c.startswith("_rows__")])


# ---- proofs -------------------------------------------------------------------------------------------------


def repeated_grain(gold: DataFrame, grain: list[str]) -> DataFrame:
    return gold.groupBy(*grain).agg(F.count("*").alias("n")).where("n > 1")


def out_of_range(gold: DataFrame, measure: str, low=None, high=None) -> DataFrame:
    """(checked, outside); a NULL is outside of nothing."""
    bad = F.lit(False)
    if low is not None:
        bad |= F.coalesce(F.col(measure) < low, F.lit(False))
    if high is not None:
        bad |= F.coalesce(F.col(measure) > high, F.lit(False))
    return gold.agg(F.count(measure).alias("checked"), F.sum(bad.cast("long")).alias("outside"))


def reconcile(gold: DataFrame, control: DataFrame, grain: list[str]) -> DataFrame:
    """Full join of two (grain, value) tables, NULL keys equal; rows where the values differ."""
    a = gold.select(*[F.col(c).alias(f"a_{c}") for c in grain], F.col("value").alias("a_value"), F.lit(1).alias("in_a"))
    b = control.select(*[F.col(c).alias(f"b_{c}") for c in grain], F.col("value").alias("b_value"), F.lit(1).alias("in_b"))
    on = reduce(lambda x, y: x & y, [a[f"a_{c}"].eqNullSafe(b[f"b_{c}"]) for c in grain])
    met = a.join(b, on, "full")
    keys = [F.when(F.col("in_a").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in grain]
    zero = lambda c: F.coalesce(c, F.lit(0))
    return met.where(zero("a_value") != zero("b_value")).select(
        *keys, F.col("a_value").alias("gold_value"), F.col("b_value").alias("control_value")
    )


def golden(gold: DataFrame, expected: DataFrame, grain: list[str], measure: str, precision: int = 2, additive: bool = True) -> DataFrame:
    """Rows of ``expected`` (grain, expected) that gold misses by more than half a unit of the last place.

    A missing row equals zero for counts and sums, a blank for ratios.
    """
    e = expected.select(*[F.col(c).alias(f"e_{c}") for c in grain], "expected")
    on = reduce(lambda x, y: x & y, [e[f"e_{c}"].eqNullSafe(gold[c]) for c in grain])
    met = e.join(gold.select(*grain, measure), on, "left")
    got, want = F.col(measure).cast("double"), F.col("expected").cast("double")
    if additive:
        got, want = F.coalesce(got, F.lit(0.0)), F.coalesce(want, F.lit(0.0))
    wrong = (got.isNull() != want.isNull()) | (F.abs(got - want) > 0.5 * 10.0**-precision + 1e-9)
    return met.where(F.coalesce(wrong, F.lit(False))).select(*[F.col(f"e_{c}").alias(c) for c in grain], "expected", measure)


def unclassified(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values that neither the population nor its stated outside names, NULL first."""
    value = F.col(column).cast("string")
    return rows.where(value.isNull() | ~value.isin(*known)).select(value.alias("value")).distinct()


def excluded_share(rows: DataFrame, card: Card) -> DataFrame:
    out = F.sum(F.when(holds(card.filters) & _included(card), 0).otherwise(1)).cast("long")
    return rows.agg(F.count("*").alias("n_rows"), out.alias("excluded"))


def _control(text: str, where: Column) -> Column:
    kind, _, column = text.partition(":")
    return _aggregate(kind, column or None, where)


def controlled(gold: DataFrame, rows: DataFrame, card: Card, m: Measure) -> DataFrame:
    """Per grain key the published value, the control and what is excluded of it; ``off`` where they do not add up.

    Distinct counts do not add: there the control is counted over the rows that are not excluded.
    """
    out = holds(m.excluded_by) if m.excluded_by else F.lit(False)
    distinct = m.control.startswith("distinct")
    control = _control(m.control, ~out if distinct else F.lit(True))
    excluded = F.lit(0) if distinct else _control(m.control, out)
    names = grain_of(card)
    by = _alive(rows).groupBy(*_grain(card)).agg(
        control.alias("control"), excluded.alias("excluded"), F.count_if(out).alias("excluded_rows"), F.count("*").alias("all_rows")
    )
    by = by.select(*[F.col(c).alias(f"s_{c}") for c in names], "control", "excluded", "excluded_rows", "all_rows")
    mine = gold.select(*names, F.col(f"{m.name}__den" if m.divided else m.name).alias("value"))
    on = reduce(lambda a, b: a & b, [mine[c].eqNullSafe(by[f"s_{c}"]) for c in names])
    half = 0.5 * 10.0**-m.precision if m.kind == "sum" else 0.0
    zero = lambda c: F.coalesce(F.col(c).cast("decimal(38,6)"), F.lit(0))
    off = F.abs(zero("value") + zero("excluded") - zero("control")) > half + 1e-9
    keys = [F.coalesce(c, f"s_{c}").alias(c) for c in names]
    return mine.join(by, on, "full").select(*keys, "value", "control", "excluded", "excluded_rows", "all_rows", off.alias("off"))


def golden_misses(gold: DataFrame, m: Measure) -> int:
    """How many of the values computed by hand the table does not have; no row equals zero, or a blank for ratios."""
    bad = 0
    for key, want in m.golden:
        here = reduce(lambda a, b: a & b, [F.col(c).cast("string") == v for c, v in key])
        got = [r[0] for r in gold.where(here).select(F.col(m.name).cast("double")).limit(2).collect()]
        if len(got) != 1:
            ok = not got and (want is None if m.divided or m.zero == "omit" else want == 0)
        else:
            ok = got[0] is None if want is None else got[0] is not None and abs(got[0] - want) <= 0.5 * 10.0**-m.precision + 1e-9
        bad += not ok
    return bad


def table_proofs(gold: DataFrame, rows: DataFrame, card: Card) -> list[Proof]:
    """What has to hold of a written table before it may be seen."""
    total = gold.count()
    found = [Proof(f"grain_{card.table}", total, repeated_grain(gold, grain_of(card)).count())]
    for m in card.measures:
        r = out_of_range(gold, m.name, m.low, m.high).first()
        found.append(Proof(f"range_{m.name}", r.checked, r.outside or 0, f"{total - r.checked} blanks not looked at" if r.checked else ""))
        if m.golden:
            found.append(Proof(f"golden_{m.name}", len(m.golden), golden_misses(gold, m)))
        else:
            found.append(Proof(f"golden_{m.name}", 0, 0, "no values computed by hand yet", fatal=False))
        if m.control:
            c = controlled(gold, rows, card, m).agg(
                F.count("*").alias("n"), F.count_if("off").alias("off"), F.sum("excluded_rows").alias("out"), F.sum("all_rows").alias("every")
            ).first()
            share = 100.0 * (c.out or 0) / max(c.every or 0, 1)
            found.append(Proof(f"control_{m.name}", c.n, c.off))
            found.append(Proof(f"excluded_{m.name}", c.every or 0, int(share > m.max_excluded), f"{share:.2f} % left out, {m.max_excluded} % allowed"))
        if m.kind == "ratio" and card.include:
            if m.column is None and m.denominator_kind == "count" and m.denominator == "TRUE":
                found.append(Proof(f"part_of_whole_{m.name}", total, gold.where(F.col(f"{m.name}__num") > F.col(f"{m.name}__den")).count()))
            mine = _alive(rows).where(holds(card.filters))
            known = {c: [*values, *dict(card.exclude).get(c, ())] for c, values in card.include}
            new = {c: [x.value for x in unclassified(mine, c, v).limit(10).collect()] for c, v in known.items()}
            found.append(Proof(f"classified_{m.name}", 1, sum(map(len, new.values())), f"neither in nor out: {new}"))
            outside = mine.where(holds(m.where) & ~_included(card)).count()
            found.append(Proof(f"outside_{m.name}", 1, 0, f"{outside} rows of the numerator are not in the population", fatal=False))
    return found


def headline(gold: DataFrame, card: Card, m: Measure) -> float | None:
    """The one number that stands for a measure; None where there is none."""
    if not m.divided and m.additivity == "non_additive" and card.grain:
        return None
    how = "ratio" if m.divided else "sum" if m.additivity == "additive" else "last"
    got = kpi(gold, m.name, how, m.scale).first().value
    return None if got is None else round(float(got), m.precision)


def build(spark: SparkSession, cards: list[tuple[Card, DataFrame]], root: str) -> dict:
    """Writes every card's table, proves all as written, and only then makes any of them visible.

    Gives proofs, headlines and versions; raises ValueError for a bad declaration and CheckFailed for a proof that does not hold.
    """
    wrong = [f"{c.table}: {x}" for c, _ in cards for x in c.problems()]
    names = [c.table for c, _ in cards]
    wrong += [f"{t} is written by several cards" for t in sorted({t for t in names if names.count(t) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))
    staged, proofs, heads = [], [], {}
    for card, rows in cards:
        target = Table(spark, f"{root}/{card.table}")
        version, written = target.stage(table(rows, card))
        staged.append((target, version))
        proofs += table_proofs(written, rows, card)
        heads |= {f"{card.table}.{m.name}": headline(written, card, m) for m in card.measures}
    demand(proofs)
    versions = {t.root.rsplit("/", 1)[-1]: t.release(v) for t, v in staged}
    return {"proofs": proofs, "headlines": heads, "versions": versions}


# ---- serving ------------------------------------------------------------------------------------------------


def kpi(
    gold: DataFrame, measure: str, kind: str = "sum", scale: int = 1, period: str = "period", precision: int | None = None
) -> DataFrame:
    """One number: a ratio from its summed parts, a sum, or the last period's value; ratios are never averaged."""
    rounded = lambda c: c if precision is None else F.round(c, precision)
    if kind == "ratio":
        num, den = F.sum(f"{measure}__num").cast("double"), F.sum(f"{measure}__den").cast("double")
        return gold.agg(rounded(scale * num / F.when(den != 0, den)).alias("value"))
    if kind != "sum":
        last = gold.agg(F.max(period).alias("_last"))
        gold = gold.join(F.broadcast(last), gold[period] == F.col("_last"))
    return gold.agg(rounded(F.sum(measure).cast("double")).alias("value"))


def chart(
    gold: DataFrame, x: str, measure: str, color: str | None = None, kind: str = "sum", scale: int = 1, additivity: str = "additive",
    period: str = "period", precision: int | None = None,
) -> DataFrame:
    """x and one column per colour; gaps of additive measures are 0, of others blank.

    What cannot be added over time is taken at its last period, unless the chart shows the periods.
    """
    if additivity == "semi_additive" and period not in (x, color):
        last = gold.agg(F.max(period).alias("_last"))
        gold = gold.join(F.broadcast(last), gold[period] == F.col("_last")).drop("_last")
    if kind == "ratio":
        num, den = F.sum(f"{measure}__num").cast("double"), F.sum(f"{measure}__den").cast("double")
        value = scale * num / F.when(den != 0, den)
        value = value if precision is None else F.round(value, precision)
    else:
        value = F.sum(measure)
    if color is None:
        return gold.groupBy(x).agg(value.alias(measure))
    wide = gold.groupBy(x).pivot(color).agg(value)
    return wide.fillna(0, [c for c in wide.columns if c != x]) if kind == "sum" and additivity == "additive" else wide


def frame(gold: DataFrame, period: str | None = None, start=None, end=None, filters: dict[str, list[str]] | None = None) -> DataFrame:
    if period and start is not None:
        gold = gold.where(F.col(period) >= F.lit(start).cast("date"))
    if period and end is not None:
        gold = gold.where(F.col(period) <= F.lit(end).cast("date"))
    for c, values in (filters or {}).items():
        if c in gold.columns and values:
            gold = gold.where(F.col(c).cast("string").isin(*values))
    return gold


def filter_values(gold: DataFrame, column: str) -> DataFrame:
    return gold.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()


def date_bounds(tables: list[DataFrame], period: str = "period") -> DataFrame:
    """First and last period over all tables that have one."""
    dated = [t.agg(F.min(period).alias("low"), F.max(period).alias("high")) for t in tables if period in t.columns]
    return reduce(DataFrame.unionByName, dated).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def freshness(clock: str, now: dt.datetime, limit_hours: float = 0, published: dt.datetime | None = None, newest: dt.date | None = None) -> tuple[str, str]:
    """(status, words) by the clock that counts: replay (never stale), load (time of publishing) or event (newest data)."""
    if clock == "replay":
        return "replay", "historical data, not watched for age"
    if clock == "load":
        published = published if published.tzinfo else published.replace(tzinfo=dt.timezone.utc)
        now = now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
        hours = (now - published).total_seconds() / 3600
        what = f"published {hours:.1f} hours ago"
    elif newest is None:
        return "stale", "no data"
    else:
        hours = 24.0 * (now.date() - newest).days
        what = f"newest data {newest}, {hours / 24:.0f} days ago"
    return ("stale", f"{what}, expected within {limit_hours:.0f} hours") if limit_hours and hours > limit_hours else ("fresh", what)


def formatted(value: float | None, unit: str = "", precision: int = 2) -> str:
    """A number in words: percent, currency:<code> or plain; a dash for none."""
    if value is None:
        return "—"
    text = f"{value:,.{precision}f}"
    if unit == "percent":
        return f"{text}%"
    return f"{unit.partition(':')[2].upper()} {text}" if unit.startswith("currency:") else text

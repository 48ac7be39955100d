"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule says "reject" from the facts of a text; the contract's base rules are rules like any other.  Cost and selectivity of each rule
are measured on a bounded sample: its text is repeated to TIMED_CHARS characters, so that a rule's own work and not the start of a job
is timed, and the time of a rule without work is taken off.  The cascade then asks rules in falling order of
rejections per second, and a row that one rule rejects is not shown to the next.  The order changes time, never the verdict.

``keep_good`` needs verdicts alone and works out a fact only where a rule is asked that needs it; ``judge`` gives all
measures, so there only rules without a measure of their own are saved.

Defined results: a null text counts as an empty one (all counts zero, rejected for having too few
words); every input row gives one output row, repeated rows too; an empty table gives an empty
table; only ``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let, read, words

#: Fixed by the contract of the base measures.
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Up to so many different repeated windows are looked up one by one, more are found by sorting.
FEW_WINDOWS = 24
#: Rows of the sample that cost and selectivity are measured on, and the characters that a rule is timed on.
SAMPLE_ROWS, TIMED_CHARS = 1000, 6_000_000


@dataclass(frozen=True)
class Facts:
    """What rules may ask of a text.  Each is an expression: a column where it is at hand, else worked out where it is used."""

    text: Column
    tokens: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_repeat_words: Column
    #: A function of (lines that repeat an earlier one, lines), as both come from one look at the lines.
    lines: Callable[[Callable[[Column, Column], Column]], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true where the rule turns a document down."""

    name: str
    rejects: Callable[[Facts], Column]


def _repeat_words(tokens: Column) -> Column:
    """Positions that lie in a WINDOW-word window whose words occur twice or more as a window."""

    def cover(starts: Column) -> Column:
        # each flagged window adds the words up to the next flagged start, at most WINDOW
        steps = F.transform(
            starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_lookup(grams: Column, twice: Column) -> Column:
        hits = F.transform(grams, lambda g, i: F.when(F.array_contains(twice, g), i))
        return let(F.array_compact(hits), cover)

    def by_sorting(grams: Column) -> Column:
        # equal windows are neighbours after sorting; a window is flagged if either neighbour equals it
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            near = lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])
            return F.array_sort(F.array_compact(F.transform(s, lambda x, k: F.when(near(x, k), x["i"]))))

        return let(let(ordered, starts), cover)

    def flagged_cover(grams: Column) -> Column:
        twice = let(F.sort_array(grams), lambda s: F.array_distinct(F.filter(s, lambda g, k: F.get(s, k - 1) == g)))
        return let(
            twice, lambda t: F.when(F.size(t) <= FEW_WINDOWS, by_lookup(grams, t)).otherwise(by_sorting(grams))
        )

    def grams(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.size(h) - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]),
        )

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(flagged_cover(g))

    hashed = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: let(grams(h), count))
    return F.when(F.size(tokens) > WINDOW, hashed).otherwise(F.lit(0).cast("long"))


def _word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long")


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def _lines(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    return let(with_word, lambda x: body((F.size(x) - F.size(F.array_distinct(x))).cast("long"), F.size(x).cast("long")))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base measures of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    lines = _lines(text, lambda dup, n: F.struct(dup.alias("dup"), n.alias("n")))
    m = docs.select("doc_id", text.alias("text"), counts.alias("w"), lines.alias("l"))
    return m.select(
        "doc_id",
        "text",
        F.col("w.n_words").alias("n_words"),
        _word_chars(F.col("text")).alias("word_chars"),
        _symbols(F.col("text")).alias("n_symbols"),
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
    )


def measured() -> Facts:
    """The facts as columns of ``measure``."""
    c = F.col
    lines = lambda body: body(c("n_dup_lines"), c("n_lines"))
    return Facts(c("text"), words(c("text")), c("n_words"), c("word_chars"), c("n_symbols"), c("n_repeat_words"), lines)


def lazily(text: Column, body: Callable[[Facts], Column]) -> Column:
    """``body`` of the facts of a text; only the split into words is done in any case."""
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(
            words(t),
            lambda w: body(Facts(t, w, F.size(w).cast("long"), _word_chars(t), _symbols(t), _repeat_words(w), lambda f: _lines(t, f))),
        ),
    )


BASE = [
    Rule("few_words", lambda f: f.n_words < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > REPEAT_PERCENT * f.n_words),
]


def base_failed() -> Column:
    return BASE[0].rejects(measured()) | BASE[1].rejects(measured())


def _stutters(tokens: Column) -> Column:
    return let(tokens, lambda w: F.size(F.filter(w, lambda x, k: F.get(w, k - 1) == x)))


def default_rules() -> list[Rule]:
    """The base rules and rules over symbols, lines, capitals and repeats; none needs another's result."""
    return [
        *BASE,
        Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
        Rule("duplicate_lines", lambda f: f.lines(lambda dup, n: 2 * dup > n)),
        Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 15 * f.n_words)),
        Rule("shouted_marks", lambda f: 10 * F.regexp_count(f.text, F.lit("[!?]")) > 3 * f.n_words),
        Rule("capitals", lambda f: 2 * F.regexp_count(f.text, F.lit(r"\p{Lu}")) > f.word_chars),
        Rule("stutter", lambda f: 10 * _stutters(f.tokens) > 3 * f.n_words),
    ]


class Cascade:
    """An ordered list of rules; ``fit`` orders them, ``passes`` is true where none rejects."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = default_rules() if rules is None else list(rules)
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = TIMED_CHARS) -> Cascade:
        """Measure seconds and rejected share of each rule on at most ``rows`` rows (of the first partitions that hold so many)."""
        sample = docs.select("text").where("text is not null").sample(0.2, 7).limit(rows).persist()
        try:
            total, size = sample.agg(F.count("*"), F.sum(F.length("text"))).first()
            if total and len(self.rules) > 1:
                copies = max(1, min(1000, chars // max(1, size)))
                many = sample.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(copies))))

                def timed(rejects: Callable[[Facts], Column]) -> tuple[float, float]:
                    times, bad = [], 0
                    while len(times) < 3 and sum(times) < 1.0:
                        began = time.perf_counter()
                        bad = many.agg(F.sum(F.when(lazily(F.col("text"), rejects), 1).otherwise(0))).first()[0]
                        times.append(time.perf_counter() - began)
                    return statistics.median(times), bad / (total * copies)

                idle = timed(lambda f: f.n_words < 0)[0]
                for rule in self.rules:
                    seconds, share = timed(rule.rejects)
                    # what is within the noise of a job counts as one hundredth of it
                    self.stats[rule.name] = (max(seconds - idle, idle / 100, 1e-6), share)
                self.rules.sort(key=lambda r: (-self.stats[r.name][1] / self.stats[r.name][0], self.stats[r.name][0], r.name))
        finally:
            sample.unpersist()
        return self

    def passes(self, facts: Facts) -> Column:
        """CASE WHEN stops at the first branch that holds."""
        verdict = None
        for rule in self.rules:
            bad = F.coalesce(rule.rejects(facts), F.lit(False))
            verdict = F.when(bad, F.lit(False)) if verdict is None else verdict.when(bad, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row; ``rules`` come on top of the base rules."""
    cascade = Cascade(None if rules is None else [*BASE, *rules]).fit(docs)
    return measure(docs).withColumn("base_failed", base_failed()).withColumn("kept", cascade.passes(measured()))


def keep_good(docs: DataFrame, cascade: Cascade | None = None) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with their own columns."""
    cascade = cascade or Cascade().fit(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # a generator's result cannot be pushed down as a filter, which would judge every text a second time
    verdict = lazily(F.col("row.text"), cascade.passes)
    judged = rows.select("row", F.explode_outer(F.filter(F.array(verdict), lambda ok: ok)).alias("ok"))
    return judged.where(F.col("ok")).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(read(spark, sf_dir, "documents")).select(*cols)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rn, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rn, i, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT rn, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
f AS (SELECT rn, i FROM g JOIN (SELECT rn, gram FROM g GROUP BY ALL HAVING count(*) > 1) USING (rn, gram)),
r AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + 5)) AS p FROM f) GROUP BY rn),
p AS (SELECT rn, count(*) FILTER (WHERE word = before) AS n FROM (SELECT rn, word, lag(word) OVER (PARTITION BY rn ORDER BY k) AS before
  FROM (SELECT rn, unnest(words) AS word, unnest(range(len(words))) AS k FROM w)) GROUP BY rn),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
  coalesce(r.n, 0) AS n_repeat_words, coalesce(p.n, 0) AS stutters, len(regexp_extract_all(text, '[!?]')) AS marks,
  len(regexp_extract_all(text, '\p{Lu}')) AS capitals FROM w LEFT JOIN r USING (rn) LEFT JOIN p USING (rn)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * marks > 3 * n_words OR 2 * capitals > word_chars OR 10 * stutters > 3 * n_words) AS kept FROM b
"""

"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A seed is a fixed mask over SPAN neighbouring words; it hashes the words under its ones and ignores the others, so a
hit survives substitutions at ignored places.  Benchmark windows are hashed under every mask and joined
with the windows of the training texts.  A hit fixes a diagonal (place in the text minus place in the item); the item's words
are then compared along that diagonal.

What counts as an overlap does not depend on the masks:

* an item of VERIFY words or more overlaps a text where VERIFY words in a row of it agree with the text on one diagonal in at least
  SHARE of their places.  Such a window has two substitutions at most, and wherever they are, one mask at one place in the window ignores
  both (tests count all 78 patterns), so no such window is missed;
* an item of SHORT to VERIFY - 1 words overlaps a text that has it word for word; its own seed spans all of it;
* an item of fewer words says nothing inside a longer text and overlaps only a text that is that item.

Words are compared lower-cased.

Skew: every document is handled in its own row; no document is moved before it has a hit.  Seeds (without texts) and items are broadcast
after a count of both; beyond MOST_SEEDS or MOST_WORDS windows are joined by a shuffle, without texts, which join again only where
there is a hit.

Defined results: null texts and items have no words and no hits; repeated rows are judged alike, rows that share a doc_id by their own
texts; rows without a doc_id are judged too; empty tables give no hits; only ``doc_id``, ``text`` and ``item_id`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, let, read, words

#: Fixed masks of weight 7: of two substitutions anywhere in VERIFY words at least one mask, at one place, ignores both.
MASKS = ("1001111101", "1110100111", "1101110011", "1011101011")
SPAN, SHORT = 10, 5
VERIFY, SHARE = 13, 0.8
MOST_SEEDS, MOST_WORDS, MOST_ROWS = 1_000_000, 4_000_000, 1_000_000


def _hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _seed(h: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(h, at + k) for k, bit in enumerate(mask) if bit == "1"])


def _masks(items: DataFrame) -> list[str]:
    """The masks, and for every length of short items that occurs one that spans all of it (at most 8 lengths)."""
    n = items.where(F.size("item") < VERIFY).select(F.size("item").alias("n")).distinct().collect()
    return [*MASKS, *("1" * r.n for r in sorted(n))]


def _windows(rows: DataFrame, words_: str, at: str, masks: list[str], keep: list[str], of_item: bool) -> DataFrame:
    """``keep``, place and seed of every window under every mask that applies."""
    size, place = F.size(words_), F.col(at)
    least = min(map(len, masks))
    rows = rows.select(*keep, F.posexplode_outer(words_).alias(at, "_w")).where(place <= size - least)

    def seed(m: str) -> Column:
        here = _seed(F.col(words_), place, m)
        if of_item:
            return F.when((size >= VERIFY) & (place <= size - len(m)) if m in MASKS else size == len(m), here)
        return here if len(m) == least else F.when(place <= size - len(m), here)

    rows = rows.select(*keep, at, F.explode(F.array(*[seed(m) for m in masks])).alias("seed"))
    return rows.where("seed is not null") if of_item or len(set(map(len, masks))) > 1 else rows


def _agreement(doc: Column, item: Column, doc_at: Column, item_at: Column) -> Column:
    """Most words that agree in any VERIFY-word window of the item on the hit's diagonal that covers the hit."""
    size = F.least(F.lit(VERIFY), F.size(item))
    first = F.greatest(item_at + F.lit(SPAN) - size, F.lit(0))
    last = F.least(item_at, F.size(item) - size)

    def best(same: Column) -> Column:
        shares = F.transform(
            F.sequence(first, F.greatest(first, last)),
            lambda s: F.aggregate(F.slice(same, s + 1, size), F.lit(0), lambda a, x: a + x),
        )
        return F.array_max(shares)

    same = F.transform(
        item,
        lambda w, k: F.when((k + doc_at - item_at >= 0) & (F.get(doc, k + doc_at - item_at) == w), 1).otherwise(0),
    )
    short = F.aggregate(same, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(item) < VERIFY, short).otherwise(let(same, best))


def _judged(hits: DataFrame) -> DataFrame:
    """Hits (doc, item, doc_at, item_at) that are overlaps."""
    compared = F.least(F.lit(VERIFY), F.size("item"))
    needed = F.when(F.size("item") < VERIFY, F.size("item")).otherwise(SHARE * VERIFY)
    # The comparison stands in a generator, as a filter on it would move into the join and there take the windows
    # out of compiled code, each with a copy of its text.
    agreeing = F.array(_agreement(F.col("doc"), F.col("item"), F.col("doc_at"), F.col("item_at")))
    enough = F.explode_outer(F.filter(agreeing, lambda n: n >= needed))
    judged = hits.select("doc_id", "text_id", "item_id", compared.alias("compared"), enough.alias("agreeing"))
    return judged.where(F.col("agreeing").isNotNull())


def overlaps(docs: DataFrame, bench: DataFrame, most_seeds: int = MOST_SEEDS, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per text and item that overlap: doc_id, text_id, item_id, agreeing, compared."""
    scratch = Scratch(docs.sparkSession, "items")
    all_items = bench.select("item_id", _hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
    items = all_items.where(F.size("item") >= SHORT).select(F.xxhash64("item_id", "item").alias("item_no"), "item_id", "item")
    items = scratch.keep(items.dropDuplicates(["item_no"]))
    masks = _masks(items)
    seeds = scratch.keep(_windows(items, "item", "item_at", masks, ["item", "item_no"], True).select("item_no", "item_at", "seed"))
    few = bounded(seeds, most_seeds) and (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= most_words
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_id"), _hashes(F.col("text")).alias("doc"))
    if few:
        # outer explodes: from the inner ones the optimizer would infer filters that hash every text twice
        hits = _windows(texts, "doc", "doc_at", masks, ["doc_id", "text_id", "doc"], False).join(F.broadcast(seeds), "seed")
        hits = hits.join(F.broadcast(items), "item_no")
    else:
        spots = _windows(texts, "doc", "doc_at", masks, ["doc_id", "text_id", "doc"], False).drop("doc")
        spots = spots.join(seeds, "seed").select("doc_id", "text_id", "item_no", "item_at", "doc_at").distinct()
        spots = scratch.keep(spots)
        here = spots.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).distinct()
        same = lambda a, d, t: a["doc_id"].eqNullSafe(F.col(d)) & (a["text_id"] == F.col(t))
        wanted = texts.join(here, same(texts, "_d", "_t"), "left_semi").dropDuplicates(["doc_id", "text_id"])
        wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t"), "doc")
        hits = spots.join(wanted, same(spots, "_d", "_t")).join(items, "item_no")
    found = _judged(hits)
    tiny = all_items.where(F.size("item") < SHORT)
    if tiny.limit(1).count():
        found = found.unionByName(_whole_texts(texts, tiny))
    return found.groupBy("doc_id", "text_id", "item_id").agg(
        F.max("agreeing").cast("long").alias("agreeing"), F.max("compared").cast("long").alias("compared")
    )


def _whole_texts(texts: DataFrame, tiny: DataFrame) -> DataFrame:
    """Items of very few words: a text is hit only if it is that item, word for word."""
    key, n = lambda c: F.xxhash64(c), lambda c: F.size(c)
    items = tiny.select("item_id", n("item").alias("compared"), key("item").alias("_key")).distinct()
    alone = texts.where((n("doc") > 0) & (n("doc") < SHORT)).select("doc_id", "text_id", key("doc").alias("_key"), n("doc").alias("_n"))
    met = alone.join(items, "_key").where("_n = compared")
    return met.select("doc_id", "text_id", "item_id", "compared", F.col("compared").alias("agreeing"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item."""
    bad = Scratch(docs.sparkSession, "overlaps").keep(overlaps(docs, bench).select("doc_id", "text_id").distinct())
    if bounded(bad, MOST_ROWS):
        bad = F.broadcast(bad)
    rows = docs.select(F.struct("*").alias("row"))  # one column, so no name can clash
    same = F.col("row.doc_id").eqNullSafe(bad["doc_id"]) & (F.xxhash64("row.text") == bad["text_id"])
    return rows.join(bad, same, "left_anti").select("row.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_id")


def _oracle_sql() -> str:
    """The query in SQL, without masks: a window of VERIFY words with two substitutions at most has four words in a row that agree."""
    run = 4
    gram = " || ' ' || ".join(f"w[pos + {k + 1}]" for k in range(run))
    return f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, w, pos, {gram} AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {run - 1})) AS pos FROM dw WHERE len(w) >= {run})),
bs AS (SELECT item_id, w, pos, {gram} AS g FROM (SELECT item_id, w, unnest(range(len(w) - {run - 1})) AS pos FROM iw WHERE len(w) >= {SHORT})),
diagonals AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, bs.w AS iw, ds.w AS dw, ds.pos - bs.pos AS shift FROM ds JOIN bs ON ds.g = bs.g),
scored AS (SELECT doc_id, item_id, least({VERIFY}, len(iw)) AS compared, list_max(list_transform(range(len(iw) - least({VERIFY}, len(iw)) + 1),
  lambda s: len(list_filter(range(s, s + least({VERIFY}, len(iw))),
    lambda k: k + shift >= 0 AND k + shift < len(dw) AND iw[k + 1] = dw[k + shift + 1])))) AS agreeing FROM diagonals),
tiny AS (SELECT doc_id, item_id, len(i.w) AS compared, len(i.w) AS agreeing FROM dw d JOIN iw i ON d.w = i.w WHERE len(i.w) > 0 AND len(i.w) < {SHORT})
SELECT doc_id, item_id, CAST(max(agreeing) AS BIGINT) AS agreeing, CAST(max(compared) AS BIGINT) AS compared
FROM (SELECT * FROM scored WHERE agreeing >= CASE WHEN compared < {VERIFY} THEN compared ELSE {SHARE} * compared END
  UNION ALL BY NAME SELECT * FROM tiny) GROUP BY doc_id, item_id"""


ORACLE_SQL = _oracle_sql()

"""Near-equal lines across documents by a segment-partition edit join.

Two lines are linked if few edits turn one into the other: one edit for every CHARS_PER_EDIT characters of the shorter
line, MAX_EDITS at most (lines of under 12 characters: none, of 12 to 23: one, longer ones: two).  Equal lines of any length are one class.

A line that allows ``k`` edits is split into ``k + 1`` even segments.  Two lines within ``k`` edits share at least one
segment of the shorter (or equally long) one, at a start that its place and both lengths bound; so every line puts out its own
segments for its length and, for every length down to ``k`` less, the substrings of itself that could match one.  Keys travel
in binary blocks to buckets by their hash, each with a hash of the line and a sketch of its characters.  A bucket compares the lines
of a key by sketch and puts out pairs; exact verification is a banded bit-parallel edit distance over the texts.

Skew: a segment that very many different lines share is split.  Sketches of linked lines are at most ``2 * k`` apart, so if
their counters are dealt to ``2 * k + 1`` parts, one part is equal; lines of such a segment go out once per part, under the segment
and that part's value.  Segments of that kind are found on one line in SAMPLED (by hash) before; the list has
at most MOST_HOT entries and only changes where lines meet.  A group that is large for one task is parted in the same way inside it.

Lines are the \\n-split parts of a text with a word, as they stand.  A row is known by its doc_id and a hash of its text.  A class is
named by its first place (smallest doc_id, then text hash, then line number); links join classes with different texts.

Defined results: null text has no lines; rows with a null doc_id are not looked at (and are kept by ``drop_repeated``); rows that
share a doc_id and have different texts are different rows, equal rows have equal places (and are both kept); an empty table gives an
empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, bounded, join_skewed, read

MAX_EDITS, CHARS_PER_EDIT = 2, 12
#: ``drop_repeated`` takes out lines of so many characters; shorter ones ("Yes.", "Chapter 2") agree by chance.
LEAST_REMOVED = 24
#: Candidate lines (16 bytes each) up to which they are broadcast to fetch texts; beyond, the join shuffles.
MOST_BROADCAST = 1_000_000
#: One line in so many is looked at for hot segments; a segment of HOT such lines or more (more where there are many) is hot.
SAMPLED, HOT, MOST_HOT = 64, 64, 50_000
#: Different lines of one key that a task compares pair by pair.
FEW = 256
COUNTERS = 32

_ENTRY = np.dtype([("key", "<u8"), ("line", "<u8"), ("sketch", "<u8"), ("indexed", "u1")])


def allowed(length: int, max_edits: int = MAX_EDITS) -> int:
    """Edits that link a line of ``length`` characters with one that is as long or longer."""
    return min(max_edits, length // CHARS_PER_EDIT)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of the even parts of a line, longer ones last."""
    small, longer = divmod(length, parts)
    sizes = [small] * (parts - longer) + [small + 1] * longer
    starts = [sum(sizes[:k]) for k in range(parts)]
    return list(zip(starts, sizes))


def probes(length: int, max_edits: int = MAX_EDITS) -> list[tuple[int, int, int, int, int]]:
    """(indexed length, segment, start, end, own) of the substrings that a line of ``length`` looks up.

    ``own`` is 1 for the line's own segments, which it is found by.
    """
    found = []
    for gap in range(max_edits + 1):
        shorter = length - gap
        edits = allowed(shorter, max_edits)
        if not edits or gap > edits:
            continue
        for k, (at, size) in enumerate(segments(shorter, edits + 1)):
            low = max(at - k, at + gap - (edits - k), 0)
            high = min(at + k, at + gap + (edits - k), length - size)
            found += [(shorter, k, s, s + size, int(gap == 0 and s == at)) for s in range(low, high + 1)]
    return found


_PLACES = np.uint64(2) * np.arange(COUNTERS, dtype=np.uint64)


def sketch(codes: np.ndarray) -> int:
    """COUNTERS character counts modulo 4; the sum of their circular gaps is at most twice the edit distance."""
    counts = np.bincount((codes * np.uint32(2654435761)) >> np.uint32(27), minlength=COUNTERS) & 3
    return int((counts.astype(np.uint64) << _PLACES).sum())


_PAIRS, _ONES = np.uint64(0x5555555555555555), np.uint64(1)


def sketch_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of circular gaps of the 2-bit counts: 1 for a difference of 1 or 3, 2 for a difference of 2."""
    low = (a ^ b) & _PAIRS  # the difference is odd
    # equal low bits and unequal high ones: the difference is 2
    high = ((a ^ b) >> _ONES) & _PAIRS & ~low
    return np.bitwise_count(low) + 2 * np.bitwise_count(high)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit-parallel over the band of its diagonals."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    low, high = 0, len(a)  # longest common start, by halving
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a:
        return len(b) <= most
    # One word of 2*most+1 bits per number of edits (bit d: diagonal d - most); a bit says that the diagonal
    # has been followed to the row at hand with so many edits.
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for j, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | 1 << (j + most)
    inside = ((1 << len(b)) - 1) << most
    reach = []
    for e in range(most + 1):  # row 0: column e after e insertions
        reach.append(sum(1 << (most + c) for c in range(e + 1) if c <= len(b)))
    for i, ch in enumerate(a):
        match = places.get(ch, 0) >> i & full  # bit d: b[i + d - most] == ch
        cells = inside >> i & full  # bit d: that column exists
        before, row = 0, []
        for e, old in enumerate(reach):
            now = old & match
            if e:
                now |= before & cells | before >> 1  # substitute; delete ch (the next diagonal down)
                now |= row[e - 1] << 1 & cells << 1 & full  # insert from b
            before = old
            row.append(now)
        # an insertion after row i reaches column i + 1 + d - most, which must exist
        limit = 0
        for d in range(width):
            if 0 <= i + 1 + d - most <= len(b):
                limit |= 1 << d
        reach = [r & limit for r in row]
        if not any(reach):
            return False
    return bool(reach[most] >> (len(b) - len(a) + most) & 1)


def _number_of_buckets(docs: DataFrame) -> int:
    n, k = docs.count(), 64
    while k * 1000 < n:
        k *= 2
    return k


def _parts(sketches: np.ndarray, parts: int) -> list[np.ndarray]:
    """The sketches reduced to each of ``parts`` sets of counters, dealt so that what varies is spread evenly."""
    bits = (sketches[:, None] >> _PLACES) & np.uint64(3)
    varied = np.array([len(np.unique(bits[:, k])) for k in range(COUNTERS)])
    order = np.argsort(-varied, kind="stable")
    return [sketches & np.uint64(sum(3 << (2 * int(k)) for k in order[p::parts])) for p in range(parts)]


def _fixed_masks(parts: int) -> list[int]:
    """The counters of each part where all tasks have to agree on them."""
    return [sum(3 << (2 * k) for k in range(p, COUNTERS, parts)) for p in range(parts)]


def _meetings(e: np.ndarray, max_edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lines under one key, one of them indexed, whose sketches allow ``max_edits``; pairs may come again."""
    parts, todo = 2 * max_edits + 1, [(e, 0)]
    while todo:
        e, depth = todo.pop()
        e = e[np.lexsort((1 - e["indexed"], e["line"], e["key"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["key"][1:] != e["key"][:-1]) | (e["line"][1:] != e["line"][:-1])
        e = e[fresh]
        starts = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]])) if len(e) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(e)))
        if depth < 3:
            large = np.flatnonzero(sizes > FEW)
            for g in large.tolist():
                group = e[starts[g] : starts[g] + sizes[g]]
                pieces = []
                for p, value in enumerate(_parts(group["sketch"], parts)):
                    piece = group.copy()
                    piece["key"] = (value ^ np.uint64(p)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p)
                    _, index, n = np.unique(piece["key"], return_inverse=True, return_counts=True)
                    pieces.append(piece[n[index] > 1])
                pieces = np.concatenate(pieces)
                # where the sketches hardly tell the lines apart, parting makes it no smaller
                todo.append((pieces, depth + 1 if len(pieces) < 4 * len(group) else 3))
            if len(large):
                e = e[np.repeat(sizes <= FEW, sizes)]
        at, apart = np.arange(len(e)), 0
        while len(at):  # every row with the one so far behind it, as long as keys agree
            apart += 1
            at = at[at + apart < len(e)]
            at = at[e["key"][at] == e["key"][at + apart]]
            x, y = e[at], e[at + apart]
            ok = ((x["indexed"] | y["indexed"]) > 0) & (sketch_gap(x["sketch"], y["sketch"]) <= 2 * max_edits)
            if ok.any():
                yield x["line"][ok].view(np.int64), y["line"][ok].view(np.int64)


def _entries(line: str, plan: list, key_of) -> list[tuple[int, int]]:
    raw = line.encode("utf-32-le")
    return [(key_of(raw[x:y], seed), own) for x, y, seed, own in plan]


def _plan(length: int, max_edits: int) -> list[tuple[int, int, int, int]]:
    """(start, end, seed, own) of a line's keys, in bytes of UTF-32."""
    return [(4 * s, 4 * e, size << 6 | k, own) for size, k, s, e, own in probes(length, max_edits)]


def hot_segments(docs: DataFrame, max_edits: int = MAX_EDITS) -> list[int]:
    """Keys that very many different lines have, at most MOST_HOT, judged by one line in SAMPLED."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of, line_of = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for b in batches:
            rows = set()
            for t in b.column(0):
                for line in (t.as_py() or "").split("\n"):
                    if allowed(len(line), max_edits):
                        h = line_of(line.encode(), 42)
                        if h % SAMPLED == 0:
                            rows.update((k, h) for k, _ in _entries(line, _plan(len(line), max_edits), key_of))
            keys, lines = (np.array(x, np.uint64).view(np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lines)], names=["key", "line"])

    seen = docs.where("doc_id is not null").select("text").mapInArrow(sample, "key long, line long")
    counts = seen.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    most = counts.orderBy(F.desc("n"), "key").limit(MOST_HOT)
    return [r.key % (1 << 64) for r in most.select("key").collect()]


def candidates(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """Pairs (a, b: line hashes, a < b) that share a segment and agree by sketch."""
    buckets = _number_of_buckets(docs)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    hot = docs.sparkSession.sparkContext.broadcast(frozenset(hot_segments(docs, max_edits)))
    masks = _fixed_masks(2 * max_edits + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list] = {}
        key_of, line_of, busy = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest, hot.value
        seen: set[int] = set()
        rows: list[tuple[int, int, int, int]] = []

        def blocks() -> pa.RecordBatch:
            entries = np.array(rows, _ENTRY)
            to = entries["key"] >> shift
            order = np.argsort(to, kind="stable")
            keys, starts = np.unique(to[order], return_index=True)
            parts = [x.tobytes() for x in np.split(entries[order], starts[1:])]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(parts, pa.binary())], names=["bucket", "block"]
            )

        for b in batches:
            for t in b.column(0):
                for line in (t.as_py() or "").split("\n"):
                    n = len(line)
                    plan = plans.get(n)
                    if plan is None:
                        plan = plans[n] = _plan(n, max_edits)
                    if not plan:
                        continue
                    h = line_of(line.encode(), 42)
                    if h in seen:
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(h)
                    raw = line.encode("utf-32-le")
                    s = sketch(np.frombuffer(raw, "<u4"))
                    mine = [(key_of(raw[x:y], seed), h, s, own) for x, y, seed, own in plan]
                    if busy and not busy.isdisjoint(k for k, _, _, _ in mine):
                        split = [x for x in mine if x[0] in busy]
                        mine = [x for x in mine if x[0] not in busy]
                        for k, _, _, own in split:
                            for p, m in enumerate(masks):
                                part = key_of((k ^ (s & m)).to_bytes(8, "little"), p + 1)
                                mine.append((part, h, s, own))
                    rows += mine
                    if len(rows) > 150_000:
                        yield blocks()
        if rows:
            yield blocks()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(found: set) -> pa.RecordBatch:
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def solve(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
            found: set[tuple[int, int]] = set()
            for x, y in _meetings(np.frombuffer(b"".join(parts), _ENTRY), max_edits):
                found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
                if len(found) > 100_000:
                    yield pairs(found)
                    found = set()
            if found:
                yield pairs(found)

        bucket, parts = None, []
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != bucket:
                    if parts:
                        yield from solve(parts)
                    bucket, parts = k, []
                parts.append(x.as_py())
        if parts:
            yield from solve(parts)

    sent = docs.where("doc_id is not null").select("text").mapInArrow(send, "bucket long, block binary")
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(receive, "a long, b long")
    return met.distinct()


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, line_no, line and h, g (two hashes, which name the line's class) of every line with a word."""
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_id"), F.split("text", "\n").alias("l"))
    lines = rows.select("doc_id", "text_id", F.posexplode("l").alias("line_no", "line")).where(F.col("line").rlike(NOT_SPACE))
    return lines.select(
        "doc_id", "text_id", "line_no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")
    )


def linked(docs: DataFrame, scratch: Scratch, max_edits: int = MAX_EDITS) -> DataFrame:
    """Verified pairs (ah, ag, bh, bg) of classes, both ways round."""
    pairs = scratch.keep(candidates(docs, max_edits), batch=1000)
    wanted = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    if bounded(wanted, MOST_BROADCAST):
        wanted = F.broadcast(wanted)
    texts = scratch.keep(
        occurrences(docs).join(wanted, "h", "left_semi").groupBy("h", "g").agg(F.min("line").alias("line"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(b.column(4).to_pylist(), b.column(5).to_pylist())
            ok = [within(x, y, allowed(min(len(x), len(y)), max_edits)) for x, y in texts]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns[:4]], names=["ah", "ag", "bh", "bg"])

    side = lambda c, t: texts.select(F.col("h").alias(c), F.col("h").alias(c + "h"), F.col("g").alias(c + "g"), F.col("line").alias(t))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    good = both.select("ah", "ag", "bh", "bg", "x", "y").mapInArrow(verify, "ah long, ag long, bh long, bg long")
    good = scratch.keep(good, batch=500)
    scratch.drop(texts)
    return good.unionByName(
        good.select(F.col("bh").alias("ah"), F.col("bg").alias("ag"), F.col("ah").alias("bh"), F.col("ag").alias("bg"))
    )


def _classes(docs: DataFrame, scratch: Scratch, max_edits: int) -> tuple[DataFrame, DataFrame]:
    """Every line's place with its class' hashes, and per class its first place, links and the first place of a linked one."""
    links = linked(docs, scratch, max_edits)
    occ = occurrences(docs).select(
        "doc_id", "text_id", "line_no", "h", "g", (F.length("line") >= LEAST_REMOVED).alias("is_long")
    )
    occ = scratch.keep(occ)
    first = occ.groupBy("h", "g").agg(F.min(F.struct("doc_id", "text_id", "line_no")).alias("first"), F.count("*").alias("n"))
    first = scratch.keep(first)
    near = (
        links.join(first.select(F.col("h").alias("bh"), F.col("g").alias("bg"), "first"), ["bh", "bg"])
        .groupBy(F.col("ah").alias("h"), F.col("ag").alias("g"))
        .agg(F.count("*").alias("n_links"), F.min("first").alias("earliest"))
    )
    return occ, scratch.keep(first.join(near, ["h", "g"], "left"))


def line_classes(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """One row per line: doc_id, text_id, line_no, class_doc_id, class_line_no, n_links, kept, is_long.

    The class is the first place of the same text, ``n_links`` the number of other texts within the edits allowed; a
    line is kept unless the same or a linked text stands earlier.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    occ, classes = _classes(docs, scratch, max_edits)
    place = F.struct("doc_id", "text_id", "line_no")
    return join_skewed(occ, classes, ["h", "g"], "n").select(
        "doc_id",
        "text_id",
        "line_no",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ((place == F.col("first")) & (F.col("earliest").isNull() | (F.col("first") < F.col("earliest")))).alias("kept"),
        "is_long",
    )


def drop_repeated(docs: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` without the lines of LEAST_REMOVED characters or more that are not kept; a row left without a word goes.

    ``n_chars``, where there is such a column, is brought up to date for rows that lost lines.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    occ, classes = _classes(docs, scratch, max_edits)
    # classes of a single line without links lose nothing
    classes = scratch.keep(classes.where("n > 1 or n_links is not null").select("h", "g", "first", "earliest", "n"))
    place = F.struct("doc_id", "text_id", "line_no")
    lost = (place != F.col("first")) | (F.col("earliest") < F.col("first"))
    gone = (
        join_skewed(occ.where("is_long"), classes, ["h", "g"], "n")
        .where(F.coalesce(lost, F.lit(False)))
        .groupBy("doc_id", "text_id")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    rows = docs.select(F.struct("*").alias("row"))  # one column, so no name can clash
    rows = rows.join(gone, (F.col("row.doc_id") == gone["doc_id"]) & (F.xxhash64("row.text") == gone["text_id"]), "left")
    rows = rows.select("row", "gone")
    lost, text = F.col("gone").isNotNull(), F.col("row.text")
    rest = F.array_join(
        F.filter(F.split(text, "\n"), lambda line, k: ~F.array_contains(F.col("gone"), k)), "\n"
    )
    rows = rows.select("row", lost.alias("lost"), F.when(lost, rest).otherwise(text).alias("rest"))
    rows = rows.where(~F.col("lost") | F.col("rest").rlike(NOT_SPACE))
    kinds = dict(docs.dtypes)
    changed = {"text": F.col("rest")}
    if "n_chars" in kinds:
        length = F.length("rest").cast(kinds["n_chars"])
        changed["n_chars"] = F.when(F.col("lost"), length).otherwise(F.col("row.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "class_doc_id", "class_line_no", "n_links", "kept")


def _oracle_sql() -> str:
    """The query in SQL over all pairs of different lines of like length.

    Counts of a few letters go first: one edit changes a count by one at most.
    """
    letters = "etaoinsrhld u.,"
    counts = ", ".join(f"length(line) - length(replace(line, '{c}', '')) AS c{k}" for k, c in enumerate(letters))
    close = " AND ".join(f"abs(a.c{k} - b.c{k}) <= {MAX_EDITS}" for k in range(len(letters)))
    edits = f"least({MAX_EDITS}, least(a.n, b.n) // {CHARS_PER_EDIT})"
    return f"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM
  (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
o AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS MATERIALIZED (SELECT line, length(line) AS n, min(ROW(doc_id, line_no)) AS first, {counts} FROM o GROUP BY line),
p AS MATERIALIZED (SELECT a.line AS x, b.line AS y, b.first AS other, {edits} AS edits FROM c a JOIN c b ON abs(a.n - b.n) <= {MAX_EDITS} AND a.line <> b.line
  AND {close} WHERE abs(a.n - b.n) <= {edits}),
k AS (SELECT x AS line, count(*) AS n_links, min(other) AS earliest FROM p WHERE levenshtein(x, y) <= edits GROUP BY x)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first[1] AS class_doc_id, CAST(first[2] AS INTEGER) AS class_line_no, coalesce(n_links, 0) AS n_links,
  ROW(doc_id, line_no) = first AND (earliest IS NULL OR first < earliest) AS kept
FROM o JOIN c USING (line) LEFT JOIN k USING (line)"""


ORACLE_SQL = _oracle_sql()

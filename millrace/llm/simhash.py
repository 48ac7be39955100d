"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * half`` bits have a value in common among all variants
within ``half`` flipped bits of each.  Every distinct fingerprint emits its variants; variants are
shuffled by their first bits and met in the receiving task.  What travels is the fingerprint, once for
each variant prefix within reach, in binary blocks: the receiving task completes the variants of
that prefix itself and parts them by further bits as long as they are too many to hold at once.  Fingerprints that
share a variant are verified to lie within the radius and joined to the smallest of them, so a
group of n near copies makes n links and not n * n.

Exact copies and equal fingerprints are put together before.  Components over links come from
large-star and small-star steps.

Defined results: null and wordless texts have fingerprint zero and link like any other; a null
``doc_id`` keeps its row and takes its component from the others (null if it has none); repeated rows
stay; rows that share a doc_id and have different texts are different rows; an empty table gives an
empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, read
from .graph import components, local_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Variants that a task holds at a time.
HELD = 4_000_000
#: Rows (16 bytes each) up to which those to be left out are broadcast.
MOST_BROADCAST = 1_000_000


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's word shingles (A-Z lower-cased, repeats included)."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(tokens))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[itertools.islice(tokens, k, None) for k in range(size)])
    return np.fromiter((digest(join(r), SEED) for r in runs), np.uint64, len(tokens) - size + 1)


def bits_of(h: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes (0 if there are none)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(h)).tolist()))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    return bits_of(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_id (a hash of the text) and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fp)], names=["doc_id", "text_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text_id long, fp long")


def place() -> Column:
    """A row's place among all rows: those with a doc_id first, then by doc_id and text."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_id")


def flips(bits: int, most: int) -> np.ndarray:
    """All masks over the lowest ``bits`` bits with at most ``most`` bits set."""
    masks = [sum(1 << k for k in c) for n in range(most + 1) for c in itertools.combinations(range(bits), n)]
    return np.array(masks, np.uint64)


def meet(fps: np.ndarray, left: np.ndarray, free: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index, index) that share a variant: prefix above ``free`` low bits, ``left`` flips to go in those."""
    counts = np.array([sum(math.comb(free, k) for k in range(w + 1)) for w in range(int(left.max(initial=0)) + 1)])
    if free > 0 and counts[left].sum() > HELD:
        step = min(4, free)
        found = []
        sub = (fps >> np.uint64(free - step)) & np.uint64((1 << step) - 1)
        for value in range(1 << step):
            rest = left - np.bitwise_count(sub ^ np.uint64(value)).astype(np.int64)
            near = np.flatnonzero(rest >= 0)
            if len(near) > 1:
                a, b = meet(fps[near], rest[near], free - step, prefix << step | value)
                found.append((near[a], near[b]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))
    low = fps & np.uint64((1 << free) - 1)
    values, owners = [], []
    for w in range(len(counts)):
        own = np.flatnonzero(left == w)
        if len(own):
            masks = flips(free, w)
            values.append((low[own, None] ^ masks[None, :]).ravel())
            owners.append((own, len(masks)))
    values = np.concatenate(values) if values else np.zeros(0, np.uint64)
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    hit = np.flatnonzero(twice[at] == values)
    who = np.concatenate([np.repeat(own, m) for own, m in owners])[hit]
    order = np.lexsort((who, at[hit]))
    group, who = at[hit][order], who[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    first = np.repeat(who[starts], np.diff(np.append(starts, len(who))))
    return who, first


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints ``fp`` to links (a, b) that join the same fingerprints as all pairs within ``radius``."""
    half = (radius + 1) // 2
    total = fps.count()
    bits = min(16, max(4, math.ceil(math.log2(max(total, 1) / 2048))) if total > 2048 else 4)
    while bits < 28 and total * sum(math.comb(bits, k) for k in range(half + 1)) >> bits > HELD:
        bits += 1
    near = flips(bits, half)
    lowest = 64 - bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            to = ((fp >> np.uint64(lowest))[:, None] ^ near[None, :]).ravel()
            order = np.argsort(to, kind="stable")
            who = np.repeat(fp, len(near))[order]
            keys, starts = np.unique(to[order], return_index=True)
            blocks = [x.tobytes() for x in np.split(who, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"]
            )

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(bucket: int, blocks: list[bytes]) -> pa.RecordBatch:
            fp = np.unique(np.frombuffer(b"".join(blocks), np.uint64))
            left = half - np.bitwise_count((fp >> np.uint64(lowest)) ^ np.uint64(bucket)).astype(np.int64)
            a, b = meet(fp, left, lowest, bucket)
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            root = local_components(len(fp), a[ok], b[ok])
            own = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays(
                [pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], names=["a", "b"]
            )

        bucket, blocks = None, []
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                if k != bucket:
                    if blocks:
                        yield solve(bucket, blocks)
                    bucket, blocks = k, []
                blocks.append(x.as_py())
        if blocks:
            yield solve(bucket, blocks)

    sent = fps.select("fp").mapInArrow(send, "bucket int, block binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(receive, "a long, b long")


def _classes(
    docs: DataFrame, scratch: Scratch, shingle: int, radius: int, similar: float | None
) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, text_id, fp), and for each fp the ``place`` that comes first in its component."""
    marked = scratch.keep(fingerprints(docs, shingle), batch=1000)
    fps = scratch.keep(marked.groupBy("fp").agg(F.min(place()).alias("first")))
    pairs = links(fps, radius)
    if similar is not None:
        from .shingles import similar_links

        pairs = similar_links(docs, pairs, shingle, similar, scratch)
    found = components(pairs, scratch)
    # only fingerprints of components with more than one need looking at
    inside = found.select(F.col("node").alias("fp"), "root").unionByName(
        found.select(F.col("root").alias("fp"), "root").distinct()
    )
    inside = scratch.keep(inside.join(fps, "fp"))
    smallest = inside.groupBy("root").agg(F.min("first").alias("component"))
    joined = inside.select("fp", "root").join(smallest, "root").select("fp", "component")
    classes = fps.join(joined, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return marked, scratch.keep(classes)


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similar: float | None = None
) -> DataFrame:
    """doc_id, fp, component_id of every row; with ``similar``, texts at that Jaccard similarity are linked too."""
    marked, classes = _classes(docs, Scratch(docs.sparkSession, "simhash"), shingle, radius, similar)
    return marked.join(classes, "fp", "left").select("doc_id", "fp", F.col("component.doc_id").alias("component_id"))


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similar: float | None = None
) -> DataFrame:
    """Of each component the row with the smallest doc_id (then text hash), once; columns as in ``docs``.

    Rows without a doc_id come last, so one of them stays only where a component has no others.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked, classes = _classes(docs, scratch, shingle, radius, similar)
    gone = marked.join(classes, "fp").where(place() != F.col("component")).select("doc_id", "text_id").distinct()
    gone = scratch.keep(gone)
    gone = F.broadcast(gone) if bounded(gone, MOST_BROADCAST) else gone
    rows = docs.select(F.struct("*").alias("row"))  # one column, so no name can clash
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_id"))
    same = lambda side: rows["doc_id"].eqNullSafe(side["doc_id"]) & (rows["text_id"] == side["text_id"])
    left = rows.join(gone, same(gone), "left_anti")
    # equal rows are rare; only where there are some do texts have to meet
    equal = scratch.keep(marked.groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1"))
    if equal.limit(1).count():
        equal = F.broadcast(equal) if bounded(equal, MOST_BROADCAST) else equal
        once = left.join(equal, same(equal), "left_semi").dropDuplicates(["doc_id", "text_id"])
        left = left.join(equal, same(equal), "left_anti").unionByName(once)
    return left.select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = near_duplicates(read(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Links between texts whose word shingles have a Jaccard similarity of at least ``similar``.

Candidates come from min-hashes: BANDS keys of ROWS minima each.  A pair at 0.8 shares no key with a probability of
(1 - 0.8 ** ROWS) ** BANDS = 3e-6.  Keys travel in binary blocks.  Every pair that shares a key is compared
exactly on its shingles unless the two are in one component already: first each text with the smallest id of its groups, then
what is still apart with another member of each group, picked anew for each.  Copies of one text are in one component then, mostly.
Members of groups that are apart even now meet in a task, each with a byte of each of SIGNS min-hashes; pairs that may be similar
enough by those (SLACK below, which is 3.8 standard deviations of the estimate at 0.8) are compared as well.  So texts that only share
a common passage are not put out in pairs.  A group goes to tasks in tiles of TILE texts.

A text's id is its hash, so exact copies are one.  Texts without a word have no shingles and no links here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded
from .graph import components
from .simhash import bits_of, hashes

BANDS, ROWS = 32, 5
#: Candidate texts up to which their ids are broadcast to fetch them.
MOST_BROADCAST = 1_000_000
SIGNS, SLACK, TILE = 480, 0.07, 2048

_g = np.random.default_rng(42)
_A = _g.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B, _MIX = _g.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64), _g.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64)
_MORE = np.random.default_rng(43)
_A = np.concatenate([_A, _MORE.integers(0, 2**63, SIGNS - BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)])
_B = np.concatenate([_B, _MORE.integers(0, 2**63, SIGNS - BANDS * ROWS, dtype=np.uint64)])
_ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("fp", "<i8"), ("n", "<i4")])


def minima(distinct: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The first ``n`` min-hashes of a set of shingle hashes."""
    least = np.full(n, np.uint64(2**64 - 1))
    for at in range(0, len(distinct), 1024):
        part = distinct[at : at + 1024, None] * _A[:n]
        part += _B[:n]
        np.minimum(least, part.min(axis=0), out=least)
    return least >> np.uint64(7)


def keys_of(distinct: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingle hashes."""
    x = minima(distinct).reshape(BANDS, ROWS) * (_MIX | np.uint64(1))
    x = (x ^ x >> np.uint64(29)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def shared(docs: DataFrame, shingle: int) -> DataFrame:
    """key, id, fp, n (distinct shingles) and the group's smallest id, of texts that share a key with another."""
    texts = docs.select(F.xxhash64("text").alias("id"), "text").where("text is not null")
    n, buckets = texts.count(), 64
    while buckets < 65536 and buckets * 1000 < n:
        buckets *= 2
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        seen: set[int] = set()

        def blocks() -> pa.RecordBatch:
            e = np.concatenate(rows)
            rows.clear()
            to = e["key"] >> shift
            order = np.argsort(to, kind="stable")
            keys, starts = np.unique(to[order], return_index=True)
            parts = [x.tobytes() for x in np.split(e[order], starts[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int32)), pa.array(parts, pa.binary())], names=["bucket", "block"]
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if i in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(i)
                h = hashes(t.as_py(), shingle)
                if len(h):
                    distinct = np.unique(h)
                    e = np.empty(BANDS, _ENTRY)
                    e["key"], e["id"], e["n"] = keys_of(distinct), i, len(distinct)
                    e["fp"] = np.uint64(bits_of(h)).view(np.int64)
                    rows.append(e)
                if len(rows) >= 4096:
                    yield blocks()
        if rows:
            yield blocks()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts: list[bytes]) -> pa.RecordBatch:
            e = np.frombuffer(b"".join(parts), _ENTRY)
            e = e[np.lexsort((e["id"], e["key"]))]
            fresh = np.ones(len(e), bool)
            fresh[1:] = (e["key"][1:] != e["key"][:-1]) | (e["id"][1:] != e["id"][:-1])
            e = e[fresh]
            starts = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
            sizes = np.diff(np.append(starts, len(e)))
            first = np.repeat(e["id"][starts], sizes)
            many = np.repeat(sizes, sizes) > 1
            e, first = e[many], first[many]
            cols = [e["key"].view(np.int64), e["id"], e["fp"], e["n"], first]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in cols], names=["key", "id", "fp", "n", "first"]
            )

        bucket, parts = None, []
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != bucket:
                    if parts:
                        yield solve(parts)
                    bucket, parts = k, []
                parts.append(x.as_py())
        if parts:
            yield solve(parts)

    sent = texts.mapInArrow(send, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(receive, "key long, id long, fp long, n int, first long")


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similar: float, scratch: Scratch) -> DataFrame:
    """Of ``pairs`` (x, y: ids) those that are similar enough, as links (a, b: fingerprints)."""
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    if bounded(wanted, MOST_BROADCAST):
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64("text").alias("id"), "text").join(wanted, "id", "left_semi")
    texts = scratch.keep(texts.groupBy("id").agg(F.min("text").alias("text")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, int]] = {}

        def of(text: str) -> tuple[np.ndarray, int]:
            if text not in known:
                if len(known) >= 200:
                    known.clear()
                h = hashes(text, shingle)
                known[text] = np.unique(h), bits_of(h)
            return known[text]

        for b in batches:
            found = []
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (u, f), (v, g) = of(s), of(t)
                both = len(np.intersect1d(u, v, assume_unique=True))
                if f != g and both >= similar * (len(u) + len(v) - both) - 1e-9:
                    found.append((f, g))
            fps = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy())], names=["a", "b"])

    both = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("s")), "x").join(
        texts.select(F.col("id").alias("y"), F.col("text").alias("t")), "y"
    )
    # a text may be of any length and stand in many pairs
    return scratch.keep(both.select("s", "t").mapInArrow(compare, "a long, b long"), batch=64)


def _apart(e: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, n, fp and component of the members of groups that lie in several components."""
    e = e.select("key", "id", "n", "fp").join(components(found, scratch), F.col("fp") == F.col("node"), "left")
    e = scratch.keep(e.select("key", "id", "n", "fp", F.coalesce("root", "fp").alias("root")))
    apart = e.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return scratch.keep(e.join(apart.select("key"), "key", "left_semi"))


def signatures(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id and a byte of each of SIGNS min-hashes (sig) of the texts in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = [minima(np.unique(hashes(t.as_py(), shingle)), SIGNS).astype(np.uint8).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.binary())], names=["id", "sig"])

    ids = F.broadcast(ids) if bounded(ids, MOST_BROADCAST) else ids
    texts = docs.select(F.xxhash64("text").alias("id"), "text").join(ids, "id", "left_semi")
    return texts.mapInArrow(run, "id long, sig binary").dropDuplicates(["id"])


def close(rows: dict, similar: float) -> list[tuple[int, int]]:
    """Pairs of ids in one tile of a group that lie in different components and may be similar enough."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows["id"]), -1)
    ids, root, tile, n = (np.array(rows[c], np.int64) for c in ("id", "root", "tile", "n"))
    ours, theirs = (np.flatnonzero(tile == rows[c][0]) for c in ("low", "high"))
    keyed = BANDS * ROWS
    band = int((sig[:, :keyed] == sig[0, :keyed]).all(axis=0).reshape(BANDS, ROWS).all(axis=1).argmax())  # the first that all share
    pairs = []
    for at in range(0, len(ours), 16):
        i = ours[at : at + 16]
        same = sig[i][:, None, :] == sig[theirs][None, :, :]
        ok = (same.mean(axis=2) >= similar - SLACK) & (root[i][:, None] != root[theirs][None, :])
        # a pair that shares several keys is put out under the first
        ok &= same[:, :, :keyed].reshape(*ok.shape, BANDS, ROWS).all(axis=3).argmax(axis=2) == band
        ok &= np.minimum.outer(n[i], n[theirs]) >= (similar - 1e-9) * np.maximum.outer(n[i], n[theirs])
        a, b = np.nonzero(ok)
        a, b = ids[i[a]], ids[theirs[b]]
        pairs += zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist())
    return pairs


def close_pairs(docs: DataFrame, e: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Pairs (x, y) of members of groups in several components whose min-hashes allow ``similar``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: dict) -> pa.RecordBatch:
            found = np.array(close(rows, similar), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["x", "y"])

        now, rows = None, None
        for batch in batches:
            cols = batch.to_pydict()
            for k in range(batch.num_rows):
                group = cols["key"][k], cols["low"][k], cols["high"][k]
                if group != now:
                    if rows:
                        yield out(rows)
                    now, rows = group, {c: [] for c in cols}
                for c in cols:
                    rows[c].append(cols[c][k])
        if rows:
            yield out(rows)

    tiles = e.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = e.select("key", "id", "n", "root").join(tiles, "key")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("tiles", "other")
    rows = rows.join(signatures(docs, e.select("id").distinct(), shingle), "id")
    parted = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return parted.mapInArrow(run, "x long, y long")


def similar_links(docs: DataFrame, other: DataFrame, shingle: int, similar: float, scratch: Scratch) -> DataFrame:
    """``other`` links (a, b: fingerprints) and those that join all texts at ``similar`` or more."""
    e = scratch.keep(shared(docs, shingle), batch=1000)
    alike = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(similar - 1e-9)
    pair = lambda a, b: [F.greatest(a, b).alias("x"), F.least(a, b).alias("y")]
    tested = scratch.keep(e.where("id <> first").select(*pair("id", "first")).distinct())
    found = scratch.keep(other.unionByName(verified(docs, tested, shingle, similar, scratch)))

    e = _apart(e, found, scratch)
    chosen = e.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id"), "id", "n", "root")).alias("p"))
    next_ = e.join(chosen, "key").where((F.col("root") != F.col("p.root")) & alike(F.col("n"), F.col("p.n")))
    next_ = scratch.keep(next_.select(*pair("id", "p.id")).distinct().join(tested, ["x", "y"], "left_anti"))
    found = scratch.keep(found.unionByName(verified(docs, next_, shingle, similar, scratch)))

    tested = tested.unionByName(next_)
    rest = close_pairs(docs, _apart(e, found, scratch), shingle, similar).distinct()
    rest = scratch.keep(rest.join(tested, ["x", "y"], "left_anti"), batch=1000)
    return found.unionByName(verified(docs, rest, shingle, similar, scratch))

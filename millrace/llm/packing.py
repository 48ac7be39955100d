"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

Tokens are those of a word BPE whose pre-tokens never span white space, so a text's ids are the
ids of its words in order; words are encoded once per worker and looked up after that.

A block of documents (up to ``block_tokens``, cut off as documents stream by) is packed at a time.
The cost of a sequence is linear in its tokens plus quadratic in the length of each piece (attention
stays within a piece).  Full sequences are cut off documents longer than one; the rest, in falling
order of length, goes to the cheapest sequence with room for it, or is cut where none has.  What a
block leaves over fills sequences whose lengths are powers of two, which need no padding.

Memory: one block's ids.  No shuffle; a task's result depends on its input partition alone, so a lost
task can be run again.  ``sequence_id`` is the partition's number times 2**32 plus a running number.

Defined results: null text counts as empty (its end id alone); repeated rows are packed as often as
they occur; an empty table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

CAPACITY, END_ID, BLOCK_TOKENS = 4096, 2, 1_000_000
#: Weight of a token and of a token pair in the cost of a sequence.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: Words and pre-tokens that a worker remembers at most; beyond, it starts again.
REMEMBERED = 400_000

_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words that need no normalisation but lower case.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: str.split also parts words at these; the tokenizer does not.
_SEPARATORS, _WORDS = regex.compile(r"[\x1c-\x1f]"), regex.compile(r"[^ \t-\r]+")


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self):
        if len(self) > REMEMBERED:
            self.clear()


class WordEncoder:
    """The ids of a text, as little-endian 32-bit integers, by looking up its words."""

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = _byte_letters()
        self.pieces, self.words = _Memory(self._piece), _Memory(self._word)

    def _piece(self, piece: str) -> bytes:
        shown = "".join([self.letters[b] for b in piece.encode()])
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not _PLAIN.fullmatch(word) or unicodedata.normalize("NFC", word) != word:
            return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.pieces[p] for p in _PRE.findall(word.lower())])

    def encode(self, text: str) -> bytes:
        self.words.trim()
        self.pieces.trim()
        words = _WORDS.findall(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


@functools.cache
def _encoder(json_path: str) -> WordEncoder:
    return WordEncoder(json_path)


def powers(n: int) -> list[int]:
    """``n`` as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one block, nothing left unfilled."""
    total = sum(lengths)
    room = np.array([capacity] * (total // capacity) + powers(total % capacity), np.int64)
    pieces, cost, fill = [], np.zeros(len(room)), np.zeros(len(room), np.int64)
    rest, opened = [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, opened, 0))
            fill[opened] = capacity
            opened += 1
        if n > full * capacity:
            rest.append((n - full * capacity, d, full * capacity))
    left = room - fill
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            fits = left >= n
            s = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(left))
            take = min(n, int(left[s]))
            pieces.append((d, start, take, s, int(fill[s])))
            cost[s] += LINEAR * take + QUADRATIC * take * take
            fill[s] += take
            left[s] -= take
            start, n = start + take, n - take
    return pieces


def pack(docs: DataFrame, json_path: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 7 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(json_path)
        end = np.array([END_ID], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids: list = []
        coded: list[bytes] = []
        held, used = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal used
            rows = []
            for d, start, n, s, at in assign([len(x) // 4 for x in coded], capacity):
                part = coded[d][4 * start : 4 * (start + n)]
                rows.append((ids[d], start, n, zlib.crc32(part), len(coded[d]) // 4, base + used + s, at, part))
            used += max(r[5] for r in rows) - base - used + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                coded.append(encoder.encode(t.as_py() or "") + end)
                held += len(coded[-1]) // 4
                if held >= block_tokens:
                    yield flush()
                    ids, coded, held = [], [], 0
        if coded:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")

"""Token counts of whole texts by overlap resynchronisation.

Texts up to ``chunk_chars`` are encoded whole.  A longer one is cut into overlapping chunks, each
encoded alone with the offsets of its tokens.  Two neighbours are spliced where both of them put
several token boundaries in a row at the same offsets around a place where the pre-tokenizer can
start afresh whatever stands before (a non-space character followed by a space): from there on
both see the same text with the same state, so their tokens agree for good.  Where no such place
lies in the overlap, the overlap is doubled, at last to the whole rest of the text, which is exact
by definition.

Memory: one chunk at a time plus its overlap (more only where a text has no boundary for long).

Defined results: null text counts as empty (0 bytes, 0 tokens); one row out per row in; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

CHUNK_CHARS, OVERLAP_CHARS = 65536, 256
#: Boundaries in a row that both chunks must share before the splice.
AGREE = 3
LIMIT = 512
#: Outside these characters the reference library itself encodes the text.
_PLAIN = regex.compile(r"[\x00-\x7f¡-ɏ‐-‧‰-⁞₠-₿]*")
_SPECIAL = "<|endoftext|>"


@functools.cache
def _fast(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)}
    )
    sizes = {i: len(b) for b, i in ranks.items()} | {len(ranks): len(_SPECIAL)}
    return coder, sizes


@functools.cache
def _library(json_path: str):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(json_path)
    coder.no_truncation()
    coder.no_padding()
    return coder


def count_whole(text: str, json_path: str, ranks_path: str) -> int:
    """Tokens of a text encoded in one piece."""
    if _PLAIN.fullmatch(text):
        return len(_fast(ranks_path)[0].encode(text, allowed_special="all"))
    return len(_library(json_path).encode(text, add_special_tokens=False).ids)


def boundaries(text: str, json_path: str, ranks_path: str) -> list[int]:
    """The end of every token as a UTF-8 offset (the library's character ends where it encodes).

    Tokens that end inside a character share that character's end in the library's form, so a
    count of tokens is the length of this list in either form.
    """
    if _PLAIN.fullmatch(text):
        coder, sizes = _fast(ranks_path)
        ends, at = [], 0
        for i in coder.encode(text, allowed_special="all"):
            at += sizes[i]
            ends.append(at)
        return ends
    return [b for _, b in _library(json_path).encode(text, add_special_tokens=False).offsets]


def count_overlapped(
    text: str,
    ends_of: Callable[[str], list[int]],
    units: Callable[[str], int],
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> int:
    """Tokens of ``text`` from overlapping chunks; ``units`` gives the length of a string as offsets count."""
    total, start, entered = 0, 0, 0  # entered: offset in the chunk at ``start`` from which its tokens count
    size = len(text)
    while True:
        wide = overlap
        stop = min(size, start + chunk)
        while True:
            end = min(size, stop + wide)
            ends = ends_of(text[start:end])
            if end == size:
                return total + sum(e > entered for e in ends)
            splice = _splice(text, start, stop, end, ends, ends_of, units)
            if splice is not None:
                break
            wide *= 2
        at, cut, entry = splice  # the next chunk starts at ``at``; ours ends at offset ``cut``, its own at ``entry``
        total += sum(entered < e <= cut for e in ends)
        start, entered = at, entry


def _splice(text, start, stop, end, ends, ends_of, units):
    """Where the chunk that ends at ``end`` and the next one, which starts at ``stop``, agree for good."""
    shift = units(text[start:stop])
    last = units(text[start:end])
    other = ends_of(text[stop:end])
    theirs = {e + shift for e in other}
    ours = [e for e in ends if e > shift]
    # offset (in this chunk) of every safe place: after a non-space character, before a space
    safe, at = set(), shift
    previous = None
    for ch in text[stop:end]:
        if previous is not None and ch.isspace() and not previous.isspace():
            safe.add(at)
        at += units(ch)
        previous = ch
    for k in range(len(ours) - AGREE):
        run = ours[k : k + AGREE]
        if run[0] in safe and run[-1] < last and all(e in theirs for e in run):
            return stop, run[0], run[0] - shift
    return None


def count_tokens(
    text: str, json_path: str, ranks_path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> int:
    if len(text) <= chunk + overlap:
        return count_whole(text, json_path, ranks_path)
    # one form of offsets for the whole text: bytes where it is plain throughout, else characters
    units = (lambda s: len(s.encode())) if _PLAIN.fullmatch(text) else len
    if units is len:
        coder = _library(json_path)
        ends_of = lambda s: [b for _, b in coder.encode(s, add_special_tokens=False).offsets]
    else:
        ends_of = lambda s: boundaries(s, json_path, ranks_path)
    return count_overlapped(text, ends_of, units, chunk, overlap)


def token_counts(
    docs: DataFrame,
    json_path: str,
    ranks_path: str,
    limit: int = LIMIT,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            n = [count_tokens(t.as_py() or "", json_path, ranks_path, chunk, overlap) for t in texts]
            size = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )

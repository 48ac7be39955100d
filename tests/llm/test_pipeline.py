"""Every stage of the pipeline against a plain version of it, each on what the stage before has kept."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import graph
from test_brute import J2, WORD, edits, plain_overlaps

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    g = random.Random(21)
    vocab = ["".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(2, 9))) for _ in range(900)]
    line = lambda n: " ".join(g.choice(vocab) for _ in range(n))
    text = lambda n: "\n".join(line(g.randint(6, 14)) for _ in range(n))
    common = [line(12) for _ in range(6)]
    bench = [line(n) for n in (30, 20, 15, 9)]
    docs = [text(g.randint(2, 12)) for _ in range(70)]
    for _ in range(25):  # near copies, some chained
        w = g.choice(docs).split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[g.randrange(len(w))] = g.choice(vocab)
        docs.append(" ".join(w))
    for _ in range(25):  # lines that many texts have, some with an edit
        x = list(g.choice(common))
        x[g.randrange(len(x)) : g.randrange(len(x))] = g.choice(["", "q"])
        docs.append(f"{text(3)}\n{g.choice([g.choice(common), ''.join(x)])}\n{text(2)}")
    for b in bench * 3:
        w = b.split()
        w[g.randrange(len(w))] = g.choice(["other", w[0]])
        docs.append(f"{text(2)} {g.choice([b, ' '.join(w)])} {text(1)}")
    docs += ["few words only", "!? " * 30, "same same " * 40, "A B C " + "UPPER " * 20, "# " * 40 + text(1), "", docs[0], docs[3], docs[3]]
    g.shuffle(docs)
    rows = [(k - k % 2 if k > 120 else k, t) for k, t in enumerate(docs)] + [(500, None), (None, text(3)), (None, docs[1])]
    return rows, [(k, b) for k, b in enumerate(bench)]


def good(text):
    t = text or ""
    w = WORD.findall(t)
    n, chars = len(w), sum(map(len, w))
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    bad = n < 10 or 100 * len(cover) > 20 * n or 10 * len(re.findall(r"[#*$%&|<>]", t)) > n or 2 * (len(lines) - len(set(lines))) > len(lines)
    bad |= chars < 2 * n or chars > 15 * n or 10 * len(re.findall("[!?]", t)) > 3 * n or 2 * sum(c.isupper() for c in t) > chars
    return not bad and 10 * sum(a == b for a, b in zip(w, w[1:])) <= 3 * n


def without_lines(rows, hashes):
    at = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if i is not None and WORD.search(x):
                at.setdefault(x, set()).add((i, hashes[t], k))
    first = {x: min(p) for x, p in at.items()}
    for x in at:
        near = [y for y in at if abs(len(x) - len(y)) <= 2 and y != x and edits(x, y) <= min(2, min(len(x), len(y)) // 12)]
        first[x] = min([first[x], *(min(at[y]) for y in near)])
    out = []
    for i, t in rows:
        gone = {k for k, x in enumerate((t or "").split("\n")) if i is not None and len(x) >= 24 and WORD.search(x) and first[x] != (i, hashes[t], k)}
        rest = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        if not gone or WORD.search(rest):
            out.append((i, rest if gone else t))
    return out


def one_of_each(rows, hashes):
    from test_brute import simhash

    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    fp = np.array([simhash.fingerprint(t, 5) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    near |= np.array([[5 * len(x & y) >= 4 * len(x | y) and bool(x) for y in sets] for x in sets])
    label = graph.local_components(len(rows), *np.nonzero(near))
    place = [(i is None, i if i is not None else 0, hashes[t] if t is not None else 42) for i, t in rows]
    best = {}
    for c, p, r in zip(label.tolist(), place, rows):
        best[c] = min(best.get(c, (p, r)), (p, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def test_stages(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    frame = lambda rs: spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rs], SCHEMA).repartition(3)
    hashes = lambda rs: {r.text: r.h for r in frame(rs).selectExpr("text", "xxhash64(text) h").distinct().collect()}
    plain = {
        "quality_rules": lambda rs: [r for r in rs if good(r[1])],
        "line_dedup": lambda rs: without_lines(rs, hashes(rs)),
        "simhash_near_dedup": lambda rs: one_of_each(rs, hashes(rs)),
        "benchmark_decontamination": lambda rs: [r for r in rs if not plain_overlaps([r], bench)],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = frame(rows)
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        kept = got.collect()
        assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
        want = sorted(plain[name](rows), key=key)
        assert sorted(((r.doc_id, r.text) for r in kept), key=key) == want, name
        assert 0 < len(want) < len(rows) or name == "line_dedup", name  # each stage has something to do
        rows = want
    pieces = corpus_pipeline.packing(spark, frame(rows), str(tmp_path)).collect()
    two, ids = Tokenizer.from_file(J2), Counter()
    for i, t in rows:
        ids[i] += len(two.encode(t or "", add_special_tokens=False).ids) + 1
    got, filled = Counter(), Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
        assert zlib.crc32(p.ids) == p.ids_crc32
    assert got == ids and all(n <= 4096 for n in filled.values())

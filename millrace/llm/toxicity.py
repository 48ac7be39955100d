"""Toxicity of whole texts by a bidirectional GRU with attention pooling, trained in numpy.

Input of a step is one word: its embedding (words seen in MIN_TEXTS or more training texts) beside the
scaled sum of its character n-grams' embeddings (every word; hashed, 3 to 6 characters with both ends marked).  A window of WINDOW words runs through a forward and a
backward GRU; attention pools their states into one logit.  Windows overlap by WINDOW - STRIDE words and
cover the text to its end; a text scores as its highest window.  Training alternates between choosing each text's
highest window and fitting it, and ends with a logistic calibration of the texts' scores.

The model is fitted on a bounded sample of the labelled rows that are not held out (MOST_TOXIC and MOST_CLEAN, the
smallest hashes of doc_id; one text of at most MOST_CHARS characters for each); every text is scored whole.

Defined results: null and wordless texts score as one window without words; rows without doc_id are scored and not
held out; a document labelled twice counts as toxic if any row says so; without rows of both
classes every score is the share of toxic training rows (0 without any); only ``doc_id``, ``text`` and ``toxic`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS, ATTEND = 8, 6, 10, 65536, 8
MOST_TOXIC, MOST_CLEAN, MOST_CHARS, MOST_WORDS, MIN_TEXTS = 800, 1200, 200_000, 20_000, 3
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 5
#: Share of words whose own embedding is left out in training, so that their characters have to do.
WORD_DROP, DECAY = 0.5, 1e-4
#: Different words whose gate inputs a worker remembers at most.
REMEMBERED = 150_000


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Grams:
    """The n-gram rows (hashes of 3 to 6 bytes, the word's ends marked) of a list of words, end to end."""

    def __init__(self, words: list[str]):
        marked = [f"<{w}>".encode() for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32) + np.uint32(1)
        word = np.repeat(np.arange(len(marked)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # bytes to the word's end
        hashes, owners, h = [], [], np.zeros(len(codes), np.uint32)
        for k in range(6):
            h = h * np.uint32(16777619)
            h[: max(0, len(codes) - k)] ^= codes[k:]
            if k >= 2:
                own = np.flatnonzero(left > k)
                hashes.append((h[own] * np.uint32(2654435761)) >> np.uint32(16))
                owners.append(word[own])
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.flat = (np.concatenate(hashes)[order] % CHAR_ROWS).astype(np.int64)
        self.sizes = np.bincount(owner, minlength=len(marked))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pick(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram row, place in ``words``) of every n-gram of the chosen words."""
        sizes = self.sizes[words]
        place = np.repeat(np.arange(len(words)), sizes)
        within = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[self.starts[words][place] + within], place

    def vectors(self, table: np.ndarray, words: np.ndarray) -> np.ndarray:
        rows, _ = self.pick(words)
        sizes = self.sizes[words]
        total = np.add.reduceat(table[rows], np.cumsum(sizes) - sizes, axis=0)
        return total / np.sqrt(sizes)[:, None].astype(np.float32)


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows of a text of ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    """Weights; rows of ``char`` and ``word`` are embeddings, ``vocab`` maps a word to its row (0: none)."""

    vocab: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    prior: float | None = None

    def init(self) -> None:
        g, d, h = np.random.default_rng(SEED), WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": (g.standard_normal((len(self.vocab) + 1, WORD_DIM)) * 0.1).astype(np.float32),
            "char": (g.standard_normal((CHAR_ROWS, CHAR_DIM)) * 0.1).astype(np.float32),
            "attend": draw(2 * h, ATTEND),
            "pick": draw(ATTEND, 1),
            "out": draw(2 * h, 1),
            "bias": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"W{side}": draw(d, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
            self.p |= {f"U{side}": draw(h, 2 * h), f"V{side}": draw(h, h)}

    def inputs(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["word"][ids], chars], axis=-1)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.p[f"W{s}"] + self.p[f"b{s}"] for s in "fb")

    def run(self, gate: np.ndarray, side: str, mask: np.ndarray | None, keep: bool = False):
        """States (time, batch, hidden) of one direction; gate is (time, batch, 3 * hidden)."""
        t, b, h = gate.shape[0], gate.shape[1], HIDDEN
        u, v = 0.5 * self.p[f"U{side}"], self.p[f"V{side}"]
        gate = gate.copy()
        gate[..., : 2 * h] *= 0.5
        state, out, saved = np.zeros((b, h), np.float32), np.empty((t, b, h), np.float32), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            zr = state @ u  # the logistic function by tanh of half its argument
            zr += gate[k, :, : 2 * h]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            c = (r * state) @ v
            c += gate[k, :, 2 * h :]
            np.tanh(c, out=c)
            new = state + z * (c - state)
            if mask is not None:
                new = np.where(mask[k][:, None], new, state)
            if keep:
                saved.append((k, state, z, r, c))
            state = out[k] = new
        return out, saved

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        u = np.tanh(states @ self.p["attend"])
        s = (u @ self.p["pick"])[..., 0]
        if mask is not None:
            s = np.where(mask, s, -1e9)
        s = np.exp(s - s.max(axis=0))
        a = s / s.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return u, a, pooled, (pooled @ self.p["out"])[:, 0] + self.p["bias"]

    def logits(self, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([self.run(gf, "f", mask)[0], self.run(gb, "b", mask)[0]], axis=2)
        return self.pool(states, mask)[3]

    def gradients(self, ids, chars, mask, y) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over a batch; ids, mask (time, batch), chars (time, batch, CHAR_DIM)."""
        h, x = HIDDEN, self.inputs(ids, chars)
        runs = {s: self.run(g, s, mask, True) for s, g in zip("fb", self.gates(x))}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        u, a, pooled, logit = self.pool(states, mask)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grad = {"bias": d.sum(keepdims=True), "out": pooled.T @ d[:, None]}
        dp = d[:, None] @ self.p["out"].T
        da = np.einsum("bh,tbh->tb", dp, states)
        ds = a * (da - (a * da).sum(axis=0))
        du = ds[..., None] * self.p["pick"][:, 0] * (1 - u * u)
        grad["pick"] = np.einsum("tbk,tb->k", u, ds)[:, None]
        grad["attend"] = np.einsum("tbh,tbk->hk", states, du)
        dstates = a[..., None] * dp[None] + du @ self.p["attend"].T
        dx = np.zeros_like(x)
        for s, part in (("f", dstates[..., :h]), ("b", dstates[..., h:])):
            w, uu, vv = self.p[f"W{s}"], self.p[f"U{s}"], self.p[f"V{s}"]
            gw, gu, gv, gb = np.zeros_like(w), np.zeros_like(uu), np.zeros_like(vv), np.zeros(3 * h, np.float32)
            carry = np.zeros_like(part[0])
            for k, before, z, r, c in reversed(runs[s][1]):
                dh = part[k] + carry
                live = mask[k][:, None]
                open_ = np.where(live, dh, 0)
                dc = open_ * z * (1 - c * c)
                drh = dc @ vv.T
                dz = open_ * (c - before) * z * (1 - z)
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                carry = np.where(live, open_ * (1 - z) + drh * r + dzr @ uu.T, dh)
                dg = np.concatenate([dzr, dc], axis=1)
                gu += before.T @ dzr
                gv += (r * before).T @ dc
                gw += x[k].T @ dg
                gb += dg.sum(axis=0)
                dx[k] += dg @ w.T
            grad |= {f"W{s}": gw, f"U{s}": gu, f"V{s}": gv, f"b{s}": gb}
        word = np.zeros_like(self.p["word"])
        np.add.at(word, ids.ravel(), dx[..., :WORD_DIM].reshape(-1, WORD_DIM))
        word[0] = 0
        return grad | {"word": word, "chars": dx[..., WORD_DIM:]}


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS) -> Net:
    """A net for these texts; the same input gives the same net."""
    aside = set(range(0, len(texts), 6)) if len(texts) >= 120 else set()
    if len({toxic[i] for i in aside}) == 2:  # every sixth text calibrates the scores and is not fitted
        net = fit_net([t for i, t in enumerate(texts) if i not in aside], [v for i, v in enumerate(toxic) if i not in aside], epochs)
        held = [tokens(texts[i]) for i in sorted(aside)]
        if net.prior is None:
            top = np.array([b.max() for b in Scorer(net).score(held, [windows(len(d)) for d in held])])
            net.scale = _calibrate(top, np.array([toxic[i] for i in sorted(aside)], np.float32))
        return net
    return fit_net(texts, toxic, epochs)


def fit_net(texts: list[str], toxic: list[int], epochs: int) -> Net:
    y = np.array(toxic, np.float32)
    net = Net({})
    if not len(y) or y.min() == y.max():
        net.prior = float(y.mean()) if len(y) else 0.0
        return net
    split = [tokens(t) for t in texts]
    words = sorted({w for d in split for w in d})
    number = {w: k for k, w in enumerate(words)}
    docs = [np.fromiter(map(number.__getitem__, d), np.int64, len(d)) for d in split]
    seen = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(words)) if words else np.zeros(0, int)
    common = np.argsort(-seen, kind="stable")[:MOST_WORDS]
    common = common[seen[common] >= MIN_TEXTS]
    net.vocab = {words[w]: k + 1 for k, w in enumerate(common.tolist())}
    row_of = np.zeros(len(words) + 1, np.int64)
    row_of[common] = np.arange(1, len(common) + 1)
    net.init()
    grams = Grams(words)
    rng = np.random.default_rng(SEED)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    every = [[(i, s) for s in windows(len(d))] for i, d in enumerate(docs)]
    for epoch in range(epochs):
        if epoch < 1:
            chosen = [w[rng.integers(len(w))] for w in every]
        elif epoch % 2:  # the highest windows, chosen anew every other epoch
            best = score_windows(net, split, every)
            chosen = [w[int(np.argmax(b))] for w, b in zip(every, best)]
        # toxic texts are the rarer class: they are drawn up to three times as often
        pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        most = max(len(pos), len(neg))
        order = [np.resize(rng.permutation(c), max(len(c), min(most, 3 * len(c)))) for c in (pos, neg)]
        order = rng.permutation(np.concatenate(order))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            ws = [docs[chosen[i][0]][chosen[i][1] : chosen[i][1] + WINDOW] for i in own]
            t = max(1, max(map(len, ws)))
            which = np.full((t, len(ws)), len(words), np.int64)  # one past the words: none
            for k, w in enumerate(ws):
                which[: len(w), k] = w
            mask = which < len(words)
            mask[0] = True
            ids = np.where(rng.random(which.shape) < WORD_DROP, 0, row_of[which])
            used, back = np.unique(which, return_inverse=True)
            back = back.reshape(which.shape)
            real = used[used < len(words)]
            chars = np.zeros((len(used), CHAR_DIM), np.float32)
            if len(real):
                chars[: len(real)] = grams.vectors(net.p["char"], real)
            grad = net.gradients(ids, chars[back], mask, y[own])
            dchars = np.zeros_like(chars)
            np.add.at(dchars, back.ravel(), grad.pop("chars").reshape(-1, CHAR_DIM))
            step += 1
            rates = RATE / (1 - 0.9**step), 1 - 0.999**step
            if len(real):
                rows, place = grams.pick(real)
                near, inverse = np.unique(rows, return_inverse=True)
                g = np.zeros((len(near), CHAR_DIM), np.float32)
                np.add.at(g, inverse, (dchars[: len(real)] / np.sqrt(grams.sizes[real])[:, None])[place])
                _adam(net.p["char"], moment["char"], g, rates, near)
            near = np.unique(ids)
            _adam(net.p["word"], moment["word"], grad.pop("word")[near], rates, near)
            net.p["word"][0] = 0
            for k, g in grad.items():
                _adam(net.p[k], moment[k], g, rates)
    top = np.array([b.max() for b in score_windows(net, split, every)])
    net.scale = _calibrate(top, y)
    return net


def _adam(weights, moment, grad, rates, rows=slice(None)) -> None:
    """One Adam step, on the given rows only; embeddings (which have rows) decay a little."""
    m, v = moment
    if not isinstance(rows, slice):
        grad = grad + DECAY * weights[rows]
    m[rows] += 0.1 * (grad - m[rows])
    v[rows] += 0.001 * (grad * grad - v[rows])
    weights[rows] -= rates[0] * m[rows] / (np.sqrt(v[rows] / rates[1]) + 1e-8)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on logits (Newton steps, slope kept positive)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum()])
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(hess, g)
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -1, 1)
    return float(a), float(b)


class Scorer:
    """Scores texts; remembers the gate inputs of words."""

    def __init__(self, net: Net):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        size = 4096
        self.gf, self.gb = np.zeros((size, 3 * HIDDEN), np.float32), np.zeros((size, 3 * HIDDEN), np.float32)

    def look_up(self, words: list[str]) -> np.ndarray:
        rows, new = self.rows, []
        for w in set(words):
            if w not in rows:
                rows[w] = len(rows)
                new.append(w)
        if new:
            net, first = self.net, len(rows) - len(new)
            chars = Grams(new).vectors(net.p["char"], np.arange(len(new)))
            ids = np.array([net.vocab.get(w, 0) for w in new])
            f, b = net.gates(net.inputs(ids, chars))
            while len(self.gf) < len(rows):
                self.gf, self.gb = (np.concatenate([g, np.zeros_like(g)]) for g in (self.gf, self.gb))
            self.gf[first : len(rows)], self.gb[first : len(rows)] = f, b
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def score(self, docs: list[list[str]], starts: list[list[int]]) -> list[np.ndarray]:
        """The logits of every window of every text."""
        out = [np.zeros(len(s), np.float32) for s in starts]
        full: list[tuple[int, int, np.ndarray]] = []
        short: list[tuple[int, int, np.ndarray]] = []

        def flush(part):
            t = max(1, max(len(w) for _, _, w in part))
            same = all(len(w) == t for _, _, w in part)
            ids = np.zeros((t, len(part)), np.int64)
            mask = None if same else np.zeros((t, len(part)), bool)
            for k, (_, _, w) in enumerate(part):
                ids[: len(w), k] = w
                if mask is not None:
                    mask[: max(1, len(w)), k] = True
            gf, gb = self.gf[ids], self.gb[ids]
            if mask is not None:  # a text without words has one step of zero input
                for k, (_, _, w) in enumerate(part):
                    if not len(w):
                        gf[:, k], gb[:, k] = self.net.p["bf"], self.net.p["bb"]
            z = self.net.logits(gf, gb, mask)
            for (i, k, _), v in zip(part, z):
                out[i][k] = v
            part.clear()

        for i, (d, s) in enumerate(zip(docs, starts)):
            if len(self.rows) > REMEMBERED:
                for part in (full, short):
                    if part:
                        flush(part)
                self.reset()
            rows = self.look_up(d)
            for k, at in enumerate(s):
                w = rows[at : at + WINDOW]
                part = full if len(w) == WINDOW else short
                part.append((i, k, w))
                if len(part) >= 1024:
                    flush(part)
        for part in (full, short):
            if part:
                flush(part)
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.net.prior is not None:
            return np.full(len(texts), self.net.prior)
        docs = [tokens(t) for t in texts]
        top = np.array([b.max() for b in self.score(docs, [windows(len(d)) for d in docs])], np.float64)
        a, b = self.net.scale
        return sigmoid(a * top + b)


def score_windows(net: Net, docs: list[list[str]], every: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    return Scorer(net).score(docs, [[s for _, s in w] for w in every])


def remainder(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = MOST_TOXIC, clean: int = MOST_CLEAN) -> DataFrame:
    """doc_id, toxic, text of a bounded sample of the labelled rows that are not held out; a repeated doc_id gives its least text."""
    one = labels.where("doc_id is not null and toxic is not null").where(remainder("doc_id") != 0)
    one = one.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = [
        one.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, toxic), (0, clean))
    ]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # at most toxic + clean rows
    short = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= MOST_CHARS)
    return short.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Net:
    rows = training_rows(docs, labels).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return fit([r.text for r in rows], [int(r.toxic) for r in rows])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the training sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = scorer(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )

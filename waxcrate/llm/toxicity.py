"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, trained in numpy.

A word's input is its own hashed embedding beside the mean embedding of its hashed character trigrams, so unseen words and
spellings still say something. A text is read in overlapping windows of its words, all of them; each window's states are pooled
by attention into a logit, and the text's score is that of its highest window. Training takes each text's highest window of all
that it has, as the network stands (at first any window, then looked for anew every few epochs), for toxic and clean texts alike. It
runs on the driver over a bounded sample of labelled rows, whole texts; scoring runs in the executors, where each different word's inputs are projected once and kept in a bounded table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps

#: Words of a window and words between windows; buckets and width of the embeddings; width of the states and of the attention.
WINDOW, STRIDE = 64, 48
WORD_BUCKETS, CHAR_BUCKETS, EMBED, HIDDEN, ATTEND = 1 << 15, 1 << 13, 12, 12, 8
#: Labelled texts taken for training, of each class at most; epochs and steps, at least; the share of epochs that look for the highest windows anew.
SAMPLE, EPOCHS, LEAST_STEPS, LOOKS = {1: 800, 0: 2000}, 9, 250, 0.34
#: Characters of the longest text of the sample: 2800 of them are 140 MB at most.
LONGEST = 50_000
#: Weight decay of the embeddings; words that a worker keeps, and windows of a step.
DECAY = 2e-5
KEPT_WORDS, WINDOWS_AT_ONCE = 200_000, 2048
_WORD = re.compile(r"\w+")


class _Numbered(dict):
    """Numbers each new word, and lists it in new."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Inputs:
    """Numbers the words it sees, and keeps the bucket and the character trigrams of each. Number 0 is no word."""

    def __init__(self):
        self.index = _Numbered()
        self.buckets, self.flat, self.sizes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.ones(1, np.int64)]

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def add(self) -> None:
        """Hashes the words numbered since the last call, all at once."""
        if not self.index.new:
            return
        raw = [w.encode("utf-8", "replace") for w in self.index.new]
        self.index.new = []
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"^" + b"$^".join(raw) + b"$", np.uint8).astype(np.int64)
        grams = ((data[:-2] * 31337 + data[1:-1]) * 31337 + data[2:]) * 2654435761 >> 15 & (CHAR_BUCKETS - 1)
        inside = np.repeat(np.cumsum(sizes + 2) - sizes - 2 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.buckets.append(np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) & (WORD_BUCKETS - 1))
        self.flat.append(grams[inside])
        self.sizes.append(sizes)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all words, their trigrams one after the other, and how many each has."""
        self.buckets, self.flat, self.sizes = ([np.concatenate(x)] for x in (self.buckets, self.flat, self.sizes))
        return self.buckets[0], self.flat[0], self.sizes[0]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of some words."""
        buckets, flat, sizes = self.tables()
        starts, own = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
        return buckets[numbers], flat[np.repeat(starts - np.cumsum(own) + own, own) + np.arange(int(own.sum()))], own


def windows(numbers: np.ndarray) -> np.ndarray:
    """(n, WINDOW) word numbers, with 0 after the last word; no row for no words."""
    n = len(numbers)
    count = 0 if n == 0 else 1 + max(0, -(-(n - WINDOW) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW if count else 0, np.int64)
    padded[:n] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE] if count else np.zeros((0, WINDOW), np.int64)


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * 0.25 + 0.5, 0, 1)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 2 * EMBED, HIDDEN
    made = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"words": made(WORD_BUCKETS, EMBED, scale=0.1), "chars": made(CHAR_BUCKETS, EMBED, scale=0.3), "attend": made(2 * h, ATTEND, scale=0.3), "choose": made(ATTEND, scale=0.3), "out": made(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
    for side in ("f", "b"):
        p |= {f"in_{side}": made(d, 3 * h, scale=d**-0.5), f"rec_{side}": made(h, 3 * h, scale=h**-0.5), f"base_{side}": np.zeros(3 * h, np.float32)}
    return p


def embedded(p: dict, buckets: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(words, 2 * EMBED)"""
    means = np.add.reduceat(p["chars"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
    return np.concatenate([p["words"][buckets], means], axis=1)


def _states(x: np.ndarray, rec: np.ndarray, mask: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
    """States (T, n, h) of a gated recurrent layer over inputs x (T, n, 3h), in the order of steps given."""
    h_ = HIDDEN
    h = np.zeros((x.shape[1], h_), np.float32)
    out = np.empty((*x.shape[:2], h_), np.float32)
    for t in order:
        a = h @ rec
        zr = _gate(x[t, :, : 2 * h_] + a[:, : 2 * h_])
        z, r = zr[:, :h_], zr[:, h_:]
        new = np.tanh(x[t, :, 2 * h_ :] + r * a[:, 2 * h_ :])
        after = (new + z * (h - new)) * mask[t]  # padding stands at the end: before the first state backward, unseen forward
        if keep is not None:
            keep.append((t, h, a[:, 2 * h_ :], z, r, new))
        h = out[t] = after
    return out


def _back(dout: np.ndarray, rec: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs (T, n, 3h) and of rec."""
    h_ = HIDDEN
    dx, drec, dh = np.empty((*dout.shape[:2], 3 * h_), np.float32), np.zeros_like(rec), np.zeros(dout.shape[1:], np.float32)
    inside = lambda g: 0.25 * ((g > 0) & (g < 1))
    for t, h, an, z, r, new in reversed(kept):
        dh = (dh + dout[t]) * mask[t]
        dpre = dh * (1 - z) * (1 - new * new)
        da = np.concatenate([dh * (h - new) * inside(z), dpre * an * inside(r), dpre * r], axis=1)
        dx[t] = np.concatenate([da[:, : 2 * h_], dpre], axis=1)
        drec += h.T @ da
        dh = dh * z + da @ rec.T
    return dx, drec


def _pool(p: dict, states: np.ndarray, mask: np.ndarray):
    """Logits by attention over states (T, n, 2h)."""
    u = np.tanh(states @ p["attend"])
    s = np.where(mask[:, :, 0] > 0, u @ p["choose"], -1e9)
    w = np.exp(s - s.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, states)
    return pooled @ p["out"] + p["bias"][0], u, w, pooled


def logits(p: dict, projected: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of windows given as rows of projected (words, 6h)."""
    out, h3 = np.empty(len(rows), np.float32), 3 * HIDDEN
    for a in range(0, len(rows), WINDOWS_AT_ONCE):
        idx = np.ascontiguousarray(rows[a : a + WINDOWS_AT_ONCE].T)
        mask = (idx > 0).astype(np.float32)[:, :, None]
        x = projected[idx]
        states = np.concatenate([_states(x[:, :, :h3], p["rec_f"], mask, range(WINDOW)), _states(x[:, :, h3:], p["rec_b"], mask, range(WINDOW - 1, -1, -1))], axis=2)
        out[a : a + WINDOWS_AT_ONCE] = _pool(p, states, mask)[0]
    return out


def project(p: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ p["in_f"] + p["base_f"], x @ p["in_b"] + p["base_b"]], axis=1)


def gradients(p: dict, inputs: Inputs, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
    """Of the mean weighted cross-entropy of windows given by word numbers."""
    used, idx = np.unique(rows.T, return_inverse=True)
    idx = idx.reshape(rows.T.shape)
    mask = (rows.T > 0).astype(np.float32)[:, :, None]
    buckets, flat, sizes = inputs.of(used)
    x = embedded(p, buckets, flat, sizes)
    every, h, h3 = project(p, x)[idx], HIDDEN, 3 * HIDDEN
    kept = {"f": [], "b": []}
    states = np.concatenate([_states(every[:, :, :h3], p["rec_f"], mask, range(WINDOW), kept["f"]), _states(every[:, :, h3:], p["rec_b"], mask, range(WINDOW - 1, -1, -1), kept["b"])], axis=2)
    y, u, w, pooled = _pool(p, states, mask)
    dy = ((1 / (1 + np.exp(-y)) - labels) * weights / len(rows)).astype(np.float32)
    g = {"bias": np.array([dy.sum()], np.float32), "out": pooled.T @ dy}
    dpool = dy[:, None] * p["out"]
    dw = np.einsum("nh,tnh->tn", dpool, states)
    ds = w * (dw - (w * dw).sum(axis=0))
    g["choose"] = np.einsum("tn,tna->a", ds, u)
    du = ds[:, :, None] * p["choose"] * (1 - u * u)
    g["attend"] = np.einsum("tnh,tna->ha", states, du)
    dstates = w[:, :, None] * dpool + du @ p["attend"].T
    dx = np.zeros_like(x)
    for k, side in enumerate("fb"):
        dgate, g[f"rec_{side}"] = _back(dstates[:, :, k * h : (k + 1) * h], p[f"rec_{side}"], mask, kept[side])
        per = np.zeros((len(used), h3), np.float32)
        np.add.at(per, idx.reshape(-1), dgate.reshape(-1, h3))
        g[f"in_{side}"], g[f"base_{side}"] = x.T @ per, per.sum(axis=0)
        dx += per @ p[f"in_{side}"].T
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], buckets, dx[:, :EMBED])
    np.add.at(g["chars"], flat, np.repeat((dx[:, EMBED:] / sizes[:, None]).astype(np.float32), sizes, axis=0))
    return g


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01, batch: int = 96) -> dict[str, np.ndarray]:
    """The network's parameters. Texts without words are left out; with one class only, the network just learns to say so."""
    rng, p, inputs = np.random.default_rng(seed), initial(seed), Inputs()
    cut = [windows(inputs.number(_WORD.findall(t.lower()))) for t in texts]
    inputs.add()
    own = [i for i, c in enumerate(cut) if len(c)]
    if not own:
        return p
    y = np.array(labels, np.float32)
    balance = {k: len(own) / (2 * max(1, sum(labels[i] == k for i in own))) for k in (0, 1)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(own) // batch)))
    for epoch in range(epochs):
        some = [cut[i] for i in own]
        if epoch < epochs // 4:
            chosen = np.array([c[rng.integers(len(c))] for c in some])
        elif (epoch - epochs // 4) % max(1, round(1 / LOOKS)) == 0:
            sizes = np.array([len(c) for c in some])
            score = logits(p, project(p, embedded(p, *inputs.tables())), np.concatenate(some))
            edges = np.cumsum(sizes) - sizes
            chosen = np.array([c[int(np.argmax(score[e : e + n]))] for c, e, n in zip(some, edges, sizes, strict=True)])
        order = rng.permutation(len(own))
        for a in range(0, len(own), batch):
            at = order[a : a + batch]
            target = y[[own[i] for i in at]]
            g = gradients(p, inputs, chosen[at], target, np.array([balance[int(k)] for k in target], np.float32))
            step += 1
            lr = rate * min(1.0, 3 * (epochs - epoch) / epochs)
            for k in ("words", "chars"):
                g[k] += DECAY * p[k]
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return p


@dataclass
class Scorer:
    """Scores texts with given parameters, keeping the projected inputs of the words seen so far."""

    p: dict[str, np.ndarray]

    def __post_init__(self):
        self.clear()

    def clear(self) -> None:
        self.inputs, self.known = Inputs(), 0
        self.projected = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.inputs.index) > KEPT_WORDS:
            self.clear()
        cut = [windows(self.inputs.number(_WORD.findall(t.lower()))) for t in texts]
        self.inputs.add()
        total = len(self.inputs.index)
        while total > len(self.projected):
            self.projected = np.concatenate([self.projected, np.zeros_like(self.projected)])
        for buckets, flat, own in zip(self.inputs.buckets, self.inputs.flat, self.inputs.sizes, strict=True):
            self.projected[self.known : self.known + len(own)] = project(self.p, embedded(self.p, buckets, flat, own))
            self.known += len(own)
        self.inputs.buckets, self.inputs.flat, self.inputs.sizes = [], [], []
        sizes = np.array([len(c) for c in cut], np.int64)
        out, some = np.zeros(len(texts)), np.flatnonzero(sizes)
        if len(some):
            y = logits(self.p, self.projected, np.concatenate([cut[i] for i in some]))
            out[some] = 1 / (1 + np.exp(-np.maximum.reduceat(y, np.cumsum(sizes[some]) - sizes[some]).astype(float)))
        return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: dict[int, int] | None = None) -> DataFrame:
    """text and label of a bounded sample of the labelled rows that aren't held out: the first of each class by a hash of the id, but for
    those with more than LONGEST characters. So the driver, which trains on whole texts, holds no more than the sample's rows times that."""
    named = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    parts = [named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in sorted((sample or SAMPLE).items())]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # as many rows as the sample has at most
    return docs.where(F.length("text") <= LONGEST).select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict[str, np.ndarray]:
    rows = sorted(training_rows(docs, labels, label).collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["label"]) for r in rows])


def score(docs: DataFrame, parameters: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) for each row of docs. A text without words, or null, scores 0.

    Repeated rows are scored each time, alike; null ids stay null; an empty table gives an empty result. Other columns of docs are
    not looked at, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(parameters)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = np.concatenate([np.zeros(0), *(scorer.scores(texts[a:b]) for a, b in steps(texts))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double, predicted int")

"""Toxicity of whole texts by a bidirectional gated recurrent network with attention.

A word enters as the sum of its own vector and the mean of the vectors of its
character n-grams, all hashed. Overlapping windows of words run through a
gated recurrent unit in both directions; attention pools the states of a
window; a text scores as the highest of all its windows, one at every word. Training is NumPy on the driver,
over a bounded sample of labelled rows; scoring runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparsight.llm.words import LOWER, bounded, coded

#: words of a window, and between the windows that training looks at; scoring takes all windows
WIDTH, HIDDEN, WINDOW, STRIDE = 8, 8, 12, 8
BUCKETS = 1 << 13
GRAMS = (3, 5)
#: the most labelled rows per class that training reads, and the longest of their texts
SAMPLE_ROWS, SAMPLE_CHARS = 700, 20_000
EPOCHS, BATCH, RATE = 15, 200, 0.02
THRESHOLD = 0.3
_CHUNK, _WORDS = 1 << 11, 1 << 13
_PRIME = np.uint32(0x01000193)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of its character n-grams, and the ends of these per word.

    An n-gram starts at every byte of the word between its marks and stops at
    its end; the buckets of one byte stand in one row.
    """
    marked = pc.binary_join_element_wise(b"^", words.cast(pa.binary()), b"$", b"")
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, len(GRAMS)), np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(marked.buffers()[1], np.int32)[: n + 1].astype(np.int64)
    raw = np.frombuffer(marked.buffers()[2], np.uint8)[: ends[-1]].astype(np.uint32)
    size = np.diff(ends)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], size)
    room = np.repeat(size, size) - place
    power = np.cumprod(np.full(64, _PRIME, np.uint32))
    whole = np.add.reduceat(raw * power[place % 64], ends[:-1])
    wide = np.concatenate([raw, np.zeros(max(GRAMS), np.uint32)])
    grams = []
    h = np.zeros(len(raw), np.uint32)
    for j in range(max(GRAMS)):
        h = (h ^ np.where(room > j, wide[j : j + len(raw)], np.uint32(0))) * _PRIME
        if j + 1 in GRAMS:
            grams.append(h)
    bucket = lambda h: ((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)
    return bucket(whole), bucket(np.stack(grams, axis=1)), ends[1:]


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, stop`` of overlapping windows that cover every word, for training; none for an empty text."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE + offsets[:-1][text]
    return text, start, np.minimum(start + WINDOW, offsets[1:][text])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``rows`` by their number ``at``."""
    return np.stack([np.bincount(at, column, n) for column in rows.T], axis=1).astype(np.float32)


class Network:
    """The parameters, the forward pass and its gradient."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": 0.1 * rng.standard_normal((BUCKETS, WIDTH)).astype(np.float32),
            "gram": 0.3 * rng.standard_normal((BUCKETS, WIDTH)).astype(np.float32),
            "x": draw(WIDTH, 6 * HIDDEN), "xb": np.zeros(6 * HIDDEN, np.float32),
            "u0": draw(HIDDEN, 3 * HIDDEN), "u1": draw(HIDDEN, 3 * HIDDEN),
            "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.full(1, -1, np.float32),
        }

    def inputs(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """A vector per distinct word."""
        word, gram, ends = found
        if not len(word):
            return np.zeros((0, WIDTH), np.float32)
        out = np.empty((len(word), WIDTH), np.float32)
        starts = np.concatenate([[0], ends[:-1]])
        for a in range(0, len(word), _WORDS):
            first, last = starts[a : a + _WORDS], ends[a : a + _WORDS]
            part = gram[first[0] : last[-1]]
            each = sum(self.p["gram"][part[:, j]] for j in range(part.shape[1]))
            sums = np.add.reduceat(each, first - first[0], axis=0)
            out[a : a + _WORDS] = self.p["word"][word[a : a + _WORDS]] + sums / (last - first)[:, None].astype(np.float32)
        return out

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """What the words add to the gates of both directions; the last row, a zero one, is padding."""
        out = vectors @ self.p["x"] + self.p["xb"]
        return np.concatenate([out, np.zeros((1, 6 * HIDDEN), np.float32)])

    def forward(self, gates: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The logit of each row of ``codes`` (-1: padding at the end)."""
        n, width = codes.shape
        there = (codes >= 0).astype(np.float32)
        full = bool(there.all())
        states = np.empty((width, n, 2 * HIDDEN), np.float32)
        steps = []
        columns = np.ascontiguousarray(codes.T)
        for side in (0, 1):
            u = self.p[f"u{side}"]
            h = np.zeros((n, HIDDEN), np.float32)
            lanes = np.ascontiguousarray(gates[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN])
            for t in range(width) if side == 0 else range(width - 1, -1, -1):
                x = lanes.take(columns[t], axis=0, mode="wrap")
                a = h @ u
                zr = x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
                zr *= np.float32(0.5)
                np.tanh(zr, out=zr)
                zr *= np.float32(0.5)
                zr += np.float32(0.5)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = r * a[:, 2 * HIDDEN :]
                new += x[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                before = h
                h = before - new
                h *= z
                h += new
                if not full:
                    h *= there[:, t : t + 1]
                states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
                if keep is not None:
                    steps.append((side, t, before, a[:, 2 * HIDDEN :], z, r, new))
        score = states @ self.p["attend"] + (there.T - 1) * np.float32(1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep += [there, states, steps, weight, pooled]
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradient(self, found, codes: np.ndarray, label: np.ndarray, weight_of: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy of windows and its gradient."""
        vectors = self.inputs(found)
        gates = self.projected(vectors)
        keep: list = []
        prob = _sigmoid(self.forward(gates, codes, keep))
        there, states, steps, weight, pooled = keep
        loss = -np.mean(weight_of * np.where(label > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7)))
        d = (weight_of * (prob - label) / len(label)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * self.p["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.p["attend"]
        d_gates = np.zeros((*codes.shape, 6 * HIDDEN), np.float32)
        carry = [np.zeros((len(codes), HIDDEN), np.float32) for _ in (0, 1)]
        for side in (0, 1):
            g[f"u{side}"] = np.zeros_like(self.p[f"u{side}"])
        for side, t, before, inner, z, r, new in reversed(steps):
            u = self.p[f"u{side}"]
            d_h = (d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN] + carry[side]) * there[:, t : t + 1]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z = d_h * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g[f"u{side}"] += before.T @ d_a
            carry[side] = d_h * z + d_a @ u.T
            d_gates[:, t, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN] = np.concatenate([d_z, d_r, d_new], axis=1)
        at = codes >= 0
        per_word = _summed(codes[at], d_gates[at], len(vectors))
        g["x"], g["xb"] = vectors.T @ per_word, per_word.sum(axis=0)
        d_vectors = per_word @ self.p["x"].T
        word, gram, ends = found
        g["word"] = _summed(word, d_vectors, BUCKETS)
        n = np.diff(np.concatenate([[0], ends]))
        each = np.repeat(d_vectors / n[:, None].astype(np.float32), n, axis=0)
        g["gram"] = sum(_summed(gram[:, j], each, BUCKETS) for j in range(gram.shape[1]))
        return float(loss), g

    def slid(self, gates: np.ndarray) -> np.ndarray:
        """The logit of every window of consecutive rows of ``gates``, what their words add to both directions.

        All windows take a step together: the words of that step are a slice.
        Of the states only their attention and their share in the logit stay.
        """
        n = len(gates) - WINDOW + 1
        lanes = np.ascontiguousarray(gates.T)
        attended, out = np.empty((2, WINDOW, n), np.float32), np.empty((2, WINDOW, n), np.float32)
        heads = np.stack([self.p["attend"].reshape(2, HIDDEN), self.p["out"].reshape(2, HIDDEN)], axis=1)
        for side in (0, 1):
            u = np.ascontiguousarray(self.p[f"u{side}"].T)
            mine = lanes[side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN]
            h = np.zeros((HIDDEN, n), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                a = u @ h
                x = mine[:, t : t + n]
                zr = a[: 2 * HIDDEN]
                zr += x[: 2 * HIDDEN]
                zr *= np.float32(0.5)
                np.tanh(zr, out=zr)
                zr *= np.float32(0.5)
                zr += np.float32(0.5)
                new = a[2 * HIDDEN :]
                new *= zr[HIDDEN:]
                new += x[2 * HIDDEN :]
                np.tanh(new, out=new)
                h -= new
                h *= zr[:HIDDEN]
                h += new
                attended[side, t], out[side, t] = heads[side] @ h
        score = attended[0] + attended[1]
        score -= score.max(axis=0)
        np.exp(score, out=score)
        return (score * (out[0] + out[1])).sum(axis=0) / score.sum(axis=0) + self.p["bias"][0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text: the highest of all its windows, one at every word; zero without words."""
        codes, offsets, words = coded(texts, LOWER)
        gates = self.projected(self.inputs(features(words)))
        size = np.diff(offsets)
        best = np.full(len(texts), -np.inf)
        short = np.flatnonzero((size > 0) & (size < WINDOW))
        for a in range(0, len(short), _CHUNK):
            at = short[a : a + _CHUNK]
            best[at] = self.forward(gates, cut(codes, offsets[at], offsets[at + 1]))
        # windows over the end of a text are computed along, and left out
        owner = np.repeat(np.arange(len(size)), size)
        last = len(codes) - WINDOW
        for a in range(0, last + 1, _CHUNK):
            b = min(a + _CHUNK, last + 1)
            whole = np.flatnonzero(owner[a:b] == owner[a + WINDOW - 1 : b + WINDOW - 1])
            if len(whole):
                logit = self.slid(gates[codes[a : b + WINDOW - 1]])
                mine = owner[a:b][whole]
                starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                np.maximum.at(best, mine[starts], np.maximum.reduceat(logit[whole], starts))
        return np.where(size > 0, _sigmoid(best), 0.0)


def cut(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Windows as rows, padded with -1."""
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < stop[:, None], codes[np.minimum(at, len(codes) - 1)], -1)


def fit(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Train on whole texts with a label each.

    The first epochs take windows at random, the later ones the windows that
    the network rates highest: one of a toxic text, two of a clean one.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        net.p["bias"][:] = -9 if not len(texts) or labels.max() == 0 else 9
        net.p["out"][:] = 0
        return net
    codes, offsets, words = coded(pa.array(texts, pa.string()), LOWER)
    word, gram, ends = features(words)
    first = np.concatenate([[0], ends[:-1]])
    text, start, stop = windows(offsets)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    share = np.clip(labels.mean(), 0.02, 0.98)
    step = 0
    for epoch in range(epochs):
        if epoch < epochs // 3:
            rank = rng.random(len(text))
        else:
            gates = net.projected(net.inputs((word, gram, ends)))
            rank = -np.concatenate([
                net.forward(gates, cut(codes, start[a : a + _CHUNK], stop[a : a + _CHUNK]))
                for a in range(0, len(text), _CHUNK)
            ])
        order = np.lexsort((rank, text))
        own = text[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        chosen = order[place < np.where(labels[own] > 0, 1 if epoch >= epochs // 3 else 3, 2)]
        rng.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            pick = chosen[a : a + BATCH]
            rows = cut(codes, start[pick], stop[pick])
            used, local = np.unique(np.maximum(rows, 0), return_inverse=True)
            local = np.where(rows >= 0, local.reshape(rows.shape), -1)
            n = ends[used] - first[used]
            at = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            label = labels[text[pick]]
            weight_of = np.where(label > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            _, grads = net.gradient((word[used], gram[at], np.cumsum(n)), local, label, weight_of)
            step += 1
            for k, grad in grads.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id):
    """The fold that training never reads: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS,
) -> tuple[list[str], list[int]]:
    """Up to ``rows`` labelled texts of each class outside the held-out fold, by the hash of their id.

    The only bounded part: texts over ``chars`` are not trained on. Null ids,
    labels and texts are left out; an id with two labels counts as toxic.
    """
    known = (
        labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
        .where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
        .groupBy("i").agg(F.max("y").alias("y"))
    )
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where(
        F.length("t").between(1, chars)
    )
    found = []
    for y in (0, 1):
        # at most twice the rows, so that texts left out by their length can be made up for
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(2 * rows)
        picked = texts.join(F.broadcast(ids), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
        found += [(r.t, r.y) for r in picked.orderBy(F.xxhash64("i"), "i").limit(rows).collect()]
    return [t for t, _ in found], [y for _, y in found]


def scored(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in bounded(batches, text, 4 << 20):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(net.scores(batch.column(text)))], [*batch.schema.names, name]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def trained(docs: DataFrame, labels: DataFrame, **names) -> Network:
    return fit(*sample(docs, labels, **names))

"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (40 words each, the last may be shorter). Every passage is described by its
byte shares and a few word figures, standardised, and encoded by one tanh layer; gated attention
``w . (tanh(V h) * sigmoid(U h))`` gives each passage a weight within its document; the weighted mean of the
encodings is scored by a logistic unit. Only documents carry labels; the gradient flows through the attention.

Training uses at most about ``sample`` labelled documents, picked by a hash of the id, and of each at most
``most`` passages, spread evenly over its whole text - these bounds are the parameters, and what the driver
gathers for fitting is their product, whatever the corpus; scoring reads every passage of every document. Cases: null and empty texts
are one empty passage; without labels every score is 0.5; labels that are null or of unknown documents teach
nothing, repeated ones are averaged; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, SpanHash, buffers, keyed_texts, opened, steps, word_spans

PASSAGE = 40
#: Byte classes: each ASCII byte, and all others as one.
_CLASSES = 129
WIDTH = _CLASSES + 4
HIDDEN, GATE = 24, 12

_hash = SpanHash(81)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of ``WIDTH`` figures for each passage, and the first passage of each text (one more than texts)."""
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    counts = np.diff(first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    edges = np.append(0, np.cumsum(bags))
    text_of = np.repeat(np.arange(len(texts)), counts)
    passage = edges[text_of] + (np.arange(len(starts)) - first[text_of]) // PASSAGE
    total = int(edges[-1])
    # A byte belongs to the passage of the last word that began at or before it in its text.
    heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.empty(0, np.int64)
    marks = np.zeros(len(data) + 1, np.int64)
    at = starts[heads].copy()
    lead = np.append(True, text_of[heads][1:] != text_of[heads][:-1]) if len(heads) else np.empty(0, bool)
    at[lead] = offsets[text_of[heads][lead]]
    held = np.repeat(edges[:-1], np.diff(offsets))
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, at[~lead], 1)
    np.add.at(step, offsets[1:], -np.bincount(text_of[heads][~lead], minlength=len(texts)))
    marks = held + np.cumsum(step)[: len(data)]
    out = np.zeros((total, WIDTH), np.float32)
    classes = np.minimum(data, _CLASSES - 1).astype(np.int64)
    out[:, :_CLASSES] = np.bincount(marks * _CLASSES + classes, minlength=total * _CLASSES).reshape(total, _CLASSES)
    size = np.maximum(1, out[:, :_CLASSES].sum(axis=1))
    words = np.bincount(passage, minlength=total)
    hashes = _hash(data, starts, ends)
    order = np.lexsort((hashes, passage))
    again = np.zeros(len(order), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    repeats = np.bincount(passage[order][again], minlength=total)
    upper, lower = out[:, 65:91].sum(axis=1), out[:, 97:123].sum(axis=1)
    out[:, _CLASSES] = words / PASSAGE
    out[:, _CLASSES + 1] = repeats / np.maximum(1, words)
    out[:, _CLASSES + 2] = size / np.maximum(1, words) / 10
    out[:, _CLASSES + 3] = upper / np.maximum(1, upper + lower)
    out[:, :_CLASSES] /= size[:, None]
    return out, edges


class Model:
    """Encoder, gated attention and scorer, with the figures' means and spreads."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.spread, self.weights = mean, spread, weights

    def forward(self, x: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        a, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (a * g) @ w["w"]
        begin, owner = edges[:-1], np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        e = np.exp(e - np.maximum.reduceat(e, begin)[owner])
        alpha = e / np.add.reduceat(e, begin)[owner]
        z = np.add.reduceat(alpha[:, None] * h, begin, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))
        return {"h": h, "a": a, "g": g, "alpha": alpha, "z": z, "p": p, "owner": owner}

    def gradients(self, x: np.ndarray, edges: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, edges)
        h, a, g, alpha, owner = f["h"], f["a"], f["g"], f["alpha"], f["owner"]
        off = (f["p"] - y) / len(y)
        dz = off[:, None] * w["c"]
        dalpha = (dz[owner] * h).sum(axis=1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, edges[:-1])[owner])
        da = de[:, None] * w["w"] * g * (1 - a * a)
        dg = de[:, None] * w["w"] * a * g * (1 - g)
        dh = (alpha[:, None] * dz[owner] + da @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ de, "c": f["z"].T @ off, "c0": off.sum(keepdims=True)}

    def score(self, figures: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return self.forward((figures - self.mean) / self.spread, edges)["p"]


def fit(figures: np.ndarray, edges: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam over whole-sample gradients, from a fixed seed."""
    mean = figures.mean(axis=0, dtype=np.float64).astype(np.float32)
    spread = (figures.std(axis=0, dtype=np.float64) + 1e-3).astype(np.float32)
    draw = np.random.default_rng(5)
    shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "c0": (1,)}
    weights = {k: (draw.normal(size=s) / np.sqrt(s[0]) * (len(s) > 1 or k in "wc")).astype(np.float32) for k, s in shapes.items()}
    model = Model(mean, spread, weights)
    x = (figures - mean) / spread
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for turn in range(1, rounds + 1):
        for k, grad in model.gradients(x, edges, y).items():
            grad = grad + decay * weights[k] * (weights[k].ndim > 1)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            weights[k] = (weights[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return model


def _bags(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in steps(batches):
        figures, edges = passages(texts)
        body = [figures[a + np.arange(min(most, b - a)) * (b - a) // min(most, b - a)].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(body, pa.binary())], ["doc_id", "bag"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for ids, texts in steps(batches):
        scores = model.score(*passages(texts)).astype(np.float64) if model else np.full(len(ids), 0.5)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], ["doc_id", "score"])


def learn(docs: DataFrame, labels: DataFrame, teaching: Column | None = None, sample: int = 3000, most: int = 32) -> Model | None:
    """A model from ``labels(doc_id, quality)``; ``teaching`` says which labels may teach."""
    Scratch(docs.sparkSession, "quality")
    known = opened(labels, ("doc_id", "quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if teaching is not None:
        known = known.where(teaching)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    n = known.count()
    # About ``sample`` ids, and never more than twice as many.
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n))) < sample).limit(2 * sample)
    bags = keyed_texts(docs).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").mapInArrow(lambda it: _bags(it, most), "doc_id long, bag binary")
    rows = sorted((r["doc_id"], r["y"], bytes(r["bag"])) for r in bags.join(picked, "doc_id").collect())  # bounded by sample and most
    if not rows:
        return None
    parts = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
    edges = np.append(0, np.cumsum([len(p) for p in parts]))
    return fit(np.concatenate(parts), edges, np.array([r[1] for r in rows], np.float32))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``: higher, label 1 likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keyed_texts(docs).mapInArrow(lambda it: _scored(it, shared.value), "doc_id long, score double")

"""Quality classifier: logistic regression on hashed word 1- and 2-grams, trained by follow-the-regularised-leader.

A text is the sparse row of its hashed words and word pairs, as written (case and attached symbols kept), each counted
and divided by the root of the number of words. All pairs of a word with itself share one coordinate, and each word
adds its last byte as a coarse 1-gram, so repeats and attached symbols count for words never seen. A text's score is the sigmoid of one sparse dot product and a bias.
Training is FTRL-proximal with per-coordinate rates over small batches of a bounded sample of labelled rows
(`sample`, a documented bound), even between the two labels; row weights restore the labels' shares in a last fit of
slope and bias on a tenth of the sample that FTRL does not see. The L1 term leaves most coordinates at zero.

Scoring reads every text once, in Arrow batches, without a shuffle; the weights (4 bytes times 2 ** `bits`) go with
the task. Null and empty texts score as the bias alone. Without usable labels every score is 0.5. Repeated rows are
scored row by row, other columns ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .linear import fitted, platt, sampled, sigmoid
from .ppm import held_out
from .runtime import lean, ship

BITS, SAMPLE, KEEP = 18, 12_000, 0.3


def tokens(part: textkit.Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash-space indices of all words and word pairs of a slice, and the document of each."""
    words, folded = part.words(lower=False), part.words()
    pairs, doc = textkit.windows(words, part.word_offsets, 2, short=False)
    inside = np.flatnonzero(part.doc[1:] == part.doc[:-1])
    pairs = np.where(folded[inside] == folded[inside + 1], np.uint64(1), pairs)
    ends = part.raw[part.bounds[1] - 1].astype(np.uint64)
    shift = np.uint64(64 - bits)
    found = [textkit.mix(words, 3), textkit.mix(pairs, 5), textkit.mix(ends, 7)]
    return (np.concatenate(found) >> shift).astype(np.int64), np.concatenate([part.doc, doc, part.doc])


def sparse(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, value, count = [], [], []
    for part in textkit.slices(texts):
        at, doc = tokens(part, bits)
        key, n = np.unique(doc << bits | at, return_counts=True)
        doc = key >> bits
        index.append(key & ((1 << bits) - 1))
        value.append(n / np.sqrt(np.diff(part.word_offsets)[doc]))
        count.append(np.bincount(doc, minlength=len(part)))
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return flat(index, np.int64), flat(value, np.float32), np.concatenate([[0], np.cumsum(flat(count, np.int64))])


def ftrl(i: np.ndarray, v: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray, bits: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0, batch: int = 16) -> dict[str, np.ndarray]:
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def leader(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= np.where(at == bias, 0, l1), 0, -(zs - np.sign(zs) * np.where(at == bias, 0, l1)) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rows = np.arange(len(y))
    learn, check = rows[rows % 10 != 9], rows[rows % 10 == 9]
    spans = np.diff(offsets)
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(learn)
        for b in range(0, len(order), batch):
            chosen = order[b : b + batch]
            size = spans[chosen]
            flat = np.repeat(offsets[chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            at = np.concatenate([i[flat], np.full(len(chosen), bias)])
            x = np.concatenate([v[flat], np.ones(len(chosen))])
            row = np.concatenate([np.repeat(np.arange(len(chosen)), size), np.arange(len(chosen))])
            active, place = np.unique(at, return_inverse=True)
            w = leader(active)
            p = sigmoid(np.bincount(row, w[place] * x, len(chosen)))
            g = np.bincount(place, (p - y[chosen])[row] * x, len(active))
            sigma = (np.sqrt(n[active] + g * g) - np.sqrt(n[active])) / alpha
            z[active] += g - sigma * w
            n[active] += g * g
    w = leader(np.arange(len(z)))
    check = check if len(np.unique(y[check])) == 2 else rows
    dot = np.array([w[i[a:b]] @ v[a:b] for a, b in zip(offsets[:-1][check], offsets[1:][check], strict=True)]) + w[bias]
    slope, shift = platt(dot, y[check], weight[check])
    return {"w": (w[:-1] * slope).astype(np.float32), "bias": np.array([w[bias] * slope + shift])}


def ftrl_score(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, keep: float = KEEP, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from rows of labels whose crc32(doc_id) mod modulus is not remainder."""
    ship(docs.sparkSession)
    out = held_out(F.col("doc_id"), modulus, remainder)
    model = fitted(sampled(docs, labels, label, sample, ~out), label, lambda t: sparse(t, bits), lambda *a: ftrl(*a, bits))
    weights, bias = (model["w"], float(model["bias"][0])) if model else (np.zeros(1 << bits, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textkit.slices(b["text"]):
                at, doc = tokens(part, bits)
                dot = np.bincount(doc, shared.value[at], len(part)) / np.sqrt(np.maximum(1, np.diff(part.word_offsets)))
                yield pa.record_batch([b["doc_id"].slice(part.first, len(part)), pa.array(sigmoid(dot + bias))], ["doc_id", "score"])

    scored_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(scored), "doc_id long, score double")
    return scored_.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))

"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words, ASCII-lower-cased and without closing punctuation, and the first 4, 5 and 6 bytes
of longer words, so that inflected forms share a term; each is a 64-bit hash. The machine scores
sigmoid(b + sum w_i + sum over pairs <v_i, v_j>): the pair term learns what a sum of weights misses, such as an insult
that is one only beside the mention of a group. It is fitted by AdaGrad, the factors far more
slowly than the weights so that a single telling term gets its own weight, on a bounded sample of labelled rows
(`sample`, a documented bound). It keeps the `most` terms whose presence separates the labels best (a likelihood-ratio
test), and the terms of the pairs among the `FREQUENT` most frequent ones whose joint presence tells more than the two
do alone, so a term that says nothing by itself is kept for its partner and a long text of ordinary words still has few
active terms. Slope and bias come last, on a tenth of the sample.

Scoring reads every whole text once, in Arrow batches, without a shuffle; the fitted terms, `most` at most, go with
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

SAMPLE, MOST, RANK, FLAG = 12_000, 4096, 8, 0.7
FREQUENT, PAIRS, GAIN, JOINT = 512, 64, 8, 16
CLOSING = np.zeros(256, bool)
CLOSING[list(b".,;:!?)\"'")] = True


def terms(part: textkit.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a slice and the document of each, not yet distinct."""
    start, end = part.bounds
    for _ in range(3):
        end = end - ((end - start > 1) & CLOSING[part.raw[end - 1]])
    prefix = part.prefix(lower=True)
    made, doc = [textkit.mix(part.spans(prefix, start, end), 1)], [part.doc]
    for n in (4, 5, 6):
        long = np.flatnonzero(end - start > n)
        made.append(textkit.mix(part.spans(prefix, start[long], start[long] + n), n))
        doc.append(part.doc[long])
    return np.concatenate(made), np.concatenate(doc)


def sparse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, count = [], []
    for part in textkit.slices(texts):
        made, offsets = textkit.distinct(*terms(part), len(part))
        index.append(made)
        count.append(np.diff(offsets))
    index = np.concatenate(index).view(np.int64) if index else np.zeros(0, np.int64)
    return index, np.ones(len(index), np.float32), np.concatenate([[0], np.cumsum(np.concatenate(count) if count else np.zeros(0, np.int64))])


def machine(row: np.ndarray, at: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores of n texts from their active terms, and the sums of factors they need."""
    total = np.stack([np.bincount(row, v[at, f], n) for f in range(v.shape[1])], 1)
    square = np.bincount(row, (v[at] ** 2).sum(1), n)
    return bias + np.bincount(row, w[at], n) + 0.5 * ((total**2).sum(1) - square), total


def _told(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood gain of a and b, the weights of both labels in a group, over the label's overall share."""
    n = a + b
    p = (a + 1e-9) / (n + 2e-9)
    return a * np.log(np.maximum(p, 1e-12) / share) + b * np.log(np.maximum(1 - p, 1e-12) / (1 - share))


def partners(row: np.ndarray, at: np.ndarray, y: np.ndarray, learn: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Terms of the pairs whose joint presence tells more of the label than both terms do one by one."""
    often = np.argsort(-counts, kind="stable")[:FREQUENT]
    often = often[counts[often] >= 8]
    slot = np.full(len(counts), -1)
    slot[often] = np.arange(len(often))
    x = np.zeros((len(y), len(often)), np.float32)
    known = slot[at] >= 0
    x[row[known], slot[at][known]] = 1
    x, y = x[learn], y[learn]
    one, none = float((y == 1).sum()), float((y == 0).sum())
    if not one or not none or not len(often):
        return np.zeros(0, np.int64)
    share = one / (one + none)
    a11, b11 = ((x[y == k].T @ x[y == k]).astype(np.float64) for k in (1, 0))
    a, b = np.diag(a11), np.diag(b11)
    alone = _told(a, b, share) + _told(one - a, none - b, share)
    cells = [(a11, b11), (a[:, None] - a11, b[:, None] - b11), (a[None] - a11, b[None] - b11), (one - a[:, None] - a[None] + a11, none - b[:, None] - b[None] + b11)]
    # a term that another always comes with leaves an empty cell, which adds nothing
    joint = sum(_told(np.maximum(p, 0), np.maximum(q, 0), share) for p, q in cells) - alone[:, None] - alone[None]
    # what two terms tell twice lowers this, so what is left is their interaction
    i, j = np.nonzero(np.triu(joint > JOINT, 1))
    best = np.argsort(-joint[i, j], kind="stable")[:PAIRS]
    return np.unique(often[np.concatenate([i[best], j[best]])])


def fit(i: np.ndarray, _: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray, most: int = MOST, rank: int = RANK, epochs: int = 40, rate: float = 0.2, decay: float = 1e-5, batch: int = 64, pace: float = 0.02) -> dict[str, np.ndarray]:
    rows = np.arange(len(y))
    learn, check = rows[rows % 10 != 9], rows[rows % 10 == 9]
    keys, at = np.unique(i, return_inverse=True)
    row = np.repeat(rows, np.diff(offsets))
    mine = (row % 10 != 9)
    a, b = (np.bincount(at[mine & (y[row] == k)], minlength=len(keys)) for k in (1, 0))
    na, nb = max(1, (y[learn] == 1).sum()), max(1, (y[learn] == 0).sum())
    p = (a + b + 1) / (na + nb + 2)
    gain = a * np.log((a / na + 1e-9) / p) + b * np.log((b / nb + 1e-9) / p)
    kept = np.flatnonzero((a + b >= 3) & (gain > GAIN))
    kept = np.union1d(kept[np.argsort(-gain[kept], kind="stable")[:most]], partners(row, at, y, learn, a + b))
    slot = np.full(len(keys), -1)
    slot[kept] = np.arange(len(kept))
    active = slot[at] >= 0
    row, at = row[active], slot[at][active]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(y)))])
    w, v, bias = np.zeros(len(kept)), np.random.default_rng(7).normal(0, 0.03, (len(kept), rank)), 0.0
    gw, gv, gb = np.full(len(kept), 1e-8), np.full((len(kept), rank), 1e-8), 1e-8
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(learn)
        for s in range(0, len(order), batch):
            chosen = order[s : s + batch]
            size = offsets[chosen + 1] - offsets[chosen]
            flat = np.repeat(offsets[chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            r, f = np.repeat(np.arange(len(chosen)), size), at[flat]
            z, total = machine(r, f, len(chosen), bias, w, v)
            g = (sigmoid(z) - y[chosen]) / len(chosen)
            used, place = np.unique(f, return_inverse=True)
            dw = np.bincount(place, g[r], len(used)) + decay * w[used]
            inner = g[r, None] * (total[r] - v[f])
            dv = np.stack([np.bincount(place, inner[:, k], len(used)) for k in range(rank)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= pace * rate * dv / np.sqrt(gv[used])
            bias -= rate * g.sum() / np.sqrt(gb)
    check = check if len(np.unique(y[check])) == 2 else rows
    z, _ = machine(row, at, len(y), bias, w, v)
    slope, shift = platt(z[check], y[check], weight[check])
    return {"keys": keys[kept], "w": w, "v": v.ravel(), "bias": np.array([bias]), "slope": np.array([slope, shift])}


def toxicity_score(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, remainder: int = 1, flag: float = FLAG, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from rows of labels whose crc32(doc_id) mod modulus is not remainder."""
    ship(docs.sparkSession)
    out = held_out(F.col("doc_id"), modulus, remainder)
    model = fitted(sampled(docs, labels, label, sample, ~out), label, sparse, fit)
    if not model:
        model = {"keys": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros(0), "bias": np.zeros(1), "slope": np.array([1.0, 0.0])}
    model["v"] = model["v"].reshape(len(model["keys"]), -1) if len(model["keys"]) else np.zeros((0, 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = textkit.Lookup(model["keys"], np.arange(len(model["keys"])), -1)
        slope, shift = model["slope"]
        for b in batches:
            for part in textkit.slices(b["text"]):
                made, row = terms(part)
                at = table.get(made.view(np.int64))
                pairs = np.unique(row[at >= 0] * len(model["keys"]) + at[at >= 0])
                row, at = pairs // max(1, len(model["keys"])), pairs % max(1, len(model["keys"]))
                z, _ = machine(row, at, len(part), float(model["bias"][0]), model["w"], model["v"])
                yield pa.record_batch([b["doc_id"].slice(part.first, len(part)), pa.array(sigmoid(slope * z + shift))], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(scored), "doc_id long, score double")
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= flag).cast("int").alias("predicted"))

"""Quality rules: fixed limits on word statistics, then a calibrated classifier of hashed word and character n-grams.

A text fails the base rules if it has fewer than 10 words, or if more than 20 % of its words lie in 5-word windows that
occur twice or more in it. The rest is judged by a logistic regression on hashed word 1-grams and pairs and on
character 3- and 4-grams (of bytes, as written): the mean weight of each family's n-grams is one term. It is trained
on a bounded sample of labelled rows (`sample`, a documented bound, even between the labels), calibrated to a
probability on a tenth of it that training does not see, with the labels' true shares, and held against `keep`.

Scoring reads each text once, in Arrow batches, without a shuffle; a text's score is the same in any batch. Null texts have no words and fail. Without usable
labels the classifier keeps all. Repeated rows are judged row by row, other columns ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit
from .linear import fitted, platt, sampled, sigmoid
from .runtime import lean, ship

BITS, SAMPLE, KEEP, WINDOW = 16, 6_000, 0.5, 5
MIN_WORDS, MAX_REPEATED = 10, 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FAMILIES = 4


def families(part: textkit.Slice, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: indices in its own hash space, and the offsets of each document's n-grams."""
    shift = np.uint64(64 - bits)
    words, folded = part.words(lower=False), part.words()
    pair = np.zeros(len(words), np.uint64)
    if len(words) > 1:
        pair[1:] = textkit.mix(words[:-1] * np.uint64(3) ^ textkit.mix(words[1:], 2), 9)
        pair[1:][folded[1:] == folded[:-1]] = 1
    pair[part.word_offsets[:-1][np.diff(part.word_offsets) > 0]] = 2
    out = [((textkit.mix(words, 1) >> shift).astype(np.int64), part.word_offsets), ((textkit.mix(pair, 4) >> shift).astype(np.int64), part.word_offsets)]
    raw, length = part.raw.astype(np.uint32), np.diff(part.offsets)
    place = np.arange(len(raw)) - np.repeat(part.offsets[:-1], length)
    for n in (3, 4):
        gram = np.zeros(len(raw), np.uint32)
        for i in range(min(n, len(raw))):
            gram[i:] |= raw[: len(raw) - i] << np.uint32(8 * i)
        gram = gram[place >= n - 1]  # none reaches into the text before
        out.append((((gram * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(0, length - n + 1))])))
    return out


def sparse(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, value, count = [], [], []
    for part in textkit.slices(texts):
        keys, rates = [], []
        for f, (at, offsets) in enumerate(families(part, bits)):
            size = np.diff(offsets)
            doc = np.repeat(np.arange(len(part)), size)
            key, n = np.unique((doc * FAMILIES + f) << bits | at, return_counts=True)
            keys.append(key)
            rates.append(n / size[(key >> bits) // FAMILIES])
        key, rate = np.concatenate(keys), np.concatenate(rates)
        order = np.argsort(key, kind="stable")
        key, rate = key[order], rate[order]
        doc = (key >> bits) // FAMILIES
        index.append(key - (doc * FAMILIES << bits))
        value.append(rate)
        count.append(np.bincount(doc, minlength=len(part)))
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return flat(index, np.int64), flat(value, np.float32), np.concatenate([[0], np.cumsum(flat(count, np.int64))])


def fit(i: np.ndarray, v: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray, bits: int, epochs: int = 6, rate: float = 0.5, decay: float = 1e-6, batch: int = 32) -> dict[str, np.ndarray]:
    w, g2, bias, b2 = np.zeros(FAMILIES << bits), np.full(FAMILIES << bits, 1e-10), 0.0, 1e-8
    rows, spans = np.arange(len(y)), np.diff(offsets)
    learn, check = rows[rows % 10 != 9], rows[rows % 10 == 9]
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(learn)
        for s in range(0, len(order), batch):
            chosen = order[s : s + batch]
            size = spans[chosen]
            flat = np.repeat(offsets[chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            row = np.repeat(np.arange(len(chosen)), size)
            used, place = np.unique(i[flat], return_inverse=True)
            x = v[flat]
            p = sigmoid(np.bincount(row, w[used][place] * x, len(chosen)) + bias)
            g = (p - y[chosen]) / len(chosen)
            dw = np.bincount(place, g[row] * x, len(used)) + decay * w[used]
            g2[used] += dw**2
            w[used] -= rate * dw / np.sqrt(g2[used])
            b2 += g.sum() ** 2
            bias -= 0.1 * rate * g.sum() / np.sqrt(b2)
    check = check if len(np.unique(y[check])) == 2 else rows
    z = np.array([w[i[a:b]] @ v[a:b] for a, b in zip(offsets[:-1][check], offsets[1:][check], strict=True)]) + bias
    slope, shift = platt(z, y[check], weight[check])
    return {"w": (w * slope).astype(np.float32), "bias": np.array([bias * slope + shift])}


def repeats(part: textkit.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Per document: words inside windows that occur twice or more in it; lines with a word that equal an earlier one."""
    hashes, offsets = part.words(lower=False), part.word_offsets
    covered = np.zeros(len(hashes), bool)
    made, doc = textkit.windows(hashes, offsets, WINDOW, short=False)
    if len(made):
        at = np.arange(len(made)) + doc * 0
        counts = np.diff(offsets)
        first = np.concatenate([[0], np.cumsum(np.maximum(counts - WINDOW + 1, 0))])
        at = at - first[doc] + offsets[doc]  # the window's first word
        order = np.lexsort((made, doc))
        same = (made[order][1:] == made[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again = np.zeros(len(made), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for i in range(WINDOW):
            covered[at[again] + i] = True
    words = textkit.sums(covered.astype(np.int64), offsets)
    raw, edges = part.raw, part.offsets
    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([edges[:-1], breaks + 1]))
    start = start[start < len(raw)]
    end = np.concatenate([start[1:], [len(raw)]]) if len(start) else start
    end = end - ((end > start) & (raw[end - 1] == 10)) if len(start) else end
    lined = textkit.sums((~textkit.SPACE[raw]).astype(np.int64), np.stack([start, end], 1).ravel())[::2] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[lined], end[lined]
    doc = np.searchsorted(edges[1:], start, "right")
    line = part.spans(part.prefix(lower=False), start, end)
    _, kept = textkit.distinct(line, doc, len(part))
    return words, np.bincount(doc, minlength=len(part)) - np.diff(kept)


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: float = KEEP, bits: int = BITS, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for each row of docs.

    carry: with all columns of docs but those of these names, so that a filter needs no join.
    """
    ship(docs.sparkSession)
    model = fitted(sampled(docs, labels, label, sample), label, lambda t: sparse(t, bits), lambda *a: fit(*a, bits))
    weights, bias = (model["w"], float(model["bias"][0])) if model else (np.zeros(FAMILIES << bits, np.float32), 35.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    carried = [c for c in docs.columns if c not in names] if carry else ["doc_id"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.reshape(FAMILIES, -1)
        for b in batches:
            for part in textkit.slices(b["text"]):
                z = np.full(len(part), bias)
                for f, (at, offsets) in enumerate(families(part, bits)):
                    size = np.diff(offsets)
                    z += textkit.sums(w[f][at].astype(np.float64), offsets) / np.maximum(1, size)
                score = sigmoid(z)
                n = np.diff(part.word_offsets)
                points = part.per_doc(((part.raw & 0xC0) != 0x80) & ~textkit.SPACE[part.raw])
                again, lines = repeats(part)
                failed = (n < MIN_WORDS) | (100 * again > MAX_REPEATED * n)
                kept = b.slice(part.first, len(part))
                columns = [n, points, part.per_doc(SYMBOL[part.raw]), lines, again, failed, ~failed & (score >= keep), score]
                yield pa.record_batch([*(kept[c] for c in carried), *map(pa.array, columns)], [*carried, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    facts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    rows = docs.select(*dict.fromkeys([*carried, "text"]))
    return rows.mapInArrow(lean(judged), f"{schema}, {facts}")

"""Document fingerprints by a randomised edit embedding.

A text is read by random walks that all texts share: at each step the walk writes the character that it stands on, and a
random bit, drawn for that step and that character, says whether it moves on to the next. Texts that differ by few edits
fall into step again soon after each edit, so their embeddings differ in few places: edit distance becomes Hamming distance.
A character is left after a number of steps that depends on the step and the character alone, so the walk is run character
by character, with a table of those numbers, for all texts of a batch at once (one by one where few long ones are left).

The fingerprint samples the embedding. Each of its SLOTS digits looks at one place of a walk, the one with the smallest hash
among all places that the walk has: chosen like this, texts of almost equal length look at the same places, whatever their
length. A digit is four bits of a hash of the character there and the two after it. Two fingerprints are as alike as the
share of equal digits, corrected for those equal by chance (1 in 16). Bands of eight digits are keys for candidate search:
alike at 0.8, two texts share one of the 32 bands with a chance above 0.99, alike at 0.3 with one below 0.01; candidates are
verified by the likeness of the whole fingerprints.

Neighbours by id: the ids' quantiles cut the table into as many blocks as there are shuffle partitions, whole texts are
shuffled once, and the first row of each block also goes to the block before. The driver sees an id for each block.

Null texts count as empty; all empty texts have one fingerprint. Null ids come first in the order; rows with one id are
ordered by text. The row after the last is the first, so a single row is its own next. Other columns are ignored. Texts of
any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .runtime import lean, partitions, ship

SLOTS, WALKS, DIGITS, BAND = 256, 2, 16, 8
CLASSES, PERIOD = 256, 1024
#: characters of a batch; beyond so few texts at a time, each is walked by itself
BATCH, TOGETHER = 4_000_000, 48
FIRST = -(1 << 63)
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _steps(walk: int) -> np.ndarray:
    """How many steps a walk stays on a character: by the character's class and the step, modulo PERIOD."""
    bits = (textkit.mix(np.arange(CLASSES * PERIOD, dtype=np.uint64), 101 + walk) >> np.uint64(40) & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    bits[:, 0] = True
    twice = np.concatenate([bits, bits], axis=1)
    nearest = np.minimum.accumulate(np.where(twice, np.arange(2 * PERIOD), 2 * PERIOD)[:, ::-1], axis=1)[:, ::-1]
    return (nearest[:, :PERIOD] - np.arange(PERIOD) + 1).astype(np.int32).ravel()


def _places() -> np.ndarray:
    """For each slot the places that hold the smallest hash so far, among places 0, 1, 2, ...: the next such place after p
    is beyond x with a chance of (p + 1) / (x + 1)."""
    at, made = np.zeros(SLOTS), [np.zeros(SLOTS)]
    for k in range(64):
        u = ((textkit.mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64(k * SLOTS), 7) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        at = np.minimum(np.floor((at + 1) / u), 2.0**52)
        made.append(at)
    return np.stack(made, axis=1).astype(np.int64)


class Walker:
    """Fingerprints of texts; its tables are made once a task."""

    def __init__(self) -> None:
        self.steps, self.places = [_steps(w) for w in range(WALKS)], _places()
        self.lists = [s.tolist() for s in self.steps]

    def walked(self, kinds: np.ndarray, offsets: np.ndarray, order: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """The step at which each character is reached, and the steps of each text in all."""
        lengths, steps = np.diff(offsets)[order], self.steps[walk]
        reached, now, start = np.zeros(len(kinds), np.int64), np.zeros(len(order), np.int64), offsets[:-1][order]
        # texts are sorted by length, the longest first; all but TOGETHER of them are over after `jointly` characters
        jointly = int(lengths[TOGETHER - 1]) if len(order) >= TOGETHER else 0
        going = len(order) - np.searchsorted(lengths[::-1], np.arange(jointly), "right")
        for i, n in enumerate(going.tolist()):
            at, step = start[:n] + i, now[:n]
            reached[at] = step
            step += steps[kinds[at] * PERIOD + (step & PERIOD - 1)]
        table = self.lists[walk]
        for k in range(int((lengths > jointly).sum())):
            begin, end, step, made = start[k] + jointly, start[k] + lengths[k], int(now[k]), []
            for kind in (kinds[begin:end] * PERIOD).tolist():
                made.append(step)
                step += table[kind + (step & PERIOD - 1)]
            reached[begin:end], now[k] = made, step
        total = np.zeros(len(order), np.int64)
        total[order] = now
        return reached, total

    def digits(self, texts: list[str]) -> np.ndarray:
        """A row of SLOTS digits for each text; those of an empty one are 0."""
        out = np.zeros((len(texts), SLOTS), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return out
        kinds = (textkit.mix(codes.astype(np.uint64), 3) >> np.uint64(56)).astype(np.int64)
        order, each = np.argsort(-np.diff(offsets), kind="stable"), SLOTS // WALKS
        for walk in range(WALKS):
            reached, total = self.walked(kinds, offsets, order, walk)
            before = np.concatenate([[0], np.cumsum(total)])
            reached += np.repeat(before[:-1], np.diff(offsets))  # ascending over all texts
            slots = range(walk * each, (walk + 1) * each)
            places = np.stack([self.places[s][np.searchsorted(self.places[s], total[some], "left") - 1] for s in slots], axis=1)
            at = np.searchsorted(reached, places + before[some][:, None], "right") - 1
            end, value = offsets[some + 1][:, None], np.zeros(at.shape, np.uint64)
            for k in range(3):
                here = np.where(at + k < end, codes[np.minimum(at + k, len(codes) - 1)], 0).astype(np.uint64)
                value = textkit.mix(value + here, k + 11)
            out[some[:, None], np.array(slots)] = (textkit.mix(value + np.array(slots, np.uint64), 5) >> np.uint64(60)).astype(np.uint8)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal digits, row by row, without those equal by chance: 0 to 1."""
    return np.maximum(0, ((a == b).mean(axis=1) * DIGITS - 1) / (DIGITS - 1))


def written(digits: np.ndarray) -> list[str]:
    signs = np.frombuffer(b"0123456789abcdef", np.uint8)[digits]
    return [row.tobytes().decode() for row in signs]


def bands(fingerprint: Column) -> Column:
    """Keys for candidate search: number and digits of each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS // BAND - 1)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(fingerprint, i * BAND + 1, F.lit(BAND))))


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many characters of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _report(walker: Walker, ids: list, texts: list[str], following: str, known: np.ndarray | None) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of the texts, each followed by the next and the last one by `following`, whose digits are returned; known:
    those of the first text."""
    every = [*texts, following]
    changed = [edited(a, b) for a, b in zip(every[:-1], every[1:], strict=True)]
    made = walker.digits(every[known is not None :] + changed)
    if known is not None:
        made = np.concatenate([known[None], made])
    own, other = made[: len(every)], made[len(every) :]
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    columns = [ids, [len(t) for t in texts], sha, written(own[:-1]), written(other), likeness(own[:-1], other), likeness(own[:-1], own[1:])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names), own[-1]


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in order, then the row after them (tail); a task's blocks one after the other."""
    walker, ids, texts, known, size, over = Walker(), [], [], None, 0, None
    for batch in batches:
        for doc_id, text, block, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "tail")), strict=True):
            if block == over:
                continue  # further rows of the id that begins the next block
            if texts and (tail or size + len(text) > BATCH):
                made, digits = _report(walker, ids, texts, text, known)
                yield made
                ids, texts, known, size = [], [], digits, 0
            if tail:
                over, known = block, None
                continue
            ids.append(doc_id)
            texts.append(text)
            size += len(text)


def _binary(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are below the value, in as many steps as their number has bits."""
    powers = [1 << k for k in range(len(bounds).bit_length())][::-1]
    held = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    return F.aggregate(F.lit(powers or [1]), F.lit(0), lambda found, p: found + F.when(F.get(held, found + p - 1) < value, p).otherwise(F.lit(0)))


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, block, tail): rows dealt into blocks and sorted; a block's last rows, with tail, come after it."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(FIRST)))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    rows = rows.withColumn("block", _binary(sorted({int(x) for x in cuts}), F.col("key")))
    heads = sorted((r["block"], r["key"]) for r in rows.groupBy("block").agg(F.min("key").alias("key")).collect())
    before = rows.sparkSession.createDataFrame([(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)], "key long, before int")
    rows = rows.join(F.broadcast(before), "key", "left")
    places = F.array(F.struct(F.col("block"), F.lit(False).alias("tail")), F.struct(F.col("before").alias("block"), F.lit(True).alias("tail")))
    rows = rows.select("doc_id", "key", "text", F.inline(F.when(F.col("before").isNull(), F.slice(places, 1, 1)).otherwise(places)))
    return rows.repartitionById(n, "block").sortWithinPartitions("block", "tail", "key", "text").select("doc_id", "text", "block", "tail")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint and that of its edited text, how alike they are, and how alike it is to the next text's.

    edited_candidate: whether the two fingerprints share a band.
    """
    ship(docs.sparkSession)
    found = followed(docs).mapInArrow(lean(_fingerprinted), FIELDS)
    return found.withColumn("edited_candidate", F.arrays_overlap(bands(F.col("fingerprint")), bands(F.col("edited_fingerprint"))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint` (a column of that name is replaced); null texts count as empty."""
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != "fingerprint"]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in batches:
            yield batch.append_column("fingerprint", pa.array(written(walker.digits([t or "" for t in batch.column("text").to_pylist()])), pa.string()))

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType())]))

"""Shared pieces of the hashed linear models: sparse rows, a bounded training sample, sigmoid and calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .runtime import lean, ship

UNIT = float(1 << 63)
#: bytes of a text that a model is fitted on at most
LONGEST = 1 << 15


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, keep: Column | None = None, longest: int = LONGEST) -> DataFrame:
    """doc_id, text, a 0/1 label, place and weight for about `most` labelled documents at most, of `longest` bytes at most.

    An id has one row, with the least of its texts, however often docs repeats it. Half are of each label if there are as many, chosen by a hash of doc_id: the same on every run. `weight` is how many
    labelled rows a row stands for, which undoes the even split. Labels that are null, of another value, or repeated
    with both values go, and so do those outside `keep`. The sample of ids, `most` rows, is the side that is broadcast.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if keep is not None:
        marks = marks.where(keep)
    marks = marks.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").alias(label))
    n = {r[label]: r["n"] for r in marks.groupBy(label).agg(F.count("*").alias("n")).collect()}
    few, many = sorted((n.get(0, 0), n.get(1, 0)))
    few = min(few, most // 2)
    quota = {y: min(n.get(y, 0), most - few if n.get(y, 0) > few else few) for y in (0, 1)}
    share = {y: quota[y] / max(1, n.get(y, 0)) for y in (0, 1)}
    place = F.abs(F.xxhash64(F.lit(11), "doc_id")) / UNIT
    of = lambda x: F.when(F.col(label) == 1, F.lit(x[1])).otherwise(F.lit(x[0]))
    chosen = marks.where(place < of(share)).withColumn("weight", of({y: 1 / max(share[y], 1e-12) for y in (0, 1)})).withColumn("place", place)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", label, "place", "weight").agg(F.min("text").alias("text"))


def fitted(rows: DataFrame, label: str, features: Callable, fit: Callable) -> dict[str, np.ndarray]:
    """Features are made on the executors; one task, given a bounded sample in hash order, fits the arrays.

    features: Arrow texts -> (indices, values, offsets); fit: (indices, values, offsets, y, weight) -> dict of arrays.
    The arrays' sizes are set by the hash space, not by the input.
    """
    ship(rows.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in textkit.slices(b["text"], 16 * textkit.SLICE):
                at, n = part.first, len(part)
                i, v, o = features(b["text"].slice(at, n))
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), x) for x in (pa.array(i, pa.int64()), pa.array(v, pa.float32()))]
                yield pa.record_batch([*(b[c].slice(at, n) for c in ("place", "y", "weight")), *lists], ["place", "y", "weight", "i", "v"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        counts = np.concatenate([np.diff(x.offsets.to_numpy()) for x in table["i"].chunks])
        flat = lambda c: np.concatenate([x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in table[c].chunks])
        found = fit(flat("i"), flat("v"), np.concatenate([[0], np.cumsum(counts)]), table["y"].to_numpy(), table["weight"].to_numpy())
        yield pa.record_batch([pa.array(list(found)), pa.array([str(x.dtype) for x in found.values()]), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["name", "kind", "data"])

    sparse = rows.select("place", "text", F.col(label).cast("int").alias("y"), "weight").mapInArrow(lean(made), "place double, y int, weight double, i array<long>, v array<float>")
    arrays = sparse.repartition(1).sortWithinPartitions("place").mapInArrow(lean(trained), "name string, kind string, data binary").collect()
    return {r["name"]: np.frombuffer(r["data"], r["kind"]) for r in arrays}


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit of y on z, with Platt's smoothed targets, by Newton steps."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * z).sum(), g.sum()])
        step *= min(1, 2 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)

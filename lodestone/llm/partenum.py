"""Jaccard self-join of word n-gram sets with PartEnum signatures, down to connected components.

Sets fall into size bands whose ends differ by the threshold's factor, so a set joins only within its own band and the
two beside it. In an instance for a band, linked sets differ in at most k elements. The domain of shingles is hashed
into n1 parts, and, where that keeps signatures selective, each part into n2 subparts of which one may be left out
(k2 = 1). By counting, two sets that differ in at most k elements agree in at least 1 + g parts, up to k2 subparts, g
being the parts beyond the fewest that would do, and they share the signature of each.

A signature of no element says nothing, so none is made. A set with more than g parts that could give one is poor, and
adds the first (1 - threshold) * size + 1 of its elements in hash order, of which linked sets share one. Nothing is
lost: of two linked sets either one is not poor, and then they agree in a part whose signature holds elements, or both
are, and then they share such an element.

Equal sets become one class by digest before anything else. Sets of one task that share a signature are noted there,
and only one of them is sent to meet those of other tasks, so no signature is hot. The sets of a signature are compared
with one pivot, its smallest. What is then left, sets of different components that have a pivot in common, is compared
in pairs where sizes and parity sketches allow a link: the difference of two sketches never exceeds that of the sets.
Sets meet by pivot and not by signature, so a pair is met once or twice, however many signatures it shares, and pairs
grow with what is near the threshold. Every link is decided on the exact sets. Joins are of plain tables, which skew
handling can split; no document collects its neighbours, and no link, class or fingerprint comes to the driver.

Null and empty texts have no shingles and are linked with nothing. Repeated rows of one id count as one document; an id
with several texts is linked by each of them. Null ids are returned, linked with nothing. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .components import components
from .runtime import Scratch, cut, drop_cut, lean, ship

#: words of a sketch, for sets of up to 64 times as many elements; larger sets have larger ones
SKETCH = 16
BROADCAST_IDS = 500_000
#: signatures, and digests, that a task holds at most
HELD, SEEN = 1 << 20, 1 << 18


@lru_cache(8)
def bands(num: int, den: int, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each band: its largest size; for its instance: g, n1 and n2 (1: no second level)."""
    ends, low = [], 1
    while low <= most:
        ends.append(low * den // num)
        low = ends[-1] + 1
    ends = np.array(ends)
    k = 2 * ends * (den - num) // (den + num)
    low = np.concatenate([[1], ends[:-1] + 1])
    single = (low >= 7 * (k + 1)) | (k < 2)
    spare = np.where(single, np.where(k < 8, 0, 1 + k // 64), (k + 2) // 20)
    return ends, spare, np.where(single, k + 1, (k + 2) // 2) + spare, np.where(single, 1, 3)


def signatures(sets: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and the set of each."""
    ends, spares, firsts, seconds = bands(num, den)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    own = np.searchsorted(ends, np.maximum(size, 1))
    found, of, poor = [], [], np.zeros(len(size), bool)
    for step in (0, 1):
        instance = own + step
        n1, n2 = firsts[instance], seconds[instance]
        cells = np.where(size > 0, n1 * n2, 0)
        base = np.concatenate([[0], np.cumsum(cells)])
        part = (textkit.mix(sets, 21) % n1[doc].astype(np.uint64)).astype(np.int64)
        sub = (textkit.mix(sets, 22) % n2[doc].astype(np.uint64)).astype(np.int64)
        cell = base[doc] + part * n2[doc] + sub
        total, count = np.zeros(base[-1], np.uint64), np.bincount(cell, minlength=base[-1])
        np.add.at(total, cell, textkit.mix(sets, 23))
        owner = np.repeat(np.arange(len(size)), cells)
        place = np.arange(base[-1]) - base[owner]
        two = n2[owner] > 1
        if two.any():  # leave out one subpart: the part's sum less its own
            start = base[owner] + place // n2[owner] * n2[owner]
            whole, many = (np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)]) for x in (total, count))
            rest, left = whole[start + n2[owner]] - whole[start] - total, many[start + n2[owner]] - many[start] - count
            total, count = np.where(two, rest, total), np.where(two, left, count)
        empty = np.flatnonzero(count == 0)
        weak = np.unique(owner[empty] * (1 + base[-1]) + place[empty] // n2[owner[empty]]) // (1 + base[-1])
        poor |= np.bincount(weak, minlength=len(size)) > spares[instance]
        kept = count > 0
        code = place.astype(np.uint64) * np.uint64(2654435761) + instance[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found.append(textkit.mix(total + textkit.mix(code, 24), 25)[kept])
        of.append(owner[kept])
    if poor.any():
        rows = np.flatnonzero(poor[doc])
        order = textkit.mix(sets[rows], 26)
        rows = rows[np.lexsort((order, doc[rows]))]
        few = size[poor] - -(-size[poor] * num // den) + 1
        begin = np.concatenate([[0], np.cumsum(size[poor])[:-1]])
        rows = rows[np.repeat(begin - np.concatenate([[0], np.cumsum(few)[:-1]]), few) + np.arange(few.sum())]
        found.append(textkit.mix(sets[rows], 27))
        of.append(doc[rows])
    return np.concatenate(found), np.concatenate(of)


def sketches(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set, words of parity bits: two sets differ in at least as many elements as their sketches in bits.

    A sketch has SKETCH words times a power of two, as many bits as elements at least; its halves, one XOR the other, are
    the sketch of half its size. Also returns the first word of each.
    """
    size = np.diff(offsets)
    words = SKETCH << np.maximum(0, np.ceil(np.log2(np.maximum(1, size / (64 * SKETCH))))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(size)), size)
    bit = (textkit.mix(sets, 31) & (64 * words[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(first[doc] * 64 + bit, minlength=64 * first[-1]) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), first


def digests(part: textkit.Slice, sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(textkit.sums(textkit.mix(sets, s), offsets).view(np.int64) for s in (41, 43))


def _digested(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in textkit.slices(b["text"]):
            sets, offsets = textkit.shingles(part, width)
            yield pa.record_batch([b["doc_id"].slice(part.first, len(part)), pa.array(np.diff(offsets)), *map(pa.array, digests(part, sets, offsets))], ["doc_id", "n", "d1", "d2"])


def _signed(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(sig, doc, own): one row without `own` for each signature that a task, or HELD signatures of it, holds; and, where
    it is of several sets, one for each of these with `own`."""
    seen: set[tuple[int, int]] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def told() -> Iterator[pa.RecordBatch]:
        sig, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(sig, kind="stable")
        sig, doc = sig[order], doc[order]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        several = np.flatnonzero(~(first & np.append(first[1:], True)))
        rows = np.concatenate([np.flatnonzero(first), several])
        own = np.arange(len(rows)) >= len(rows) - len(several)
        for i in range(0, len(rows), 200_000):
            at = rows[i : i + 200_000]
            yield pa.record_batch([pa.array(sig[at].view(np.int64)), pa.array(doc[at]), pa.array(own[i : i + 200_000])], ["sig", "doc", "own"])

    for b in batches:
        for part in textkit.slices(b["text"]):
            ids = b["doc_id"].slice(part.first, len(part)).to_numpy(zero_copy_only=False)
            sets, offsets = textkit.shingles(part, width)
            new = np.zeros(len(part), bool)
            for i, d in enumerate(zip(*(x.tolist() for x in digests(part, sets, offsets)), strict=True)):
                if d not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    new[i] = True
            size = np.where(new, np.diff(offsets), 0)
            sets = sets[np.repeat(new, np.diff(offsets))]
            found, of = signatures(sets, np.concatenate([[0], np.cumsum(size)]), num, den)
            held.append((found, ids[of]))
            if sum(len(x) for x, _ in held) > HELD:
                yield from told()
    if held:
        yield from told()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in textkit.slices(b["text"]):
            sets, offsets = textkit.shingles(part, width)
            bits, first = sketches(sets, offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sets.view(np.int64)))
            marks = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bits))
            yield pa.record_batch([b["doc_id"].slice(part.first, len(part)), pa.array(np.diff(offsets)), marks, lists], ["doc_id", "n", "sketch", "items"])


def _halved(sketch: Column) -> Column:
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) with den * intersection >= num * union."""
    side = lambda c, *more: sets.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in more))
    light = pairs.join(side("a", "n", "sketch"), "a").where("n_a > 0").join(side("b", "n", "sketch"), "b")
    light = light.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)  # so of sketches one is twice the other at most
    fit = lambda c, d: F.when(F.size(f"sketch_{c}") > F.size(f"sketch_{d}"), _halved(F.col(f"sketch_{c}"))).otherwise(F.col(f"sketch_{c}"))
    apart = F.aggregate(F.zip_with(fit("a", "b"), fit("b", "a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    light = light.where(apart * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b", "n_a", "n_b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return light.join(side("a", "items"), "a").join(side("b", "items"), "b").where(common * den >= (F.col("n_a") + F.col("n_b") - common) * num).select("a", "b")


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """(sig, p, n): signatures with several sets, their pivots, the smallest sets, and their numbers of sets; of
    signatures with the very same sets one is kept, as all give the same pairs."""
    members = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("doc").alias("p"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("y")).where("n > 1")
    return members.groupBy("n", "p", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "p", "n")


def _rest(stars: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a > b, of different components that have a pivot in common and that sizes and sketches allow to be
    linked; stars: (doc, p) of signatures of three sets or more."""
    comp = scratch.cut(stars.join(labels, F.col("doc") == F.col("id"), "left").select("p", "doc", F.coalesce("component", "doc").alias("comp")))
    several = scratch.cut(comp.groupBy("p").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("p"))

    def folded(word: int) -> Column:
        """A word of the sketch of SKETCH words that larger ones fold to."""
        return F.aggregate(F.filter("sketch", lambda _, i: i % SKETCH == word), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    facts = sets.select(F.col("doc_id").alias("doc"), "n", *(folded(i).alias(f"s{i}") for i in range(SKETCH)))
    left = scratch.cut(comp.join(several, "p", "left_semi").join(facts, "doc"))
    size = lambda c: F.col(f"{c}.n")
    apart = sum((F.bit_count(F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}"))) for i in range(SKETCH)), F.lit(0))
    near = (F.least(size("l"), size("r")) * den >= F.greatest(size("l"), size("r")) * num) & (apart * (den + num) <= (size("l") + size("r")) * (den - num))
    pairs = left.alias("l").join(left.alias("r"), (F.col("l.p") == F.col("r.p")) & (F.col("l.comp") < F.col("r.comp")) & near)
    return pairs.select(F.greatest("l.doc", "r.doc").alias("a"), F.least("l.doc", "r.doc").alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * intersection >= num * union of their shingle sets."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    before, early, late = Scratch(), Scratch(), Scratch()
    base = cut(rows.mapInArrow(lean(lambda it: _digested(it, width)), "doc_id long, n long, d1 long, d2 long"))
    classes = base.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    # classes are cut so that both sides of the join are plain shuffles, which skew handling can split
    copies = late.cut(base.join(before.cut(classes), ["d1", "d2", "n"]).select("doc_id", "rep").distinct())
    signed = rows.where("doc_id IS NOT NULL").mapInArrow(lean(lambda it: _signed(it, width, num, den)), "sig long, doc long, own boolean")
    # rows with `own` are known to have company, and are dealt out one by one; of the others a task sends one a signature
    shared = signed.selectExpr("sig", "doc", "own", "count(*) OVER (PARTITION BY sig, IF(own, doc, NULL)) AS n").where("own OR n > 1")
    shared = early.cut(shared.join(copies.withColumnRenamed("doc_id", "doc"), "doc", "left").select("sig", F.coalesce("rep", "doc").alias("doc")).distinct())
    before.drop()
    stars = late.cut(shared.join(early.cut(_distinct_buckets(shared)), "sig").select("doc", "p", "n"))
    early.drop()
    wanted = late.cut(stars.select(F.col("doc").alias("doc_id")).distinct())
    # candidates are few beside the rows; their ids are broadcast only if counted small, else the texts are shuffled
    held = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = late.cut(rows.join(held, "doc_id", "left_semi").mapInArrow(lean(lambda it: _sets(it, width)), "doc_id long, n long, sketch array<long>, items array<long>").withColumn("d", F.xxhash64("items")).dropDuplicates(["doc_id", "d"]))

    first = late.cut(stars.where("doc <> p").select(F.col("doc").alias("a"), F.col("p").alias("b")).distinct())
    edges = late.cut(verified(first, sets, num, den))
    # of two sets none is left to compare, nor is the pivot
    linked = components(edges)
    rest = late.cut(_rest(stars.where("n > 2 AND doc <> p").select("doc", "p").distinct(), linked, sets, num, den, late))
    drop_cut(linked)
    edges = edges.union(late.cut(verified(rest.join(first, ["a", "b"], "left_anti"), sets, num, den)))
    whole = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(whole.union(edges))
    late.drop()
    out = base.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))

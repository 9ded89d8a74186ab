"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash h = 2h + G[byte] is taken modulo 2^16, so it depends on the last 16 bytes alone. Every word has the hash at
its end, and of each WINDOW words in a row the one with the least hash (the last of equal ones) ends a chunk. Cuts so
depend on the words around them alone: an insertion moves only the chunks it touches, a chunk has WINDOW words at most,
and a passage of WORDS words, wherever it stands, holds two cuts at least and so a whole chunk. (A word of more than
LONG bytes counts by its parts, which begin at every code point outside ASCII and where the top bits of the gear hash
are zero, so that scripts without spaces, other separators and encoded data resist shifts too.)

Chunks are keyed by digest, of 64 bits with what is beside them, as windows and runs of chunks decide. A passage of WORDS words holds a whole chunk and, on one side of it at least, BESIDE
words more; so a chunk is listed twice, with bits of the words before and of those after it, and counts as repeated where
either is listed elsewhere too. A repeated chunk points to the first, by (doc_id, position), that it is like. A run of
neighbouring chunks that point to neighbouring chunks of one text is a copy of it, and of WORDS words or more it goes.
Around all other repeated chunks, first ones included, the windows of WORDS words that contain them, and reach no further
beyond their run than where chunks depend on what is outside a passage, are compared by digests of 128 bits of their own, and every window but the first goes: what goes are exactly the words of repeated windows (but for white
space between the chunks of a copied run, which may differ). What repeats over fewer words, such as a common closing line,
stays. A text that repeats itself keeps its first period.

Of equal keys that meet in one task all but the first are known there to be repeated, with that first as origin; only one
row of each key and task goes on to meet those of other tasks, so a passage in a third of all texts is not hot. The chunks
are made and shuffled once. Spans are gathered by document and text, and are bounded by its length. No digest comes to the
driver.

Null texts count as empty, and an empty text has no chunks. Null ids are returned whole. Rows repeated under one id and
text are treated alike; different texts under one id are texts of their own. Other columns are kept by deduplicated(). A
passage of fewer bytes than WORDS words have at least, such as a ruled line, stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .runtime import Scratch, cut, lean, ship

WORDS, WINDOW, LONG, BITS = 51, 21, 32, 2
GEAR = textkit.mix(np.arange(256, dtype=np.uint64), 61).astype(np.uint16)
OTHER = 0xC2B2AE3D27D4EB4F
#: units beside a chunk that are part of its keys; ids that go to every task; rows that a task holds
BESIDE, BROADCAST_IDS, HELD = 14, 500_000, 1 << 19
#: units from the end of a passage to where its chunks are its own: a hash looks back 16 bytes, 8 units at most; a repeated
#: window so reaches no further beyond a run of repeated chunks
EDGE = WINDOW + 8
#: added to units, so that a range may begin before its text
REACH = 64
#: place: 27 bits that tell the texts of an id apart, 32 of the first unit, 5 of the units; f and origin: id and place of
#: the first row of the key in this task, null for that row itself, of which `many` tells that there are others
CHUNK = "key long, mark long, doc_id long, place long, f long, origin long, many boolean"


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash modulo 2^16 after each byte, by doubling the window: 1, 2, 4, 8, 16 bytes."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        wide = h.copy()
        wide[step:] += h[:-step] << np.uint16(step)
        h = wide
    return h


@dataclass
class Units:
    """Words of a slice, or parts of long ones: their bytes, documents, and the first unit of each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    offsets: np.ndarray


def units(part: textkit.Slice) -> Units:
    start, end = part.bounds
    long = end - start > LONG
    if not long.any():
        return Units(start, end, part.doc, part.word_offsets)
    raw = part.raw
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[start[long]] += 1
    inside[end[long]] -= 1  # a text may end where the next begins
    inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
    spot = np.flatnonzero(inside[1:] & inside[:-1] & (raw[1:] & 0xC0 != 0x80)) + 1
    into = spot - start[np.searchsorted(start, spot, "right") - 1]
    due = (into >= 16) & (gear(raw)[spot - 1] >> np.uint16(16 - BITS) == 0)  # a hash must not reach into the word before
    spot = spot[(into > 0) & (due | (raw[spot] >= 0x80))]
    start, end = np.sort(np.concatenate([start, spot])), np.sort(np.concatenate([end, spot]))
    doc = np.searchsorted(part.offsets[1:], start, "right")
    return Units(start, end, doc, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(part)))]))


def chunks(part: textkit.Slice, every: Units, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First and last units of all chunks of a slice, in order; they hold every unit."""
    n = len(every.start)
    if not n:
        return (np.zeros(0, np.int64),) * 2
    h = gear(part.raw)[every.end - 1].astype(np.uint32)
    h[every.end - part.offsets[every.doc] < 16] = 1 << 16  # a hash must not reach into the text before
    last = every.offsets[1:][np.diff(every.offsets) > 0] - 1
    closing = np.zeros(n, bool)
    closing[last] = True
    if n >= window:
        # the place of the least hash, the last of equal ones, of 1, 2, 4, ... units, then of all in a window
        least, size = np.arange(n), 1
        while size < window:
            step = min(size, window - size)
            a, b = least[:-step], least[step:]
            least, size = np.where(h[b] <= h[a], b, a), size + step
        closing[least[every.doc[: len(least)] == every.doc[window - 1 :]]] = True
    end = np.flatnonzero(closing)
    return np.concatenate([[0], end[:-1] + 1]), end


def _digests(part: textkit.Slice, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    return [part.spans(part.prefix(lower=False, base=b), start, end, base=b).view(np.int64) for b in (textkit.BASE, OTHER)]


def _unit(place: np.ndarray) -> np.ndarray:
    return place >> 5 & 0xFFFFFFFF


def _beside(part: textkit.Slice, every: Units, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the hash of each of BESIDE units before and after chunks, the nearest lowest; 0 beyond the text."""
    bits = (part.spans(part.prefix(lower=False), every.start, every.end) >> np.uint64(62)).astype(np.int64)
    low, high = every.offsets[every.doc[first]], every.offsets[every.doc[first] + 1]
    before, after = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for k in range(BESIDE):
        i, j = first - 1 - k, last + 1 + k
        before |= np.where(i >= low, bits[np.maximum(i, 0)], 0) << (2 * k)
        after |= np.where(j < high, bits[np.minimum(j, len(bits) - 1)], 0) << (2 * k)
    return before, after


def _told(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows key, mark, doc_id, place, of each key the first as it is, the others with it as their origin and dealt by
    themselves; rows repeated in full are one."""
    key, mark, ids, place = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((place, ids, mark, key))
    key, mark, ids, place = (x[order] for x in (key, mark, ids, place))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
    kept = np.ones(len(key), bool)
    kept[1:] = new[1:] | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])
    key, mark, ids, place, new = (x[kept] for x in (key, mark, ids, place, new))
    begin = np.flatnonzero(new)
    first = begin[np.cumsum(new) - 1]
    many = np.zeros(len(key), bool)
    many[begin] = np.diff(np.append(begin, len(key))) > 1
    key = np.where(new, key, textkit.mix((ids ^ place).view(np.uint64), 71).view(np.int64))
    for i in range(0, len(key), 100_000):
        at = slice(i, i + 100_000)
        yield pa.record_batch([*(pa.array(x[at]) for x in (key, mark, ids, place)), pa.array(ids[first[at]], mask=new[at]), pa.array(place[first[at]], mask=new[at]), pa.array(many[at])], ["key", "mark", "doc_id", "place", "f", "origin", "many"])


def _noted(made: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    for found in made:
        held.append(found)
        if sum(len(x[0]) for x in held) > HELD:
            yield from _told(held)
    if held:
        yield from _told(held)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[list[np.ndarray]]:
        for b in batches:
            for part in textkit.slices(b["text"]):
                found = units(part)
                first, last = chunks(part, found)
                doc = found.doc[first]
                before, after = _beside(part, found, first, last)
                ids, t = (b[c].slice(part.first, len(part)).to_numpy() for c in ("doc_id", "t"))
                place = t[doc].astype(np.int64) << 37 | first - found.offsets[doc] << 5 | last - first + 1
                one, two = (x.view(np.uint64) for x in _digests(part, found.start[first], found.end[last]))
                both = textkit.mix(one ^ textkit.mix(two, 84), 83)
                for side, bits in enumerate((before, after)):
                    yield [textkit.mix(both ^ textkit.mix(bits.view(np.uint64), 81 + side), 85).view(np.int64), np.zeros(len(doc), np.int64), ids[doc], place]

    return _noted(made())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the repeated chunks of each text: copied runs, as ranges of units that go; and, with `ask`, ranges in which
    windows are to be compared."""

    def told(b: pa.RecordBatch, x: np.ndarray, y: np.ndarray, ask: bool) -> pa.RecordBatch:
        """x, y: with the row of b in the bits from 32 on."""
        own = pa.array(x >> 32)
        low, high = ((v & 0xFFFFFFFF) - REACH for v in (x, y))
        return pa.record_batch([b["doc_id"].take(own), b["t"].take(own), *(pa.array(np.maximum(v, 0).astype(np.int32)) for v in (low, high)), pa.array(np.full(len(x), ask))], ["doc_id", "t", "x", "y", "ask"])

    for b in batches:
        lists = b["chunks"]
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = dict(zip([f.name for f in lists.type.value_type], (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten()), strict=True))
        if not len(row):
            continue
        m, here = flat["place"] & 31, row << 32 | _unit(flat["place"]) + REACH
        # copied runs: neighbours that point to neighbours, of one text, at one distance
        away = np.flatnonzero((flat["f"] != b["doc_id"].to_numpy()[row]) | (flat["origin"] != flat["place"]))
        text, shift = flat["origin"] >> 37, _unit(flat["origin"]) - _unit(flat["place"])
        away = away[np.lexsort((here[away], shift[away], text[away], flat["f"][away], row[away]))]
        one = np.ones(len(away), bool)
        alike = lambda: np.all([v[away[1:]] == v[away[:-1]] for v in (row, flat["f"], text, shift)], axis=0)
        one[1:] = ~alike() | (here[away[1:]] != here[away[:-1]])
        away = away[one]  # a chunk that both of its keys repeat is there twice
        begins = np.ones(len(away), bool)
        begins[1:] = ~alike() | (here[away[1:]] != here[away[:-1]] + m[away[:-1]])
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(away)) - 1
        start, end = here[away[first]], here[away[last]] + m[away[last]]
        copied = end - start >= WORDS
        start, end = start[copied], end[copied]
        yield told(b, start, end, False)
        # windows around the other chunks, as far as their run of repeated chunks and EDGE beside it reach; those that lie
        # inside one copied run are known already
        new = np.append(True, here[1:] > (here + m)[:-1])
        low = here[np.flatnonzero(new)][np.cumsum(new) - 1]
        high = (here + m)[np.append(np.flatnonzero(new)[1:], len(here)) - 1][np.cumsum(new) - 1]
        x, y = np.maximum(here + m - WORDS, low - EDGE), np.minimum(here + WORDS, high + EDGE)
        x, y = x[(wide := y - x >= WORDS)], y[wide]
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        at = np.searchsorted(start, x, "right") - 1
        inside = (at >= 0) & (y <= reach[np.maximum(at, 0)]) if len(start) else np.zeros(len(x), bool)
        x, y = x[~inside], y[~inside]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        if len(x):
            far = np.maximum.accumulate(y)
            new = np.append(True, x[1:] > far[:-1])
            yield told(b, x[new], far[np.append(np.flatnonzero(new)[1:], len(x)) - 1], True)


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of WORDS units inside `ranges` of units."""

    def made() -> Iterator[list[np.ndarray]]:
        for b in batches:
            for part in textkit.slices(b["text"]):
                ranges = b["ranges"].slice(part.first, len(part))
                found = units(part)
                doc = np.repeat(np.arange(len(part)), ranges.value_lengths().to_numpy(zero_copy_only=False))
                low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges.flatten().flatten())
                low, high = np.maximum(low, 0), np.minimum(high, np.diff(found.offsets)[doc])
                many = np.maximum(0, high - low - WORDS + 1)
                at = np.unique(np.repeat(found.offsets[doc] + low - np.cumsum(many) + many, many) + np.arange(many.sum()))
                doc = found.doc[at]
                ids, t = (b[c].slice(part.first, len(part)).to_numpy() for c in ("doc_id", "t"))
                yield [*_digests(part, found.start[at], found.end[at + WORDS - 1]), ids[doc], t[doc].astype(np.int64) << 37 | at - found.offsets[doc] << 5]

    return _noted(made())


def _again(made: DataFrame) -> DataFrame:
    """doc_id, t, place, f and origin (id and place of the first that is known) of all rows of made whose key others have
    too, that first one included."""
    by = Window.partitionBy("key", "mark").orderBy("doc_id", "place")
    rows = made.withColumns({"first": F.first(F.struct("doc_id", "place")).over(by), "more": F.lead("place").over(by).isNotNull()})
    rows = rows.where("f IS NOT NULL OR many OR more OR doc_id <> first.doc_id OR place <> first.place")
    return rows.select("doc_id", F.shiftright("place", 37).cast("int").alias("t"), "place", F.coalesce("f", "first.doc_id").alias("f"), F.coalesce("origin", "first.place").alias("origin"))


def _near(rows: DataFrame) -> DataFrame:
    """rows to go to every task, if counted few; beyond that the other side is shuffled to meet them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def text_key() -> Column:
    """Tells texts of one id apart, by 26 bits."""
    return F.pmod(F.hash(F.coalesce("text", F.lit(""))), F.lit(1 << 26)).cast("int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, t, spans): for each text that has any, what goes of it as sorted (start, end) of units; they may overlap."""
    ship(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("t"), "text")
    scratch = Scratch()
    made = rows.mapInArrow(lean(_chunked), CHUNK)
    gathered = _again(made).groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("place", "f", "origin"))).alias("chunks"))
    found = scratch.cut(gathered.mapInArrow(lean(_runs), "doc_id long, t int, x int, y int, ask boolean"))
    ranges = scratch.cut(found.where("ask").groupBy("doc_id", "t").agg(F.collect_set(F.struct("x", "y")).alias("ranges")))
    asked = rows.join(_near(ranges.select("doc_id", "t")), ["doc_id", "t"], "left_semi")
    windows = _again(asked.join(ranges, ["doc_id", "t"]).mapInArrow(lean(_windowed), CHUNK)).where("doc_id <> f OR place <> origin")
    at = F.shiftright("place", 5).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    spans = found.where("NOT ask").select("doc_id", "t", "x", "y").union(windows.select("doc_id", "t", at, at + WORDS))
    whole = cut(spans.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct(F.col("x").alias("start"), F.col("y").alias("end")))).alias("spans")))
    scratch.drop()
    return whole


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that touch or overlap, as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with `text` less its repeated passages, and with removed (spans of bytes), n_repeated (how many) and text_bytes.

    Null texts become empty. Columns of docs that have these names are replaced, others carried.
    """
    kept = docs.drop("n_repeated", "removed", "text_bytes", "_cdc_doc", "_cdc_t", "_cdc_spans")
    spans = repeated_passages(docs).select(F.col("doc_id").alias("_cdc_doc"), F.col("t").alias("_cdc_t"), F.col("spans").alias("_cdc_spans"))
    filled = kept.withColumn("text", F.coalesce("text", F.lit("")))
    same = (F.col("doc_id").cast("long") == F.col("_cdc_doc")) & (text_key() == F.col("_cdc_t"))
    ids = spans.select("_cdc_doc", "_cdc_t")
    if ids.count() <= BROADCAST_IDS:  # texts of which nothing goes stay where they are
        touched = filled.join(F.broadcast(ids), same, "left_semi").join(spans, same)
        joined = touched.unionByName(filled.join(F.broadcast(ids), same, "left_anti"), allowMissingColumns=True)
    else:
        joined = filled.join(spans, same, "left")
    joined = joined.drop("_cdc_doc", "_cdc_t")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", removed array<struct<start:int,end:int>>, n_repeated int, text_bytes long"

    def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [n for n in b.schema.names if n != "_cdc_spans"]
            texts, some = b["text"], pc.is_valid(b["_cdc_spans"])
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            gone: list[list[dict[str, int]]] = [[] for _ in range(len(b))]
            made, held, chosen = [], texts.filter(some), b["_cdc_spans"].filter(some).to_pylist()
            for part in textkit.slices(held):
                every = units(part)
                for k in range(len(part)):
                    base, begin = every.offsets[k], part.offsets[k]
                    cuts = [(int(every.start[base + x] - begin), int(every.end[base + y - 1] - begin)) for x, y in merged([(s["start"], s["end"]) for s in chosen[part.first + k]])]
                    cuts = [c for c in cuts if c[1] - c[0] >= 2 * WORDS - 1]
                    raw = part.raw[begin : part.offsets[k + 1]].tobytes()
                    edges = [0, *(x for c in cuts for x in c), len(raw)]
                    made.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode())
                    gone[at[part.first + k]] = [{"start": x, "end": y} for x, y in cuts]
            less = pc.replace_with_mask(texts, some, pa.array(made, texts.type)) if made else texts
            spans_ = pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            counts = pc.cast(pc.list_value_length(spans_), pa.int32())
            yield pa.record_batch([*(less if n == "text" else b[n] for n in names), spans_, counts, pc.cast(pc.binary_length(texts), pa.int64())], [*names, "removed", "n_repeated", "text_bytes"])

    return joined.mapInArrow(lean(stripped), schema)

"""Language-model scoring by prediction by partial matching (PPM, escape method C, with symbol exclusion).

The trie of byte contexts of up to `ORDER` bytes is a set of Spark tables, one for each depth: how often a symbol
followed a context in the training texts. A symbol is a byte of the ASCII-lower-cased text or the end of the text;
a text begins in a context of start marks. In a context seen n times with d different symbols a symbol seen c times
has c / (n + d) and the escape d / (n + d). After an escape the next shorter context leaves out the symbols of the
longer one. As a context's symbols all follow its suffix too, what is left out is a sum per context, which one join
computes, so exclusion is exact. Past the empty context every symbol not yet seen there is equally likely.

How it scales: a block is a split of the input files, or one of several hash classes of its rows, as many as it has
BLOCK bytes (where there are no files, classes of all rows by Spark's estimate of their size). Its texts and its keys
are so bounded, whatever the size of a split. The first pass counts the distinct words and grams of each block in its own
task. Keys are dealt into parts by a hash, about as many as there are blocks, and a block sends its keys of one part as one
row of packed numbers, so that Spark moves and sorts a row per block and part instead of one per block and key. A part sums
its keys over all blocks; the distinct grams get their code length by joins of trie tables, and the parts give each block
the values of its own keys. The second pass sends the texts once, by block, behind the block's part of the model, and
streams them against it; blocks are numbered, and each number is a task of its own. A key is in a block's rows once, or as
often as its counts were flushed, so none is hot; nothing but three totals reaches the driver.

Null texts count as empty, and an empty text has one token, its end. Null ids are scored and belong to the training
part. Equal ids are scored row by row. Other columns are ignored. A symbol that the first pass did not see in its block,
which only an input that changes meanwhile can have, costs as much as any of SYMBOLS equally likely ones. Words are keyed by 64-bit hashes; among w distinct
words a collision has odds of about w^2 / 2^65. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .runtime import Scratch, cut, lean, partitions, ship, trim

ORDER = 5
BITS, SYMBOL, SYMBOLS = 9, 511, 257
WORD, GRAM, DOC = 0, 1, 2
FLUSH, HELD, CHUNK, SLICE, BLOCK = 1 << 21, 1 << 22, 1 << 18, 1 << 17, 16 << 20
PRIME = 1_000_000_007
CODE = textkit.LOWER.astype(np.int64) + 2


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def grams(part: textkit.Slice, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of each text with the `order` symbols before it, packed, the newest in the low bits; and offsets."""
    offsets = part.offsets + np.arange(len(part) + 1)
    made = CODE[np.insert(part.raw, part.offsets[1:], 0)]
    made[offsets[1:] - 1] = 1
    width = 1
    while width <= order:  # each has `width` symbols; those of the one `more` places before join, where both have one it is the same
        more = min(width, order + 1 - width)
        made[more:] |= made[:-more] << (BITS * more)
        width += more
    for j in range(order):  # a text's first symbols have none of the text before it
        at = offsets[:-1] + j
        at = at[at < offsets[1:]]
        made[at] &= (1 << BITS * (j + 1)) - 1
    return made, offsets


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)


def merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of sorted pieces (keys, counts), and the sums of their counts."""
    if len(pieces) == 1:
        return pieces[0]
    keys, counts = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(keys, kind="stable")  # runs that are sorted are merged
    keys = keys[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def flat(rows: pa.Array, kind: type) -> np.ndarray:
    """The 8-byte numbers that a binary column's rows hold, one row's behind the other's."""
    if pa.types.is_large_binary(rows.type):
        rows = rows.cast(pa.binary())
    _, offsets, data = rows.buffers()
    if not len(rows) or data is None:
        return np.zeros(0, kind)
    offsets = np.frombuffer(offsets, np.int32)
    return np.frombuffer(data, np.uint8)[offsets[rows.offset] : offsets[rows.offset + len(rows)]].view(kind)


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary row of 8-byte numbers for each stretch between neighbouring edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _counts(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, kind, keys, counts), keys ascending, with the training count of each of the block's words and
    grams, 0 for those of held-out texts only; a key is in the same part whatever the block."""
    raw: dict[tuple[int, int, bool], list[np.ndarray]] = {}
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def tallied() -> int:
        """What lies in `raw` is counted and goes to `held`; how many keys that has."""
        for (block, kind, known), pieces in raw.items():
            keys = np.concatenate(pieces)
            if not len(keys):
                continue
            keys.sort()
            first = runs(keys)
            own = held.setdefault((block, kind), [])
            own.append((keys[first], np.diff(first, append=len(keys)) if known else np.zeros(len(first), np.int64)))
            if len(own) > 1 and sum(len(x[0]) for x in own[1:]) > max(len(own[0][0]), 1 << 18):
                own[:] = [merged(own)]
        raw.clear()
        return sum(len(x[0]) for pieces in held.values() for x in pieces)

    def emitted() -> Iterator[pa.RecordBatch]:
        while held:
            (block, kind), pieces = held.popitem()
            keys, counts = merged(pieces)
            part = keys % PRIME % parts  # as below in SQL
            by = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            keys, counts, part = keys[by], counts[by], part[by]
            edges = np.append(runs(part), len(part))
            for i in range(0, len(edges) - 1, step := max(1, len(edges) * CHUNK // len(keys))):
                own = edges[i : i + step + 1]
                n, a, b = len(own) - 1, own[0], own[-1]
                yield pa.record_batch([pa.array(np.full(n, block)), pa.array(part[own[:-1]].astype(np.int32)), pa.array(np.full(n, kind, np.int8)), packed(keys[a:b], own - a), packed(counts[a:b], own - a)], ["block", "part", "kind", "keys", "counts"])
        trim()

    size = 0
    for batch in batches:
        blocks = batch["block"].to_numpy(zero_copy_only=False)
        if (blocks[1:] != blocks[:-1]).any():  # classes of one split, which lie mixed
            batch = batch.take(pa.array(np.argsort(blocks, kind="stable")))
            blocks = batch["block"].to_numpy(zero_copy_only=False)
        train = ~batch["held_out"].to_numpy(zero_copy_only=False)
        edges = np.append(runs(blocks), len(blocks))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for part in textkit.slices(batch["text"].slice(a, b - a), SLICE):
                learn = train[a + part.first : a + part.first + len(part)]
                made, offsets = grams(part, order)
                for kind, keys, chosen in ((WORD, part.words().view(np.int64), learn[part.doc]), (GRAM, made, np.repeat(learn, np.diff(offsets)))):
                    for known in (True, False):
                        raw.setdefault((int(blocks[a]), kind, known), []).append(keys[chosen == known])
                    size += len(keys)
                if size > FLUSH:
                    size = 0
                    if tallied() > HELD:
                        yield from emitted()
    tallied()
    yield from emitted()


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch | None]]:
    """Sorted rows: the slices of each stretch of equal `by`, then None."""
    group = None
    for batch in batches:
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(max(0, len(batch) - 1), bool)
        for x in columns:
            change |= x[1:] != x[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(batch)]]) if len(batch) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(int(x[a]) for x in columns)
            if now != group and group is not None:
                yield group, None
            group = now
            yield group, batch.slice(a, b - a)
    if group is not None:
        yield group, None


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _counts() come sorted by part and kind. Of each part first the blocks' keys go through, then come rows
    (key, total) with each key's count over all blocks."""
    kinds = {"part": pa.int32(), "kind": pa.int8(), "key": pa.int64(), "total": pa.int64(), "block": pa.int64(), "keys": pa.binary()}

    def row(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([columns.get(c, pa.nulls(n, kinds[c])) for c in kinds], list(kinds))

    pieces = []
    for (part, kind), piece in _groups(batches, "part", "kind"):
        if piece is not None:
            pieces += [(flat(x["keys"], np.int64).copy(), flat(x["counts"], np.int64).copy()) for x in (piece.slice(i, 1) for i in range(len(piece)))]
            yield row(len(piece), part=piece["part"], kind=piece["kind"], block=piece["block"], keys=piece["keys"])
            continue
        keys, total = merged(pieces)
        pieces = []
        for i in range(0, len(keys), CHUNK):
            k, n = keys[i : i + CHUNK], len(keys[i : i + CHUNK])
            yield row(n, part=pa.array(np.full(n, part, np.int32)), kind=pa.array(np.full(n, kind, np.int8)), key=pa.array(k), total=pa.array(total[i : i + CHUNK]))


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, kind and block: a part's (key, value), then its blocks' keys. Gives the blocks' keys that
    have values, and these."""
    found, table = [], None
    for _, piece in _groups(batches, "part", "kind"):
        if piece is None:
            found, table = [], None
            continue
        lone = piece["block"].null_count  # they are first
        if lone:
            found.append((piece["key"].slice(0, lone).to_numpy().copy(), piece["value"].slice(0, lone).to_numpy().copy()))
        if lone == len(piece) or not found:  # words of held-out texts alone have no value
            continue
        if table is None:
            keys, values = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(keys)
            table = keys[order], values[order]
        piece = piece.slice(lone)
        asked = flat(piece["keys"], np.int64)
        at = np.minimum(np.searchsorted(table[0], asked), len(table[0]) - 1)
        hit = table[0][at] == asked
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(piece["keys"]).to_numpy(zero_copy_only=False) // 8)])
        edges = np.concatenate([[0], np.cumsum(hit)])[edges]
        yield pa.record_batch([piece["block"], piece["kind"], packed(asked[hit], edges), packed(table[1][at[hit]], edges)], ["block", "kind", "keys", "values"])


def trie(grams_: DataFrame, scratch: Scratch, order: int = ORDER) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """From training grams (key, n): for each depth the counts (key, n), and for each context its n, d and x, the
    count of its symbols in the context one shorter (what exclusion takes away there)."""
    counts = {order: grams_}
    for k in range(order - 1, -1, -1):
        counts[k] = scratch.cut(counts[k + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")))
    contexts = {}
    for k in range(order, -1, -1):
        rows = counts[k]
        if k:
            rows = rows.withColumn("short", F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1))).join(counts[k - 1].select(F.col("key").alias("short"), F.col("n").alias("m")), "short")
        contexts[k] = scratch.cut(rows.groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("n").alias("n"), F.count("*").alias("d"), (F.sum("m") if k else F.lit(0)).cast("long").alias("x")))
    return counts, contexts


def code_lengths(fresh: DataFrame, counts: dict[int, DataFrame], contexts: dict[int, DataFrame]) -> DataFrame:
    """(key, bits10): minus log10 of the probability of the last symbol of each packed gram, counted or fresh, after its context."""
    order = max(counts)
    long = contexts[order].select("context", F.col("n").alias("cn"), F.col("d").alias("cd"))
    direct = counts[order].withColumn("context", F.shiftright("key", BITS)).join(long, "context").select("key", (F.log10(F.col("cn") + F.col("cd")) - F.log10("n")).alias("bits10"))
    # cost: so far, from escapes; left_d, left_x: what exclusion takes from the next context; done: the symbol was coded
    fresh = fresh.select("key").withColumns({"cost": F.lit(0.0), "left_d": F.lit(0), "left_x": F.lit(0), "done": F.lit(False)})
    for k in range(order, -1, -1):
        if k < order:
            fresh = fresh.withColumn("here", F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))).join(counts[k].select(F.col("key").alias("here"), F.col("n").alias("c")), "here", "left").drop("here")
        else:
            fresh = fresh.withColumn("c", F.lit(None).cast("long"))
        fresh = fresh.withColumn("context", F.shiftright(F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)), BITS)).join(contexts[k].select("context", "n", "d", "x"), "context", "left").drop("context")
        rest_n, rest_d = F.col("n") - F.col("left_x"), F.col("d") - F.col("left_d")
        step = F.when(F.col("done") | F.col("n").isNull() | (rest_d == 0), 0.0).when(F.col("c").isNotNull(), F.log10(rest_n + rest_d) - F.log10("c")).otherwise(F.log10(rest_n + rest_d) - F.log10(rest_d))
        fresh = fresh.select("key", (F.col("cost") + step).alias("cost"), (F.col("done") | F.col("c").isNotNull()).alias("done"), F.coalesce("d", "left_d").alias("left_d"), F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col("x")).alias("left_x"))
        # an unseen context takes nothing away, and so does none below it that is unseen
    last = F.when(F.col("done"), 0.0).otherwise(F.log10(F.lit(float(SYMBOLS)) - F.col("left_d")))
    return direct.unionByName(fresh.select("key", (F.col("cost") + last).alias("bits10")))


def costs(made: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> np.ndarray:
    """The sum of the values of each text's grams, by a table of ascending keys. Grams are sorted, with their texts in the
    bits left, as looking up each distinct one in order takes less than looking up all where they stand."""
    room, out = 63 - BITS * (order + 1), np.zeros(len(offsets) - 1)
    for i in range(0, len(out), 1 << room):
        edges = offsets[i : i + (1 << room) + 1]
        at = made[edges[0] : edges[-1]] << room
        at |= np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        at.sort()
        first = runs(at)
        count, at = np.diff(first, append=len(at)), at[first]
        key, text = at >> room, at & ((1 << room) - 1)
        first = runs(key)
        asked = key[first]
        cost = np.full(len(asked), np.log10(SYMBOLS))
        if len(table[0]):
            found = np.minimum(np.searchsorted(table[0], asked), len(table[0]) - 1)
            hit = table[0][found] == asked
            cost[hit] = table[1][found[hit]]
        out[i : i + len(edges) - 1] = np.bincount(text, np.repeat(cost, np.diff(first, append=len(key))) * count, len(edges) - 1)
    return out


def _scored(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and kind: a block's words, its grams, then its texts."""
    block, parts, words, table = None, {WORD: [], GRAM: []}, None, None
    for (now, kind), piece in _groups(batches, "block", "kind"):
        if piece is None:
            continue
        if now != block:
            block, parts, words, table = now, {WORD: [], GRAM: []}, None, None
            trim()
        if kind != DOC:
            parts[kind].append((flat(piece["keys"], np.int64).copy(), flat(piece["values"], np.float64).copy()))
            continue
        if table is None:
            found = {k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) if v else (np.zeros(0, np.int64), np.zeros(0)) for k, v in parts.items()}
            words = textkit.Lookup(*found[WORD], 0.0)
            by = np.argsort(found[GRAM][0], kind="stable")
            table = found[GRAM][0][by], found[GRAM][1][by]
            parts, found = {WORD: [], GRAM: []}, {}
            trim()
        for part in textkit.slices(piece["text"]):
            made, offsets = grams(part, order)
            logs = words.get(part.words().view(np.int64))
            yield pa.record_batch(
                [piece["doc_id"].slice(part.first, len(part)), pa.array(np.diff(part.word_offsets) + 1), pa.array(textkit.sums((logs > 0).astype(np.int64), part.word_offsets)), pa.array(textkit.sums(logs, part.word_offsets)), pa.array(-costs(made, offsets, table, order))],
                ["doc_id", "n_tokens", "n_known", "logs", "score"],
            )


def ppm_score(docs: DataFrame, order: int = ORDER, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    `score` is log10 of the PPM probability of the lower-cased text and its end, by a model of the rows whose
    crc32(doc_id) mod `modulus` is not `remainder`. `base_score` is the add-one unigram score of words and end.
    """
    spark = docs.sparkSession
    ship(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    loose = min(max(4 * partitions(spark), size // BLOCK + 1), 1 << 20)
    text = F.coalesce("text", F.lit(""))
    filed = F.input_file_name() != ""
    classes = F.when(filed, F.ceil(F.greatest(F.input_file_block_length(), F.lit(1)) / BLOCK)).otherwise(F.lit(loose))
    own = F.pmod(F.xxhash64("doc_id", F.octet_length(text)), classes.cast("long"))
    block = F.xxhash64(F.input_file_name(), F.when(filed, F.input_file_block_start()).otherwise(F.lit(0)), own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), block.alias("block"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    tasks = partitions(spark)
    parts = tasks * min(size // (tasks * BLOCK) + 1, 1 << 10)
    found = rows.select("block", "held_out", "text").mapInArrow(lean(lambda it: _counts(it, order, parts)), "block long, part int, kind byte, keys binary, counts binary")
    scratch = Scratch()
    known = scratch.cut(found.repartitionById(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(lean(_totals), "part int, kind byte, key long, total long, block long, keys binary"))
    # each training text has an end besides its words; the end is one more word of the vocabulary
    words, seen = (known.where(f"block IS NULL AND kind = {kind}").select("part", "key", "total") for kind in (WORD, GRAM))
    total = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count(F.when(F.col("total") > 0, 1)).alias("v")).first()
    ends = rows.where(~F.col("held_out")).select("held_out").count()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    tries = Scratch()
    counts, contexts = trie(tries.cut(seen.where("total > 0").select("key", F.col("total").alias("n"))), tries, order)
    lengths = scratch.cut(code_lengths(seen.where("total = 0"), counts, contexts))
    tries.drop()
    table = words.where("total > 0").select("part", F.lit(WORD).cast("byte").alias("kind"), "key", F.log10(F.col("total") + 1).alias("value")).unionByName(lengths.select((F.col("key") % PRIME % parts).cast("int").alias("part"), F.lit(GRAM).cast("byte").alias("kind"), "key", F.col("bits10").alias("value")))
    asked = table.unionByName(known.where("block IS NOT NULL").select("part", "kind", "block", "keys"), allowMissingColumns=True)
    # a block whose counts were flushed midway has several rows of one key, all with the same value
    model = cut(asked.repartitionById(tasks, "part").sortWithinPartitions("part", "kind", F.col("block").asc_nulls_first()).mapInArrow(lean(_valued), "block long, kind byte, keys binary, values binary"))
    texts = rows.select("block", F.lit(DOC).cast("byte").alias("kind"), "doc_id", "text")
    numbers = cut(model.select("block").distinct().selectExpr("block", "CAST(row_number() OVER (ORDER BY block) - 1 AS INT) AS number"))
    blocks = max(1, numbers.count())
    scratch.drop()
    scored = model.unionByName(texts, allowMissingColumns=True).join(numbers, "block").repartitionById(blocks, "number").sortWithinPartitions("block", "kind").drop("number").mapInArrow(lean(lambda it: _scored(it, order)), "doc_id long, n_tokens long, n_known long, logs double, score double")
    end = float(np.log10(ends + 1))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), "score",
    )

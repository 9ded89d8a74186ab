"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

One inserted, deleted or replaced character touches at most two bigrams of either word, and those that it leaves keep
their order and move by one place at most. If the bigrams of all words are sorted in one global order, rarest first (ties:
by bigram, then by place), the first bigram that two such words share is therefore among the three first of both. So a word
is listed under its three rarest bigrams only, by (bigram, length, place), and asks for words of its own length at the same
place and for words longer by one at the same place or the next. One edit also leaves the first or the last half of the
shorter word as it is, so each half is part of a key of its own: few words meet that are not near, however many share a
bigram. What meets is verified by edit distance inside the join; only true pairs come out. The order is of bigrams, not of (bigram, place): a moved bigram must keep its rank.

The corpus is read once: occurrences are counted with map-side combining, so a word that makes up a third of the corpus is
one row of a task. All later steps work on the vocabulary. The frequencies that reach the driver and the tasks are those of
at most 8,100 bigrams (90 letters, squared). A bigram under which very many words are listed is split by skew handling.

A word's form is its near word of largest count, if that is RATIO times its own; forms are followed by pointer doubling,
as many rounds as the largest count allows (a chain multiplies it by RATIO at each step).

Null texts have no words. A null id is written as nothing in `<doc_id>:<run>`. Repeated rows count as often as they stand
there. Words may be as long as a text. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, cut, ship

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
#: letters from which words are compared in linear time
LONG = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column, slip: int = SLIP) -> Column:
    """The run, without one code point where `slip` divides the hash of doc_id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(slip)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n): lower-cased runs of letters of least_length or more, at least least_count times in all texts.

    slip: with the contract's planted slips; None: the words as they stand.
    """
    # a run that is shorter already can only get shorter
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run") if slip is None else slipped(F.col("doc_id"), F.col("run"), slip)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, the rarest first: at most the square of the number of letters."""
    paired = lambda word: F.regexp_extract_all(word, F.lit(".."), F.lit(0))
    grams = words.select(F.explode(F.concat(paired(F.col("word")), paired(F.substring("word", 2, 1 << 30)))).alias("gram"))
    return {r["gram"]: i for i, r in enumerate(grams.groupBy("gram").agg(F.count("*").alias("f")).orderBy("f", "gram").collect())}


def prefixed(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """words with `first`, the ranks and places of the three rarest bigrams of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("gram", pa.int32()), ("at", pa.int32())]))
        for batch in batches:
            first = [[{"gram": g, "at": i} for g, i in heapq.nsmallest(3, ((ranks[w[i : i + 2]], i) for i in range(len(w) - 1)))] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(first, kind)], ["word", "n", "first"])

    ship(words.sparkSession)
    return words.select("word", "n").mapInArrow(run, "word string, n long, first array<struct<gram:int,at:int>>")


def one_edit(shorter: Column, longer: Column) -> Column:
    """Whether two words whose lengths differ by 0 or 1 are exactly one edit apart, in linear time, for very long ones."""
    apart = F.array_position(F.zip_with(F.split(shorter, ""), F.split(longer, ""), lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    rest = F.substring(longer, apart + 1, F.length(longer))
    return (apart > 0) & (rest == F.substring(shorter, F.when(F.length(shorter) == F.length(longer), apart + 1).otherwise(apart), F.length(shorter)))


def _key(longer: int, at: Column, side: str, half: Column) -> Column:
    return F.xxhash64("gram", F.col("length") + longer, at, F.lit(side), half)


def _met(listed: DataFrame, near: Column) -> DataFrame:
    at, length = F.col("at"), F.col("length")
    cut_at = lambda n: F.floor(n / 2).cast("int")
    first = lambda h: F.substring("word", F.lit(1), h)
    after = lambda h: F.substring("word", h + 1, length)
    h, g = cut_at(length), cut_at(length - 1)
    # an edit leaves one half of the shorter word as it is; where it stands tells by how much a bigram can have moved
    asked = [_key(0, at, "l", first(h)), _key(0, at, "r", after(h)), _key(1, at, "first", first(h)), F.when(at >= h, _key(1, at + 1, "first", first(h))), _key(1, at + 1, "after", after(h)), F.when(at <= h - 2, _key(1, at, "after", after(h)))]
    shelf = [_key(0, at, "l", first(h)), _key(0, at, "r", after(h)), _key(0, at, "first", first(g)), _key(0, at, "after", after(g + 1))]
    rows = listed.select("word", "n", "length", F.inline("first"))
    keyed = lambda keys, *names: rows.select(*(F.col(a).alias(b) for a, b in zip(("word", "n", "length"), names, strict=True)), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    met = keyed(asked, "word", "n", "own").join(keyed(shelf, "other", "other_n", "length"), "key")
    met = met.where((F.col("own") < F.col("length")) | ((F.col("own") == F.col("length")) & (F.col("word") < F.col("other"))))
    return met.where(near).select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, other, other_n): each two words (word, n) exactly one edit apart, once; of at least four letters each."""
    listed = scratch.cut(prefixed(words, bigram_ranks(words)).withColumn("length", F.length("word")))
    usual = _met(listed.where(F.col("length") <= LONG), F.levenshtein("word", "other", 1) == 1)
    long = _met(listed.where(F.col("length") >= LONG), (F.col("length") > LONG) & one_edit(F.col("word"), F.col("other")))
    return usual.union(long).distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of words (word, n), which must be distinct."""
    scratch = Scratch()
    pairs = scratch.cut(near_pairs(words, scratch))
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other", "n")).alias("best"))
    frequent = -F.col("best.less") >= F.lit(ratio) * F.col("best.n")
    near = cut(best.select("word", "n_near", F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")))
    roots = scratch.cut(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most = words.agg(F.max("n")).first()[0] or 1
    hops = max(1, int(math.log(most, ratio)) + 1)
    for _ in range(math.ceil(math.log2(hops))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    found = near.join(roots, "word", "left")
    out = cut(words.select("word", "n").join(found, "word", "left"))
    scratch.drop()
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word of the texts with its near words counted, its form and its root."""
    return variants(cut(vocabulary(docs)))

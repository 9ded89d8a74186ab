"""Embedding near-duplicates with randomised-rotation binary codes (RaBitQ).

A unit vector o is turned by a random orthogonal matrix and stored as the signs x of its coordinates, one bit each, with
the correction factor f = <x/sqrt(d), o>. For another turned vector q, <x/sqrt(d), q> / f is an unbiased estimate of
<o, q>, wrong by more than EPSILON * sqrt((1 - f^2) / f^2) / sqrt(d - 1) with negligible odds. As the other side of a
pair, a vector is stored in levels of LEVEL bits, kept as bit planes, with the length of what they leave out, so an
estimate is a few AND and bit-count operations, and its bound is exact about the levels. One pass makes these codes; they
alone are shuffled. A pair goes on if its upper bound, from either side, reaches the threshold; of those, and no others,
the vectors are fetched and the cosine is computed in double precision. Links rest on that alone.

Pairs are looked for in buckets: `tables` independent groups of sign bits, enough that a pair at the threshold shares a
bucket with probability 1 - MISS; closer pairs are surer still (recall is measured in the tests). The number of bits
follows the rows of the largest label, so a bucket's expected size does not grow. A pair that shares several buckets
counts in the first. A bucket of over CHUNK vectors is dealt into pairs of chunks, each its own unit of work, so no group
must fit one task and none is capped. Equal vectors become one before any pair is formed. Buckets give counts and a
spanning forest of links, never their pairs.

Labels may be of any type that casts to text. Null labels, null or empty vectors, and those that are zero or hold null or
non-finite components link with nothing. Vectors of different lengths never link. Rows repeated in full count, and are
returned, once; different vectors of one id are vectors of their own with its id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, drop_cut, lean, partitions, ship

EPSILON, MISS, CHUNK, ROOM, LEVEL, SLACK = 4.0, 1e-4, 1024, 16, 4, 1e-5


@lru_cache(4)
def rotations(dim: int, bits: int) -> np.ndarray:
    """Random orthogonal matrices side by side, until there are `bits` columns, each with dim columns."""
    rng, made = np.random.default_rng(dim), []
    while not made or len(made) * dim < bits:
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made, 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square is beyond the range
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def layout(dim: int, bits: int, tables: int) -> np.dtype:
    """How a vector's code is stored."""
    words = -(-dim // 64)
    return np.dtype([("code", "<u8", (words,)), ("planes", "<u8", (LEVEL, words)), ("low", "<f4"), ("step", "<f4"), ("factor", "<f4"), ("rest", "<f4"), ("signs", "u1", (-(-bits * tables // 8),))])


def _packed(flags: np.ndarray) -> np.ndarray:
    wide = np.zeros((*flags.shape[:-1], -(-flags.shape[-1] // 64) * 64), bool)
    wide[..., : flags.shape[-1]] = flags
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Codes of vectors of one length."""
    n, dim = vectors.shape
    made = rotations(dim, bits * tables)
    out = np.zeros(n, layout(dim, bits, tables))
    u = unit(vectors)
    turned = u @ made[:, :dim]
    out["code"] = _packed(turned > 0)
    out["factor"] = np.abs(turned).sum(1) / np.sqrt(dim)
    top = np.abs(turned).max(1)
    out["low"], out["step"] = -top, 2 * top / ((1 << LEVEL) - 1)
    low, step = (out[c].astype(np.float64)[:, None] for c in ("low", "step"))
    level = np.clip(np.rint((turned - low) / step), 0, (1 << LEVEL) - 1).astype(np.int64)
    out["rest"] = np.sqrt(((turned - (low + step * level)) ** 2).sum(1))
    out["planes"] = np.stack([_packed((level >> b) & 1 > 0) for b in range(LEVEL)], 1)
    out["signs"] = np.packbits(u @ made[:, : bits * tables] > 0, axis=1, bitorder="little")
    return out


def keys(made: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket keys by table."""
    signs = np.unpackbits(made["signs"], axis=1, count=bits * tables, bitorder="little")
    return (signs.reshape(len(made), tables, bits).astype(np.int32) << np.arange(bits, dtype=np.int32)).sum(2, dtype=np.int32)


def bounds(a: np.ndarray, b: np.ndarray, dim: int, pairs: bool = False) -> np.ndarray:
    """Upper bounds of the cosines of all of a, by their signs, with all of b, by their levels; `pairs`: of a[i] with b[i]."""
    left, right = (lambda x: x, lambda x: x) if pairs else (lambda x: x[:, None], lambda x: x[None])
    inner = np.int32(0)
    for p in range(LEVEL):
        for w in range(a["code"].shape[1]):
            inner = inner + (np.bitwise_count(left(a["code"][:, w]) & right(b["planes"][:, p, w])).astype(np.int32) << np.int32(p + 1))
    total = sum(np.bitwise_count(b["planes"][:, p]).astype(np.int32).sum(1, dtype=np.int32) << np.int32(p) for p in range(LEVEL))
    positive = 2 * np.bitwise_count(a["code"]).astype(np.int64).sum(1) - dim
    factor = np.maximum(a["factor"].astype(np.float64), 1e-9)
    error = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / np.sqrt(max(1, dim - 1)) + SLACK
    step, low, rest = (b[c].astype(np.float64) for c in ("step", "low", "rest"))
    scale = 1 / (np.sqrt(dim) * factor)
    # (low * positive + step * (inner - total)) * scale + error + rest / factor, with what is of one side alone made once
    return (inner * right(step) + right(-step * total) + left(positive) * right(low)) * left(scale) + left(error) + right(rest) / left(factor)


def near(made: np.ndarray, side: np.ndarray, table: int, low: float, dim: int, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of one unit of work whose bounds reach `low` and that share no earlier table's bucket.

    Between two chunks (sides 0 and 1) only pairs across are compared.
    """
    across = side.any()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if across else left
    known, found = keys(made, bits, tables)[:, :table], []
    for s in range(0, len(left), 256):
        i = left[s : s + 256]
        hit = bounds(made[i], made[right], dim) >= low
        if not across:
            hit &= right[None, :] > i[:, None]
        x, y = np.nonzero(hit)
        x, y = i[x], right[y]
        for c in range(0, len(x), 50_000):
            p, q = x[c : c + 50_000], y[c : c + 50_000]
            new = ~(known[p] == known[q]).any(1)
            p, q = p[new], q[new]
            sure = bounds(made[q], made[p], dim, True) >= low  # from the other side
            found.append((p[sure], q[sure]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each row's component."""
    root = ids.copy()
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        if (root == before).all():
            return root


def _vectors(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the rows of that length, and their vectors."""
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, flat[start[rows][:, None] + np.arange(dim)]


def _coded(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    names = ["vec_id", "label", "c1", "c2"]
    for b in batches:
        for dim, rows, vectors in _vectors(b["embedding"]):
            made = codes(vectors, bits, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(keys(made, bits, tables).ravel()))
            yield pa.record_batch([*(b[c].take(pa.array(rows)) for c in names), pa.array(np.full(len(rows), dim, np.int32)), pa.array([x.tobytes() for x in made], pa.binary()), lists], [*names, "dim", "code", "keys"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by unit; the rows of each."""
    held, now = [], None
    for b in batches:
        ids = b["unit"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if held and ids[x] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = ids[x]
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(t: pa.Table, low: float, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    dim = t["dim"][0].as_py()
    made = np.frombuffer(b"".join(t["code"].to_pylist()), layout(dim, bits, tables))
    return near(made, t["side"].to_numpy(), t["table"][0].as_py(), low, dim, bits, tables)


def _near(batches: Iterator[pa.RecordBatch], low: float, bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Of each unit the rows that have a pair to compute."""
    names = ["unit", "table", "side", "c1", "c2"]
    for t in _grouped(batches):
        if len(t) > 1:
            some = pa.array(np.unique(np.concatenate(_candidates(t, low, bits, tables))))
            yield from t.select(names).take(some).to_batches()


def _exact(batches: Iterator[pa.RecordBatch], low: float, bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches):
        i, j = _candidates(t, low, bits, tables)
        (_, _, vectors), *_ = _vectors(t["embedding"].combine_chunks())
        u, label = unit(vectors), np.unique(t["label"].to_numpy(), return_inverse=True)[1]
        hit = np.zeros(len(i), bool)
        for s in range(0, len(i), 50_000):
            x, y = i[s : s + 50_000], j[s : s + 50_000]
            hit[s : s + 50_000] = (np.einsum("ij,ij->i", u[x], u[y]) >= low) & (label[x] == label[y])
        i, j, ids, copies = i[hit], j[hit], t["rep"].to_numpy(), t["copies"].to_numpy()
        if len(i):
            links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            some = np.flatnonzero(links)
            of = [t[c].take(pa.array(some)).combine_chunks() for c in ("c1", "c2", "rep")]
            yield pa.record_batch([*of, pa.array(links[some].astype(np.int64)), pa.array(roots(len(ids), i, j, ids)[some])], ["c1", "c2", "rep", "links", "root"])


def near_vectors(vectors: DataFrame, low: float = 0.98, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    floats = vectors.schema["embedding"].dataType.elementType.simpleString() in ("float", "double")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), (F.col("embedding") if floats else F.col("embedding").cast("array<double>")).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    base = base.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64(F.lit(1), "label", "embedding").alias("c1"), F.xxhash64(F.lit(2), "label", "embedding").alias("c2"))
    most = vectors.where("label IS NOT NULL").groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    bits = int(np.clip(np.ceil(np.log2(max(1, most / ROOM))), 4, 24))
    agree = 1 - np.arccos(low) / np.pi
    tables = max(1, int(np.ceil(np.log(miss) / np.log(1 - agree**bits))))
    ids = base.groupBy("vec_id", "usable", "c1", "c2").agg(F.lit(1).alias("one"))
    coded = base.where("usable").drop("usable").mapInArrow(lean(lambda it: _coded(it, bits, tables)), "vec_id long, label string, c1 long, c2 long, dim int, code binary, keys array<int>")
    # of equal vectors all but the id is equal
    by_id = coded.groupBy("c1", "c2", "vec_id").agg(F.first(F.struct("label", "dim", "code", "keys")).alias("x"))
    classes = cut(by_id.groupBy("c1", "c2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")).select("c1", "c2", "rep", "copies", "x.*"))
    rows = classes.select("c1", "c2", "label", "dim", "code", F.posexplode("keys").alias("table", "key")).withColumn("bucket", F.xxhash64("label", "dim", "table", "key"))
    large = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    dealt = rows.join(large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("c1", "table"), F.col("chunks")).cast("int"))
    # each pair of chunks x <= y is a unit; a vector goes to all units of its chunk
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    place = [F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "table", (F.col("own") > F.col("other")).cast("int").alias("side")]
    units = dealt.select(*place, "c1", "c2", "dim", "code").repartition(4 * partitions(spark), "unit").sortWithinPartitions("unit")
    close = cut(units.mapInArrow(lean(lambda it: _near(it, low, bits, tables)), "unit long, table int, side int, c1 long, c2 long"))
    # only now the vectors themselves, of rows that have a pair to compute
    wanted = close.select("c1", "c2").distinct().join(classes.select("c1", "c2", F.col("rep").alias("vec_id")), ["c1", "c2"])
    held = cut(base.where("usable").select("vec_id", "c1", "c2", "embedding").join(wanted, ["vec_id", "c1", "c2"]).groupBy("c1", "c2").agg(F.first("embedding").alias("embedding")))
    work = close.join(classes.drop("keys"), ["c1", "c2"]).join(held, ["c1", "c2"]).repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    found = cut(work.mapInArrow(lean(lambda it: _exact(it, low, bits, tables)), "c1 long, c2 long, rep long, links long, root long"))
    drop_cut(close)
    drop_cut(held)
    links = found.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("c1", "c2", "rep", "copies").join(links, ["c1", "c2"], "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("c1", "c2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("usable"))
    out = ids.join(known, ["usable", "c1", "c2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))

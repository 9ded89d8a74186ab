"""SentencePiece encoding and decoding as weighted finite-state transduction.

The model file is compiled once per worker. The normaliser is a transducer that rewrites the longest rule at each place
(the model's own character map, decoded from its double array, or given rules), squeezes spaces, adds the dummy prefix
and turns spaces into U+2581. The pieces are a trie of states whose final states give a piece; where no piece begins, the
byte fallback's arcs spell a character's bytes. Composed with a text they give a lattice of positions, relaxed from left
to right in the tropical semiring (weights add along a path, the least path wins), and the encoding is the shortest path.

For a unigram model an arc weighs minus its piece's score. For a BPE model the lattice is composed with a second acceptor
over pairs of neighbouring pieces, which weighs 0 where the pair is what merging gives for the two pieces' joint text and
infinitely much otherwise; the relaxation is the same. As merges are local and ordered by (score, position) alone, a segmentation is the BPE result
exactly if each of its neighbouring pairs is, so one path has finite weight, and it equals the merge procedure's
result. Pairs are decided once each, by undoing the two pieces' merges from the last, and kept.

Texts fall apart where no piece crosses (before a run of U+2581 or of closing marks, and around characters that no longer piece holds), so
segments are encoded one by one and kept in a table of bounded size (two generations of CACHE / 2 segments).

Decoding concatenates the pieces' bytes, turns U+2581 into a space and drops the dummy prefix. Round trips are exact
for texts that the normaliser leaves alone and that hold no U+2581 of their own. Null and empty texts have no pieces.
Control pieces are never made from text. Repeated rows are encoded row by row, other columns ignored or carried.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import lean, ship

CACHE, PAIRS = 700_000, 400_000
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def char_map(data: bytes) -> dict[str, str]:
    """The rewrite rules of a model's precompiled character map: a double array of keys, then their replacements."""
    size = struct.unpack("<I", data[:4])[0]
    array_, blob = struct.unpack(f"<{size // 4}I", data[4 : 4 + size]), data[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    rules, states = {}, [(offset(array_[0]), b"")]
    while states:
        at, key = states.pop()
        for byte in range(1, 256):
            to = at ^ byte
            if to >= len(array_) or array_[to] & (1 << 31 | 0xFF) != byte:
                continue
            unit, below = array_[to], to ^ offset(array_[to])
            if unit >> 8 & 1:  # a key ends here; its value is the leaf below
                value = array_[below] & (1 << 31) - 1
                rules[(key + bytes([byte])).decode(errors="surrogateescape")] = blob[value : blob.index(b"\0", value)].decode()
            states.append((below, key + bytes([byte])))
    return {k: v for k, v in rules.items() if not any("\udc80" <= c <= "\udcff" for c in k)}


class Machine:
    """The compiled transducer of one model."""

    def __init__(self, model: bytes, rules: dict[str, str] | None = None):
        self.kind, pieces, spec = UNIGRAM, [], {}
        for number, value in fields(model):
            if number == 1:
                found = dict(fields(value))
                pieces.append((found[1].decode(), struct.unpack("<f", found.get(2, bytes(4)))[0], found.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec |= dict(fields(value))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if rules is None and spec.get(2):
            rules = char_map(spec[2])
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have weights")
        self.text = [p for p, _, _ in pieces]
        self.arcs = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.byte = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        self.longest = max(map(len, self.arcs))
        self.penalty = 10 - min((self.score[i] for i in self.arcs.values()), default=0)
        self.rules = dict(rules or {})
        self.lengths: dict[str, list[int]] = {}  # of the rules that begin with a character, the longest first
        for rule in sorted(self.rules, key=len, reverse=True):
            found = self.lengths.setdefault(rule[0], [])
            if len(rule) not in found:
                found.append(len(rule))
        self.ruled = re.compile("[" + "".join(map(re.escape, sorted(self.lengths))) + "]") if self.rules else None
        # the pieces' trie: (state, character) to state, numbers of 21 bits for the character; and what final states give
        self.next: dict[int, int] = {}
        self.final: dict[int, tuple[str, float]] = {}
        for p, i in self.arcs.items():
            state = 0
            for c in p:
                state = self.next.setdefault(state << 21 | ord(c), len(self.next) + 1)
            self.final[state] = p, -self.score[i]
        # where segments may fall apart: around `hard` characters, before U+2581, and between a letter and `late` ones
        inner = {c for p in self.arcs if len(p) > 1 for c in p}
        hard = {chr(c) for c in range(128) if chr(c) not in inner}
        inside = {(a, b) for p in self.arcs for a, b in zip(p, p[1:], strict=False)}
        late = {c for c in map(chr, range(33, 127)) if not c.isalnum()} - hard
        late -= {b for a, b in inside if a.isalpha()}
        odd = {a for a, b in inside if b in late and a.isalnum()}
        h, t, o = (re.escape("".join(sorted(x))) for x in (hard, late, odd))
        whole = any(a != SPACE and b == SPACE for a, b in inside) or not hard or not late
        letter, other = rf"[^\W_{o}]", rf"(?:(?![{SPACE}{h}])[\W_{o}])"
        self.split = re.compile("(?s).+" if whole else rf"[{h}]|(?!\Z){SPACE}*+{other}*+{letter}*+(?=[{t}{SPACE}{h}]|\Z)|{SPACE}*[^{SPACE}{h}]+|{SPACE}+")
        self.made: dict[str, tuple[str, str] | None] = {}
        self.tied = len(set(self.score[i] for i in self.arcs.values())) < len(self.arcs)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.good = {p for p in self.arcs if len(p) == 1 or self.halves(p)} if self.kind == BPE else set()
        raw = [bytes([int(p[1:-1], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.raw, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.start = np.cumsum(self.size) - self.size

    def normal(self, text: str) -> str:
        if self.ruled and self.ruled.search(text):
            text = self.rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def rewritten(self, text: str) -> str:
        """The longest rule at each place, from the left."""
        out, at = [], 0
        while found := self.ruled.search(text, at):
            i = found.start()
            out.append(text[at:i])
            for n in self.lengths[text[i]]:
                if text[i : i + n] in self.rules:
                    out.append(self.rules[text[i : i + n]])
                    at = i + n
                    break
            else:
                out.append(text[i])
                at = i + 1
        return "".join([*out, text[at:]])

    def merged(self, symbols: list[str], stop: int = 1) -> list[str]:
        """Merging by the best score, the leftmost first, until nothing merges or `stop` symbols are left."""
        arcs, score = self.arcs, self.score
        while len(symbols) > stop:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = arcs.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def halves(self, a: str) -> tuple[str, str] | None:
        """What the last merge that makes a piece joins; None for a character, or a piece that merging never makes."""
        if a not in self.made:
            found = self.merged(list(a), 2)
            self.made[a] = (found[0], found[1]) if len(found) == 2 and a in self.arcs and self.merged(list(a)) == [a] else None
        return self.made[a]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: their merges are undone from the last, and before each one's turn no
        merge across the border may come first."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(list(a + b)) == [a, b] if self.tied and SPACE * 2 in a + b else self.bordered(a, b)
        return known

    def bordered(self, a: str, b: str) -> bool:
        arcs, score, halves = self.arcs, self.score, self.halves
        limit, first = None, True  # merges across count if their score is above limit, or equal to it if not `first`
        while True:
            i = arcs.get(a + b)
            if i is not None and (limit is None or score[i] > limit or (score[i] == limit and not first)):
                return False
            x, y = halves(a), halves(b)
            if x is None and y is None:
                return True
            # the later merge is undone: of equal scores the right one, as the left merges first
            if y is None or (x is not None and score[arcs[a]] < score[arcs[b]]):
                limit, first, a = score[arcs[a]], True, x[1]
            else:
                limit, first, b = score[arcs[b]], False, y[0]

    def path(self, s: str) -> list[str]:
        """The shortest path through the lattice of a segment, as pieces and characters without a piece."""
        n, next_, final, good, pairs, merging = len(s), self.next, self.final, self.good, self.pairs, self.kind == BPE
        cost, back = [0.0] + [INFINITE] * n, [""] * (n + 1)
        for i in range(n):
            # all arcs into i are relaxed, so back[i] ends the least path to it
            if cost[i] == INFINITE:
                continue
            state, j, last = 0, i, back[i]
            while j < n:
                state = next_.get(state << 21 | ord(s[j]), 0)
                j += 1
                found = final.get(state) if state else None
                if found is None:
                    if j > i + 1:
                        if state:
                            continue
                        break
                    found = s[i], self.penalty  # no piece: the character by itself, as bytes or unknown
                p, weight = found
                if merging:  # the acceptor of pairs
                    if j > i + 1 and p not in good:
                        continue
                    fits = pairs.get((last, p)) if i else True
                    weight = 0.0 if (fits if fits is not None else self.compatible(last, p)) else INFINITE
                if cost[i] + weight < cost[j]:
                    cost[j], back[j] = cost[i] + weight, p
                if not state:
                    break
        out, j = [], n
        while j:
            out.append(back[j])
            j -= len(back[j])
        return out[::-1]

    def ids(self, segment: str) -> bytes:
        out = []
        for p in self.path(segment):
            i = self.arcs.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        young, old, out = self.young, self.old, []
        for s in self.split.findall(self.normal(text)):
            found = young.get(s)
            if found is None:
                found = old.get(s)
                if found is None:
                    found = self.ids(s)
                if len(s) < 64:
                    if len(young) >= CACHE // 2:
                        self.old, self.young = young, {}
                        young, old = self.young, self.old
                    young[s] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and their offsets, from ids and the offsets of each text's ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        raw = self.raw[at]
        edges = np.concatenate([[0], ends])[offsets]
        if self.dummy:
            lead = edges[:-1][(edges[1:] > edges[:-1])]
            lead = lead[raw[lead] == 0x20]
            keep = np.ones(len(raw), bool)
            keep[lead] = False
            raw = raw[keep]
            edges = edges - np.searchsorted(lead, edges, "left")
        return raw, edges


_machines: dict[int, Machine] = {}


def machine(model: bytes) -> Machine:
    """The compiled model; one per worker and model."""
    key = zlib.crc32(model)
    if key not in _machines:
        _machines[key] = Machine(model)
    return _machines[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model_path: str | None = None, decoded: bool = True) -> DataFrame:
    """docs (doc_id, text and others) with n_tokens, ids, round_trip and, if asked, decoded, the text made from the ids again.

    round_trip: the decoded text equals the text (null as empty). The driver reads the model file and sends its bytes,
    so executors need no file. Columns of docs of these names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path or default_model(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    made = {"n_tokens": "long", "ids": "array<int>", "round_trip": "boolean", **({"decoded": "string"} if decoded else {})}
    kept = docs.drop(*made, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(shared.value)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            found = [m.encode(t) for t in texts]
            ids = np.frombuffer(b"".join(found), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int64)
            del found
            raw, edges = m.decode(ids, offsets)
            raw, edges = raw.tobytes(), edges.tolist()
            again = [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
            same = pa.array([x == t.encode() for x, t in zip(again, texts, strict=True)])
            more = [pa.array([x.decode(errors="replace") for x in again], pa.string())] if decoded else []
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.record_batch([*b.columns, pa.array(np.diff(offsets)), lists, same, *more], [*b.schema.names, *made])
        m.old = {}  # a worker without a task keeps the newer half

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{k} {v}" for k, v in made.items()])
    return kept.mapInArrow(lean(run), schema)


def report(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    keep = encoded(docs.select("doc_id", "text"), model_path, decoded=False)
    return keep.select("doc_id", "n_tokens", "ids", "round_trip")

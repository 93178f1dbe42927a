"""SimHash near-duplicates, joined by Golay-code fuzzy hashes.

A fingerprint has a bit set where more than half of the document's shingle hashes have it. Equal fingerprints are one
class, counted once. Two fingerprints with at most three differing bits, cut into segments of 22, 21 and 21 bits, have two
segments with at most one error each (else two segments had two errors or more, four in all). A segment, padded to 23 bits,
is decoded by the perfect binary Golay code: a vector within one bit of another decodes to one of the codewords that the
other one's neighbours decode to, five on average. So for each two segments a fingerprint gives, in a left role, (its
codeword, its neighbours' codewords) and, in a right role, the reverse; of linked fingerprints one's left key is the
other's right key. Keys are joined by sorting, candidates verified on all 64 bits, and links reduced to a forest in
each task. A key with over ``limit`` rows is not compared pair by pair: its rows are filed again, each under the key with
one of four quarters of the fingerprint (three errors leave one quarter equal), four rows for one and groups some
hundreds of times smaller. Only what is over the limit even then, fingerprints that crowd together, is filed under 13 equal
nibbles of 16 (three errors spoil three at most), where no key can have over 4,096 fingerprints.

Components come from large-star and small-star rounds, each written to the shared folder.

Null, empty: fingerprint zero, linked like any other. Fewer than three words: the whole sequence is the shingle. Repeated
rows and ids are kept, one result row each. Null ids get a component like others if a linked row has an id, else null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

SEED, SHINGLE, BITS, LIMIT = 42, 3, 3, 4096
_U = np.uint64
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _remainder(v: int) -> int:
    for k in range(22, 10, -1):
        if v >> k & 1:
            v ^= GENERATOR << (k - 11)
    return v


_REM = np.array([_remainder(m << 11) for m in range(4096)], np.int64)
_ERROR = np.zeros(2048, np.int64)
for _w in range(4):
    for _bits in combinations(range(23), _w):
        _e = sum(1 << b for b in _bits)
        _ERROR[_remainder(_e)] = _e


def codeword(v: np.ndarray) -> np.ndarray:
    """The index, 0 to 4095, of the codeword within three bits of a 23-bit vector: there is just one."""
    return (v ^ _ERROR[(v & 2047) ^ _REM[v >> 11]]) >> 11


_LANES = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], _U)


def fingerprint(row: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (row or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[: -shingle] + 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], np.arange(0, len(h), 255), axis=0)
    counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprint_kernel(shingle: int, seed: int):
    def kernel(batches):
        for batch in batches:
            fps = np.array([fingerprint(r, shingle, seed) for r in base.byte_rows(batch, "text")], _U)
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(fps.view(np.int64)))

    return kernel


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return base.mapped(base.columns_only(docs, {"doc_id": "long", "text": "string"}), _fingerprint_kernel(shingle, seed), "doc_id long, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, key, role): for each fingerprint its keys in either role, 1 left and 2 right."""
    own, near, fresh = [], [], []
    for at, width in SEGMENTS:
        v = ((fps >> _U(at)) & _U((1 << width) - 1)).astype(np.int64)
        own.append(codeword(v))
        ball = np.sort(codeword(np.stack([v, *(v ^ (1 << k) for k in range(width))], axis=1)), axis=1)
        near.append(ball)
        fresh.append(np.concatenate([np.ones((len(v), 1), bool), ball[:, 1:] != ball[:, :-1]], axis=1))
    of, key, role = [], [], []
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        for left, (one, many) in ((True, (a, b)), (False, (b, a))):
            i, j = np.nonzero(fresh[many])
            x, y = own[one][i], near[many][i, j]
            of.append(i)
            key.append(pair << 24 | (x << 12 | y if left else y << 12 | x))
            role.append(np.full(len(i), 1 if left else 2, np.int8))
    return np.concatenate(of), np.concatenate(key), np.concatenate(role)


def nibble_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for keys with many rows: all but three of the 16 nibbles, in both roles."""
    of, key = [], []
    for number, gone in enumerate(combinations(range(16), 3)):
        mask = (1 << 64) - 1 - sum(15 << 4 * g for g in gone)
        key.append(base.mix(base.mix(fps & _U(mask)) + _U(number + 1)).view(np.int64))
        of.append(np.arange(len(fps)))
    return np.concatenate(of), np.concatenate(key), np.full(560 * len(fps), 3, np.int8)


def _quarter_kernel(batches):
    """Rows of a large key again, under the key and a quarter."""
    for batch in batches:
        key, fp, role = (batch.column(c).to_numpy() for c in ("key", "fp", "role"))
        for k in range(4):
            quarter = (fp.view(_U) >> _U(16 * k)) & _U(0xFFFF)
            again = base.mix(base.mix(key.view(_U) + _U(k << 60)) + quarter)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (again.view(np.int64), fp, role)], ["key", "fp", "role"])


def _key_kernel(keys, rows: int = 4096):
    def kernel(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), rows):
                of, key, role = keys(fp[at : at + rows].view(_U))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, fp[at:][of], role)], ["key", "fp", "role"])

    return kernel


class _Forest:
    """Union-find over what one task has seen; says which links are news. Forgetting costs no more than some links twice."""

    def __init__(self, most: int = 1 << 19):
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def news(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        if len(self.up) > self.most:
            self.up.clear()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out.append((min(x, y), max(x, y)))
        return out


def _link_kernel(bits: int, limit: int | None):
    """Rows come sorted by key. Gives (0, a, b) for links that join what this task has not yet joined, (role, key, fp) for rows of too large keys."""
    cols = ["key", "fp", "role"]

    def kernel(batches):
        forest = _Forest()
        held, hot = [np.zeros(0, t) for t in (np.int64, np.int64, np.int8)], None

        def out(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(kind), len(a)).astype(np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["kind", "a", "b"])

        def links(key, fp, role):
            bit = fp.view(_U)
            i, lag = np.arange(len(key)), 1
            while True:
                i = i[i + lag < len(key)]
                i = i[key[i] == key[i + lag]]
                if not len(i):
                    return
                j = i + lag
                ok = ((role[i] | role[j]) == 3) & (fp[i] != fp[j])
                ok[ok] = np.bitwise_count(bit[i[ok]] ^ bit[j[ok]]) <= bits
                if ok.any() and (news := forest.news(fp[i[ok]], fp[j[ok]])):
                    yield out(0, *zip(*news, strict=True))
                lag += 1

        for batch in batches:
            now = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, cols, strict=True)]
            if not len(now[0]):
                continue
            edge = np.append(np.flatnonzero(now[0][1:] != now[0][:-1]) + 1, len(now[0]))
            start = np.append(0, edge[:-1])
            size = edge - start
            over = (size > limit) if limit else np.zeros(len(size), bool)
            over |= now[0][start] == hot if hot is not None else False
            if over.any():
                rows = np.repeat(over, size)
                yield out(now[2][rows], now[0][rows], now[1][rows])
                hot = now[0][-1] if over[-1] else None
            done = np.repeat(~over, size)
            last = start[-1]
            done[last:] = False
            yield from links(*(v[done] for v in now))
            held = [v[last:][:0] if over[-1] else v[last:] for v in now]
        yield from links(*held)

    return kernel


def _compared(keyed: DataFrame, bits: int, limit: int | None) -> DataFrame:
    return base.mapped(keyed.repartition("key").sortWithinPartitions("key"), _link_kernel(bits, limit), "kind int, a long, b long")


def links(classes: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """(a, b): a spanning set of the links between the fingerprints ``fp`` of distinct classes, a < b."""
    if bits > 3:
        raise ValueError("the segments allow for three differing bits")
    keyed = "key long, fp long, role byte"
    found = base.written(_compared(base.mapped(classes.select("fp"), _key_kernel(golay_keys), keyed), bits, limit), "links")
    large = found.where("kind > 0").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("kind").cast("byte").alias("role"))
    again = base.written(_compared(base.mapped(large, _quarter_kernel, keyed), bits, limit), "links")
    crowd = again.where("kind > 0").select(F.col("b").alias("fp")).distinct()
    last = _compared(base.mapped(crowd, _key_kernel(nibble_keys, 64), keyed), bits, None)
    return found.unionByName(again).unionByName(last).where("kind = 0").select("a", "b")


def _forest_kernel(batches):
    """Of a task's links those that join what its others haven't joined."""
    forest = _Forest()
    for batch in batches:
        if news := forest.news(batch.column("u").to_numpy(), batch.column("v").to_numpy()):
            a, b = zip(*news, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64())], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge the smallest node it reaches, by alternating stars."""

    def sign(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def kept(df, links):
        # a round makes at most twice as many links as there were; few links need few tasks
        return base.written(df.coalesce(max(1, links // 20_000)) if links < 2_000_000 else df, "edges")

    first = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    now = base.written(base.mapped(first, _forest_kernel, "u long, v long").distinct(), "edges")
    was = sign(now)
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = kept(large, was[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = kept(small, was[0])
        base.dropped(edges.sparkSession, large)
        base.dropped(edges.sparkSession, now)
        now, before, was = new, was, sign(new)
        if was == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _roots(prints: DataFrame, bits: int, limit: int) -> DataFrame:
    """(fp, rep, root): each class with the smallest id in it and the component it is in."""
    classes = base.written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    known = components(links(classes, bits, limit))
    return base.written(classes.join(known, classes.fp == known.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = base.written(fingerprints(docs, shingle, seed), "fingerprints")
    roots = _roots(prints, bits, limit)
    least = base.written(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    label = base.written(roots.join(least, "root").select("fp", "component_id"), "labels")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """One document of each ``root`` of ``marks`` (doc_id, h, root): that of the smallest id, of the smallest text among
    several; where none has an id, the one of the smallest text."""
    marks = base.written(marks, "marks")
    least = marks.groupBy("root").agg(F.min("doc_id").alias("least"))
    heads = marks.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("least")))
    spare = [c for c in (f"{name}_{k}" for k in range(len(docs.columns) + 1) for name in ("id", "hash", "root", "rank")) if c not in docs.columns]
    at, by, root, rank = (next(c for c in spare if c.startswith(name)) for name in ("id", "hash", "root", "rank"))
    heads = heads.select(F.col("doc_id").alias(at), F.col("h").alias(by), F.col("root").alias(root)).distinct()
    found = docs.join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.xxhash64(F.col("text").cast("string")) == F.col(by)))
    first = F.row_number().over(Window.partitionBy(root).orderBy("text"))
    return found.withColumn(rank, first).where(F.col(rank) == 1).select([F.col(f"`{c}`") for c in docs.columns])


def representatives(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Of each component one document, all its columns."""
    rows = base.columns_only(docs, {"doc_id": "long", "text": "string"}).withColumn("h", F.xxhash64("text"))
    prints = base.written(base.mapped(rows, _fingerprint_kernel(shingle, seed), "doc_id long, h long, fp long"), "fingerprints")
    return survivors(docs, prints.join(_roots(prints, bits, limit), "fp").select("doc_id", "h", "root"))

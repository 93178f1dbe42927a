"""Near-duplicates by the similarity of their texts: sets of five-word shingles with a Jaccard similarity of at least 0.8.

Texts with the same set are one class. Candidates come from two sides, and all are verified on whole sets of 64-bit hashes:

1. the Golay keys of ``simhash``: each class has a SimHash fingerprint of its shingles, and classes whose fingerprints are equal or
   linked are candidates. Three bits are much less than a similarity of 0.8 leaves equal (ten bits differ on average), so
   the keys find close copies only, and no number of keys would find all pairs;
2. so what they miss is completed exactly, by prefix filtering. The shingles of a set are put in one order for all, those of a
   sample's most frequent last; two sets as similar as wanted share one of their first n - ceil(0.8 n) + 1, and the sizes
   and the places of the first that they share bound what they can have in common. Rows of these first shingles meet by sorting.

Classes of a shingle are first compared with their neighbour in size and with the smallest only, which joins, together with the
Golay links, large groups of near copies by a few links a member; what is not in one component then is compared pair by pair, in the
task that has the shingle: a bitmap of each set bounds what two have in common, and of the pairs that this leaves between two
components a task gives out a few only, since one that holds joins them. Maps that grow with the sets rule out most of these before
whole sets are moved. Where more were left and none held, the next round gives out eight times as many, until nothing is left.

Words are lower-cased (ASCII). Fewer than five words: the whole sequence is the shingle. Null, empty: one class of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .simhash import components, links, survivors

SHINGLE, SIMILARITY = 5, 0.8
#: The sample that tells frequent shingles, and how many there are at most: they decide about the order, not about the result.
SAMPLE, FREQUENT = 8000, 1 << 16
#: Bits of the map of texts to be compared.
SLOTS = 1 << 24
#: Bits of the map of a set that its rows carry, and the least and most of the map that grows with it.
BITS, LEAST_BITS, MOST_BITS = 2048, 256, 1 << 16
#: Places for pairs that a task has given out, and for pairs of components.
SEEN = 1 << 20
#: Pairs that a task gives out between two components in the first round, and how many times as many in the next.
GIVEN, MORE = 1, 8
_U = np.uint64
_EPS = 1e-9


def _sets(rows: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the distinct shingles of each row, sorted by row and hash."""
    buf, s, e, first = base.word_spans([(r or b"").lower() for r in rows])
    words = base.Sequence(base.word_hashes(buf, s, e))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    at = base.ranges(first[:-1], count)
    row = np.repeat(np.arange(len(rows)), count)
    grams = words.span(at, np.minimum(at + shingle, first[row + 1])) if len(at) else np.zeros(0, _U)
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.append(True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1]))[: len(row)]
    return row[new], grams[new]


_LANES = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], _U)


def fingerprints(grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHash of each row's set: a bit is set where more than half of the hashes have it; zero for an empty set."""
    fp = np.zeros(len(size), _U)
    some = np.flatnonzero(size)
    if not len(some):
        return fp
    size = size[some]
    begin = np.cumsum(size) - size
    blocks = -(-size // 255)  # a lane of eight bits counts to 255
    cut = np.repeat(begin, blocks) + 255 * base.ranges(np.zeros(len(blocks), np.int64), blocks)
    lanes = np.add.reduceat(_LANES[grams.astype("<u8").view(np.uint8).reshape(-1, 8)], cut, axis=0).astype("<u8").view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(lanes.astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    fp[some] = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return fp


def bitmaps(row: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
    """Of each row's set a map with a bit for every hash, as 64-bit words."""
    bits = np.zeros((rows, BITS), bool)
    bits[row, (grams & _U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def wide_maps(grams: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Of each row's set a map of four bits for a hash, a power of two within the bounds."""
    out, at = [], 0
    for n in size.tolist():
        bits = np.zeros(min(MOST_BITS, max(LEAST_BITS, 1 << (4 * n - 1).bit_length())) if n else LEAST_BITS, bool)
        bits[(grams[at : at + n] & _U(len(bits) - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
        at += n
    return out


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """A map in fewer words: what a smaller map of the same set would be."""
    return np.bitwise_or.reduce(x.reshape(-1, words), axis=0)


def may_be_similar(x: bytes, y: bytes, n: int, m: int, similarity: float) -> bool:
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    words = min(len(x), len(y))
    x, y = _folded(x, words), _folded(y, words)
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return most * (1 + similarity) >= similarity * (n + m) * (1 - _EPS)


def most_common(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes two sets can share at most: what one map has beyond the other stands for as many hashes or more."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 14):
        a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        x, y = bits[a], bits[b]
        out[k : k + len(a)] = np.minimum(n[a] - np.bitwise_count(x & ~y).sum(axis=1), n[b] - np.bitwise_count(y & ~x).sum(axis=1))
    return out


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.where(n > 0, n - np.ceil(similarity * n - _EPS).astype(np.int64) + 1, 0)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def _frequent(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles in at least four texts of a sample, the most frequent last."""

    def kernel(batches):
        for batch in batches:
            yield _batch({"gram": _sets(byte_rows(batch), shingle)[1].view(np.int64)})

    byte_rows = lambda batch: base.byte_rows(batch, "text")
    total = rows.count()
    part = rows.where(F.pmod("h", F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * SAMPLE / max(total, 1)) + 1)).dropDuplicates(["h"])
    found = base.mapped(part.select("text"), kernel, "gram long").groupBy("gram").count().where("count >= 4")
    found = found.orderBy(F.desc("count"), "gram").limit(FREQUENT).collect()
    return np.array([r.gram for r in reversed(found)], np.int64).view(_U)


def _shingle_kernel(shingle: int, similarity: float, frequent: np.ndarray):
    where = np.argsort(frequent)
    known = frequent[where]

    def kernel(batches):
        for batch in batches:
            row, grams = _sets(base.byte_rows(batch, "text"), shingle)
            size = np.bincount(row, minlength=batch.num_rows)
            sums = np.zeros(batch.num_rows, _U)
            np.add.at(sums, row, base.mix(grams))
            fp, bits, wide = fingerprints(grams, size), bitmaps(row, grams, batch.num_rows), wide_maps(grams, size)
            late = np.zeros(len(grams), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                late = np.where(known[at] == grams, where[at] + 1, 0)
            grams = grams[np.lexsort((grams, late, row))]
            keep, begin = prefix_length(size, similarity), np.cumsum(size) - size
            firsts = [grams[b : b + k].tobytes() for b, k in zip(begin.tolist(), keep.tolist(), strict=True)]
            yield _batch({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "cls": base.mix(sums + size.astype(_U)).view(np.int64), "n": size, "fp": fp.view(np.int64), "bits": pa.array([b.tobytes() for b in bits], pa.binary()), "wide": pa.array(wide, pa.binary()), "firsts": pa.array(firsts, pa.binary())})

    return kernel


def _spread(batches):
    for batch in batches:
        firsts = batch.column("firsts").to_pylist()
        many = np.array([len(f) // 8 for f in firsts], np.int64)
        cls, n = batch.column("cls").to_numpy(), batch.column("n").to_numpy()
        yield _batch({"key": np.frombuffer(b"".join(firsts), np.int64), "cls": np.repeat(cls, many), "n": np.repeat(n, many), "pos": base.ranges(np.zeros(len(many), np.int64), many)})


def _groups(batches, columns):
    """Arrays of whole groups: rows come sorted by key, and a group may go on in the next batch."""
    held = None
    for batch in batches:
        now = [np.frombuffer(b"".join(batch.column(c).to_pylist()), _U).reshape(batch.num_rows, -1) if c == "bits" else batch.column(c).to_numpy() for c in columns]
        if held is not None:
            now = [np.concatenate((h, x)) for h, x in zip(held, now, strict=True)]
        key = now[0]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield [x[:last] for x in now]
        held = [x[last:] for x in now]
    if held is not None and len(held[0]):
        yield held


def _shared(batches):
    """Rows whose key another row has."""
    for key, cls, n, pos in _groups(batches, ("key", "cls", "n", "pos")):
        same = np.append(key[1:] == key[:-1], False)
        ok = same | np.append(False, same[:-1])
        if ok.any():
            yield _batch({"key": key[ok], "cls": cls[ok], "n": n[ok], "pos": pos[ok]})


def _possible(n, pos, i, j, similarity):
    """Whether sets that first meet at these places can be as similar as wanted."""
    least = similarity / (1 + similarity) * (n[i] + n[j])
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least * (1 - _EPS)


def _pairs(cls, i, j):
    a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return _batch({"a": a[new], "b": b[new]})


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name of each pair, in either order."""
    return base.mix(base.mix(np.minimum(a, b).view(_U)) + np.maximum(a, b).view(_U)) | _U(1)


def _slots(names: np.ndarray) -> np.ndarray:
    return (names >> _U(64 - SEEN.bit_length() + 1)).astype(np.int64)


class _Given:
    """What a task has given out, as far as tables of bounded size remember: pairs, and how many between two components."""

    def __init__(self, most: int):
        self.most = most
        self.pairs, self.links, self.counts = np.zeros(SEEN, _U), np.zeros(SEEN, _U), np.zeros(SEEN, np.int64)

    def count(self, link: np.ndarray) -> np.ndarray:
        slot = _slots(link)
        return np.where(self.links[slot] == link, self.counts[slot], 0)

    def chosen(self, pair: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the pairs to give out, whether there may be more between their components): one beyond the most tells of more."""
        at = np.unique(pair, return_index=True)[1]
        at = at[self.pairs[_slots(pair[at])] != pair[at]]
        at = at[np.argsort(link[at], kind="stable")]
        names = link[at]
        start = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(at)])
        nth = self.count(names) + base.ranges(np.zeros(len(start), np.int64), np.diff(np.append(start, len(at))))
        at, names, nth = (x[nth <= self.most] for x in (at, names, nth))
        self.pairs[_slots(pair[at])] = pair[at]
        # in order of components and numbers, so the last of each stays
        self.links[_slots(names)], self.counts[_slots(names)] = names, nth + 1
        return at, nth == self.most


def _few_kernel(similarity):
    def kernel(batches):
        for key, cls, n, pos in _groups(batches, ("key", "cls", "n", "pos")):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            head = np.repeat(start, np.diff(np.append(start, len(key))))
            at = np.arange(len(key))
            i = np.concatenate((head, np.maximum(at - 1, head)))
            j = np.concatenate((at, at))
            ok = (i != j) & _possible(n, pos, i, j, similarity)
            yield _pairs(cls, i[ok], j[ok])

    return kernel


def _rest_kernel(similarity, most):
    def kernel(batches):
        given = _Given(most)
        for key, cls, n, pos, root, bits in _groups(batches, ("key", "cls", "n", "pos", "root", "bits")):
            i, lag = np.arange(len(key)), 1
            while True:
                i = i[i + lag < len(key)]
                # sorted by size: once the other is too large, all after it are
                i = i[(key[i] == key[i + lag]) & (n[i] >= similarity * n[i + lag] * (1 - _EPS))]
                if not len(i):
                    break
                x = i[(root[i] != root[i + lag]) & _possible(n, pos, i, i + lag, similarity)]
                link = _names(root[x], root[x + lag])
                wanted = given.count(link) <= most
                x, link = x[wanted], link[wanted]
                ok = most_common(n, bits, x, x + lag) * (1 + similarity) >= similarity * (n[x] + n[x + lag]) * (1 - _EPS)
                x, link = x[ok], link[ok]
                if len(x):
                    at, more = given.chosen(_names(cls[x], cls[x + lag]), link)
                    if len(at):
                        a, b = cls[x[at]], cls[x[at] + lag]
                        yield _batch({"a": np.minimum(a, b), "b": np.maximum(a, b), "more": more})
                lag += 1

    return kernel


def _possible_pairs(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs that their maps don't rule out."""

    def kernel(batches):
        for batch in batches:
            ok = [may_be_similar(*x, similarity) for x in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(maps.select(F.col("cls").alias("a"), F.col("wide").alias("x"), "n"), "a").join(maps.select(F.col("cls").alias("b"), F.col("wide").alias("y"), F.col("n").alias("m")), "b")
    return base.written(base.mapped(both.select("a", "b", "x", "y", "n", "m"), kernel, "a long, b long"), "pairs")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of classes that are as similar as wanted."""

    def make(batches):
        for batch in batches:
            texts = base.byte_rows(batch, "text")
            row, grams = _sets(texts, shingle)
            cut = np.searchsorted(row, np.arange(len(texts) + 1))
            yield _batch({"cls": batch.column("cls"), "grams": pa.array([grams[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) * (1 - _EPS))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    heads = base.written(classes.join(wanted, "cls", "left_semi").select("cls", F.col("h").alias("head")), "heads")
    # a bitmap of the wanted texts' hashes keeps nearly all others from being shuffled; the join decides
    bits = np.zeros(SLOTS, bool)
    bits[heads.select(F.pmod("head", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    seen = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def likely(batches):
        for batch in batches:
            slot = batch.column("h").to_numpy() % SLOTS
            yield batch.filter(pa.array(seen.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1))

    near = base.mapped(rows.select("h", "text"), likely, "h long, text string")
    texts = near.join(heads, F.col("h") == F.col("head")).dropDuplicates(["cls"]).select("cls", "text")
    sets = base.written(base.mapped(texts, make, "cls long, grams binary"), "sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    found = base.written(base.mapped(both.select("a", "b", "x", "y"), compare, "a long, b long"), "links")
    base.dropped(rows.sparkSession, sets)
    return found


def _golay_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of classes with equal fingerprints, or with fingerprints linked by Golay keys, as many as join them."""
    least = base.written(classes.groupBy("fp").agg(F.min("cls").alias("least")), "prints")
    same = classes.join(least, "fp").where("cls != least").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"of_{x}")) for x in "ab"]
    near = links(least).join(ends[0], "a").join(ends[1], "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return same.unionByName(near).distinct()


def roots(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, root) of every row: the component it is in; h is a hash of its text."""
    rows = base.columns_only(docs, {"doc_id": "long", "text": "string"}).withColumn("h", F.xxhash64("text"))
    schema = "doc_id long, h long, cls long, n long, fp long, bits binary, wide binary, firsts binary"
    marks = base.written(base.mapped(rows, _shingle_kernel(shingle, similarity, _frequent(rows, shingle)), schema), "shingles")
    first = marks.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.first("firsts").alias("firsts"))
    full = base.written(first, "classes")
    golay = base.written(_golay_pairs(full), "golay")
    keyed = "key long, cls long, n long, pos long"

    def dealt(table, kernel, out):
        return base.mapped(table.repartition("key").sortWithinPartitions("key", "n", "cls"), kernel, out)

    shared = base.written(dealt(base.mapped(full.select("cls", "n", "firsts"), _spread, keyed), _shared, keyed), "shared")
    maps = base.written(full.select("cls", "n", "bits", "wide"), "maps")
    heavy, marks = marks, base.written(marks.select("doc_id", "h", "cls"), "marks")
    for table in (heavy, full):
        base.dropped(docs.sparkSession, table)
    base.relieved(docs.sparkSession)
    classes = marks.groupBy("cls").agg(F.min("h").alias("h"))
    few = base.written(dealt(shared, _few_kernel(similarity), "a long, b long").unionByName(golay).distinct(), "pairs")
    linked = _verified(_possible_pairs(few, maps, similarity), rows, classes, shingle, similarity)
    known = base.written(components(linked), "known")
    tried, most, open_roots = few, GIVEN, None
    while open_roots is None or not open_roots.isEmpty():
        base.relieved(docs.sparkSession)
        named = shared.join(known, shared.cls == known.node, "left").select("key", "cls", "n", "pos", F.coalesce("component", "cls").alias("root"))
        named = base.written(named if open_roots is None else named.join(open_roots, "root", "left_semi"), "named")
        apart = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        named = named.join(base.written(apart, "apart"), "key").join(maps.select("cls", "bits"), "cls").select("key", "cls", "n", "pos", "root", "bits")
        rest = base.written(dealt(named, _rest_kernel(similarity, most), "a long, b long, more boolean"), "rest")
        new = base.written(rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        linked = linked.unionByName(_verified(_possible_pairs(new, maps, similarity), rows, classes, shingle, similarity))
        known = base.written(components(linked), "known")
        # only between these may there be pairs that weren't given out
        ends = [known.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"]
        left = rest.where("more").select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y"))
        open_roots = base.written(left.where("x != y").select(F.explode(F.array("x", "y")).alias("root")).distinct(), "open")
        tried, most = tried.unionByName(new), most * MORE
    return marks.select("doc_id", "h", "cls").join(known, F.col("cls") == F.col("node"), "left").select("doc_id", "h", F.coalesce("component", "cls").alias("root"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of near-duplicates one document, all its columns."""
    return survivors(docs, roots(docs, shingle, similarity))

"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits of the lower-cased text in any script; an ideograph or kana is a word of its own. A seed is a
run of ``least`` words. Whatever covers ``coverage`` of an item with tiles of ``least`` words or more shares at least one of its
``coverage`` x words / ``least`` most frequent seeds or of the others, so the most frequent ones but for one are left out, and

1. documents give the places of all runs that the benchmark may have, told by a bitmap of bounded size (one narrow pass);
2. these runs are joined to the items' seeds, which gives the pairs of document and item that have to be compared;
3. documents and the items they were paired with meet sorted, one document's places being held at a time: the longest common stretch
   of unmarked words is looked for with Karp-Rabin hashes and marked in both, again and again, until none of ``least`` words is
   left; so an item is found in any order of its parts.

A document is contaminated by an item if its tiles cover at least ``coverage`` of the item's words. Equal texts, of documents or of
items, are compared once. Nothing is collected but the bitmap, and a broadcast of a table is Spark's choice by its size.

Items of fewer than ``least`` words can't contaminate. Null and empty texts, and an empty benchmark, contaminate nothing; repeated
rows and repeated items each give rows, and so do null ids.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

LEAST, COVERAGE = 5, 0.5
SCHEMA = "doc_id long, item_id long, matched_words long, item_words long, coverage double, tiles long"
#: Bits of the map of the benchmark's runs: 64 a run, within these bounds.
FEWEST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 27
_U = np.uint64
_ASCII = bytes(b if chr(b).isalnum() else 32 for b in range(128)) + bytes(128)
_OUT = re.compile(r"[\W_]+")
_ALONE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def folded(row: bytes | None) -> bytes:
    """The words, lower-cased, with spaces between."""
    if not row:
        return b""
    if row.isascii():
        return row.lower().translate(_ASCII)
    text = _OUT.sub(" ", row.decode("utf-8", "replace").lower())
    if _ALONE.search(text):
        text = _ALONE.sub(r" \g<0> ", text)
    return text.encode()


def words_of(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all the rows' words, and where each row's begin (and the end)."""
    buf, s, e, first = base.word_spans([folded(r) for r in rows])
    return base.word_hashes(buf, s, e), first


def runs_of(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash) of every run of ``least`` words."""
    count = np.maximum(0, np.diff(first) - least + 1)
    at, row = base.ranges(first[:-1], count), np.repeat(np.arange(len(count)), count)
    return row, at - first[row], base.Sequence(words).span(at, at + least)


class _Tiler:
    """Stretches of ``least`` words that two texts share, hashed once, for looking for the longest one again and again."""

    def __init__(self, a: np.ndarray, b: np.ndarray, least: int):
        self.a, self.b, self.least = a, b, least
        at_a, at_b = (np.arange(max(0, len(x) - least + 1)) for x in (a, b))
        ha, hb = base.Sequence(a).span(at_a, at_a + least), base.Sequence(b).span(at_b, at_b + least)
        order = np.argsort(hb, kind="stable")
        self.hb, self.at_b = hb[order], at_b[order]
        lo, hi = np.searchsorted(self.hb, ha), np.searchsorted(self.hb, ha, "right")
        self.at_a, self.ha = at_a[hi > lo], ha[hi > lo]

    def longest(self, free_a: np.ndarray, free_b: np.ndarray) -> tuple[int, int, int]:
        """The longest common stretch of free words, the first in a and then in b: starts and length, 0 if below least."""
        a, b, least = self.a, self.b, self.least
        best = (0, 0, 0)
        run_a, run_b = np.append(0, np.cumsum(free_a)), np.append(0, np.cumsum(free_b))
        ok = run_a[self.at_a + least] - run_a[self.at_a] == least
        self.at_a, self.ha = self.at_a[ok], self.ha[ok]  # what is marked stays marked
        ok = run_b[self.at_b + least] - run_b[self.at_b] == least
        self.at_b, self.hb = self.at_b[ok], self.hb[ok]
        lo, hi = np.searchsorted(self.hb, self.ha), np.searchsorted(self.hb, self.ha, "right")
        step = max(1, (1 << 20) // max(1, int((hi - lo).max(initial=1))))
        for k in range(0, len(self.at_a), step):  # a bounded number of pairs at a time
            n = (hi - lo)[k : k + step]
            i, j = np.repeat(self.at_a[k : k + step], n), self.at_b[base.ranges(lo[k : k + step], n)]
            size = least
            while len(i):
                p, q = i + size, j + size
                ok = (p < len(a)) & (q < len(b))
                ok[ok] = (a[p[ok]] == b[q[ok]]) & free_a[p[ok]] & free_b[q[ok]]
                if not ok.any():
                    break
                i, j, size = i[ok], j[ok], size + 1
            if len(i) and size > best[2]:
                best = (int(i[0]), int(j[0]), size)
        return best


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in the item, start in the text, length), the longest first."""
    tiler, out = _Tiler(item, text, least), []
    free_a, free_b = np.ones(len(item), bool), np.ones(len(text), bool)
    while True:
        i, j, n = tiler.longest(free_a, free_b)
        if not n:
            return out
        free_a[i : i + n] = free_b[j : j + n] = False
        out.append((i, j, n))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def _binaries(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """One binary for each range of values between two cuts."""
    return pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())


class Benchmark:
    """A benchmark made ready: its rows and their texts' names, each text's words, its seeds, and the bitmap of all its runs."""

    def __init__(self, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE):
        spark, self.least, self.coverage = benchmark.sparkSession, least, coverage
        rows = base.columns_only(benchmark, {"item_id": "long", "text": "string"}).where("text is not null").withColumn("item", F.md5(F.col("text").cast("binary")))
        self.rows = base.written(rows.select("item_id", "item"), "items")

        def forms(batches):
            for batch in batches:
                words, first = words_of(base.byte_rows(batch, "text"))
                yield _batch({"item": batch.column("item"), "words": _binaries(words, first), "n": np.diff(first)}).filter(pa.array(np.diff(first) >= least))

        def spread(batches):
            for batch in batches:
                words = [np.frombuffer(x, _U) for x in batch.column("words").to_pylist()]
                first = np.append(0, np.cumsum([len(w) for w in words]))
                row, at, run = runs_of(np.concatenate(words), first, least)
                yield _batch({"item": batch.column("item").take(pa.array(row)), "n": batch.column("n").to_numpy()[row], "at": at, "run": run.view(np.int64)})

        distinct = rows.dropDuplicates(["item"]).select("item", "text")
        self.forms = base.written(base.mapped(distinct, forms, "item string, words binary, n long"), "forms")
        runs = base.written(base.mapped(self.forms, spread, "item string, n long, at long, run long"), "runs")
        often = runs.groupBy("run").agg(F.count("*").alias("often"))
        # the rarest runs of an item, as many as leave too few others to cover enough of it
        rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "run", "at"))
        spared = F.ceil(F.lit(coverage) * F.col("n") / least - F.lit(1e-9))
        seeds = runs.join(often, "run").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - (least - 1) - spared + 1)
        self.seeds = base.written(seeds.select("run", "item").distinct(), "seeds")
        slots, many = FEWEST_SLOTS, 64 * runs.count()
        while slots < min(many, MOST_SLOTS):
            slots *= 2
        shift = 64 - slots.bit_length() + 1
        slot = F.shiftrightunsigned("run", shift)
        words = runs.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit")).distinct()
        found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        bits = np.zeros(slots >> 6, np.int64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.map, self.shift = spark.sparkContext.broadcast(bits.view(_U)), shift
        base.dropped(spark, runs)


def _known(bitmap, shift: int):
    """A test of runs: whether the benchmark may have each."""

    def has(runs: np.ndarray) -> np.ndarray:
        slot = runs >> _U(shift)
        return (bitmap.value[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) == 1

    return has


def _places_kernel(least: int, has):
    """Of each row with a run of the benchmark's its name, and the places and hashes of these runs."""

    def kernel(batches):
        for batch in batches:
            rows = base.byte_rows(batch, "text")
            for a, b in base.chunks(rows):
                row, at, run = runs_of(*words_of(rows[a:b]), least)
                hit = np.flatnonzero(has(run))
                if not len(hit):
                    continue
                row, at, run = row[hit], at[hit], run[hit]
                some = np.unique(row)
                cut = np.append(np.searchsorted(row, some), len(row))
                part = batch.slice(a, b - a).select(["doc_id", "h"]).take(pa.array(some))
                names = [hashlib.md5(rows[a + r]).hexdigest() for r in some.tolist()]
                yield _batch({"doc_id": part.column("doc_id"), "h": part.column("h"), "doc": pa.array(names), "at": _binaries(at, cut), "runs": _binaries(run, cut)})

    return kernel


def _runs_kernel(batches):
    """A row for each distinct run of a document."""
    for batch in batches:
        runs = [np.unique(np.frombuffer(x, np.int64)) for x in batch.column("runs").to_pylist()]
        yield _batch({"doc": batch.column("doc").take(pa.array(np.repeat(np.arange(len(runs)), [len(x) for x in runs]))), "run": np.concatenate(runs)})


class _Document:
    """The places of one document's runs, sorted by run."""

    def __init__(self, at: bytes, runs: bytes, least: int):
        at, runs = np.frombuffer(at, np.int64), np.frombuffer(runs, _U)
        order = np.argsort(runs, kind="stable")
        self.runs, self.at, self.least = runs[order], at[order], least

    def common(self, words: np.ndarray) -> np.ndarray:
        """The document's words that stand in runs of the item's; what isn't next to each other in it is kept apart by other words."""
        least, place = self.least, np.arange(len(words) - self.least + 1)
        run = base.Sequence(words).span(place, place + least)
        lo, hi = np.searchsorted(self.runs, run), np.searchsorted(self.runs, run, "right")
        at, place = self.at[base.ranges(lo, hi - lo)], np.repeat(place, hi - lo)
        at, some = np.unique(at, return_index=True)
        at, place = (np.concatenate([x + k for k in range(least)]) for x in (at, place[some]))
        at, some = np.unique(at, return_index=True)
        if not len(at):
            return np.zeros(0, _U)
        gap = np.flatnonzero(np.diff(at) > 1) + 1
        known = set(words.tolist())
        apart = next(x for x in range(len(words) + 1) if x not in known)  # no word of the item
        return np.insert(words[place[some]], gap, _U(apart))


def _tile_kernel(least: int, coverage: float):
    """Rows come sorted by document; a document's places stand before the items it is compared with."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def kernel(batches):
        name = doc = None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["item"] is None:
                    name, doc = x["doc"], _Document(x["a"], x["b"], least)
                    continue
                if x["doc"] != name:
                    raise ValueError("an item without its document")
                words = np.frombuffer(x["a"], _U)
                found = tiles(words, doc.common(words), least)
                matched = sum(n for *_, n in found)
                if matched and matched >= coverage * len(words):
                    out.append((name, x["item"], matched, len(words), len(found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "item", "matched_words", "item_words", "tiles"])

    return kernel


def _matches(docs: DataFrame, items: Benchmark) -> tuple[DataFrame, DataFrame]:
    """The rows that have a run of the benchmark's (doc_id, h, doc), and (doc, item, matched_words, item_words, tiles) of contaminated texts."""
    rows = base.columns_only(docs, {"doc_id": "long", "text": "string"}).where("text is not null").withColumn("h", F.xxhash64("text"))
    places = base.written(base.mapped(rows, _places_kernel(items.least, _known(items.map, items.shift)), "doc_id long, h long, doc string, at binary, runs binary"), "places")
    once = base.written(places.groupBy("doc").agg(F.first("at").alias("at"), F.first("runs").alias("runs")), "texts")
    runs = base.mapped(once.select("doc", "runs"), _runs_kernel, "doc string, run long")
    pairs = base.written(runs.join(items.seeds, "run").select("doc", "item").distinct(), "pairs")
    asked = pairs.join(items.forms, "item").select("doc", "item", F.col("words").alias("a"), F.lit(None).cast("binary").alias("b"))
    held = once.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", F.lit(None).cast("string").alias("item"), F.col("at").alias("a"), F.col("runs").alias("b"))
    met = held.unionByName(asked).repartition("doc").sortWithinPartitions("doc", F.col("item").asc_nulls_first())
    found = base.written(base.mapped(met, _tile_kernel(items.least, items.coverage), "doc string, item string, matched_words long, item_words long, tiles long"), "tiles")
    marks = base.written(places.select("doc_id", "h", "doc"), "marks")
    for table in (places, once, pairs):
        base.dropped(docs.sparkSession, table)
    return marks, found


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it contains."""
    items = Benchmark(benchmark, least, coverage)
    marks, found = _matches(docs, items)
    share = (F.col("matched_words") / F.col("item_words")).alias("coverage")
    return marks.join(found, "doc").join(items.rows, "item").select("doc_id", "item_id", "matched_words", "item_words", share, "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The documents, all their columns, that no item contaminates."""
    marks, found = _matches(docs, Benchmark(benchmark, least, coverage))
    bad = base.written(marks.join(found.select("doc").distinct(), "doc", "left_semi").select("h", "doc").distinct(), "bad")
    taken = {c.lower() for c in docs.columns}
    by, name = ([c for c in (f"{x}{'_' * k}" for k in range(len(taken) + 1)) if c not in taken][0] for x in ("by", "name"))
    bad = bad.select(F.col("h").alias(by), F.col("doc").alias(name))
    text = F.col("text").cast("string")
    # the hash of eight bytes finds them, the digest decides
    return docs.join(bad, (F.xxhash64(text) == F.col(by)) & (F.md5(text.cast("binary")) == F.col(name)), "left_anti")

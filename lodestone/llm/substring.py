"""Substring deduplication by recompression.

Rounds name token runs and pairs: a round joins short maximal runs of one symbol, or pairs of a left and a right symbol,
where a symbol's side is a bit of its name. The name of a run or pair is a 64-bit hash of the names of its parts and of the
round, so it is the same in every partition and document, and a round needs no exchange to agree on names. No symbol grows
beyond a round's limit, so what a round does at a place depends on ``limit - 1`` words on either side only; after all
rounds, two equal stretches have equal symbols but for ``reach(ROUNDS)`` words at their ends. The rounds are as tall as windows of
50 words allow whole common symbols: up to six words.

Each window of ``window`` words is filed under one interior symbol, the one with the smallest scrambled name, together
with the ``reach`` words around it, all inside the window. Windows of a document that share a symbol are one stretch. Then

1. symbols found in one document only are dropped (counts with a partial aggregate, nothing gathered);
2. stretches that start, as a whole, in a smaller document are repeats, by 128-bit hashes of all their words;
3. the smallest document of each other stretch compares its single windows, again by 128-bit hashes.

Null, empty: no words, nothing removed. Repeated ids: rows of one id never count against each other; repeated rows cost their
number, as their spans are sets. Null ids: the row is kept whole and removes nothing elsewhere. Ties can't arise: only smaller ids count. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW = 50
ROUNDS = (("run", 3), ("pair", 2), ("pair", 4), ("pair", 6))
_U = np.uint64


def reach(rounds=ROUNDS) -> int:
    return sum(limit - 1 for _, limit in rounds)


def recompress(words: np.ndarray, first: np.ndarray, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and names of the symbols that stand after the rounds over hashed words; none crosses from one row into the next."""
    n = len(words)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    at, name = np.arange(n), words
    for number, (kind, limit) in enumerate(rounds):
        salt = _U(0x9E3779B97F4A7C15 * (2 * number + 1) % (1 << 64))
        length, opens = np.append(at[1:], n) - at, begins[at]
        if kind == "run":
            head = np.append(True, (name[1:] != name[:-1]) | opens[1:])[: len(at)]
            run = np.flatnonzero(head)
            copies = np.diff(np.append(run, len(at)))
            short = (copies > 1) & ((copies + 1) * length[run] <= limit)
            stays = head | ~np.repeat(short, copies)
            name = name.copy()
            name[run[short]] = base.mix(name[run[short]] + salt * copies[short].astype(_U))
        else:
            right = (base.mix(name ^ salt) & _U(1)).astype(bool)
            joins = ~right[:-1] & right[1:] & ~opens[1:] & (length[:-1] + length[1:] <= limit)
            stays = np.append(True, ~joins)[: len(at)]
            left = np.flatnonzero(joins)
            name = name.copy()
            name[left] = base.mix(base.mix(name[left] + salt) + name[left + 1])
        at, name = at[stays], name[stays]
    return at, np.append(at[1:], n), name


def _smallest(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each pair lo <= hi the index of the smallest of order[lo..hi], the first on ties."""
    table, width = [np.arange(len(order))], 1
    while 2 * width <= int((hi - lo).max()) + 1:
        a, b = table[-1][:-width], table[-1][width:]
        step = table[-1].copy()
        step[: len(a)] = np.where(order[a] <= order[b], a, b)
        table.append(step)
        width *= 2
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    flat = np.stack(table)
    a, b = flat[level, lo], flat[level, hi - (1 << level) + 1]
    return np.where(order[a] <= order[b], a, b)


def stretches(rows: list[bytes | None], window: int = WINDOW, rounds=ROUNDS) -> dict[str, np.ndarray]:
    """Every window of the rows, as stretches filed under an interior symbol: row, key, 128-bit content, start, count."""
    c = reach(rounds)
    buf, s, e, first = base.word_spans(rows)
    windows = np.maximum(0, np.diff(first) - window + 1)
    if not windows.any():
        return {k: np.zeros(0, np.int64) for k in ("row", "key", "c1", "c2", "start", "n")}
    words = base.word_hashes(buf, s, e)
    seq = base.Sequence(words)
    p, q, name = recompress(words, first[:-1][np.diff(first) > 0], rounds)
    w = base.ranges(first[:-1], windows)
    count = np.zeros(seq.n + 2, np.int64)
    count[p + 1] = 1
    lo = np.cumsum(count)[w + c]
    count[:] = 0
    count[q] = 1
    hi = np.cumsum(count)[w + window - c] - 1
    best = _smallest(base.mix(name ^ _U(0x5851F42D4C957F2D)), lo, hi)
    cut = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (w[1:] != w[:-1] + 1)))
    n = np.diff(np.append(cut, len(w)))
    at, sym = w[cut], best[cut]
    row = np.searchsorted(first, at, "right") - 1
    end = at + n - 1 + window
    return {"row": row, "key": seq.span(p[sym] - c, q[sym] + c).view(np.int64), "c1": seq.span(at, end).view(np.int64), "c2": seq.span(at, end, 1).view(np.int64), "start": at - first[row], "n": n}


def _stretch_kernel(window: int, rounds):
    def kernel(batches):
        for batch in batches:
            rows = base.byte_rows(batch, "text")
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for a, b in base.chunks(rows):
                x = stretches(rows[a:b], window, rounds)
                if len(x["row"]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (x["key"], x["c1"], x["c2"], ids[a:b][x["row"]], marks[a:b][x["row"]], x["start"].astype(np.int32), x["n"].astype(np.int32))],
                        ["key", "c1", "c2", "doc_id", "mark", "start", "n"],
                    )

    return kernel


def _window_kernel(window: int):
    def kernel(batches):
        for batch in batches:
            rows, asked = base.byte_rows(batch, "text"), batch.column("parts").to_pylist()
            ids, marks = (batch.column(c).to_pylist() for c in ("doc_id", "mark"))
            rows = [r if x else b"" for r, x in zip(rows, asked, strict=True)]
            for a, b in base.chunks(rows):
                buf, s, e, first = base.word_spans(rows[a:b])
                wanted = [(i, x["start"], x["n"]) for i, xs in enumerate(asked[a:b]) for x in xs or ()]
                if not wanted:
                    continue
                seq = base.Sequence(base.word_hashes(buf, s, e))
                i, start, n = (np.array(v, np.int64) for v in zip(*wanted, strict=True))
                at, of = base.ranges(first[i] + start, n), np.repeat(i, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (seq.span(at, at + window).view(np.int64), seq.span(at, at + window, 1).view(np.int64), np.array(ids[a:b], np.int64)[of], np.array(marks[a:b], np.int64)[of], (at - first[of]).astype(np.int32))],
                    ["w1", "w2", "doc_id", "mark", "start"],
                )

    return kernel


def repeats(docs: DataFrame, window: int = WINDOW, rounds=ROUNDS) -> DataFrame:
    """(doc_id, mark, spans): for each row with repeated windows, the word ranges that they cover; mark tells rows of one id apart."""
    assert window >= 2 * reach(rounds) + 2 * max(limit for _, limit in rounds), "windows too short for these rounds"
    spark = docs.sparkSession
    marked = base.columns_only(docs, {"doc_id": "long", "text": "string"}).where("doc_id is not null").withColumn("mark", F.xxhash64("text"))
    found = base.written(
        base.mapped(marked, _stretch_kernel(window, rounds), "key long, c1 long, c2 long, doc_id long, mark long, start int, n int"), "stretches"
    )
    # what is joined to rows that may hold a hot key is a table, not an aggregate, so that Spark can split the hot partition
    several = (F.min("c1") < F.max("c1")) | (F.min("c2") < F.max("c2"))
    shared = base.written(found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), several.alias("several")).where("lo < hi").select("key", "several"), "keys")
    near = base.written(found.join(shared, "key"), "shared")
    base.dropped(spark, found)
    base.relieved(spark)
    least = base.written(near.groupBy("key", "c1", "c2").agg(F.min("doc_id").alias("least")), "least")
    judged = base.written(near.join(least, ["key", "c1", "c2"]).where("doc_id > least or several").select("doc_id", "mark", "start", "n", (F.col("doc_id") > F.col("least")).alias("whole")), "judged")
    base.dropped(spark, near)
    base.relieved(spark)
    parts = judged.where("not whole").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "n")).alias("parts"))
    single = base.written(base.mapped(marked.join(parts.hint("shuffle_hash"), ["doc_id", "mark"]), _window_kernel(window), "w1 long, w2 long, doc_id long, mark long, start int"), "windows")
    first = base.written(single.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "first")
    later = single.join(first, ["w1", "w2"]).where("doc_id > least").select("doc_id", "mark", "start", F.lit(1).alias("n"))
    cover = judged.where("whole").select("doc_id", "mark", "start", "n").unionByName(later)
    return cover.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n") + F.lit(window - 1)).alias("end"))).alias("spans"))


def covered(n_words: int, spans: list[dict]) -> np.ndarray:
    """Which of a row's words stand in any of the spans."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, [x["start"] for x in spans], 1)
    np.add.at(step, [x["end"] for x in spans], -1)
    return np.cumsum(step)[:-1] > 0


def _digest_kernel(batches):
    for batch in batches:
        rows, spans = base.byte_rows(batch, "text"), batch.column("spans").to_pylist()
        total, gone, sha = [], [], []
        for row, cover in zip(rows, spans, strict=True):
            words = (row or b"").split()
            total.append(len(words))
            if cover:
                stays = ~covered(len(words), cover)
                words = list(compress(words, stays.tolist()))
            gone.append(total[-1] - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame, window: int, rounds) -> DataFrame:
    marked = docs.withColumn("mark", F.xxhash64("text"))
    return marked.join(repeats(docs, window, rounds).hint("shuffle_hash"), ["doc_id", "mark"], "left")


def digests(docs: DataFrame, window: int = WINDOW, rounds=ROUNDS) -> DataFrame:
    """One row per document: word counts and the hash of the words that are kept."""
    rows = base.columns_only(docs, {"doc_id": "long", "text": "string"})
    return base.mapped(_joined(rows, window, rounds).select("doc_id", "text", "spans"), _digest_kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _text_kernel(batches):
    for batch in batches:
        rows, spans, texts = base.byte_rows(batch, "text"), batch.column("spans").to_pylist(), []
        for row, cover in zip(rows, spans, strict=True):
            if not cover:
                texts.append(None if row is None else row.decode())
                continue
            _, s, e, _ = base.word_spans([row])
            gone = covered(len(s), cover)
            edge = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
            texts.append("\n".join(row[s[a] : e[b - 1]].decode() for a, b in zip(edge[0::2], edge[1::2], strict=True)))
        yield batch.drop_columns(["spans", "text"]).append_column("text", pa.array(texts, pa.string()))


def deduplicated(docs: DataFrame, window: int = WINDOW, rounds=ROUNDS) -> DataFrame:
    """The documents with repeated passages cut out; what stood around a cut is joined by a line feed, all else is unchanged.

    A document without any word left, but with some before, becomes an empty text. Columns are those of ``docs``;
    ``n_chars``, where there is one, follows the text.
    """
    names = docs.columns
    free = next(c for c in ("_row", "_row_", "_row__") if c not in names)
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")], F.lit(0).alias(free)).alias("rest"))
    joined = _joined(packed.withColumn("doc_id", F.col("doc_id").cast("long")), window, rounds).select("doc_id", "rest", "text", "spans")
    out = base.mapped(joined, _text_kernel, joined.select("doc_id", "rest", "text").schema)
    kinds = dict(docs.dtypes)
    return out.select([F.col(c).cast(kinds[c]) if c in ("doc_id", "text") else F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in names])

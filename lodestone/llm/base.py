"""What the training-data operators share: scratch tables, bounded chunks of rows, and vectorised word arithmetic.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_ROWS, PLAIN, ROWS, folder, importable, scratch, shared_dir, written

__all__ = ["BATCH_ROWS", "PLAIN", "ROWS", "scratch", "shared_dir", "written"]

#: Bytes of text that a kernel works on at a time, so that its arrays stay small whatever a batch holds.
CHUNK_BYTES = 1 << 20
_U = np.uint64


def dropped(spark: SparkSession, table: DataFrame) -> None:
    """Deletes a scratch table that nothing reads any more, and lets Spark clear the shuffles behind it."""
    path, files = folder(spark, table._scratch)
    files.delete(path, True)
    spark.sparkContext._jvm.System.gc()


def relieved(spark: SparkSession) -> None:
    """Executors collect their garbage, so that heap which a step before needed goes back; it stays theirs otherwise, beside the workers of the next."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def columns_only(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Just the columns an operator reads, in fixed types; others, however named, don't disturb it."""
    return df.select([F.col(f"`{c}`").cast(t).alias(c) for c, t in wanted.items()])


def mapped(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``df`` through a kernel on Arrow batches, which it gets in small slices: what it makes of one is freed before the next."""

    def run(batches):
        yield from kernel(slices(batches))
        pa.default_memory_pool().release_unused()

    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes; a larger row is a slice of its own."""
    for batch in batches:
        size = np.full(batch.num_rows, limit / rows)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def byte_rows(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def chunks(rows: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    at = total = 0
    for i, row in enumerate(rows):
        n = len(row or b"") + 1
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if len(rows) > at:
        yield at, len(rows)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the rows in one array, where its words start and end, and each row's first word (and the count)."""
    data = b"\n".join([r or b"" for r in rows]) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    ink = ~_WHITE[buf]
    edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    if ink[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(r or b"") + 1 for r in rows)])
    return buf, starts, ends, np.searchsorted(starts, begins)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Bits of an 8-byte lane that belong to a word of so many bytes.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 512


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; zeros follow the last byte."""
    whole = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", whole.data, strides=(1,))


def _few_lanes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for some places of a large array, which is not copied."""
    inner = np.minimum(at, len(buf) - 8)
    return np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))[inner] >> ((at - inner) << 3).astype(_U)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: lanes of eight bytes, each mixed in by a bijection, so that no structure cancels out.

    Words of the same length up to eight bytes never collide.
    """
    lane, size = _lanes(buf), ends - starts
    out = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0xD6E8FEB86659FD93))
    some = np.flatnonzero(size <= LONG_WORD)
    at, left, h = starts[some], size[some], out[some]
    while len(some):
        h = mix(h ^ (lane[at] & _LANE[np.minimum(left, 8)]))
        more = left > 8
        out[some[~more]] = h[~more]
        some, at, left, h = some[more], at[more] + 8, left[more] - 8, h[more] + _U(0xA0761D6478BD642F)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].data, 42)
    return out


def same_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each word of ``buf`` has the bytes of the word of ``other`` from ``at`` to ``to``."""
    buf, other = (np.concatenate((x, np.zeros(8, np.uint8))) if len(x) < 8 else x for x in (buf, other))
    same = ends - starts == to - at
    some = np.flatnonzero(same)
    a, b, left = starts[some], at[some], (ends - starts)[some]
    while len(some):
        ok = (_few_lanes(buf, a) ^ _few_lanes(other, b)) & _LANE[np.minimum(left, 8)] == 0
        same[some[~ok]] = False
        on = ok & (left > 8)
        some, a, b, left = some[on], a[on] + 8, b[on] + 8, left[on] - 8
    return same


#: Stretches are polynomials modulo this prime, in two bases without any relation.
PRIME = (1 << 61) - 1
_P, _LOW, _MID = _U(PRIME), _U(0xFFFFFFFF), _U((1 << 29) - 1)
_BASES = (0x0A3F1C6E5B9D2781, 0x1C84E6A39F07B5D2)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)  # below zero wraps around to the top


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x b modulo the prime, for numbers below it."""
    a1, a0, b1, b0 = a >> _U(32), a & _LOW, b >> _U(32), b & _LOW
    mid = a1 * b0
    mid += a0 * b1
    a1 *= b1
    a1 <<= _U(3)  # 2**64 is 8
    a0 *= b0
    a1 += a0 >> _U(61)
    a0 &= _P
    a1 += a0
    a1 += mid >> _U(29)
    mid &= _MID
    mid <<= _U(32)
    a1 += mid
    return _reduced(a1)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo the prime and their inverses, kept per process."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        pair = []
        for b in (_BASES[which], pow(_BASES[which], -1, PRIME)):
            p, step = np.ones(1, _U), b
            while len(p) < max(n, 1024):
                p = np.concatenate((p, times(p, np.full(len(p), step, _U))))
                step = step * step % PRIME
            pair.append(p)
        _POWERS[which] = (pair[0], pair[1])
    return _POWERS[which]


class Sequence:
    """Hashes of any stretch of items in constant time; equal stretches have equal hashes wherever they stand."""

    def __init__(self, items: np.ndarray):
        self.n, self.items = len(items), _reduced(items)
        self.prefix: dict[int, np.ndarray] = {}

    def _prefix(self, which: int) -> np.ndarray:
        if which not in self.prefix:
            x = times(self.items, _powers(which, self.n + 1)[0][: self.n])
            # sums of halves don't overflow before 2**32 items
            high, low = np.zeros(self.n + 1, _U), np.zeros(self.n + 1, _U)
            np.cumsum(x >> _U(32), out=high[1:])
            np.cumsum(x & _LOW, out=low[1:])
            self.prefix[which] = _reduced((high >> _U(29)) + ((high & _MID) << _U(32)) + low)
        return self.prefix[which]

    def span(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        p = self._prefix(which)
        x = p[b] - p[a]
        return mix(times(np.minimum(x, x + _P), _powers(which, self.n + 1)[1][a]))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for each start as many as its count says."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)

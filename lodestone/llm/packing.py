"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenised where they lie; a task packs what it has gathered whenever that reaches ``hold`` tokens (and at
its end), so memory is bounded and nothing is shuffled. Whole capacities are first cut off a document's front, one full
sequence each. The remainders go to the least number of windows that could hold them: each starts as a partition of
its own, and the two partitions with the largest spreads are merged again and again, the one's heavy windows with the
other's light ones, until one partition is left, of near-equal windows. The window count rises as long as any window exceeds
the capacity. Only then, if more than ``spare`` of the tokens would be padding, the lightest windows are taken apart again:
their documents, and no others, are cut to fill the room of the rest.

Null text: empty, its end id alone. Repeated rows are packed once each. Other columns are ignored. Sequence ids are unique
(task number, then a counter); padding is what a window lacks to the capacity.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame

from . import base
from .encode import encoder

CAPACITY, END, HOLD, SPARE = 4096, 2, 1 << 21, 0.005
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size, by multiway differencing."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # a partition: its window sums, rising and less the smallest; its trees of members, -1 for none
    left, right = np.full(2 * n * k if n * k < 1 << 16 else 1 << 16, -1, np.int64), None
    right = left.copy()
    used = n
    heap, parts = [], {}
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i))
    heapq.heapify(heap)
    fresh = n

    def state(i):
        if i in parts:
            return parts.pop(i)
        sums, trees = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], trees[-1] = sizes[i], i
        return sums, trees

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (s, t), (u, v) = state(a), state(b)
        u, v = u[::-1], v[::-1]
        sums = s + u
        both = np.flatnonzero((t >= 0) & (v >= 0))
        trees = np.maximum(t, v)
        if len(both):
            while used + len(both) > len(left):
                left, right = (np.concatenate((x, np.full(len(x), -1, np.int64))) for x in (left, right))
            new = np.arange(used, used + len(both))
            left[new], right[new] = t[both], v[both]
            trees[both] = new
            used += len(both)
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        parts[fresh] = (sums, trees[order])
        heapq.heappush(heap, (-int(sums[-1]), fresh))
        fresh += 1
    _, trees = state(heap[0][1])
    out = np.empty(n, np.int64)
    node, window = trees[trees >= 0], np.flatnonzero(trees >= 0)
    while len(node):
        leaf = node < n
        out[node[leaf]] = window[leaf]
        node, window = node[~leaf], window[~leaf]
        node, window = np.concatenate((left[node], right[node])), np.concatenate((window, window))
    return out


def balanced(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each size, and how many there are: as many as differencing needs to keep every one within the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        of = differencing(sizes, k)
        most = int(np.bincount(of, sizes, k).max())
        if most <= capacity:
            return of, k
        k = max(k + 1 + k // 128, k * most // capacity)


def windows(sizes: np.ndarray, capacity: int = CAPACITY, spare: float = SPARE) -> list[list[tuple[int, int, int]]]:
    """Each window's pieces (item, start, length); every size below the capacity."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return []
    of, k = balanced(sizes, capacity)
    loads = np.bincount(of, sizes, k).astype(np.int64)
    stay = max(-(-total // capacity), int((1 + spare) * total / capacity))
    order = np.argsort(loads, kind="stable")
    apart = np.zeros(k, bool)
    apart[order[: max(0, k - stay)]] = True
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for item in np.argsort(of, kind="stable").tolist():
        if not apart[of[item]]:
            out[of[item]].append((item, 0, int(sizes[item])))
    roomy = iter(order[apart.sum() :].tolist())  # most room first, so that pieces are long
    w = next(roomy, None)
    for item in np.flatnonzero(apart[of]).tolist():
        start = 0
        while start < sizes[item]:
            part = min(int(sizes[item]) - start, capacity - int(loads[w]))
            if not part:
                w = next(roomy)
                continue
            out[w].append((item, start, part))
            loads[w] += part
            start += part
    return [w for w in out if w]


def _pack_kernel(path: str, end: int, capacity: int, hold: int, spare: float):
    stop = int(end).to_bytes(4, "little")

    def packed(docs: list[tuple[int, bytes]], sequence: int):
        rows = []

        def piece(doc, ids, start, length, offset):
            rows.append((doc, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset))

        rests = []
        for doc, ids in docs:
            n = len(ids) // 4
            for start in range(0, n - capacity + 1, capacity):
                piece(doc, ids, start, capacity, 0)
                sequence += 1
            rests.append((doc, ids, n - n % capacity, n % capacity))
        rests = [x for x in rests if x[3]]
        for window in windows(np.array([x[3] for x in rests], np.int64), capacity, spare):
            offset = 0
            for item, start, length in window:
                doc, ids, begins, _ = rests[item]
                piece(doc, ids, begins + start, length, offset)
                offset += length
            sequence += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), sequence

    def kernel(batches):
        enc = encoder(path)
        sequence, docs, total = pyspark.TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            rows, names = base.byte_rows(batch, "text"), batch.column("doc_id").to_pylist()
            for a, b in base.chunks(rows):
                for doc, ids in zip(names[a:b], enc.many(rows[a:b]), strict=True):
                    docs.append((doc, ids + stop))
                    total += len(ids) // 4 + 1
                    if total >= hold:
                        out, sequence = packed(docs, sequence)
                        yield out
                        docs, total = [], 0
        if docs:
            yield packed(docs, sequence)[0]

    return kernel


def pack(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, hold: int = HOLD, spare: float = SPARE) -> DataFrame:
    """One row per piece: the document, where the piece starts in its ids and how long it is, its checksum, and its place."""
    return base.mapped(base.columns_only(docs, {"doc_id": "long", "text": "string"}), _pack_kernel(path, end, capacity, hold, spare), SCHEMA)

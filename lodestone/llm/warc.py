"""WARC fixity audit with Merkle trees.

``archive`` writes pages as WARC/1.0 resource records, in ascending page_id order, into segments of 256 ids, each in parts of
about ``PART_BYTES``: a Parquet table (segment, part, data) in the shared folder; ``replica`` copies one. ``leaves`` reads such a
table back, walks its records by their headers and hashes each one, and also the bytes before a part's first record. A tree's lowest
nodes are page ids with the hashes of their records, which are added up and so never gathered; above, a node is an ordered
range of 16 nodes, which lie one after another in their segment, so a node stands for an offset range. Each level of a tree is a
table. ``audit`` compares two replicas from the root down and descends into mismatching nodes only, to the records that differ.

A tree is keyed by id, so a record that is missing or longer in a replica doesn't make its successors differ. Bytes that don't
start a record belong to the record before them; at the start of a part they are a leaf without page_id, by their hash. Null html:
an empty body; null url: empty; null ids: under id -1, spread over segments by a hash of their content, and over the tree by that of
their records. Repeated rows are records of their own, counted under their id. Empty tables: equal replicas, nothing found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

FAN_BITS, SEGMENT_BITS, PART_BYTES = 4, 8, 4 << 20
#: Segments for records without an id, below all others, and the keys that these records are spread over, below 0.
NO_ID, NO_ID_SEGMENTS, NO_ID_KEYS = -1, 4096, 1 << 28
_START = b"WARC/1.0\r\n"
_ID = re.compile(rb"^WARC-Record-ID: <urn:page:(-?\d+)>\r?$", re.M)
_LENGTH = re.compile(rb"^Content-Length: *(\d+)\r?$", re.M | re.I)


def record(page_id: int, url: bytes, body: bytes) -> bytes:
    head = (
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: %s\r\n"
        b"WARC-Block-Digest: sha256:%s\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n"
    )
    return head % (page_id, url, hashlib.sha256(body).hexdigest().encode(), len(body)) + body + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, header) of each record; one that is cut short ends where the next begins."""
    at = data.find(_START)
    while 0 <= at < len(data):
        body = data.find(b"\r\n\r\n", at)
        after = data.find(_START, at + 1, body) if body >= 0 else data.find(_START, at + 1)
        if body < 0 or after >= 0:  # cut within its header
            end = after if after >= 0 else len(data)
            header = data[at:end]
        else:
            header = data[at:body]
            n = _LENGTH.search(header)
            end = body + 8 + int(n[1]) if n else len(data) + 1
            if end > len(data) or data[end - 4 : end] != b"\r\n\r\n" or (end < len(data) and data[end : end + len(_START)] != _START):
                after = data.find(_START, at + 1)
                end = after if after >= 0 else len(data)
        yield at, end - at, header
        at = data.find(_START, end)


Damage = Callable[[int, bytes], bytes | None]


def archive(pages: DataFrame, damage: Damage | None = None) -> DataFrame:
    """The stored segments. ``damage`` changes a record's bytes, or drops it, as a bad disk would; for drills and tests."""

    def kernel(batches):
        segment, part, held, size = None, 0, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["segment", "part", "data"])

        for batch in batches:
            for seg, page, url, html in zip(batch.column("segment").to_pylist(), batch.column("page_id").to_pylist(), base.byte_rows(batch, "url"), base.byte_rows(batch, "html"), strict=True):
                if held and (seg != segment or size >= PART_BYTES):
                    yield out()
                    part, held, size = (part + 1 if seg == segment else 0), [], 0
                elif seg != segment:
                    part = 0
                segment = seg
                data = record(page, url or b"", html or b"")
                data = damage(page, data) if damage else data
                if data:
                    held.append(data)
                    size += len(data)
        if held:
            yield out()

    rows = base.columns_only(pages, {"page_id": "long", "url": "string", "html": "string"})
    spread = F.lit(-1 << 62) - F.pmod(F.xxhash64("url", "html"), F.lit(NO_ID_SEGMENTS))
    rows = rows.withColumn("segment", F.coalesce(F.shiftright("page_id", SEGMENT_BITS), spread)).withColumn("page_id", F.coalesce("page_id", F.lit(NO_ID)))
    ordered = rows.repartition("segment").sortWithinPartitions("segment", "page_id", "url", "html")
    return base.written(base.mapped(ordered, kernel, "segment long, part int, data binary"), "warc")


def replica(stored: DataFrame, damage: Damage | None = None) -> DataFrame:
    """A copy of the stored segments, with damage done to single records."""

    def kernel(batches):
        for batch in batches:
            parts = []
            for data in batch.column("data").to_pylist():
                kept, at = [], 0
                for start, n, header in records(data):
                    key = _ID.search(header)
                    kept.append(data[at:start])
                    kept.append((damage(int(key[1]), data[start : start + n]) if damage and key else data[start : start + n]) or b"")
                    at = start + n
                parts.append(b"".join([*kept, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("part"), pa.array(parts, pa.binary())], ["segment", "part", "data"])

    return base.written(base.mapped(stored, kernel, "segment long, part int, data binary"), "warc")


def _leaf_kernel(batches):
    names = ["segment", "part", "key", "page_id", "offset", "length", "digest"]
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            data = x["data"]
            found = list(records(data))
            before = found[0][0] if found else len(data)
            for at, n, header in [(0, before, b"")] * (before > 0) + found:
                name, sha = _ID.search(header), hashlib.sha256(data[at : at + n])
                page = int(name[1]) if name else None
                key = page if page not in (None, NO_ID) else ~(int.from_bytes(sha.digest()[:8], "big") % NO_ID_KEYS)
                rows.append((x["segment"], x["part"], key, page, at, n, sha.hexdigest()))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def leaves(stored: DataFrame) -> DataFrame:
    """(segment, part, key, page_id, offset, length, digest) of every record of a replica; the key is its place in the tree."""
    return base.written(base.mapped(stored, _leaf_kernel, "segment long, part int, key long, page_id long, offset long, length long, digest string"), "leaves")


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (node, hash) from keys up, a table each; a node of one level has at most 16 children in the level below."""
    # a multiset of digests as four sums of 60 bits each and the count: partial sums, however many records have a key
    sums = [F.sum(F.conv(F.substring("digest", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    out = [base.written(leaf.groupBy(F.col("key").alias("node")).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256).alias("hash")), "nodes")]
    for _ in range(levels):
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))  # 16 at most
        up = out[-1].groupBy(F.shiftright("node", FAN_BITS).alias("up")).agg(F.sha2(F.concat_ws(",", F.transform(children, lambda c: F.concat_ws(":", c["node"], c["hash"]))), 256).alias("hash"))
        out.append(base.written(up.select(F.col("up").alias("node"), "hash"), "nodes"))
    return out


def height(*replicas: DataFrame) -> int:
    """Levels above keys until only the nodes 0 and -1 can be left."""
    far = [x for r in replicas for x in r.agg(F.max("key"), F.min("key")).first() if x is not None]
    return max(1, max((-(-(max(x, ~x)).bit_length() // FAN_BITS) for x in far), default=1))


def audit(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Records of the replica ``mine`` (its leaves) that ``other`` lacks or has otherwise, and ``other``'s that ``mine`` lacks.

    Gives page_id, status (corrupt, missing, extra), segment, part, offset, length, digest (of ``mine`` unless extra).
    """
    spark = mine.sparkSession
    levels = height(mine, other)
    a, b = tree(mine, levels), tree(other, levels)
    bad = None
    for level in range(levels, -1, -1):
        x, y = (t[level] if bad is None else t[level].withColumn("up", F.shiftright("node", FAN_BITS)).join(bad.withColumnRenamed("node", "up"), "up", "left_semi").drop("up") for t in (a, b))
        above, bad = bad, base.written(x.join(y.withColumnRenamed("hash", "theirs"), "node", "full").where("not (hash <=> theirs)").select("node"), "mismatches")
        for table in [a[level], b[level]] + [above] * (above is not None):
            base.dropped(spark, table)
    found, keys = bad.withColumnRenamed("node", "key"), ["key", "digest"]
    p, q = (base.written(r.join(found, "key", "left_semi"), "differing") for r in (mine, other))
    there = q.select("page_id").distinct().withColumn("there", F.lit(True))
    lost = p.join(q.select(keys).distinct(), keys, "left_anti").join(there, "page_id", "left").withColumn("status", F.when(F.col("there"), "corrupt").otherwise("missing"))
    fewer = p.groupBy(keys).agg(F.count("*").alias("n")).join(q.groupBy(keys).agg(F.count("*").alias("m")), keys).where("n > m").select(*keys)
    lost = lost.drop("there").unionByName(p.join(fewer, keys, "left_semi").withColumn("status", F.lit("missing")))
    extra = q.join(p.select("page_id").distinct(), "page_id", "left_anti").withColumn("status", F.lit("extra"))
    more = q.groupBy(keys).agg(F.count("*").alias("m")).join(p.groupBy(keys).agg(F.count("*").alias("n")), keys).where("m > n").select(*keys)
    extra = extra.unionByName(q.join(more, keys, "left_semi").withColumn("status", F.lit("extra")))
    return lost.unionByName(extra).select("page_id", "status", "segment", "part", "offset", "length", "digest")


def drill(page_id: int, data: bytes) -> bytes | None:
    """The damage of the audit drill: of about every 97 records one with a bit flipped, of 101 one cut short, of 103 one lost."""
    if page_id % 97 == 13:
        return data[:-5] + bytes([data[-5] ^ 1]) + data[-4:]
    if page_id % 101 == 29:
        return data[: len(data) - 40]
    return None if page_id % 103 == 41 else data

"""A content-addressed store of token ids.

A rolling hash over ``REACH`` ids cuts each document's id stream into chunks, where the hash has its low bits clear, between a least
and a greatest length; so a changed word changes one chunk or two, and copies share all. A chunk's address is the
128-bit BLAKE2b of its bytes. The store is a folder of three Parquet tables:

- ``chunks`` (digest, data): each distinct chunk once; ids as little-endian integers of ``width`` bytes;
- ``recipes`` (part, doc, doc_id, n_tokens, root, digests, sizes): in ascending doc_id order, a range of ids per part, each
  document's chunks in order and the root of the Merkle tree over them;
- ``manifest`` (part, first_id, last_id, docs, tokens, root): a Merkle tree over the roots of each part.

Reading recomputes all of it: each chunk's digest, each document's tree, each part's tree; anything missing or
changed stops the read. Checksums of documents are combined from those of chunks, so reading moves no data.

Null text: empty, its end id alone. Repeated rows and ids: one recipe each, ordered by id, then by root. Null ids come first.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base
from .encode import encoder

END, REACH, LEAST, AVERAGE, MOST = 1, 8, 64, 256, 2048
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree; an odd node moves up as it is. Leaves and nodes are hashed apart."""
    if not leaves:
        return digest(b"")
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        up = [digest(b"\1" + a + b) for a, b in zip(level[0::2], level[1::2], strict=False)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


def marks(ids: np.ndarray, average: int = AVERAGE, reach: int = REACH) -> np.ndarray:
    """Places where the rolling hash of the ``reach`` ids before has its low bits clear; ``average`` is a power of two."""
    if len(ids) <= reach:
        return np.zeros(0, np.int64)
    if reach & (reach - 1):
        raise ValueError("the reach of the rolling hash is a power of two")
    rolled, width = base.mix(ids.astype(_U) + _U(1)), 1
    while width < reach:  # of two neighbours one
        rolled = rolled[:-width] * _ODD + rolled[width:]
        rolled ^= rolled >> _U(29)
        width *= 2
    return np.flatnonzero((base.mix(rolled[:-1]) & _U(average - 1)) == 0) + reach


def cuts(places: list[int], start: int, end: int, least: int = LEAST, most: int = MOST, reach: int = REACH) -> list[int]:
    """Where chunks of the stream from ``start`` to ``end`` end, given the marks in it, ascending."""
    ends, at = [], start
    for place in [*(p for p in places if p >= start + reach), end]:
        while place - at > most:
            at += most
            ends.append(at)
        if at < place and (place - at >= least or place == end):
            at = place
            ends.append(at)
    return ends


def _chunk_kernel(path: str, end: int, width: int):
    names = ["doc", "doc_id", "n_tokens", "root", "digests", "sizes", "fresh"]

    def lists(counts: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)

    def kernel(batches):
        enc, tail = encoder(path), int(end).to_bytes(4, "little")
        doc, sent = pyspark.TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            rows, ids = base.byte_rows(batch, "text"), batch.column("doc_id")
            for a, b in base.chunks(rows):
                streams = [s + tail for s in enc.many(rows[a:b])]
                whole = np.frombuffer(b"".join(streams), "<u4")
                if int(whole.max()) >> 8 * width:
                    raise ValueError(f"ids need more than {width} bytes")
                places, data = marks(whole), whole.astype(f"<u{width}").tobytes()
                tokens = np.array([len(s) // 4 for s in streams])
                ends = np.cumsum(tokens)
                inner = np.split(places, np.searchsorted(places, ends[:-1]))
                roots, digests, sizes, counts, fresh, news = [], [], [], [], [], []
                for start, stop, own in zip((ends - tokens).tolist(), ends.tolist(), inner, strict=True):
                    at, mine, new = start, [], len(fresh)
                    for z in cuts(own.tolist(), start, stop):
                        piece = data[width * at : width * z]
                        d = digest(piece)
                        mine.append(d)
                        sizes.append(z - at)
                        at = z
                        if d not in sent:  # what a task has sent it needn't send again; forgetting costs only space
                            if len(sent) >= 1 << 18:
                                sent.clear()
                            sent.add(d)
                            fresh.append((d, piece))
                    roots.append(merkle(mine))
                    digests += mine
                    counts.append(len(mine))
                    news.append(len(fresh) - new)
                f = pa.StructArray.from_arrays([pa.array([d for d, _ in fresh], pa.binary()), pa.array([x for _, x in fresh], pa.binary())], ["digest", "data"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(doc, doc + b - a)), ids[a:b], pa.array(tokens, pa.int64()), pa.array(roots, pa.binary()), lists(counts, pa.array(digests, pa.binary())), lists(counts, pa.array(sizes, pa.int32())), lists(news, f)],
                    names,
                )
                doc += b - a

    return kernel


_ROW = "doc long, doc_id long, n_tokens long, root binary, digests array<binary>, sizes array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, width: int = 2) -> None:
    """Encodes every document and writes the store into the folder ``path``."""
    spark = docs.sparkSession
    rows = base.columns_only(docs, {"doc_id": "long", "text": "string"})
    staged = base.written(base.mapped(rows, _chunk_kernel(tokenizer, end, width), f"{_ROW}, fresh array<struct<digest:binary,data:binary>>"), "streams")
    recipes = staged.drop("fresh").repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root", "doc")
    recipes.withColumn("part", F.spark_partition_id()).write.options(**base.PLAIN).option("compression", "zstd").parquet(f"{path}/recipes")
    # tasks have dealt with their own repeats, so chunks go straight to their place and are sorted there once
    fresh = staged.select(F.explode_outer("fresh").alias("x")).where("x is not null").select("x.*").repartition("digest")
    fresh.groupBy("digest").agg(F.first("data").alias("data")).write.options(**base.PLAIN).option("compression", "zstd").parquet(f"{path}/chunks")
    base.dropped(spark, staged)
    _parts(_recipes(spark, path)).write.options(**base.PLAIN).parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_ROW}, part int").parquet(f"{path}/recipes")


def _part_kernel(batches):
    """Sorted rows of parts in, a row per part out; only roots are held."""
    part, roots, first, last, docs, tokens = None, [], None, None, 0, 0

    def row():
        return pa.RecordBatch.from_pylist([{"part": part, "first_id": first, "last_id": last, "docs": docs, "tokens": tokens, "root": merkle(roots)}], pa.schema([("part", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("root", pa.binary())]))

    for batch in batches:
        for x in batch.to_pylist():
            if x["part"] != part:
                if part is not None:
                    yield row()
                part, roots, first, docs, tokens = x["part"], [], x["doc_id"], 0, 0
            roots.append(x["root"])
            last, docs, tokens = x["doc_id"], docs + 1, tokens + x["n_tokens"]
    if part is not None:
        yield row()


def _parts(recipes: DataFrame) -> DataFrame:
    """The manifest, from recipes; a part is a bounded range of documents."""
    rows = recipes.select("part", "doc_id", "n_tokens", "root", "doc").repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "root", "doc")
    return base.mapped(rows, _part_kernel, "part int, first_id long, last_id long, docs long, tokens long, root binary")


def _shift_tables() -> np.ndarray:
    """[power][byte][value]: what 2**power zero bytes make of each byte of a CRC-32 state."""
    def apply(op, v):
        out = np.zeros_like(v)
        for k in range(32):
            out ^= np.where(v >> k & 1, op[k], 0)
        return out

    bit = np.array([0xEDB88320, *(1 << k for k in range(31))], np.int64)  # one zero bit
    for _ in range(3):
        bit = apply(bit, bit)
    ops, tables = bit, []
    for _ in range(40):
        tables.append([apply(ops, np.arange(256, dtype=np.int64) << 8 * k) for k in range(4)])
        ops = apply(ops, ops)
    return np.array(tables)


_TABLES: list[np.ndarray] = []


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 contributes to that of a text with so many bytes behind; a text's is the XOR of its pieces'."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    crc = crc.astype(np.int64)
    for power in range(int(n_bytes.max(initial=0)).bit_length()):
        some = (n_bytes >> power & 1).astype(bool)
        c, t = crc[some], _TABLES[0][power]
        crc[some] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return crc


def _check_kernel(width: int):
    """Chunks in, (digest, checksum as 32-bit ids, length) out."""

    def kernel(batches):
        for batch in batches:
            data, named = batch.column("data").to_pylist(), batch.column("digest").to_pylist()
            for d, x in zip(named, data, strict=True):
                if digest(x) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crc, pa.int64()), pa.array([len(x) // width for x in data], pa.int32())], ["digest", "crc", "n"])

    return kernel


def _use_kernel(batches):
    """Recipes in, a row per use of a chunk out, with the number of ids behind it; the trees are checked."""
    for batch in batches:
        doc, digests, behind, sizes = [], [], [], []
        for x in batch.to_pylist():
            if merkle(x["digests"]) != x["root"] or sum(x["sizes"]) != x["n_tokens"]:
                raise ValueError(f"the recipe of document {x['doc_id']} is damaged")
            doc += [x["doc"]] * len(x["digests"])
            digests += x["digests"]
            sizes += x["sizes"]
            behind += (x["n_tokens"] - np.cumsum(x["sizes"])).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(behind, pa.int64())], ["doc", "digest", "size", "behind"])


def _combine_kernel(batches):
    for batch in batches:
        crc, behind = (batch.column(c).to_numpy() for c in ("crc", "behind"))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(crc_shifted(crc, 4 * behind))], ["doc", "part_crc"])


def read(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files, after checking them."""
    recipes = _recipes(spark, path)
    known = spark.read.schema("part int, first_id long, last_id long, docs long, tokens long, root binary").parquet(f"{path}/manifest")
    # one row per part, and parts follow the number of partitions, not of documents
    said, found = ({r.part: tuple(r) for r in t.collect()} for t in (known, _parts(recipes)))
    if said != found:
        raise ValueError("recipes and manifest differ")
    starts, total = [], 0
    for part in sorted(said):
        starts.append((part, total))
        total += said[part][4]
    facts = base.mapped(spark.read.schema("digest binary, data binary").parquet(f"{path}/chunks"), _check_kernel(width), "digest binary, crc long, n int")
    uses = base.mapped(recipes.select("doc", "doc_id", "n_tokens", "root", "digests", "sizes"), _use_kernel, "doc long, digest binary, size int, behind long")
    met = uses.join(facts, "digest", "left").withColumn("crc", F.when(F.col("n") == F.col("size"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing"))))
    crc = base.mapped(met.select("doc", "crc", "behind"), _combine_kernel, "doc long, part_crc long").groupBy("doc").agg(F.bit_xor("part_crc").alias("ids_crc32"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root", "doc").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("part", "doc", "doc_id", "root", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    offsets = spark.createDataFrame(starts, "part int, offset long")
    return placed.join(F.broadcast(offsets), "part").join(crc, "doc").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def restore(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, ids): the id streams themselves, put together from chunks."""

    def kernel(batches):
        for batch in batches:
            streams = []
            for parts in batch.column("parts").to_pylist():
                data = b"".join(x["data"] for x in sorted(parts, key=lambda x: x["at"]))
                streams.append(np.frombuffer(data, f"<u{width}").tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(streams, pa.list_(pa.int32()))], ["doc_id", "ids"])

    recipes = _recipes(spark, path)
    uses = recipes.select("doc", "doc_id", F.posexplode("digests").alias("at", "digest"))
    chunks = spark.read.schema("digest binary, data binary").parquet(f"{path}/chunks")
    parts = uses.join(chunks, "digest").groupBy("doc", "doc_id").agg(F.collect_list(F.struct("at", "data")).alias("parts"))
    return base.mapped(parts.select("doc_id", "parts"), kernel, "doc_id long, ids array<int>")


def digests(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes a store into the shared folder and reads it back."""
    path = base.scratch(docs.sparkSession, "store")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)

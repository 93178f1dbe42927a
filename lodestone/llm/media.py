"""Media columns: ISO base media files, described from their boxes and sample tables without decoding payloads.

``describe`` walks nested boxes (32- and 64-bit sizes, boxes up to the end, user types, nested ``DEPTH`` deep at most), reads the
sample tables of each track and the runs of its fragments, and gives codec, duration and the byte ranges of its keyframes. What a
header counts is held against the bytes that are there before anything of that size is made. ``store`` puts texts into such files, as the 8-bit samples
of one raw audio track whose access units hold 192 samples, every 16th a sync unit, and writes them as a Parquet table
with a binary column.

Null text: empty, one unit of spaces. Files that are cut short or damaged don't stop a job: what is wrong is in ``error``, the
other fields are null. A null file gives nulls. Repeated rows, null ids and other columns pass as they are.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import base

UNIT, RATE, SYNC, UNITS_A_CHUNK = 192, 8000, 16, 32
DEPTH = 16
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = 8 + len(body)
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(text: bytes | None, unit: int = UNIT) -> bytes:
    text = text or b""
    return text + b" " * (max(1, -(-len(text) // unit)) * unit - len(text))


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE, sync: int = SYNC) -> bytes:
    """A file with one track of unsigned 8-bit samples; the payload is a multiple of ``unit`` long."""
    units, n = len(payload) // unit, len(payload)
    wide = n >= 1 << 31
    v, t = (1, ">QQIQ") if wide else (0, ">IIII")
    times = struct.pack(t, 0, 0, rate, n)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16 if rate < 65536 else 0))
    keys = np.arange(1, units + 1, sync, dtype=">u4")
    starts = np.arange(0, units, UNITS_A_CHUNK, dtype=np.int64) * unit
    runs = [(1, min(units, UNITS_A_CHUNK))] if units % UNITS_A_CHUNK == 0 or len(starts) == 1 else [(1, UNITS_A_CHUNK), (len(starts), units % UNITS_A_CHUNK)]

    def moov(shift: int) -> bytes:
        at = starts + shift
        place = full(b"co64", 0, 0, struct.pack(">I", len(at)), at.astype(">u8").tobytes()) if wide else full(b"stco", 0, 0, struct.pack(">I", len(at)), at.astype(">u4").tobytes())
        table = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, units, unit)),
            full(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", unit, units)),
            place,
        )
        links = box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1)))
        media = box(b"mdia", full(b"mdhd", v, 0, times, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"soun"), b"\0"), box(b"minf", full(b"smhd", 0, 0, bytes(4)), links, table))
        track = full(b"tkhd", v, 7, struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _IDENTITY, bytes(8))
        return box(b"moov", full(b"mvhd", v, 0, times, struct.pack(">IHH8x", 0x10000, 0x100, 0), _IDENTITY, bytes(24), struct.pack(">I", 2)), box(b"trak", track, media))

    data = box(b"mdat", payload)
    size = len(moov(0))
    return head + moov(len(head) + size + len(data) - n) + data


class Box(NamedTuple):
    kind: bytes
    start: int
    end: int
    path: tuple[bytes, ...]
    at: int = 0  # where its header starts


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[Box]:
    """Every box with the range of its body, parents before children; ValueError where sizes don't fit or boxes nest too deep."""
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        start, end, path = todo.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and end - start >= 16:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        found = Box(kind, start + head, start + size, path, start)
        yield found
        todo.append((found.end, end, path))
        if kind in NESTED:
            if len(path) >= DEPTH:
                raise ValueError(f"boxes at {start} nest too deep")
            todo.append((found.start, found.end, (*path, kind)))


def _array(data: bytes, at: int, n: int, kind: str, end: int) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise ValueError(f"a table at {at} is cut short")
    return np.frombuffer(data, kind, n, at)


class Track(NamedTuple):
    codec: str
    handler: str
    timescale: int
    duration: int
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray


def _samples(data: bytes, t: dict[bytes, Box]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each sample starts, its size, and the numbers (from 0) of those that are keyframes."""
    b = t[b"stsz"] if b"stsz" in t else t[b"stz2"]
    fixed, n = struct.unpack_from(">II", data, b.start + 4)
    if b.kind == b"stz2":
        width = fixed & 255
        if width not in (4, 8, 16):
            raise ValueError(f"sample sizes of {width} bits")
        if width == 4:
            pairs = _array(data, b.start + 12, (n + 1) // 2, ">u1", b.end)
            sizes = np.stack((pairs >> 4, pairs & 15), axis=1).reshape(-1)[:n].astype(np.int64)
        else:
            sizes = _array(data, b.start + 12, n, f">u{width // 8}", b.end).astype(np.int64)
    else:
        if fixed and n * fixed > len(data):
            raise ValueError(f"{n} samples of {fixed} bytes don't fit")
        sizes = np.full(n, fixed, np.int64) if fixed else _array(data, b.start + 12, n, ">u4", b.end).astype(np.int64)
    b = t[b"co64"] if b"co64" in t else t[b"stco"]
    (chunks,) = struct.unpack_from(">I", data, b.start + 4)
    places = _array(data, b.start + 8, chunks, ">u8" if b.kind == b"co64" else ">u4", b.end).astype(np.int64)
    b = t[b"stsc"]
    (runs,) = struct.unpack_from(">I", data, b.start + 4)
    runs = _array(data, b.start + 8, 3 * runs, ">u4", b.end).astype(np.int64).reshape(-1, 3)
    if n and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
        raise ValueError("chunk runs are out of order")
    counts = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], chunks + 1))) if n else np.zeros(0, np.int64)
    if counts.sum() != n or len(counts) != (chunks if n else 0):
        raise ValueError("chunks and samples don't add up")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    some = counts > 0
    starts = np.repeat(places[: len(counts)][some] - before[first[some]], counts[some]) + before if n else before
    _inside(data, starts, sizes)
    if b"stss" in t:
        b = t[b"stss"]
        (keys,) = struct.unpack_from(">I", data, b.start + 4)
        keys = _array(data, b.start + 8, keys, ">u4", b.end).astype(np.int64) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("keyframes beyond the samples")
    else:
        keys = np.arange(n)
    return starts, sizes, keys


def _inside(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
    if len(starts) and (int(starts.min()) < 0 or int(starts.max()) > len(data) or int((starts + sizes).max()) > len(data)):
        raise ValueError("samples lie beyond the file")


def _fields(data: bytes, b: Box, flags: int, wanted: tuple[tuple[int, str], ...], at: int) -> tuple[list[int | None], int]:
    """The optional fields of a box that its flags say are there, and where they end."""
    out: list[int | None] = []
    for bit, kind in wanted:
        if not flags & bit:
            out.append(None)
            continue
        size = struct.calcsize(kind)
        if at + size > b.end:
            raise ValueError(f"box {b.kind!r} is cut short")
        out.append(struct.unpack_from(kind, data, at)[0])
        at += size
    return out, at


class _Fragments:
    """Samples of movie fragments: where they start, their sizes, which are keyframes, and how long they last, by track id."""

    def __init__(self, data: bytes):
        self.data, self.defaults = data, {}
        self.found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}

    def trex(self, b: Box) -> None:
        track, _, *rest = struct.unpack_from(">5I", self.data, b.start + 4)
        self.defaults[track] = rest

    def moof(self, b: Box) -> None:
        self.base = self.next = b.at

    def tfhd(self, b: Box) -> None:
        flags, self.track = struct.unpack_from(">II", self.data, b.start)
        (base, _, *own), _ = _fields(self.data, b, flags, ((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")), b.start + 8)
        self.default = [y if x is None else x for x, y in zip(own, self.defaults.get(self.track, [0, 0, 0]), strict=True)]
        self.at = base if base is not None else self.base if flags & 0x20000 else self.next
        self.from_ = self.at
        self.found.setdefault(self.track, [])

    def trun(self, b: Box) -> None:
        flags, n = struct.unpack_from(">II", self.data, b.start)
        (shift, first), at = _fields(self.data, b, flags, ((1, ">i"), (4, ">I")), b.start + 8)
        bits = [k for k in (0x100, 0x200, 0x400, 0x800) if flags & k]
        if not bits and n * max(1, self.default[1]) > len(self.data):
            raise ValueError(f"{n} samples of a run don't fit")
        table = _array(self.data, at, n * len(bits), ">u4", b.end).astype(np.int64).reshape(n, len(bits))
        last, size, sync = (table[:, bits.index(k)] if k in bits else np.full(n, d, np.int64) for k, d in zip((0x100, 0x200, 0x400), self.default, strict=True))
        if first is not None and n:
            sync = np.append(first, sync[1:])
        begin = self.at if shift is None else self.from_ + shift
        starts = begin + np.cumsum(size) - size
        _inside(self.data, starts, size)
        self.at = self.next = begin + int(size.sum())
        self.found[self.track].append((starts, size, sync & 0x10000 == 0, int(last.sum())))


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file; ValueError if it is damaged or has no sample table."""
    try:
        groups: list[dict[bytes, Box]] = []
        more = _Fragments(data)
        for b in walk(data):
            if b.kind == b"trak":
                groups.append({})
            elif b.path[:2] == (b"moov", b"trak"):
                groups[-1].setdefault(b.kind, b)
            elif b.kind == b"moof":
                more.moof(b)
            elif (b.kind, b.path[-1:]) in ((b"trex", (b"mvex",)), (b"tfhd", (b"traf",)), (b"trun", (b"traf",))):
                getattr(more, b.kind.decode())(b)
        out = []
        for t in groups:
            at = t[b"mdhd"].start
            scale, duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
            codec = data[t[b"stsd"].start + 12 : t[b"stsd"].start + 16].decode("latin-1")
            handler = data[t[b"hdlr"].start + 8 : t[b"hdlr"].start + 12].decode("latin-1")
            starts, sizes, keys = _samples(data, t)
            at = t[b"tkhd"].start
            for begin, size, sync, last in more.found.pop(struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0], ()) if more.found else ():
                keys = np.append(keys, np.flatnonzero(sync) + len(starts))
                starts, sizes, duration = np.append(starts, begin), np.append(sizes, size), duration + last
            out.append(Track(codec, handler, scale, duration, starts, sizes, keys))
        if more.found:
            raise ValueError("fragments of a track that isn't there")
    except (KeyError, struct.error, IndexError, AttributeError, TypeError, OverflowError) as e:
        raise ValueError(f"a box is missing or cut short: {e}") from e
    if not out:
        raise ValueError("no track")
    return out


def payload(data: bytes, track: Track) -> bytes:
    """The samples' bytes, in order; neighbours are copied together."""
    if not len(track.starts):
        return b""
    ends = track.starts + track.sizes
    cut = np.flatnonzero(track.starts[1:] != ends[:-1]) + 1
    return b"".join(data[a:z] for a, z in zip(track.starts[np.append(0, cut)].tolist(), ends[np.append(cut - 1, len(ends) - 1)].tolist(), strict=True))


def keyframes(track: Track) -> list[tuple[int, int]]:
    return [(int(a), int(a + n)) for a, n in zip(track.starts[track.keys], track.sizes[track.keys], strict=True)]


_TRACK = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def describe(df: DataFrame, column: str = "media") -> DataFrame:
    """The other columns with ``tracks`` and ``error`` of each file in place of the file."""
    rest = [c for c in df.columns if c not in (column, "tracks", "error")]

    def kernel(batches):
        for batch in batches:
            found, errors = [], []
            for data in batch.column(column).to_pylist():
                try:
                    found.append(None if data is None else [{"codec": t.codec, "handler": t.handler, "duration_s": t.duration / t.timescale if t.timescale else None, "samples": len(t.sizes), "keyframes": [{"start": a, "end": z} for a, z in keyframes(t)]} for t in tracks(data)])
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
            yield batch.select(rest).append_column("tracks", pa.array(found, pa.list_(_TRACK))).append_column("error", pa.array(errors, pa.string()))

    found = StructType.fromDDL("tracks array<struct<codec:string,handler:string,duration_s:double,samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>, error string")
    return base.mapped(df.select(*rest, column), kernel, StructType(df.select(rest).schema.fields + found.fields))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a media file, written to the shared folder and read from there."""

    def kernel(batches):
        for batch in batches:
            rows, ids = base.byte_rows(batch, "text"), batch.column("doc_id")
            for a, b in base.chunks(rows, 4 * base.CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array([len(r or b"") for r in rows[a:b]], pa.int64()), pa.array([mux(padded(r)) for r in rows[a:b]], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = base.columns_only(docs, {"doc_id": "long", "text": "string"})
    return base.written(base.mapped(rows, kernel, "doc_id long, n_bytes long, media binary"), "media")


def _feature(t: Track) -> str:
    keys = keyframes(t)
    spans = hashlib.sha256(repr(keys).encode()).hexdigest()[:16]
    return f"{t.handler}/{t.codec.strip()} {t.duration / t.timescale:.6f}s {len(t.sizes)} samples {len(keys)} keyframes {keys[0][0]}-{keys[-1][1]} {spans}"


def _read_kernel(batches):
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            t = tracks(media)[0]
            body = payload(media, t)
            rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(media), hashlib.sha256(media).hexdigest(), _feature(t)))
        if rows:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names])


def digests(docs: DataFrame) -> DataFrame:
    """What the stored files hold, read back from them."""
    return base.mapped(store(docs), _read_kernel, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
